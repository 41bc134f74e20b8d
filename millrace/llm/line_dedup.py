"""Fuzzy line deduplication over a corpus.

Lines are normalised (lower case, words joined by one space) and compared
across all documents. Equal normalised lines belong together. Others are
candidates where they share a key and their 256-bit SimHashes are near;
candidates are verified by edit similarity of the whole normalised lines,
character by character, connected groups are formed, and one occurrence of each
group stays: the least (doc_id, line number).

Keys depend on the length of the longer line of a pair; a line that can be the
shorter one of a pair of the next class has the keys of both.

* under 10 characters: no edit is allowed, only equal lines match;
* 10 to 19: one edit leaves the first or the last half whole, so these are the keys;
* longer: the character grams with the least hashes, as many as find 0.9 of pairs
  with edits at random places at the least similarity. A gram grows with the
  logarithm of the corpus, so a line's chance partners don't grow with the corpus,
  and the number of grams a line grows with the length of the gram.

Blocks of a SimHash can't be the keys at this similarity: edits of a tenth of the
characters change 0.34 of the 4-character grams and some 19 of 64 bits, and 20
blocks of three bits select nothing.

What shares a key is a run. A gram that edits have left alone has as many
characters more or fewer before it in one line than in the other as there were
edits at least, and so behind it; so pairs in which that is more than the
similarity allows aren't candidates by this key, which are most of those that
share a gram by chance. The others of a run are candidates where they are few.
A run with many, such as versions of one template, gives no pairs at first: its lines are compared
with their neighbours in the order of their SimHashes, which connects what is
alike by a number of edges in proportion to the lines; then pairs of lines that
aren't connected yet are compared, all of them. So groups are those of all pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .edit import within
from .graph import connected_components
from .store import fits, fresh, keep, scratch

SIMILARITY = 0.9
#: Normalised lines of fewer bytes would match only equal ones; there is no such floor.
FUZZY_BYTES = 0
#: From which length on of the longer line a class of keys holds. The last has no end.
CLASSES = (10, 20, 30, 48, 96, 192)
#: Characters from which on candidates' 256-bit SimHashes must be near. Bits that may differ are 87
#: at this length and 8 less for each doubling, 24 at least: 0.985 of random edits at 0.9 stay below.
_SKETCHED = 48
#: Lines of a run all of whose pairs are candidates at once; larger runs' too where they have no more pairs a line.
SHORT_RUN = 8
#: Lines up to which a run's pairs are counted.
_COUNTED = 256
#: Of a key's place in a line: parts of the line, and the code of a gram that has several places.
_PLACES, _ANYWHERE = 254, 255
#: Lengths are coded by steps of this ratio, from 9 characters on.
_STEP = 1.025
#: Bits of a line's hash that runs have; lines are joined to them by these, so equal ones only add candidates.
_ID = (1 << 40) - 1
#: Lines of a long run that are in one task at a time.
BLOCK = 16_384
_LOW = np.uint64(0x0F0F0F0F0F0F0F0F)
_table: np.ndarray | None = None


def _signs() -> np.ndarray:
    """4096 random rows of 256 four-bit 0/1 lanes, lane k in the low half of byte k, or in the high half of byte k - 128; and a row of zeros."""
    global _table
    if _table is None:
        lanes = np.random.default_rng(20240229).integers(0, 2, size=(4096, 256), dtype=np.uint8)
        _table = np.concatenate([lanes[:, :128] | lanes[:, 128:] << 4, np.zeros((1, 128), np.uint8)]).view(np.uint64)
    return _table


def gram_size(lines: int) -> int:
    """Characters of a long line's grams in a corpus of so many lines."""
    return min(20, max(8, math.ceil(0.7 * math.log2(max(lines, 2)))))


def class_grams(kind: int, size: int) -> tuple[int, int]:
    """Characters of a gram of a class, and grams a line (0: all)."""
    k = min(size, (0, 8, 10, 13, 16, size)[kind])
    return k, 0 if kind < 3 else 32 if kind == 3 else max(16, math.ceil(k * k / (8 if kind == 4 else 11)))


def gather(chars: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of some lines one after another, where each begins, and each character's line."""
    n = np.diff(first)[rows]
    begin = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), n)
    return chars[np.arange(len(row)) + np.repeat(first[:-1][rows] - begin[:-1], n)], begin, row


def grams(chars: np.ndarray, begin: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """40-bit hashes of all k-character grams of gathered lines, with 8 bits more for the code of a place; the lines' places, and where the grams begin."""
    if len(chars) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + K.U64(1)) * K.powers(K._P, len(chars))[: len(chars)], out=total[1:])
    h = total[k:] - total[:-k]
    h *= K.powers(K._PINV, len(chars))[: len(h)]
    inside = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    h = K.mix(h[inside])
    h >>= K.U64(24)
    h <<= K.U64(8)
    return h, row[inside], inside


def least_grams(h: np.ndarray, row: np.ndarray, inside: np.ndarray, begin: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` least distinct hashes of each line's grams (0: all), their lines and places."""
    rows, length = len(begin) - 1, np.diff(begin).astype(np.float64)

    def least(at):
        # as integers would give them: a product below 2^52 is exact, and a quotient never rounds up to the next whole number
        row_, out = row[at], []
        h_ = h[at] | ((inside[at] - begin[row_]) * float(_PLACES) / length[row_]).astype(np.uint64)
        # 16 bits for the row
        for lo in range(0, rows, 1 << 16):
            some = (row_ >= lo) & (row_ < lo + (1 << 16)) if rows > 1 << 16 else slice(None)
            code = np.sort(((row_[some] - lo).astype(np.uint64) << K.U64(48)) | h_[some])
            new = np.ones(len(code) + 1, bool)
            new[1:-1] = code[1:] >> K.U64(8) != code[:-1] >> K.U64(8)
            place = np.where(new[1:], code & K.U64(255), K.U64(_ANYWHERE)).astype(np.uint8)[new[:-1]]
            code = code[new[:-1]]
            own = (code >> K.U64(48)).astype(np.int64) + lo
            if most:
                rank = np.arange(len(code)) - np.searchsorted(own, np.arange(lo, min(rows, lo + (1 << 16))))[own - lo]
                code, own, place = code[rank < most], own[rank < most], place[rank < most]
            out.append((code >> K.U64(8) & K.U64((1 << 40) - 1), own, place))
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))

    if not most or not len(h):
        return least(slice(None))
    n = np.bincount(row, minlength=rows)
    # most hashes can't be among the least; where too few are left, as grams repeat, all are taken
    part = np.where(n > 3 * most, 3.0 * most / np.maximum(n, 1), 1.0)
    cut = (part * (1 << 40)).astype(np.uint64) << K.U64(8)
    found = least(np.flatnonzero(h < cut[row]))
    again = (np.bincount(found[1], minlength=rows) < most) & (part < 1)
    if again.any():
        more = least(np.flatnonzero(again[row]))
        found = tuple(np.concatenate([x[~again[found[1]]], y]) for x, y in zip(found, more))
    return found


def simhash(chars: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(lines, 4) words: each line's 256-bit SimHash of its 4-character grams; 0 where it has none."""
    rows = len(begin) - 1
    n = np.maximum(np.diff(begin) - 3, 0)
    out = np.zeros((rows, 4), np.uint64)
    if not n.any():
        return out
    c = chars.astype(np.uint32)
    h = c[:-3] * np.uint32(0x9E3779B1) + c[1:-2] * np.uint32(0x85EBCA77) + c[2:-1] * np.uint32(0xC2B2AE3D) + c[3:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    feature = (h >> np.uint32(20)).astype(np.int32)
    signs = _signs()
    # a lane holds at most 15, so a line is summed in runs of 15 grams, a gram of each run at a time; row 4096 is zero
    runs = -(-n // 15)
    ends = np.cumsum(runs)
    # by whole lines, some 512 runs at a time, as their sums then stay in the cache
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), 512)), rows))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = runs[lo:hi]
        of = np.repeat(np.arange(lo, hi), some)
        if not len(of):
            continue
        nth = np.arange(len(of)) - np.repeat(np.cumsum(some) - some, some)
        at = begin[of] + nth * 15 + np.arange(15)[:, None]
        own = feature.take(at, mode="clip")
        own[at >= (begin[:-1] + n)[of]] = 4096
        lanes = signs.take(own[0], axis=0)
        for step in range(1, 15):
            lanes += signs.take(own[step], axis=0)
        # in a byte a lane holds 17 runs
        first = np.flatnonzero(nth % 17 == 0)
        total = np.add.reduceat(np.concatenate([lanes & _LOW, lanes >> np.uint64(4) & _LOW], axis=1), first, axis=0).view(np.uint8).astype(np.int32)
        here = of[first]
        if nth.max() >= 17:
            new = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            total, here = np.add.reduceat(total, new, axis=0), here[new]
        out[here] = np.packbits(2 * total > n[here][:, None], axis=1).view(np.uint64)
    return out


def line_keys(chars: np.ndarray, first: np.ndarray, size: int):
    """(line, key) arrays of every key of every line."""
    for line, key, _ in placed_keys(chars, first, size):
        yield line, key


def placed_keys(chars: np.ndarray, first: np.ndarray, size: int):
    """(line, key, place) arrays of every key of every line."""
    length = np.diff(first)
    low, high = (np.searchsorted(CLASSES, x, side="right") - 1 for x in (length, length * 10 // 9))
    for kind in range(len(CLASSES)):
        rows = np.flatnonzero((low == kind) | (high == kind))
        if not len(rows):
            continue
        own, begin, row = gather(chars, first, rows)
        if kind:
            k, most = class_grams(kind, size)
            key, at, place = least_grams(*grams(own, begin, row, k), begin, most)
        else:
            key, at = halves(own, begin)
            place = np.full(len(at), _ANYWHERE, np.uint8)
        yield rows[at], K.mix(key ^ (K.U64(kind + 1) << K.U64(56))), place


def halves(chars: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last halves as keys, for the line as the shorter one of a pair and as the longer by one."""
    keys, at = [], []
    length = np.diff(begin)
    for less in (0, 1):
        for m in np.unique(length - less):
            some = np.flatnonzero(length - less == m)
            half = int(m) // 2
            for side, start in enumerate((begin[:-1][some], begin[1:][some] - half)):
                x = chars[start[:, None] + np.arange(half)].astype(np.uint64) + K.U64(1)
                keys.append(K.mix((x * K.powers(K._P, half)[:half]).sum(axis=1, dtype=np.uint64) + K.U64(2 * int(m) + side)))
                at.append(some)
    return np.concatenate(keys), np.concatenate(at)


def _scan(fuzzy_bytes: int):
    """Every line with a word; its text where this task hasn't just given it."""

    def run(it):
        given = np.zeros(1 << 18, np.uint64)
        for batch, data, offsets in K.batches(it):
            lines, first = K.line_offsets(data, offsets)
            words = K.Words(data, lines)
            h = words.sequence_hash()
            used = np.flatnonzero(h)
            doc = np.searchsorted(first, used, side="right") - 1
            text, begin = normalised(data, words)
            # a line of fewer than nine bytes isn't like any but its equals
            slot = (h[used] & K.U64(len(given) - 1)).astype(np.int64)
            new = (np.diff(begin)[used] >= max(9, fuzzy_bytes)) & (given[slot] != h[used])
            _, once = np.unique(h[used], return_index=True)
            first_here = np.zeros(len(used), bool)
            first_here[once] = True
            new &= first_here
            given[slot[new]] = h[used][new]
            norm = pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(text)])
            norm = norm.take(pa.array(np.where(new, used, 0), mask=~new)).cast(pa.string())
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_pydict({"dk": K.ints(batch, "dk")[doc], "doc_id": ids.take(pa.array(doc)), "line": (used - first[doc]).astype(np.int32), "h": h[used].view(np.int64), "norm": norm})

    return run

def normalised(data: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all units' words joined by one space, and where each unit begins."""
    n = np.diff(words.first)
    joined = np.ones(len(words.size), bool)
    joined[words.first[1:][n > 0] - 1] = False
    size = words.size + joined
    ends = np.cumsum(size)
    at = np.repeat(words.start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    at = np.minimum(at, len(data) - 1)
    out = data[at]
    out[ends[joined] - 1] = 32
    return out, np.concatenate([[0], ends])[words.first]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of UTF-8 texts, and where each text begins."""
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[offsets]


def length_code(n: np.ndarray) -> np.ndarray:
    """A byte that grows by one for each step of length; 255 has no end."""
    return np.minimum(255, np.floor(np.log(np.maximum(n / 9, 1)) / math.log(_STEP))).astype(np.uint8)


def code_gap(similarity: float) -> int:
    """By how much the codes of like lines may differ."""
    return math.ceil(-math.log(similarity) / math.log(_STEP)) if 0 < similarity else 255


def placed(code_a, place_a, code_b, place_b, similarity: float) -> np.ndarray:
    """Which pairs may be alike by the places of a key they share, as far as codes tell; b are the longer ones."""
    # in parts of the longer line: what is before the key and what is behind it
    ratio = _STEP ** (code_a.astype(np.int16) - code_b)
    x, y = place_a / _PLACES, place_b / _PLACES
    apart = np.abs(x * ratio - y) + np.abs((1 - x) * ratio - (1 - y))
    return (apart <= 1 - similarity + (_STEP - 1) + 2 / _PLACES + 1e-6) | (np.maximum(place_a, place_b) == _ANYWHERE) | (np.maximum(code_a, code_b) == 255)


def _to_keys(size: int, parts: int):
    def flush(h, key, code, place):
        # by key within a part, byte by byte, as high bytes then pack well
        part, short = (key % K.U64(parts)).astype(np.int32), key >> K.U64(40)
        order = np.argsort((part.astype(np.uint64) << K.U64(24)) | short)
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        short = short[order].view(np.uint8).reshape(-1, 8)[:, :3]
        h = np.ascontiguousarray(h[order].view(np.uint8).reshape(-1, 8)[:, :5])
        code, place = code[order], place[order]
        for p in range(0, parts, 256):
            some = [q for q in range(p, min(parts, p + 256)) if ends[q] < ends[q + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32())} | {name: pa.array([x[ends[q] : ends[q + 1]].tobytes() for q in some], pa.binary()) for name, x in (("hs", h), ("codes", code), ("places", place))} | {"key": pa.array([short[ends[q] : ends[q + 1]].T.tobytes() for q in some], pa.binary())})

    def run(it):
        held, n = [], 0
        for batch, data, offsets in K.batches(it, "norm", lower=False):
            h = K.ints(batch, "h")
            chars, first = code_points(data, offsets)
            code = length_code(np.diff(first))
            for line, key, place in placed_keys(chars, first, size):
                held.append((h[line], key, code[line], place))
                n += len(line)
            if n >= 2_000_000:
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def run_pairs(number: np.ndarray, size: np.ndarray, code: np.ndarray, place: np.ndarray, similarity: float, short_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places i, j) of short runs, and which runs are short; a run's lines ascend by length."""
    gap = code_gap(similarity)
    counted = size <= max(short_run, _COUNTED)
    end = np.repeat(np.cumsum(size), size)
    left, step = np.flatnonzero(np.repeat(counted & (size > 1), size)), 1
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left):
        left = left[left + step < end[left]]
        left = left[code[left + step] - code[left] <= gap]
        ok = left[placed(code[left], place[left], code[left + step], place[left + step], similarity)]
        a.append(ok)
        b.append(ok + step)
        step += 1
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.bincount(number[a], minlength=len(size))
    short = counted & ((size <= short_run) | (2 * pairs <= size * (short_run - 1)))
    some = short[number[a]]
    return a[some], b[some], short


def _runs(similarity: float, short_run: int, block: int):
    """Pairs (a, b) of short runs; lines (a) of long runs with the run, the block of the run that has them and the key's place.

    A run is what shares a key without a step in length that is too large for a pair.
    """

    def run(table: pa.Table) -> pa.Table:
        hs, code, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("hs", "codes", "places"))
        key, h = np.zeros((len(code), 4), np.uint8), np.zeros((len(code), 8), np.uint8)
        key[:, :3] = np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1).T for x in table.column("key").to_pylist()])
        h[:, :5] = hs.reshape(-1, 5)
        key, h = key.view(np.uint32).ravel(), h.view(np.int64).ravel()
        order = np.argsort((key.astype(np.uint64) << K.U64(40)) | (code.astype(np.uint64) << K.U64(32)) | (h & 0xFFFFFFFF).astype(np.uint64), kind="stable")
        key, h, code, place = key[order], h[order], code[order].astype(np.int16), place[order]
        new = np.ones(len(h), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, h, code, place = key[new], h[new], code[new], place[new]
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (code[1:] - code[:-1] > code_gap(similarity))))
        size = np.diff(np.append(begin, len(key)))
        number = np.repeat(np.arange(len(size)), size)
        i, j, short = run_pairs(number, size, code, place, similarity, short_run)
        a, b = np.minimum(h[i], h[j]), np.maximum(h[i], h[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        long = np.repeat(~short, size)
        part = table.column("part")[0].as_py()
        number = (np.int64(part) << 32) | np.repeat(begin, size)[long]
        inner = (np.arange(len(key)) - np.repeat(begin, size))[long] // block
        blocks = np.repeat(-(-size // block), size)[long]
        pad = pa.nulls(len(a), pa.int64())
        few = pad.cast(pa.int32())
        return pa.table({
            "a": np.concatenate([a, h[long]]), "b": pa.chunked_array([pa.array(b), pa.nulls(len(number), pa.int64())]),
            "run": pa.chunked_array([pad, pa.array(number)]), "block": pa.chunked_array([few, pa.array(inner.astype(np.int32))]), "blocks": pa.chunked_array([few, pa.array(blocks.astype(np.int32))]), "place": pa.chunked_array([few, pa.array(place[long].astype(np.int32))]),
        })

    return run


def _sketches(it):
    for batch, data, offsets in K.batches(it, "norm", lower=False):
        chars, begin = code_points(data, offsets)
        n = np.diff(begin)
        four = simhash(chars, begin).view(np.int64)
        yield pa.RecordBatch.from_pydict({"id": pa.array(K.ints(batch, "h") & _ID), "h": batch.column(0), "n": n.astype(np.int32)} | {w: np.ascontiguousarray(four[:, k]) for k, w in enumerate(_WORDS)})


_WORDS = ("s0", "s1", "s2", "s3")


def most_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the SimHash in which candidates whose longer line has n characters may differ."""
    return np.where(n < _SKETCHED, 256, np.maximum(24, np.floor(87 - 8 * np.log2(np.maximum(n, 1) / _SKETCHED)))).astype(np.int32)


class Lines:
    """Lengths and SimHashes of some lines, and places of a key they share, to ask which pairs of places are candidates."""

    def __init__(self, n: np.ndarray, words: list[np.ndarray], similarity: float, place: np.ndarray | None = None):
        self.n = n.astype(np.int32)
        self.place = place
        self.words = [x.view(np.uint64) for x in words]
        # both fall or grow with the length, so the longer line's are the pair's
        self.edits = np.floor(n * (1 - similarity) + 1e-9).astype(np.int32)
        self.bits = most_bits(n)

    def differing(self, a, b) -> np.ndarray:
        return sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in self.words)

    def near(self, a, b) -> np.ndarray:
        """Which of the pairs (places in a, places in b) are candidates; their positions."""
        at = np.flatnonzero(np.abs(self.n[a] - self.n[b]) <= np.maximum(self.edits[a], self.edits[b]))
        if self.place is not None:
            at = at[self.placed(a[at], b[at])]
        a, b = a[at], b[at]
        return at[self.differing(a, b) <= np.minimum(self.bits[a], self.bits[b])]

    def placed(self, a, b) -> np.ndarray:
        """Which pairs may be alike by the key's places."""
        x, y = self.place[a], self.place[b]
        before, longer = np.abs(x * self.n[a] - y * self.n[b]), np.maximum(self.n[a], self.n[b])
        behind = np.abs((_PLACES - x) * self.n[a] - (_PLACES - y) * self.n[b])
        return (before + behind <= np.maximum(self.edits[a], self.edits[b]) * _PLACES + 2 * longer) | (np.maximum(x, y) == _ANYWHERE)


def neighbours(lines: Lines, unit: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each line of a unit (a run's block) the nearest one before it among those beside it in four orders of the SimHash."""
    a, b = [], []
    for turn in range(4):
        order = np.lexsort((lines.words[turn], unit))
        for step in range(1, width + 1):
            i, j = order[:-step], order[step:]
            same = unit[i] == unit[j]
            i, j = np.maximum(i[same], j[same]), np.minimum(i[same], j[same])
            ok = lines.near(i, j)
            a.append(i[ok])
            b.append(j[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((lines.differing(a, b), a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new], b[new]


def unconnected(lines: Lines, g: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidate pairs of lines of one unit and different groups, by places."""
    rows = np.arange(len(g))
    by_group, by_length = np.lexsort((lines.n, g, unit)), np.lexsort((lines.n, unit))
    # either order has the units in the same places
    of = unit[by_length]
    end = np.searchsorted(of, of, side="right")
    x = g[by_group]
    past = np.append(np.flatnonzero((x[1:] != x[:-1]) | (of[1:] != of[:-1])) + 1, len(g))
    past = np.repeat(past, np.diff(np.append(0, past)))
    longest = end
    if np.all(lines.edits * 9 <= lines.n):
        n = lines.n[by_length].astype(np.int64)
        _, dense = np.unique(of, return_inverse=True)
        longest = np.searchsorted(dense << 33 | n, dense << 33 | (n * 10 // 9 + 2), side="right")
    # the way with fewer pairs to look at: those of other groups, or those of near lengths
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    fewer = np.add.reduceat(end - past, first) <= np.add.reduceat(longest - rows - 1, first) if len(of) else np.empty(0, bool)
    fewer = np.repeat(fewer, np.diff(np.append(first, len(of))))
    order, first, last = np.where(fewer, by_group, by_length), np.where(fewer, past, rows + 1), np.where(fewer, end, longest)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, step = np.flatnonzero(first < last), 0
    while len(left):
        x, y = order[left], order[first[left] + step]
        some = np.flatnonzero(g[x] != g[y])
        x, y = x[some], y[some]
        ok = lines.near(x, y)
        a.append(x[ok])
        b.append(y[ok])
        step += 1
        left = left[first[left] + step < last[left]]
    return np.concatenate(a), np.concatenate(b)


def _units(table: pa.Table, *names: str) -> np.ndarray:
    """A number for each row's unit, which the columns name."""
    parts = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    for x in parts:
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _lines(table: pa.Table, similarity: float) -> tuple[np.ndarray, Lines]:
    h, n, place, *words = (table.column(c).to_numpy() for c in ("h", "n", "place", *_WORDS))
    return h, Lines(n, words, similarity, place.astype(np.int64))


def _pairs(h, a, b):
    x, y = h[a], h[b]
    return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _neighbours(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        h, lines = _lines(table, similarity)
        return _pairs(h, *neighbours(lines, _units(table, "run", "block")))

    return run


def _unconnected(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        h, lines = _lines(table, similarity)
        g, block, p, q = (table.column(c).to_numpy() for c in ("g", "block", "p", "q"))
        a, b = unconnected(lines, g, _units(table, "run", "p", "q"))
        # pairs within a block are those of the unit that has it twice
        ok = (p[a] == q[a]) | (block[a] != block[b])
        return _pairs(h, a[ok], b[ok])

    return run


def _verify(similarity: float, most_bytes: int = 16 << 20):
    """The pairs (a, b, x, y) whose texts x and y are alike, in large batches, as few pairs leave lanes empty."""

    def check(held):
        table = pa.Table.from_batches(held)
        (x, xs), (y, ys) = (code_points(*K.buffers(K.plain(table.column(c)))) for c in ("x", "y"))
        n, m = np.diff(xs), np.diff(ys)
        ok = within(np.concatenate([x, y]), xs[:-1], n, len(x) + ys[:-1], m, np.floor(np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64))
        return table.select(["a", "b"]).filter(pa.array(ok)).combine_chunks().to_batches()

    def run(it):
        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.nbytes
            if size > most_bytes:
                yield from check(held)
                held, size = [], 0
        if held:
            yield from check(held)
        K.release()

    return run


def _alike(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a kept table whose lines are alike."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted = keep(wanted, "line-wanted")
    if fits(wanted, 16):
        norms = norms.join(F.broadcast(wanted), "h")
    texts = norms.dropDuplicates(["h"])
    some = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("norm").alias("y")), "b")
    return keep(some.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long"), "line-edges")


def _groups(norms: DataFrame, lines: int, texts: int, similarity: float, short_run: int, block: int) -> DataFrame:
    """(h, g): lines that are like others with the least of their group."""
    parts = max(8, -(-texts * 24 // 1_000_000))
    keys = norms.mapInArrow(_to_keys(gram_size(lines), parts), "part int, hs binary, codes binary, places binary, key binary")
    runs = keep(keys.groupBy("part").applyInArrow(_runs(similarity, short_run, block), "a long, b long, run long, block int, blocks int, place int"), "line-runs")
    short = runs.where("run is null").select("a", "b").distinct()
    wanted = keep(runs.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct(), "line-wanted")
    some = norms.withColumn("id", F.col("h").bitwiseAND(F.lit(_ID)))
    some = some.join(F.broadcast(wanted), "id") if fits(wanted, 16) else some.join(wanted, "id")
    words = ", ".join(f"{w} long" for w in _WORDS)
    sketches = keep(some.select("h", "norm").mapInArrow(_sketches, f"id long, h long, n int, {words}").dropDuplicates(["h"]), "line-sketches")

    def ends(df, small):
        for x in ("a", "b"):
            own = sketches.select(F.col("id").alias(x), *[F.col(c).alias(c + x) for c in ("h", "n", *_WORDS)])
            df = df.join(F.broadcast(own) if small else own, x)
        return df

    long = F.greatest("na", "nb")
    close = ends(short, fits(sketches, 64)).where(long - F.least("na", "nb") <= F.floor(long * (1 - similarity) + 1e-9))
    bits = sum((F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in _WORDS), F.lit(0))
    close = close.where((long < _SKETCHED) | (bits <= F.greatest(F.lit(24), F.floor(87 - 8 * F.log2(long / _SKETCHED))))).select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    members = runs.where("run is not null").select(F.col("a").alias("id"), "run", "block", "blocks", "place")
    # written, as they are needed twice; lines of runs are joined to their groups where they are
    members = keep(members.join(F.broadcast(sketches) if fits(sketches, 64) else sketches, "id").drop("id"), "line-members")
    # small runs are many, so a call has a bin of them
    partitions = int(norms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(4 * partitions, members.count() // 20_000)
    beside = members.groupBy(F.pmod(F.xxhash64("run", "block"), F.lit(bins)).alias("bin")).applyInArrow(_neighbours(similarity), "a long, b long")
    pairs = keep(close.union(beside).distinct(), "line-pairs")
    edges = _alike(pairs, norms, similarity)
    groups = connected_components(edges)
    roots = groups.select(F.col("node").alias("h"), "root")
    of = members.join(F.broadcast(roots) if fits(groups, 16) else roots, "h", "left").select("h", "n", "place", *_WORDS, "run", "block", "blocks", F.coalesce("root", "h").alias("g"))
    # a pair of blocks is one task's; a run of one group only has nothing left to compare
    mixed = of.groupBy("run").agg((F.min("g") < F.max("g")).alias("mixed")).where("mixed").select("run")
    mixed = keep(mixed, "line-mixed")
    of = of.join(F.broadcast(mixed) if fits(mixed, 8) else mixed, "run").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = of.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    # by number, as their work is more than their size, by which partitions would be joined
    of = of.withColumn("bin", F.pmod(F.xxhash64("run", "p", "q"), F.lit(bins))).repartition(partitions, "bin")
    rest = of.groupBy("bin").applyInArrow(_unconnected(similarity), "a long, b long")
    rest = keep(rest.distinct(), "line-pairs")
    if rest.isEmpty():
        return groups.select(F.col("node").alias("h"), F.col("root").alias("g"))
    more = _alike(rest, norms, similarity)
    return connected_components(edges.union(more)).select(F.col("node").alias("h"), F.col("root").alias("g"))


def _masks(it):
    """(dk, gone, n_gone): for each document whether line k goes, up to the last one that does."""
    for batch in it:
        lists = batch.column(batch.schema.get_field_index("lines"))
        masks, count = [], []
        for k in range(len(batch)):
            at = np.unique(lists[k].values.to_numpy())
            mask = np.zeros(int(at[-1]) + 1, bool)
            mask[at] = True
            masks.append(mask)
            count.append(len(at))
        sizes = np.cumsum([0, *(len(x) for x in masks)]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"dk": K.ints(batch, "dk"), "gone": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(masks) if masks else np.empty(0, bool))), "n_gone": pa.array(count, pa.int32())})


def _removals(docs: DataFrame, similarity: float, fuzzy_bytes: int, short_run: int, block: int) -> DataFrame:
    """(dk, gone, n_gone): which lines to remove from each document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk")).where("text is not null")
    with scratch(docs.sparkSession):
        scan = keep(keyed.mapInArrow(_scan(fuzzy_bytes), "dk long, doc_id long, line int, h long, norm string"), "lines")
        norms = scan.where("norm is not null").select("h", "norm")
        counts = scan.agg(F.count("h").alias("lines"), F.count("norm").alias("texts")).first()
        groups = _groups(norms, counts.lines, counts.texts, similarity, short_run, block)
        if fits(groups, 16):
            groups = F.broadcast(groups)
        of = scan.select("dk", "doc_id", "line", "h").join(groups, "h", "left").select("dk", "doc_id", "line", F.coalesce("g", "h").alias("g"))
        # most lines are alone; no more than their hashes is shuffled
        several = keep(of.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "line-several")
        of = of.join(F.broadcast(several) if fits(several, 8) else several, "g")
        kept = of.groupBy("g").agg(F.min(F.struct("doc_id", "dk", "line")).alias("kept"))
        gone = of.join(kept.select("g", F.col("kept.dk").alias("kd"), F.col("kept.line").alias("kl")), "g").where("dk <> kd or line <> kl")
        lists = gone.groupBy("dk").agg(F.collect_list("line").alias("lines"))
        removals = keep(lists.mapInArrow(_masks, "dk long, gone array<boolean>, n_gone int"), "line-removals", stays=True)
    return removals


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, fuzzy_bytes: int = FUZZY_BYTES, short_run: int = SHORT_RUN, block: int = BLOCK) -> DataFrame:
    """Documents with only one occurrence left of each group of like lines.

    Adds ``n_lines`` (lines before) and ``n_removed``. ``similarity`` is
    1 - edit distance / longer length, in characters of normalised lines.
    Lines of fewer than ``fuzzy_bytes`` bytes match only lines equal to them
    after normalisation. ``short_run`` and ``block`` don't change the result.

    Defined cases: lines without a word (blank, punctuation) always stay; a null
    text stays null with null counts; an empty text has one empty line; the same
    line twice in a document counts as two occurrences; rows that repeat both
    doc_id and text count as one document and all stay; a null doc_id sorts
    first; other columns pass through, whatever their names, but ``n_lines`` and
    ``n_removed``, which are replaced. A document all of whose lines go keeps
    its row with an empty text. An empty table gives an empty table.
    """
    gone = _removals(docs, similarity, fuzzy_bytes, short_run, block)
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 64), F.lit(0)).alias("bytes")).first().bytes
    dk, mask, count = fresh(docs, "dk", "gone", "n_gone")
    gone = gone.select(F.col("dk").alias(dk), F.col("gone").alias(mask), F.col("n_gone").alias(count))
    own = docs.withColumn(dk, F.xxhash64("doc_id", "text"))
    lines = F.split("text", "\n")
    left = F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(mask, i), F.lit(False))), "\n"))
    return own.join(F.broadcast(gone) if size <= 32 << 20 else gone, dk, "left").select(
        *[F.col(c) if c != "text" else left.alias("text") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("text").isNotNull(), F.size(lines)).alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.coalesce(count, F.lit(0))).alias("n_removed"),
    )
