"""Set-similarity join of documents on their word n-grams, by prefix trees.

A document is the set of its word n-gram hashes. Equal sets are one entry. The
n-grams have one global order, from rare to frequent: by a level of the number
of sets that have the n-gram, then by hash. Numbers are counted for all n-grams by
36 bits of their hashes, which are shuffled sorted, as differences of two bytes;
Bloom filters, one for each level, carry them to the sets. All filters together
have a bounded size; where they would be larger, the lowest levels are left out.

*Search.* Sets of n n-grams that reach the Jaccard threshold t with another
share at least 16 of their first n - ceil(t n) + 16 in that order (all that the
sizes ask for where that is less; more where the sizes are alike, as what comes
after a prefix can't make up for it). So only these are shuffled, and of these
none that only one set has, as the lowest level tells; a set that has fewer than
it must share is like no other. What shares an n-gram is a run. Pairs of short runs are counted; long runs, such as n-grams
of a template, give pairs of neighbours in size only, as many as they have
entries. Pairs with counts enough connect entries to groups.

*Tries.* A group's sets are stored in a compact trie, frequent n-grams first, as
near copies share those; a node is a run of n-grams shared by all sets below it.
All entries of the group are probes of one traversal: a node's n-grams are added
to every probe's overlap at once, and a probe leaves a subtree as soon as its
overlap and the most that either side has left can't reach the threshold.

*Rest.* Pairs of entries in different groups that share enough n-grams, those of
long runs included, are then joined in the same way. So no link is lost: the
result is that of comparing all pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .graph import connected_components
from .store import fits, fresh, keep

N = 3
THRESHOLD = 0.5
#: N-grams that candidates share in their prefixes. With few, chance connects what isn't alike.
SHARED = 16
#: Entries of a run all of whose pairs are counted at once.
SHORT_RUN = 8
#: Entries of a long run that are in one task at a time.
BLOCK = 8192
#: Pairs of a long run that its task gives out at a time.
MOST_PAIRS = 1 << 20
#: N-grams (8 bytes each) that a trie's task takes; larger groups are taken apart into pairs of blocks.
GROUP_BYTES = 8 << 20
#: Bytes of the filters that tell how many sets have an n-gram: one for each n-gram and level.
FILTER_BYTES = 48 << 20
#: From which number of sets on an n-gram is in a level.
LEVELS = np.array([2, 3] + [k << e for e in range(1, 30) for k in (2, 3)])
#: Bits of an n-gram's hash by which it is counted: a slice's number and a place in it. N-grams that share them only add candidates.
_SLICES, _PLACE = 1 << 10, 26


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, each text's ascending, and where each begins; and its set's hash (0: none)."""
    grams, at = K.Words(data, offsets).shingles(n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    at = np.searchsorted(doc, np.arange(len(at)))
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(K.mix(grams + K.U64(77)), out=total[1:])
    size = np.diff(at)
    print_ = K.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)) | K.U64(1)
    return grams, at, np.where(size > 0, print_, K.U64(0))


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers as differences of 16 bits, 65535 for that much without a number."""
    step = np.diff(places, prepend=0)
    ends = np.cumsum(step // 65535 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 65535, np.uint16)
    out[ends - 1] = step % 65535
    return out.tobytes()


def unpacked(data) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _once_a_task():
    """Which sets (by hash) a task hasn't just had."""
    given = np.zeros(1 << 18, np.uint64)

    def new(fp):
        slot = (fp & K.U64(len(given) - 1)).astype(np.int64)
        some = (fp != 0) & (given[slot] != fp)
        given[slot[some]] = fp[some]
        return some

    return new


def _to_slices(n: int, groups: int):
    """The counted bits of all n-grams of each set that this task hasn't just had."""

    def flush(held):
        code = np.sort(np.concatenate(held))
        at = np.searchsorted(code >> K.U64(_PLACE), np.arange(_SLICES + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(at))
        places = (code & K.U64((1 << _PLACE) - 1)).astype(np.int64)
        out = [packed(places[at[k] : at[k + 1]]) for k in some]
        yield pa.RecordBatch.from_pydict({"part": (some * groups // _SLICES).astype(np.int32), "slice": some.astype(np.int32), "grams": pa.array(out, pa.binary())})

    def run(it):
        new, held, rows = _once_a_task(), [], 0
        for _, data, offsets in K.batches(it):
            grams, at, fp = sets_of(data, offsets, n)
            held.append(grams[np.repeat(new(fp), np.diff(at))] >> K.U64(64 - 10 - _PLACE))
            rows += len(held[-1])
            if rows >= 4_000_000:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


def _numbers(table: pa.Table) -> pa.Table:
    """Of each slice the places that several sets have, their levels (from 1 on), and how many n-grams and places there are of each level."""
    own, cells = table.column("slice").to_numpy(), table.column("grams")
    out = {"slice": [], "grams": [], "levels": [], "places": [], "sets": []}
    for k in np.unique(own):
        place = np.sort(np.concatenate([unpacked(cells[int(c)].as_buffer()) for c in np.flatnonzero(own == k)]))
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(begin, len(place)))
        level = np.searchsorted(LEVELS, count, side="right")
        several = level > 0
        out["slice"].append(int(k))
        out["grams"].append(packed(place[begin[several]]))
        out["levels"].append(level[several].astype(np.uint8).tobytes())
        out["places"].append(np.bincount(level, minlength=len(LEVELS) + 1).tolist())
        out["sets"].append(np.bincount(level, weights=count, minlength=len(LEVELS) + 1).astype(np.int64).tolist())
    return pa.table({name: pa.array(x, kind) for (name, x), kind in zip(out.items(), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))})


class Numbers:
    """How many sets have an n-gram, by Bloom filters of words of 64 bits: never too few, as far as levels go."""

    def __init__(self, places: np.ndarray, most_bytes: int):
        at_least = np.cumsum(places[::-1])[::-1]
        words = -(-at_least // (8 * _SLICES))  # of a slice in each level's filter, at eight n-grams a word
        bytes_ = np.cumsum(words[::-1])[::-1] * 8 * _SLICES
        some = np.array([k for k in range(1, len(places)) if words[k] and bytes_[k] <= most_bytes], np.int64)
        #: The levels that have a filter. Where all have, what is in none of them is one set's alone.
        self.levels = some
        self.alone = not places[1 : some[0] if len(some) else None].any()
        self.words = words[some]
        self.begin = np.cumsum(self.words) - self.words
        self.wide = int(self.words.sum())
        self.bits = np.zeros((_SLICES, self.wide), np.uint64)

    @staticmethod
    def _probe(code):
        h = K.mix(code + K.U64(12345))
        one = K.U64(1)
        mask = np.left_shift(one, h & K.U64(63))
        for k in (6, 12, 18):
            mask |= np.left_shift(one, h >> K.U64(k) & K.U64(63))
        return h >> K.U64(32), mask

    def slice_bits(self, number: int, places: np.ndarray, levels: np.ndarray) -> np.ndarray:
        out = np.zeros(self.wide, np.uint64)
        h, mask = self._probe((np.uint64(number) << K.U64(_PLACE)) | places.astype(np.uint64))
        for level, begin, words in zip(self.levels, self.begin, self.words):
            some = levels >= level
            np.bitwise_or.at(out, begin + (h[some] * K.U64(words) >> K.U64(32)).astype(np.int64), mask[some])
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Each n-gram's number of filters that have it."""
        found = np.zeros(len(grams), np.uint8)
        code = grams >> K.U64(64 - 10 - _PLACE)
        h, mask = self._probe(code)
        base = (code >> K.U64(_PLACE)).astype(np.int64) * self.wide
        bits, some = self.bits.ravel(), np.arange(len(grams))
        for k, (begin, words) in enumerate(zip(self.begin, self.words), 1):
            own = mask[some]
            some = some[bits[base[some] + begin + (h[some] * K.U64(words) >> K.U64(32)).astype(np.int64)] & own == own]
            if not len(some):
                break
            found[some] = k
        return found


def _filters(numbers: Numbers):
    def run(it):
        for batch in it:
            own, grams, levels = (batch.column(k) for k in range(3))
            out = [numbers.slice_bits(own[k].as_py(), unpacked(grams[k].as_buffer()), np.frombuffer(levels[k].as_buffer(), np.uint8)).tobytes() for k in range(len(batch))]
            yield pa.RecordBatch.from_pydict({"slice": own, "bits": pa.array(out, pa.binary())})

    return run


def _count(texts: DataFrame, n: int, most_bytes: int) -> tuple[Numbers, int]:
    """The filters, and how many n-grams of sets may be shuffled."""
    groups = min(_SLICES, 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = texts.mapInArrow(_to_slices(n, groups), "part int, slice int, grams binary")
    counted = keep(slices.groupBy("part").applyInArrow(_numbers, "slice int, grams binary, levels binary, places array<long>, sets array<long>"), "set-numbers")
    places, sets = np.zeros((2, len(LEVELS) + 1), np.int64)
    for row in counted.select("places", "sets").collect():
        places += row.places
        sets += row.sets
    numbers = Numbers(places, most_bytes)
    if numbers.wide:
        for row in counted.select("slice", "grams", "levels").mapInArrow(_filters(numbers), "slice int, bits binary").collect():
            numbers.bits[row.slice] = np.frombuffer(bytes(row.bits), np.uint64)
    return numbers, int(sets[1:].sum() if numbers.alone else sets.sum())


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + SHARED)


def needed(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Prefix n-grams that two sets within the threshold share at least.

    Of the set whose prefix ends first in the global order all n-grams in common
    up to there are in both prefixes, and what comes after it can add no more
    than it has left.
    """
    overlap = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9).astype(np.int64)
    left = np.maximum(na - prefix_size(na, threshold), nb - prefix_size(nb, threshold))
    return np.maximum(np.minimum(SHARED, overlap), overlap - left).astype(np.int32)


_SETS = "dk long, doc_id long, fp long, size int, part int, key binary, fps binary, sizes binary"


def _prefixes(n: int, threshold: float, numbers: Numbers, parts: int):
    """Each text's set (dk, doc_id, fp, size); and rows of packed (key, entry, size) for the first n-grams
    of each set that this task hasn't just had, but those that no other set has."""

    def flush(key, fp, size):
        part = (key % K.U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        short = np.ascontiguousarray((key[order] >> K.U64(40)).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3])
        fp, size = fp[order], size[order].view(np.uint8).reshape(-1, 4)  # byte by byte, as most high bytes are 0 and pack well
        for p in range(0, parts, 256):
            some = [q for q in range(p, min(parts, p + 256)) if ends[q] < ends[q + 1]]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_pydict({"dk": none, "doc_id": none, "fp": none, "size": none.cast(pa.int32()), "part": pa.array(some, pa.int32())} | {name: pa.array([x[ends[q] : ends[q + 1]].tobytes() for q in some], pa.binary()) for name, x in (("key", short), ("fps", fp))} | {"sizes": pa.array([size[ends[q] : ends[q + 1]].T.tobytes() for q in some], pa.binary())})

    def run(it):
        new, held, rows = _once_a_task(), [], 0
        for batch, data, offsets in K.batches(it):
            grams, at, fp = sets_of(data, offsets, n)
            size = np.diff(at)
            some = np.flatnonzero(fp)
            none = pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_pydict({"dk": K.ints(batch, "dk")[some], "doc_id": K.ints(batch, "doc_id")[some], "fp": fp[some].view(np.int64), "size": size[some].astype(np.int32), "part": none.cast(pa.int32()), "key": none, "fps": none, "sizes": none})
            mine = np.repeat(new(fp), size)
            grams, doc = grams[mine], np.repeat(np.arange(len(size)), size)[mine]
            level = numbers.of(grams)
            first = prefix_size(size, threshold)
            if numbers.alone:
                shared = level > 0
                grams, doc, level = grams[shared], doc[shared], level[shared]
                # a prefix begins with what no other set has
                first = first - (size - np.bincount(doc, minlength=len(size)))
                enough = (first >= np.minimum(SHARED, np.ceil(threshold * size - 1e-9)))[doc]
                grams, doc, level = grams[enough], doc[enough], level[enough]
            order = np.argsort((doc << 8) | level, kind="stable")  # n-grams of a set ascend
            grams, doc = grams[order], doc[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(size)))[doc]
            begin = rank < first[doc]
            doc = doc[begin]
            held.append((K.mix(grams[begin]), fp[doc], size[doc].astype(np.uint32)))
            rows += len(doc)
            if rows >= 2_000_000:
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held, rows = [], 0
        if rows:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


_RUNS = "kind int, a long, b long, hits int, need int, block int, blocks int"


def _runs(threshold: float, short_run: int, block: int):
    """kind 0: pairs (a, b) of short runs and their n-grams in common here; 1: of neighbours in
    long runs; 2: entries (a) of long runs (b) with their size (hits) and place (block of blocks)."""

    def run(table: pa.Table) -> pa.Table:
        raw, fp = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("key", np.uint8), ("fps", np.int64)))
        key = np.zeros((len(fp), 4), np.uint8)
        key[:, :3] = raw.reshape(-1, 3)
        key = key.view(np.uint32).ravel()
        size = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T) for x in table.column("sizes").to_pylist()]).view(np.uint32).ravel().astype(np.int64)
        order = np.lexsort((fp, size, key))
        key, fp, size = key[order], fp[order], size[order]
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp, size = key[new], fp[new], size[new]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(begin, len(key)))
        out = []
        for kind, some, steps in ((0, (n > 1) & (n <= short_run), short_run), (1, n > short_run, 3)):
            own = np.repeat(some, n)
            a, b, need = [fp[:0]], [fp[:0]], [np.empty(0, np.int32)]
            for step in range(1, min(steps, len(key))):
                at = np.flatnonzero(own[:-step] & (key[:-step] == key[step:]) & (size[:-step] >= threshold * size[step:] - 1e-9))
                a.append(np.minimum(fp[at], fp[at + step]))
                b.append(np.maximum(fp[at], fp[at + step]))
                need.append(needed(size[at], size[at + step], threshold))
            a, b, need = (np.concatenate(x) for x in (a, b, need))
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
            zero = np.zeros(len(first), np.int32)
            out.append((zero + kind, a[first], b[first], np.diff(np.append(first, len(a))).astype(np.int32), need[first], zero, zero))
        long = np.repeat(n > short_run, n)
        number = (np.int64(table.column("part")[0].as_py()) << 32) | np.repeat(begin, n)[long]
        place = (np.arange(len(key)) - np.repeat(begin, n))[long] // block
        zero = np.zeros(len(number), np.int32)
        out.append((zero + 2, fp[long], number, size[long].astype(np.int32), zero, place.astype(np.int32), np.repeat(-(-n // block), n)[long].astype(np.int32)))
        return pa.table(dict(zip(("kind", "a", "b", "hits", "need", "block", "blocks"), (np.concatenate(x) for x in zip(*out)))))

    return run


def _across(threshold: float, most_pairs: int = MOST_PAIRS):
    """Pairs of entries of different groups in a long run, one n-gram in common each, given out some ``most_pairs`` at a time,
    as a pair of blocks may have thousands for each of its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        fp, g, size, most, block = (table.column(c).to_numpy() for c in ("fp", "g", "size", "most", "block"))
        order = np.lexsort((size, g))
        fp, g, size, most, block = fp[order], g[order], size[order].astype(np.int64), most[order], block[order]
        two = table.column("p")[0] != table.column("q")[0]  # pairs within a block are another task's

        def pairs(held):
            x, y = (np.concatenate(x) for x in zip(*held))
            need = needed(size[x], size[y], threshold)
            x, y = fp[x], fp[y]
            return pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "hits": np.ones(len(x), np.int32), "need": need})

        end = np.searchsorted(g, g, side="right")
        left, step, held, n = np.arange(len(order)), 0, [], 0
        while len(left):
            left = left[end[left] + step < len(order)]
            right = end[left] + step
            ok = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
            if two:
                ok &= block[left] != block[right]
            x, y = left[ok], right[ok]
            ok = np.minimum(most[x], most[y]) >= needed(size[x], size[y], threshold)
            held.append((x[ok].astype(np.int32), y[ok].astype(np.int32)))
            n += len(held[-1][0])
            step += 1
            if n >= most_pairs:
                yield pairs(held)
                held, n = [], 0
        if n:
            yield pairs(held)

    return run


def _blobs(n):
    def run(it):
        for batch, data, offsets in K.batches(it):
            grams, at, _ = sets_of(data, offsets, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "root", "g", "rows", "blocks")), pa.array([grams[at[d] : at[d + 1]].tobytes() for d in range(len(at) - 1)], pa.binary())], names=["fp", "root", "g", "rows", "blocks", "grams"])

    return run


class Trie:
    """A compact prefix tree over sets of hashes, and one traversal of it by many probes.

    N-grams are ranked from frequent to rare among the sets; those of one set
    only overlap nothing and aren't stored. Sets are kept in lexicographic order
    with the lengths of their common prefixes, which is the tree: a node ends
    where neighbours part.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        hashes, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(hashes), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(hashes))
        self.ranks = int((count > 1).sum())
        ends = np.cumsum(self.size)
        self.sets = [np.sort(x[x < self.ranks]) for x in (rank[at[e - n : e]] for e, n in zip(ends, self.size))]
        self.order = sorted(range(len(sets)), key=lambda k: self.sets[k].astype(">u4").tobytes())
        self.common = [self._common(self.sets[p], self.sets[q]) for p, q in zip(self.order, self.order[1:])] + [0]

    @staticmethod
    def _common(x, y):
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m

    def search(self, probes: np.ndarray, threshold: float):
        """(set, probes, overlaps): for every set the probes (places of sets) within the threshold.

        One walk for all probes; the branch that is being walked has their overlaps at each of its nodes.
        """
        ratio = threshold / (1 + threshold)
        has = np.zeros((self.ranks, len(probes)), np.uint8)
        for k, p in enumerate(probes):
            has[self.sets[p], k] = 1
        wide = self.ranks + 1
        codes = np.concatenate([self.sets[p] + k * wide for k, p in enumerate(probes)])
        stop = np.cumsum([len(self.sets[p]) for p in probes])
        size = self.size[probes]
        sizes = self.size[self.order]
        rest = np.array([len(self.sets[k]) for k in self.order])
        common = np.array(self.common)
        walk = [(0, np.arange(len(probes)), np.zeros(len(probes), np.int32))]

        def down(node, ranks):
            _, who, overlap = node
            if not len(ranks) or not len(who):
                return who, overlap
            rows = has[ranks] if len(who) == len(probes) else has[ranks][:, who]
            return who, overlap + rows.sum(axis=0, dtype=np.int32)

        for at, k in enumerate(self.order):
            own, part = self.sets[k], int(common[at])

            def branch(own=own, part=part, at=at):
                who, overlap = down(walk[-1], own[walk[-1][0] : part])
                # what either side has left below this node
                ahead = np.flatnonzero(common[at:] < part)
                end = at + int(ahead[0]) + 1 if len(ahead) else len(sizes)
                left = stop[who] - np.searchsorted(codes, who * wide + own[part - 1], side="right")
                below = np.minimum(left, rest[at:end].max() - part)
                stay = overlap + below >= ratio * (size[who] + sizes[at:end].min()) - 1e-9
                walk.append((part, who[stay], overlap[stay]))

            if part > walk[-1][0]:
                branch()
            who, overlap = down(walk[-1], own[walk[-1][0] :])
            ok = overlap >= ratio * (size[who] + self.size[k]) - 1e-9
            yield k, probes[who[ok]], overlap[ok]
            while walk[-1][0] > part:
                walk.pop()
            if walk[-1][0] < part:
                branch()


def links(sets: list[np.ndarray], threshold: float, rows: np.ndarray, block: np.ndarray | None, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, the rows that link to it, and the least place in its connected part.

    Pairs within a block are left out where blocks are given, and pairs within
    a group where groups are.
    """
    trie = Trie(sets)
    count, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    step = int(np.clip((16 << 20) // max(trie.ranks, 1), 8, 1024))
    for lo in range(0, len(sets), step):
        for k, who, _ in trie.search(np.arange(lo, min(lo + step, len(sets))), threshold):
            who = who[who != k]
            if block is not None:
                who = who[block[who] != block[k]]
            if group is not None:
                who = who[group[who] != group[k]]
            if len(who):
                count[k] += rows[who].sum()
                some = np.unique(np.append(label[who], label[k]))
                if len(some) > 1:
                    label[np.isin(label, some)] = some[0]
    return count, label


def _tries(threshold: float, grouped: bool):
    """One task's groups: (fp, links, other), a spanning edge to ``other`` beside each entry's links."""

    def run(table: pa.Table) -> pa.Table:
        fp, root, g, rows, block = (table.column(c).to_numpy() for c in ("fp", "root", "g", "rows", "block"))
        grams = table.column("grams")
        # a unit is a pair of blocks; pairs within one are those of the unit that has it twice
        two = table.column("p")[0] != table.column("q")[0]
        order = np.argsort(root, kind="stable")
        ends = np.flatnonzero(np.append(root[order][1:] != root[order][:-1], True)) + 1
        count, other = np.zeros(len(fp), np.int64), fp.copy()
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            at = order[lo:hi]
            sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in at]
            some, label = links(sets, threshold, rows[at], block[at] if two else None, g[at] if grouped else None)
            count[at], other[at] = some, fp[at][label]
        some = count > 0
        return pa.table({"fp": fp[some], "links": count[some], "other": other[some]})

    return run


def _joined(own: DataFrame, entries: DataFrame, groups: DataFrame, n: int, threshold: float, most_bytes: int, grouped: bool) -> DataFrame:
    """Links of the entries (fp, root, g) of each group. A group beyond ``most_bytes`` is several tasks' work, one for each pair of its blocks."""
    of = groups.join(entries.select("fp", "dk", "rows", "size"), "fp")
    bytes_ = of.groupBy("root").agg(F.sum(F.col("size").cast("long") * 8).alias("bytes"))
    of = of.join(bytes_.select("root", F.ceil(F.col("bytes") / most_bytes).cast("int").alias("blocks")), "root")
    wanted = keep(of.select("dk", "fp", "root", "g", "rows", "blocks"), "set-wanted")
    total = of.agg(F.sum(F.col("size").cast("long") * 8)).first()[0] or 0
    some = own.join(F.broadcast(wanted) if fits(wanted, 48) else wanted, "dk").select("fp", "root", "g", "rows", "blocks", "text")
    sets = some.mapInArrow(_blobs(n), "fp long, root long, g long, rows long, blocks int, grams binary")
    bins = max(1, total // (2 << 20))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = F.col("blocks") > 1
    unit = [F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"), large.alias("large"), F.least("block", "beside").alias("p"), F.greatest("block", "beside").alias("q")]
    sets = sets.select("fp", "root", "g", "rows", "block", "grams", *unit)
    return keep(sets.groupBy("unit", "large", "p", "q").applyInArrow(_once(_tries(threshold, grouped)), "fp long, links long, other long"), "set-links")


def _once(f):
    """Documents that repeat both doc_id and text bring their entry more than once."""

    def run(table: pa.Table) -> pa.Table:
        _, first = np.unique(table.column("fp").to_numpy(), return_index=True)
        return f(table.take(pa.array(np.sort(first))) if len(first) < len(table) else table)

    return run


def _run(docs: DataFrame, n: int, threshold: float, most_bytes: int, short_run: int, block: int, filter_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a set (dk, doc_id, fp), entries (fp, rows) and what links (fp, links, root)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("dk")).where("doc_id is not null and text is not null")
    numbers, grams = _count(own.select("text"), n, filter_bytes)
    parts = max(8, grams // 1_000_000)
    scan = keep(own.mapInArrow(_prefixes(n, threshold, numbers, parts), _SETS), "sets")
    members = scan.where("fp is not null").select("dk", "doc_id", "fp", "size")
    entries = keep(members.groupBy("fp").agg(F.min("dk").alias("dk"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size")), "set-entries")
    prefixes = scan.where("part is not null").select("part", "key", "fps", "sizes")
    runs = keep(prefixes.groupBy("part").applyInArrow(_runs(threshold, short_run, block), _RUNS), "set-runs")
    zero = F.when(F.col("kind") == 0, F.col("hits")).otherwise(0)
    counted = keep(runs.where("kind < 2").groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.sum(zero).alias("short"), F.max("need").alias("need")), "set-pairs")
    groups = connected_components(counted.where("hits >= need").select("a", "b")).select(F.col("node").alias("fp"), "root")
    found = _joined(own, entries, groups.select("fp", "root", F.lit(0).cast("long").alias("g")), n, threshold, most_bytes, False)
    of = F.broadcast(groups) if fits(groups, 16) else groups

    def group_of(df):
        return df.join(of.withColumnRenamed("root", "g"), "fp", "left").withColumn("g", F.coalesce("g", "fp"))

    long = group_of(runs.where("kind = 2").select(F.col("a").alias("fp"), F.col("b").alias("run"), F.col("hits").alias("size"), "block", "blocks"))
    mixed = long.groupBy("run").agg((F.min("g") < F.max("g")).alias("mixed")).where("mixed").select("run")
    long = keep(long.join(mixed, "run"), "set-long")
    # what an entry has in long runs, with what it shares with any one entry in short runs, bounds what it shares with another
    most = counted.where("short > 0").select(F.explode(F.array("a", "b")).alias("fp"), "short").groupBy("fp").agg(F.max("short").alias("short"))
    enough = long.groupBy("fp").agg(F.count(F.lit(1)).alias("own"), F.first("size").alias("size")).join(most, "fp", "left")
    enough = enough.select("fp", "size", (F.col("own") + F.coalesce("short", F.lit(0))).alias("most"))
    enough = keep(enough.where(F.col("most") >= F.least(F.lit(SHARED), F.ceil(threshold * F.col("size") - 1e-9))).select("fp", "most"), "set-enough")
    long = long.join(F.broadcast(enough) if fits(enough, 16) else enough, "fp")
    long = long.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.withColumn("p", F.least("block", "beside")).withColumn("q", F.greatest("block", "beside"))
    # by number, as their work is more than their size, by which partitions would be joined
    long = long.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run", "p", "q")
    across = long.groupBy("run", "p", "q").applyInArrow(_across(threshold), "a long, b long, hits int, need int")
    across = across.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("need").alias("need"))
    rest = across.join(counted.where("short > 0").select("a", "b", "short"), ["a", "b"], "left").where(F.col("hits") + F.coalesce("short", F.lit(0)) >= F.col("need"))
    rest = keep(rest.select("a", "b"), "set-rest")
    if not rest.isEmpty():
        more = connected_components(rest).select(F.col("node").alias("fp"), "root")
        found = found.union(_joined(own, entries, group_of(more).select("fp", "root", "g"), n, threshold, most_bytes, True))
    total = found.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    return members, entries, total.join(classes.select(F.col("node").alias("fp"), "root"), "fp")


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, most_bytes: int = GROUP_BYTES, short_run: int = SHORT_RUN, block: int = BLOCK, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row (doc_id, class_id, n_links) for each document.

    ``n_links`` is the number of other rows whose n-gram sets have Jaccard >=
    ``threshold`` with the row's. Links connect documents to classes;
    ``class_id`` is the least doc_id of the class. ``most_bytes``, ``short_run``,
    ``block`` and ``filter_bytes`` don't change the result.

    Defined cases: a text of 1..n-1 words is one n-gram of all its words; null,
    empty and wordless texts have no set, link to nothing and are a class of
    their own; rows with a null doc_id are left out; rows that repeat a doc_id
    are rows of their own, whether their texts differ or not. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    members, entries, linked = _run(docs, n, threshold, most_bytes, short_run, block, filter_bytes)
    of = entries.select("fp", "rows").join(linked, "fp", "left").select("fp", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), F.coalesce("root", "fp").alias("root"))
    rows = members.select("doc_id", "fp").join(of, "fp")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    with_set = rows.join(least, "root").select("doc_id", "class_id", F.col("links").alias("n_links"))
    # rows without a set have no member's row
    sets = members.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("sets"))
    all_ = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    bare = all_.join(sets, "id", "left").withColumn("bare", F.col("rows") - F.coalesce("sets", F.lit(0))).where("bare > 0")
    bare = bare.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("bare")))).select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.unionByName(bare)


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the least doc_id of each class.

    Documents without a set, rows with a null doc_id and rows that repeat the
    least doc_id stay. Columns pass through, whatever their names.
    """
    members, entries, linked = _run(docs, n, threshold, GROUP_BYTES, SHORT_RUN, BLOCK, FILTER_BYTES)
    some = entries.where("rows > 1").select("fp").union(linked.select("fp")).distinct()
    rows = members.join(some, "fp").join(linked.select("fp", "root"), "fp", "left").select("dk", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("least"))
    (name,) = fresh(docs, "gone")
    gone = keep(rows.join(least, "root").where("doc_id <> least").select(F.col("dk").alias(name)).distinct(), "near-copies")
    return docs.join(F.broadcast(gone) if fits(gone, 16) else gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone[name], "left_anti")
