"""Byte-pair encoding and decoding with a public vocabulary.

A text is cut into pieces by the vocabulary's pattern. A long piece's symbols form a
doubly linked list; a priority queue holds the ranks of neighbouring pairs, and
entries whose symbols have merged meanwhile are skipped as stale. Short pieces, as
most are, are encoded many at a time: a round merges the pair of least rank of each,
and only the two pairs beside it are ranked anew. A worker remembers the pieces that
it has met lately. Decoding concatenates vocabulary strings.
"""

import base64
import heapq
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernel as K

#: Where the public vocabularies are; a parameter of every function.
VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with the faster standard module, for texts without odd characters:
#: there a letter is ``[^\W\d_]`` and a number ``\d``.
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_ODD = frozenset("\x1c\x1d\x1e\x1f" + "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) in ("No", "Nl")))
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers: half of them the last it has met, half those before.
CACHE = 300_000
#: Bytes from which on a piece is encoded by itself, and new pieces from which on the others are encoded together.
_LONG, _FEW = 64, 32
_NONE = np.int64(1 << 62)


def load(path: str) -> dict[bytes, int]:
    """Ranks by symbol, of a file with a base64 symbol and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.append((rank, i, 2))
    heapq.heapify(queue)
    while queue:
        rank, i, size = heapq.heappop(queue)
        left = symbol[i]
        if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != size:
            continue  # one of the two has merged since
        merged = left + symbol[j]
        symbol[i], symbol[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(merged + symbol[k])
            if rank is not None:
                heapq.heappush(queue, (rank, i, len(merged) + len(symbol[k])))
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbol[h] + merged)
            if rank is not None:
                heapq.heappush(queue, (rank, h, len(symbol[h]) + len(merged)))
    return [ranks[s] for s in symbol if s is not None]


class Pairs:
    """Ranks of pairs of symbols, which are known by their ranks: a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(a << 32 | b, rank) for s, rank in ranks.items() for k in range(1, len(s)) if (a := ranks.get(s[:k])) is not None and (b := ranks.get(s[k:])) is not None]
        self.bits = max(8, (4 * len(found)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key, rank = np.array(found, np.int64).reshape(-1, 2).T
        at = self._slots(key)
        while len(key):
            # of those that want a slot the last written has it
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            own = self.keys[at] == key
            self.ranks[at[own]] = rank[own]
            key, rank, at = key[~own], rank[~own], at[~own] + 1 & len(self.keys) - 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 for those that don't merge."""
        key = a << 32 | b
        at = self._slots(key)
        out, have = self.ranks[at], self.keys[at]
        left = np.flatnonzero((have != key) & (have >= 0))
        out[have != key] = -1
        while len(left):
            at[left] = at[left] + 1 & len(self.keys) - 1
            have = self.keys[at[left]]
            hit = have == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (have >= 0)]
        return out


def encode_pieces(pieces: list[bytes], byte_ranks: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Token ids of pieces of a byte or more, as the bytes of 32-bit integers."""
    size = np.array([len(p) for p in pieces], np.int64)
    symbol = byte_ranks[np.frombuffer(b"".join(pieces), np.uint8)]
    out: list[bytes] = [b""] * len(pieces)
    own = np.arange(len(pieces))  # the piece of each run of symbols

    def ranked(at, last):
        """A pair's rank and its first symbol's place, by which the first of equal pairs is the least."""
        got = np.full(len(at), _NONE)
        inner = np.flatnonzero(~last)
        rank = pairs(symbol[at[inner]], symbol[at[inner] + 1])
        got[inner] = np.where(rank >= 0, rank, _NONE)
        return got

    last = np.zeros(len(symbol), bool)
    last[np.cumsum(size) - 1] = True
    rank = ranked(np.arange(len(symbol)), last)
    while len(own):
        begin = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, begin)
        over = least == _NONE
        if over.any():
            raw, ends = symbol.astype(np.int32).tobytes(), begin + size
            for k in np.flatnonzero(over).tolist():
                out[own[k]] = raw[4 * begin[k] : 4 * ends[k]]
            stay = np.repeat(~over, size)
            symbol, rank, last = symbol[stay], rank[stay], last[stay]
            own, size, least = own[~over], size[~over], least[~over]
            if not len(own):
                break
            begin = np.cumsum(size) - size
        place = np.flatnonzero(rank == np.repeat(least, size))
        of = np.searchsorted(begin, place, side="right") - 1
        place = place[np.append(True, of[1:] != of[:-1])]
        symbol[place] = least
        last[place] = last[place + 1]
        stay = np.ones(len(symbol), bool)
        stay[place + 1] = False
        symbol, rank, last = symbol[stay], rank[stay], last[stay]
        size -= 1
        place -= np.arange(len(place))
        rank[place] = ranked(place, last[place])
        ahead = place[place > np.cumsum(size) - size] - 1
        rank[ahead] = ranked(ahead, last[ahead])
    return out


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = [b""] * (max(ranks.values(), default=-1) + 1)
        for s, k in ranks.items():
            self.strings[k] = s
        self.length = np.array([len(s) for s in self.strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.strings), np.uint8)
        self.ascii, self.fast, self.any = re.compile(_ASCII, re.ASCII), re.compile(_FAST), regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.byte_ranks = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        self.pairs: Pairs | None = None

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
            return (self.any if odd else self.ascii).findall(text)
        return (self.fast if _ODD.isdisjoint(text) else self.any).findall(text)

    def ids(self, text: str) -> np.ndarray:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.cut(t) for t in texts]
        if len(self.pieces) > CACHE // 2:
            self.before, self.pieces = self.pieces, {}
        known, before = self.pieces, self.before
        some = []
        for p in set().union(*cut).difference(known):
            have = before.get(p)
            if have is not None:
                known[p] = have
            else:
                some.append(p)
        raw = [p.encode() for p in some]
        short = [k for k, p in enumerate(raw) if len(p) < _LONG] if len(raw) >= _FEW and self.byte_ranks.min() >= 0 else []
        if short:
            if self.pairs is None:
                self.pairs = Pairs(self.ranks)
            known.update(zip([some[k] for k in short], encode_pieces([raw[k] for k in short], self.byte_ranks, self.pairs)))
        for p, x in zip(some, raw):
            if p not in known:
                known[p] = np.array(encode_piece(x, self.ranks), np.int32).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cut]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the vocabulary strings of ``ids``, one after another."""
        length = self.length[ids]
        end = np.cumsum(length)
        shift = self.start[ids] - end + length
        return self.bytes[np.repeat(shift, length) + np.arange(end[-1] if len(end) else 0)]

    def text(self, ids) -> str:
        return self.joined(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(load(path))
    return _codecs[path]


def _encode(path, check):
    def run(it):
        c = codec(path)
        for batch, data, offsets in K.batches(it, lower=False):
            null = batch.column(batch.schema.get_field_index("text")).is_null().to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
            ids = c.all_ids(texts)
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=at[1:])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            tokens = pa.ListArray.from_arrays(pa.array(at, mask=np.append(null, False)), flat) if null.any() else pa.ListArray.from_arrays(pa.array(at), flat)
            columns = [*batch.columns, tokens, pa.array(np.diff(at), mask=null)]
            names = [*batch.schema.names, "tokens", "n_tokens"]
            if check:
                all_ids = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
                out = np.concatenate([[0], np.cumsum(c.length[all_ids])])[at]
                whole = c.joined(all_ids)
                if np.array_equal(out, offsets) and np.array_equal(whole, data):
                    same = np.ones(len(ids), bool)
                else:
                    same = np.array([np.array_equal(whole[a:b], data[x:y]) for a, b, x, y in zip(out, out[1:], offsets, offsets[1:])], bool)
                columns.append(pa.array(same, mask=null))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _decode(path, column):
    def run(it):
        c = codec(path)
        for batch in it:
            at = batch.schema.get_field_index(column)
            texts = [None if x is None else c.text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, check: bool = True) -> DataFrame:
    """``docs`` with ``tokens``, ``n_tokens`` and, with ``check``, ``round_trip``:
    whether decoding the tokens gives exactly the text.

    Every executor must find the file ``vocabulary``. Defined cases: a null text
    has null results, an empty one no tokens; any text decodes exactly, as the
    vocabulary has all bytes; columns named like a result are replaced; repeated
    rows stay. An empty table gives an empty table.
    """
    own = docs.drop("tokens", "n_tokens", "round_trip")
    return own.mapInArrow(_encode(vocabulary, check), _schema(own) + ", tokens array<int>, n_tokens int" + ", round_trip boolean" * check)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, column: str = "tokens") -> DataFrame:
    """``tokens`` with ``text``, the concatenated vocabulary strings of ``column``.
    Null lists give null; bytes that aren't UTF-8 become U+FFFD; an id outside
    the vocabulary is an IndexError."""
    own = tokens.drop("text")
    return own.mapInArrow(_decode(vocabulary, column), _schema(own) + ", text string")
