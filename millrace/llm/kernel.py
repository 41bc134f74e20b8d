"""Vectorised text primitives over Arrow string batches.

Everything here works on the raw UTF-8 bytes of a whole batch with numpy, so
the cost is a few nanoseconds a byte and no per-word Python object exists.

A *word* is a maximal run of ``[0-9a-z]`` and non-ASCII characters after
lower-casing; U+0080..U+00BF, U+2000..U+207F and U+3000..U+303F separate words
like ASCII punctuation and white space do. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system's library; memory is then kept
    _libc = None
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD1B54A32D192ED03
_QINV = pow(_Q, -1, 1 << 64)
_ORDER = [0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
          0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9,
          0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]
_powers: dict[int, np.ndarray] = {}

#: The same words by a regular expression, for tests and for single lines.
WORD_RE = re.compile(r"(?:[0-9a-z]|[^\x00-\xbf -ⁿ　-〿])+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """Texts without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end of the last."""
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    base, end = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8)[base:end], offsets - base


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    ok = _IS_WORD[data]
    if len(data) and int(data.max()) >= 0xC2:
        lead = np.flatnonzero(data == 0xC2)
        ok[lead] = False
        ok[lead + 1] = False
        for first, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            lead = np.flatnonzero(data == first)
            lead = lead[(data[lead + 1] >= low) & (data[lead + 1] <= high)]
            for k in range(3):
                ok[lead + k] = False
    return ok


class Words:
    """Words of the units (documents, lines) given by ``offsets``.

    ``hash`` and ``size`` (bytes) of each word, ``start`` byte, and ``first``:
    the index of each unit's first word, with the number of words at the end.
    """

    __slots__ = ("hash", "size", "start", "first", "unit")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        if n == 0:
            self.hash, self.size, self.start = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            self.unit = np.empty(0, np.int64)
            return
        ok = word_mask(data)
        begins = ok.copy()
        begins[1:] &= ~ok[:-1]
        inner = offsets[:-1][offsets[:-1] < n]
        begins[inner] = ok[inner]
        ends = ok.copy()
        ends[:-1] &= ~ok[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = ok[last]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(_P, n)[:n], out=total[1:])
        self.start, self.size = start, stop - start
        h = (total[stop] - total[start]) * powers(_PINV, n)[start]
        self.hash = mix(h + self.size.astype(U64) * U64(_Q))
        self.first = np.searchsorted(start, offsets)
        self.unit = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def sequence_hash(self) -> np.ndarray:
        """One hash for each unit's sequence of words; 0 where it has none."""
        w = len(self.hash)
        total = np.zeros(w + 1, U64)
        np.cumsum(self.hash * powers(_Q, w + 1)[:w], out=total[1:])
        lo, hi = self.first[:-1], self.first[1:]
        h = (total[hi] - total[lo]) * powers(_QINV, w + 1)[lo]
        return np.where(hi > lo, mix(h + (hi - lo).astype(U64)) | U64(1), U64(0))

    def shingles(self, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles in order, and each unit's first one.

        With ``whole``, a unit of 1..n-1 words has one shingle: all its words.
        """
        h, first = self.hash, self.first
        count = np.diff(first)
        rows = np.maximum(count - (n - 1), 0)
        short = (count > 0) & (count < n) if whole else np.zeros(len(count), bool)
        full = np.repeat(np.arange(len(count)), rows)
        at = np.zeros(len(count) + 1, np.int64)
        np.cumsum(rows + short, out=at[1:])
        out = np.empty(at[-1], U64)
        if len(full):
            begin = np.zeros(len(count) + 1, np.int64)
            np.cumsum(rows, out=begin[1:])
            pos = np.arange(len(full)) - begin[full]
            word = first[:-1][full] + pos
            acc = h[word] * U64(_ORDER[0])
            for k in range(1, n):
                acc += h[word + k] * U64(_ORDER[k])
            out[at[:-1][full] + pos] = mix(acc)
        for u in np.flatnonzero(short):
            x = h[first[u] : first[u + 1]]
            acc = x * np.array(_ORDER[: len(x)], dtype=U64)
            out[at[u]] = mix(acc.sum(keepdims=True, dtype=U64))[0]
        return out, at

    def pairs(self, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of word pairs with ``gap`` words between them, and their units."""
        h, u = self.hash, self.unit
        d = gap + 1
        if len(h) <= d:
            return np.empty(0, U64), np.empty(0, np.int64)
        same = u[:-d] == u[d:]
        x = h[:-d][same] * U64(_ORDER[0]) + h[d:][same] * U64(_ORDER[1]) + U64(gap * 2 + 1)
        return mix(x), u[:-d][same]


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (split at line feeds; n line feeds make n+1 lines),
    and the index of each document's first line. Each line keeps its line feed."""
    feeds = np.flatnonzero(data == 10) + 1
    docs = len(offsets) - 1
    per = np.searchsorted(feeds, offsets[1:], side="right") - np.searchsorted(feeds, offsets[:-1], side="right") + 1
    first = np.zeros(docs + 1, np.int64)
    np.cumsum(per, out=first[1:])
    out = np.empty(first[-1] + 1, np.int64)
    out[first[:-1]] = offsets[:-1]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    out[:-1][inner] = feeds
    out[-1] = offsets[-1]
    return out, first


def release() -> None:
    """Give freed memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def batches(it, column: str = "text", lower: bool = True, most: int = 1 << 18):
    """(record batch slice, bytes, offsets) in slices of about ``most`` bytes."""
    for batch in it:
        texts = plain(batch.column(batch.schema.get_field_index(column)))
        _, raw = buffers(texts)
        for lo, hi in slices(raw, most):
            some = texts.slice(lo, hi - lo)
            data, offsets = buffers(pc.utf8_lower(some) if lower else some)
            yield batch.slice(lo, hi - lo), data, offsets
    release()


def ints(batch, column: str) -> np.ndarray:
    """A 64-bit integer column; nulls are -1."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    return (col.fill_null(-1) if col.null_count else col).to_numpy(zero_copy_only=False)
