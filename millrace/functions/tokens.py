"""Column functions on arrays of token ids, and the joint id space.

Ids 0..img_n-1 are image codes, the next txt_n ids are text, and the last 27 are
command tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

COMMANDS = (
    "[PAD]", *(f"[BOI{k}]" for k in (1, 2, 3)), *(f"[EOI{k}]" for k in (1, 2, 3)), *(f"[ROI{k}]" for k in (1, 2, 3)),
    "[SEP]", "[MASK]", "[CLS]", "[ENC]", "[TINY]", "[SMALL]", "[BASE]", "[BIG]", *(f"[POS{k}]" for k in range(9)),
)
SIZE_TOKEN = {8: "[TINY]", 16: "[SMALL]", 32: "[BASE]", 64: "[BIG]"}


def points(texts: pa.Array) -> pa.Array:
    """The code points of a batch of texts, decoded as a whole."""
    null = texts.is_null().to_numpy(zero_copy_only=False)
    own = texts.cast(pa.large_string()).fill_null("")
    if not len(own):
        return pa.array([], pa.list_(pa.int32()))
    _, offsets, data = own.buffers()
    at = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.int32)
    return pa.ListArray.from_arrays(pa.array(begins[at - at[0]].astype(np.int32)), pa.array(chars), mask=pa.array(null))


def code_points(text: Column) -> Column:
    """A text's code points, the ids of the default tokenizer."""
    return F.arrow_udf(points, ArrayType(IntegerType()))(text)


def pad_or_cut(ids: Column, width: int, fill: int = -1, spare: int = 0) -> Column:
    """Exactly ``width`` ids: cut to ``width - spare``, then filled up."""
    return F.slice(F.concat(F.slice(ids, 1, width - spare), F.array_repeat(F.lit(fill), width)), 1, width)


def replace_id(ids: Column, old: int, new: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == old, F.lit(new)).otherwise(x))


def offset_ids(ids: Column, by: int) -> Column:
    return F.transform(ids, lambda x: x + by)


def row_width(txt_len: int, sizes) -> int:
    """Ids in a sample: text, and (s / 8)^2 image codes for each size."""
    return txt_len + sum((s // 8) ** 2 for s in sizes)


def sample_row(text_ids: Column, codes_by_size: dict[int, Column]) -> Column:
    """Text ids, then the codes of the smallest size up to the largest."""
    return F.concat(text_ids, *(codes_by_size[s] for s in sorted(codes_by_size)))


@dataclass(frozen=True)
class IdSpace:
    img_n: int = 8192
    txt_n: int = 50000

    def __len__(self) -> int:
        return self.img_n + self.txt_n + len(COMMANDS)

    def __getitem__(self, command: str) -> int:
        return self.img_n + self.txt_n + COMMANDS.index(command)

    def kind(self, c: Column) -> Column:
        """image (also ids below 0), text or command."""
        return F.when(c >= self.img_n + self.txt_n, "command").when(c < self.img_n, "image").otherwise("text")

    def wrap(self, codes: Column, index: int = 1) -> Column:
        """Image codes between their size, begin and end tokens."""
        n = F.size(codes)
        size = F.when(n == 64, self["[TINY]"]).when(n == 256, self["[SMALL]"]).when(n == 1024, self["[BASE]"]).when(n == 4096, self["[BIG]"]).otherwise(F.raise_error(F.lit("not a square of a known side")).cast("int"))
        return F.concat(F.array(size, F.lit(self[f"[BOI{index}]"])), codes, F.array(F.lit(self[f"[EOI{index}]"])))

    def segments(self, ids: Column) -> Column:
        """Segments (kind, ids) in order of output.

        Image codes and text ids gather in a buffer each. A command gives out
        the image buffer if it is an end of image, then the text buffer, then
        itself; the end of the list gives out both, image first.
        """
        return F.arrow_udf(self._segments, "array<struct<kind:string,ids:array<int>>>")(ids)

    def _segments(self, ids: pa.Array) -> pa.Array:
        base, ends = self.img_n + self.txt_n, {self[f"[EOI{k}]"] for k in (1, 2, 3)}
        kinds, parts, rows, of = [], [], [0], []

        def give(kind, some):
            some = np.concatenate(some) if len(some) != 1 else some[0]
            if len(some):
                kinds.append(kind)
                parts.append(some)

        for row in ids:
            if row.is_valid:
                x = row.values.to_numpy(zero_copy_only=False)
                image, last = [x[:0]], 0
                for k in np.flatnonzero(x >= base):
                    between, last = x[last:k], k + 1
                    image.append(between[between < self.img_n])
                    if x[k] in ends:
                        give("image", image)
                        image = [x[:0]]
                    give("text", [between[between >= self.img_n] - self.img_n])
                    give("command", [x[k : k + 1] - base])
                between = x[last:]
                give("image", [*image, between[between < self.img_n]])
                give("text", [between[between >= self.img_n] - self.img_n])
            rows.append(len(kinds))
            of.append(not row.is_valid)
        size = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
        values = pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32))
        segments = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(size), values)], names=["kind", "ids"])
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), segments, mask=pa.array(of))

    def parse(self, query: str, encode, image=None) -> list[int]:
        """Ids of a query: words, commands, ``[MASK]``, ``[MASK]*N`` and
        ``[Image{N}]path`` (the first N of ``image(path)``'s codes, 1024 by
        default, the rest masked). Words before an image are given out after it,
        as the buffer only ends at commands and masks."""
        out: list[int] = []
        words: list[str] = []

        def flush():
            if words:
                out.extend(x + self.img_n for x in encode(" ".join(words)))
                words.clear()

        for part in query.split(" "):
            if part in COMMANDS:
                flush()
                out.append(-1 if part == "[MASK]" else self[part])
            elif part.startswith("[MASK]*"):
                n = int(part[len("[MASK]*") :])
                if n <= 0:
                    raise ValueError(f"{part}: the count must be positive")
                flush()
                out += [-1] * n
            elif part.startswith("[Image"):
                count, _, path = part[len("[Image") :].partition("]")
                codes = list(image(path))
                keep = int(count) if count else 1024
                out += [c if k < keep else -1 for k, c in enumerate(codes)]
            else:
                words.append(part)
        flush()
        return out

    def parse_udf(self, encode, image=None):
        """``parse`` as a vectorised column function. Ids of about 1 MB of queries are held and given out at a time."""

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for queries in batches:
                queries = queries.cast(pa.large_string())
                for lo, hi in _slices(queries, 1 << 20):
                    rows = [None if q is None else np.array(self.parse(q, encode, image), np.int32) for q in queries[lo:hi].to_pylist()]
                    ends = np.cumsum([0, *(0 if x is None else len(x) for x in rows)]).astype(np.int32)
                    values = np.concatenate([np.empty(0, np.int32), *(x for x in rows if x is not None)])
                    yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([x is None for x in rows], pa.bool_()))

        return run


def _slices(texts: pa.LargeStringArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text has its own."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi
