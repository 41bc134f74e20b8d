"""Tasks: whole plans from a source to samples.

A task has ``plan(df, ...) -> DataFrame``; it never touches rows on the driver.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import PILE_SETS, normalizer
from ..functions.strings import basename_key, strip
from ..functions.tokens import pad_or_cut, replace_id
from ..operators.flow import pack_stream, ratio_cut
from ..operators.tokenizers import CodePoints, Tokenizer
from ..operators.vision import image_codes
from ..registry import register


class Task:
    """The base of user-defined tasks."""

    def plan(self, df: DataFrame, **options) -> DataFrame:
        raise NotImplementedError


def decode_image(content: bytes) -> np.ndarray:
    """(h, w, channels) bytes of a ``.npy`` array or a binary PPM/PGM picture.
    Other formats need a decoder of the caller's."""
    if content[:6] == b"\x93NUMPY":
        x = np.load(io.BytesIO(content), allow_pickle=False)
        return x if x.ndim == 3 else np.repeat(x[..., None], 3, axis=2)
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(int(content[at:end]))
            at = end
        width, height, _ = fields
        channels = 3 if content[:2] == b"P6" else 1
        x = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
        return x if channels == 3 else np.repeat(x, 3, axis=2)
    raise ValueError("not a known picture format")


@register
class TextTask(Task):
    """Lines -> stripped, non-empty -> normalised -> ids -> packed samples."""

    REGISTER_NAME = "TextTask"

    def __init__(self, tokenizer: Tokenizer | None = None, text_format: str | None = None, pile_sets: Sequence[str] = PILE_SETS, on_error: str = "null"):
        self.tokenizer, self.format, self.sets, self.on_error = tokenizer or CodePoints(), text_format, pile_sets, on_error

    def texts(self, lines: DataFrame, value: str = "value") -> DataFrame:
        line = strip(value)
        make = normalizer(self.format)
        text = make(line, self.sets, on_error=self.on_error) if self.format == "pile" else make(line, on_error=self.on_error)
        return lines.where(F.length(line) > 0).withColumn("text", text).where(F.col("text").isNotNull())

    def encode(self, lines: DataFrame, value: str = "value") -> DataFrame:
        """``lines`` with ``ids``, without the end token."""
        return self.texts(lines, value).withColumn("ids", self.tokenizer.column(F.col("text")))

    def plan(self, df: DataFrame, order: Sequence[str] = ("idx",), value: str = "value", length_per_sample: int = 1024, ratio: float = 1.0, batch_size: int = 128) -> DataFrame:
        """(chunk, tokens)"""
        rows = self.texts(ratio_cut(df, order, batch_size, ratio), value)
        text = F.col("text")
        return pack_stream(rows.select(*order, "text"), order, self.tokenizer.column(text), length_per_sample, self.tokenizer["</s>"], self.tokenizer.count(text))


@register
class ImageTextTask(Task):
    """Pictures with captions -> caption ids, then codes of each size.

    ``encode(picture) -> codes`` takes a normalised (3, s, s) array and runs in
    Arrow batches; captions are joined before any picture is decoded.
    """

    REGISTER_NAME = "ImageTextTask"
    fill, spare, newline = -1, 0, None
    min_side = False
    standardise = True

    def __init__(self, encode: Callable, tokenizer: Tokenizer | None = None, img_sizes: Sequence[int] = (256,), txt_len: int = 64, decode: Callable = decode_image, on_missing_caption: str = "drop"):
        self.encode, self.tokenizer, self.sizes, self.txt_len, self.decode = encode, tokenizer or CodePoints(), sorted(img_sizes), txt_len, decode
        if on_missing_caption not in ("drop", "empty"):
            raise ValueError("on_missing_caption can be drop or empty")
        self.missing = on_missing_caption

    def key(self, name: Column) -> Column:
        return basename_key(name)

    def captioned(self, rows: DataFrame, captions: DataFrame | None, most_bytes: int = 32 << 20) -> DataFrame:
        """``rows`` with the ``text`` of their ``key``; those without are dropped or kept with null.
        Captions are broadcast up to so many bytes, 32 for each and those of its text."""
        if captions is None:
            captions = rows.sparkSession.createDataFrame([], "key string, text string")
        size = captions.agg(F.sum(F.octet_length("text") + F.octet_length("key") + 32)).first()[0] or 0
        return rows.join(F.broadcast(captions) if size <= most_bytes else captions, "key", "inner" if self.missing == "drop" else "left")

    def text_ids(self, text: Column) -> Column:
        ids = self.tokenizer.column(text)
        if self.newline is not None:
            ids = replace_id(ids, self.newline, self.fill)
        return pad_or_cut(ids, self.txt_len, self.fill, self.spare)

    def plan(self, df: DataFrame, captions: DataFrame | None = None, order: Sequence[str] = ("file_ix", "idx"), ratio: float = 1.0, batch_size: int = 128, most_caption_bytes: int = 32 << 20) -> DataFrame:
        """(full_filename, key, tokens) of rows (full_filename, content)."""
        rows = ratio_cut(df, order, batch_size, ratio).where(F.col("content").isNotNull()).withColumn("key", self.key(F.col("full_filename")))
        rows = self.captioned(rows, captions, most_caption_bytes)
        rows = rows.withColumn("text_ids", self.text_ids(F.coalesce("text", F.lit(""))))
        sizes, encode, decode, small = self.sizes, self.encode, self.decode, self.min_side
        mean, std = ((0.79093, 0.76271, 0.75340), (0.30379, 0.32279, 0.32800)) if self.standardise else ((0, 0, 0), (1, 1, 1))

        def run(it):
            for batch in it:
                names, keys, contents, texts = (batch.column(k).to_pylist() for k in range(4))
                out = []
                for name, key, content, text in zip(names, keys, contents, texts):
                    try:
                        picture = decode(content)
                    except Exception:
                        continue  # a corrupt picture has no sample
                    if small and min(picture.shape[:2]) < max(sizes):
                        continue
                    out.append((name, key, list(text) + image_codes(picture, sizes, encode, mean, std).tolist()))
                yield pa.RecordBatch.from_pydict({"full_filename": pa.array([o[0] for o in out], pa.string()), "key": pa.array([o[1] for o in out], pa.string()), "tokens": pa.array([o[2] for o in out], pa.list_(pa.int32()))})

        return rows.select("full_filename", "key", "content", "text_ids").mapInArrow(run, "full_filename string, key string, tokens array<int>")


@register
class PaddedImageTextTask(ImageTextTask):
    """As ImageTextTask, with the tokenizer's ``<pad>`` as filling (at least one),
    its ``<n>`` replaced by it, pictures of enough pixels only, and no
    standardisation."""

    REGISTER_NAME = "PaddedImageTextTask"
    min_side, standardise, spare = True, False, 1

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self.fill, self.newline = self.tokenizer["<pad>"], self.tokenizer["<n>"]


@register
class ConvertToTarTask(Task):
    """Members whose full name has a caption, as they are, for the tar sink."""

    REGISTER_NAME = "ConvertToTarTask"

    def plan(self, df: DataFrame, captions: DataFrame) -> DataFrame:
        return df.where(F.col("content").isNotNull()).join(captions.select(F.col("key").alias("full_filename")), "full_filename", "left_semi")
