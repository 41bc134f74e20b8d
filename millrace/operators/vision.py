"""Images and vectors: nearest codes, code lookup, resizing, normalising."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEAN, STD = (0.79093, 0.76271, 0.75340), (0.30379, 0.32279, 0.32800)


def nearest(vectors: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The index of each vector's nearest codeword by squared distance; the least
    index where several are equally near. One matrix product for each block."""
    vectors, codebook = vectors.astype(np.float64), codebook.astype(np.float64)
    norms = (codebook**2).sum(axis=1)
    out = np.empty(len(vectors), np.int32)
    step = max(1, (1 << 22) // max(1, len(codebook)))
    for lo in range(0, len(vectors), step):
        out[lo : lo + step] = np.argmin(norms - 2 * vectors[lo : lo + step] @ codebook.T, axis=1)
    return out


def quantize(df: DataFrame, column: str, codebook: np.ndarray, most_bytes: int = 256 << 20) -> DataFrame:
    """``df`` with ``code``: the nearest codeword of an array column; null for null.

    The codebook travels with the task; one beyond ``most_bytes`` is refused.
    """
    if codebook.nbytes > most_bytes:
        raise ValueError(f"the codebook has {codebook.nbytes} bytes; the limit is {most_bytes}")
    at = df.columns.index(column)
    width = codebook.shape[1]

    def run(it):
        for batch in it:
            col = batch.column(at)
            ok = ~col.is_null().to_numpy(zero_copy_only=False)
            flat = col.drop_null().flatten().to_numpy(zero_copy_only=False)
            codes = np.zeros(len(col), np.int32)
            codes[ok] = nearest(flat.reshape(-1, width), codebook)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, mask=~ok)], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", code int")


def lookup(df: DataFrame, code: str, codebook: DataFrame) -> DataFrame:
    """``df`` joined to the codebook's (code, embedding)."""
    return df.join(codebook, df[code] == codebook["code"]).drop(codebook["code"])


def commitment(x: np.ndarray, codes: np.ndarray, codebook: np.ndarray) -> float:
    """Mean squared distance to the chosen codewords."""
    return float(((codebook[codes] - x) ** 2).mean())


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear scaling of (h, w, channels), pixel centres aligned at half."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image.astype(np.float64)

    def places(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = places(h, height)
    x0, x1, fx = places(w, width)
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def resize_crop(image: np.ndarray, size: int) -> np.ndarray:
    """The short side scaled to ``size``, then the square in the middle."""
    h, w = image.shape[:2]
    scale = size / min(h, w)
    image = resize(image, max(size, int(h * scale)), max(size, int(w * scale)))
    top, left = round((image.shape[0] - size) / 2), round((image.shape[1] - size) / 2)
    return image[top : top + size, left : left + size]


def normalize(image: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    """(h, w, 3 or 4) bytes to (3, h, w): alpha dropped, scaled, standardised."""
    x = image[..., :3].astype(np.float64) / 255
    return ((x - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def denormalize(image: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    return image.transpose(1, 2, 0) * np.array(std) + np.array(mean)


def patch_codes(image: np.ndarray, codebook: np.ndarray, patch: int = 8) -> np.ndarray:
    """Codes of a (3, h, w) image: each patch's mean colour against a codebook of
    three columns. The place where a trained encoder would go."""
    c, h, w = image.shape
    means = image.reshape(c, h // patch, patch, w // patch, patch).mean(axis=(2, 4))
    return nearest(means.reshape(c, -1).T, codebook)


def image_codes(image: np.ndarray, sizes, encode, mean=MEAN, std=STD) -> np.ndarray:
    """Codes for all sizes of one picture, smallest first: cropped at the largest,
    scaled down for the rest."""
    largest = resize_crop(image, max(sizes))
    return np.concatenate([encode(normalize(resize(largest, s, s), mean, std)) for s in sorted(sizes)])


def with_side(df: DataFrame, width: str, height: str, size: int) -> DataFrame:
    """Pictures whose shorter side is at least ``size``."""
    return df.where(F.least(width, height) >= size)
