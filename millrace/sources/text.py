"""Line text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import strip


def read_lines(spark: SparkSession, paths: Sequence[str], blank_bad_bytes: bool = False) -> DataFrame:
    """(file, value): stripped lines. Bytes that aren't UTF-8 become U+FFFD; with
    ``blank_bad_bytes`` a line with one becomes empty."""
    value = strip("value")
    if blank_bad_bytes:
        value = F.when(F.col("value").rlike("�"), "").otherwise(value)
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), value.alias("value"))


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, value): the stripped, non-empty lines of a text column."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "line"))
    return lines.select(key, "idx", strip("line").alias("value")).where(F.length("value") > 0)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
