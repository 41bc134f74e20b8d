"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs its own tasks and never a recomputation from the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from millrace.shared import shared_folder


_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept within are removed at the end, but those that stay."""
    paths: list[str] = []
    before = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; nothing is created yet."""
    return shared_folder(spark, name)


def keep(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    paths = _scratch.get()
    if paths is not None and not stays:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> bool:
    """Whether a kept table is small enough to broadcast."""
    return df.count() * row_bytes <= most


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "_mr_" + name
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
