"""The folder that all executors share, for files that operators write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, or below a temporary
    folder of this process where a local session doesn't set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        global _own
        if _own is None:
            _own = tempfile.mkdtemp(prefix="millrace-files-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        root = "file://" + _own
    return f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex[:12]}"


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
