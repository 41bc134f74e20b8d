"""Make this package importable on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of documents that travel to a Python worker at once.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application.

    Where the session has Spark's default for rows of an Arrow batch, this
    lowers it, as rows here are whole documents. Clusters that install the package on every node don't need this.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        _shipped.add(app)
    return spark
