"""The text plan over an unbounded folder of lines.

Everything up to the token ids works on one row at a time, so the batch task's
``encode`` runs on a stream as it is. Packing, cutting by ratio and splitting need
a total order and stay with batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.tasks import TextTask


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def encode_stream(lines: DataFrame, task: TextTask) -> DataFrame:
    """(text, ids) of a streaming table of lines."""
    return task.encode(lines).select("text", "ids")


def write_stream(encoded: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet, exactly once; with ``once`` it ends when what is there is read."""
    writer = encoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
