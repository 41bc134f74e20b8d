"""Bounded samples of labelled documents for fitting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fits, keep


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` documents of each class.

    The documents with the least hashes of their ids are taken, so the sample
    doesn't depend on row order. Of repeated labels of a document the largest
    holds; null labels, ids and texts are left out.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = keep(picked[0].union(picked[1]), "sample-ids")
    side = F.broadcast(ids) if fits(ids, 16) else ids
    return docs.select("doc_id", "text").where("text is not null").join(side, "doc_id")


def skew(labels: DataFrame, label: str, per_class: int, rare: int) -> float:
    """How many documents of the other class one sampled document of it stands for,
    where a sampled document of the class ``rare`` stands for one."""
    counts = {r[0]: r[1] for r in labels.groupBy(F.col(label).cast("int")).count().collect()}
    n, other = counts.get(rare, 0), counts.get(1 - rare, 0)
    return (other / min(other, per_class)) / (n / min(n, per_class)) if n and other else 1.0
