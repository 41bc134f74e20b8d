"""Sharding, batching, cutting, packing, merging and splitting of rows.

Global positions never put all rows into one task: rows fall into ranges of
their first order key that hold about as many rows each, each range is summed,
and a row's position is what comes before its range plus what comes before it
in its range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh


#: Ranges of the order key for each shuffle partition.
RANGES = 4
#: Ranges at most.
FINEST = 2048
#: Rows for each task that numbers them, about.
TASK_ROWS = 500_000


def rank_of(index: Column, world: int) -> Column:
    """The rank that a strided deal gives a row to."""
    return F.pmod(index, F.lit(world)).cast("int")


def worker_of(index: Column, world: int, workers: int) -> tuple[Column, Column]:
    """(rank, worker) of a line under a stride of world x workers."""
    at = F.pmod(index, F.lit(world * workers))
    return F.floor(at / workers).cast("int"), F.pmod(at, F.lit(workers)).cast("int")


def shard_plan(files: Sequence[str], world: int) -> list[tuple[list[str], int, int]]:
    """(files, stride, offset) of each rank: whole files where there are at least
    two a rank, otherwise every file with its members dealt out."""
    if len(files) >= 2 * world:
        return [(list(files[r::world]), 1, 0) for r in range(world)]
    return [(list(files), world, r) for r in range(world)]


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def running_offset(df: DataFrame, order: Sequence[str], weight: Column, name: str = "offset") -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before it in ``order``.

    The first order column must be numeric; its approximate quantiles are the
    ranges' bounds, so a few far keys don't matter. Nulls come first. Ties in
    ``order`` are numbered in an arbitrary order.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, range_, own, sum_, base = fresh(df, "key", "range", "weight", "sum", "base")
    keyed = df.withColumn(at, F.col(order[0]).cast("double")).withColumn(own, weight)
    quantiles, rows = keyed.agg(F.expr(f"percentile_approx(`{at}`, array({', '.join(f'{k / FINEST}D' for k in range(1, FINEST))}), 10000)"), F.count(F.lit(1))).first()
    parts = max(partitions, -(-rows // TASK_ROWS))
    n = min(FINEST, parts * RANGES)
    bounds = [quantiles[k * FINEST // n - 1] for k in range(1, n)] if quantiles else []
    splits = [-float("inf"), *sorted({b for b in bounds if b == b and abs(b) != float("inf")}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=at, outputCol=range_, handleInvalid="keep").transform(keyed) if len(splits) > 2 else keyed.withColumn(range_, F.lit(0))
    ranged = ranged.withColumn(range_, F.when(F.col(at).isNull(), -1).otherwise(F.col(range_)).cast("int")).drop(at)
    sums = ranged.groupBy(range_).agg(F.sum(own).alias(sum_))
    before = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)  # over at most n + 2 rows
    bases = sums.select(range_, F.coalesce(F.sum(sum_).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # more rows take more tasks, not larger ones
    out = (ranged.repartition(parts, range_) if rows > TASK_ROWS else ranged).join(F.broadcast(bases), range_)
    return out.withColumn(name, (F.col(base) + F.coalesce(F.sum(own).over(within), F.lit(0))).cast("long")).drop(range_, own, base)


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """``df`` with 0..N-1 in ``order``."""
    return running_offset(df, order, F.lit(1).cast("long"), name)


def ratio_cut(df: DataFrame, order: Sequence[str], batch: int, ratio: float) -> DataFrame:
    """The longest row of whole batches whose running size is at most ratio x all.
    A ratio of 1 keeps all rows and needs no order."""
    if ratio >= 1:
        return df
    total = df.count()
    full = int(total * ratio + 1e-9) // batch * batch
    last = total // batch * batch  # the last, short batch begins here
    keep = full if full < last or total > total * ratio else total
    (idx,) = fresh(df, "idx")
    return dense_index(df, order, idx).where(F.col(idx) < keep).drop(idx)


def running_batches(df: DataFrame, order: Sequence[str], batch: int) -> DataFrame:
    """(batch, size, running): rows of each batch and up to its end."""
    sizes = dense_index(df, order, "_mr_idx").groupBy(batch_of(F.col("_mr_idx"), batch).alias("batch")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.select("batch", "size", (F.col("batch") * batch + F.col("size")).alias("running"))


def _cut(length: int, eos: int):
    """(at, ids) rows to (chunk, at, part): each row's ids and ``eos``, cut where samples end."""

    def run(it):
        for batch in it:
            at = batch.column(0).to_numpy()
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            if lists.null_count:
                size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, size)
            ends = np.cumsum(size)
            # every row's ids with eos behind them, one row after another
            ids = np.full(int(size.sum()) + len(at), eos, np.int32)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ids[np.arange(len(values)) + np.repeat(np.arange(len(at)), size)] = values
            start, full = ends - size + np.arange(len(at)), size + 1
            first, last = at // length, (at + full - 1) // length
            row = np.repeat(np.arange(len(at)), last - first + 1)
            chunk = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin = np.maximum(chunk * length - at[row], 0)
            cuts = np.append(start[row] + begin, len(ids)).astype(np.int32)  # parts follow one another without gaps
            yield pa.RecordBatch.from_pydict({"chunk": chunk, "at": at[row] + begin, "part": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))})

    return run


def pack_stream(df: DataFrame, order: Sequence[str], ids: Column, length: int, eos: int, count: Column | None = None) -> DataFrame:
    """(chunk, tokens): all ids, ``eos`` after each row's, in one stream cut into
    samples of ``length``; what is left at the end is dropped. Null ids count as none.

    ``count`` is the number of a row's ids, for where it costs less than the
    ids. A row is cut once for each sample that it reaches into, so that no row
    of the plan is a single token.
    """
    (name,) = fresh(df, "at")
    n = F.size(ids) if count is None else count
    at = running_offset(df, order, (F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) + 1).cast("long"), name)
    parts = at.select(name, ids.cast("array<int>").alias("ids")).mapInArrow(_cut(length, eos), "chunk long, at long, part array<int>")
    packed = parts.groupBy("chunk").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("tokens"))
    return packed.where(F.size("tokens") == length)


def split_parts(df: DataFrame, index: str, n: int) -> DataFrame:
    """``df`` with ``part``: N rows in n runs of ceil(N / n), the last one what is left."""
    per = max(1, -(-df.count() // n))
    return df.withColumn("part", F.least(F.floor(F.col(index) / per), F.lit(n - 1)).cast("int"))


def merge_ordered(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """UNION ALL with ``part`` (place in the list) and the dense ``sample_id`` by
    part and ``order``."""
    tagged = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    sizes = [p.count() for p in parts]
    out, base = [], 0
    for p, n in zip(tagged, sizes):
        (idx,) = fresh(p, "idx")
        out.append(dense_index(p, order, idx).withColumn("sample_id", F.col(idx) + base).drop(idx))
        base += n
    return reduce(DataFrame.unionByName, out)


def last_wins(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value) of the last row of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def all_done(df: DataFrame, group: str, done: Column) -> DataFrame:
    """Whether every row of a group is done."""
    return df.groupBy(group).agg(F.bool_and(done).alias("done"))


def tail(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


