"""URL filters by Bloom filter cascades.

Level 1 encodes the listed keys. The keys of the universe that it accepts
wrongly are encoded by level 2, the listed keys that level 2 accepts by level 3,
and so on until no key is left. A key is listed if the number of levels that
accept it in a row is odd. For keys of the universe this is exact, and takes a
few bits a key instead of the keys.

Keys are split by hash into shards with a cascade each, built in parallel by
one task a shard. Cascades of up to ``most_bytes`` in all are broadcast; beyond that the
distinct keys' hashes are sent to their shards, and the listed ones are joined to the rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fits, fresh, keep

#: Keys of the universe for each shard.
SHARD_KEYS = 1_000_000
FIRST_RATE, RATE = 0.05, 0.5


def url_key(url):
    """A URL without scheme, port, ``www.``, query, fragment, final slash and
    ``.html``, in lower case; null for null."""
    key = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    key = F.regexp_replace(F.regexp_replace(key, r"[?#].*$", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(key, r"^([^/:]*):[0-9]+", "$1"), r"(\.html)?/*$", "")


def url_host(key):
    return F.substring_index(key, "/", 1)


def _bits(n: int, rate: float) -> tuple[int, int]:
    m = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return -(-m // 64) * 64, max(1, round(m / max(n, 1) * math.log(2)))


def _places(keys: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    """(k, n) bit places by double hashing of 64-bit keys."""
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return (a[None, :] + np.arange(k, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(m)


def _accepts(keys, level, m, k, bits: np.ndarray) -> np.ndarray:
    at = _places(keys, level, m, k)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build(listed: np.ndarray, others: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels (m, k, bits) for disjoint arrays of 64-bit keys."""
    levels, inside, outside = [], listed, others
    while len(inside):
        m, k = _bits(len(inside), FIRST_RATE if not levels else RATE)
        bits = np.zeros(m, bool)
        bits[_places(inside, len(levels), m, k).ravel().astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little")
        wrong = outside[_accepts(outside, len(levels), m, k, packed)] if len(outside) else outside
        levels.append((m, k, packed))
        inside, outside = wrong, inside
    return levels


def member(keys: np.ndarray, levels) -> np.ndarray:
    """Whether each key of the universe is listed."""
    passed, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level, (m, k, bits) in enumerate(levels):
        if not len(alive):
            break
        alive = alive[_accepts(keys[alive], level, m, k, bits)]
        passed[alive] += 1
    return passed % 2 == 1


def _build(table: pa.Table) -> pa.Table:
    keys, listed = np.asarray(table.column("h")).view(np.uint64), np.asarray(table.column("listed").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
    levels = build(np.unique(keys[listed]), np.unique(keys[~listed]))
    n = len(levels)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()), "level": pa.array(range(n), pa.int32()), "m": pa.array([x[0] for x in levels], pa.int64()), "k": pa.array([x[1] for x in levels], pa.int32()), "bits": pa.array([x[2].tobytes() for x in levels], pa.binary())})


def _levels(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for shard, _, m, k, bits in sorted(zip(*(rows.column(c).to_pylist() for c in ("shard", "level", "m", "k", "bits"))), key=lambda r: r[:2]):
        out.setdefault(shard, []).append((m, k, np.frombuffer(bits, np.uint8)))
    return out


def _lookup(cascades: dict[int, list], shards: int):
    def run(it):
        for batch in it:
            h = batch.column(batch.num_columns - 1)
            null = h.is_null().to_numpy(zero_copy_only=False)
            keys = np.ascontiguousarray(h.fill_null(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            shard, out = keys % np.uint64(shards), np.zeros(len(keys), bool)
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                out[rows] = member(keys[rows], cascades.get(int(s), []))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out & ~null)], names=[*batch.schema.names[:-1], "listed"])

    return run


def _routed(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The listed ones of a shard's keys."""
    h = left.column("h").combine_chunks()
    levels = _levels(right)
    return pa.table({"h": h.filter(pa.array(member(np.ascontiguousarray(h.to_numpy()).view(np.uint64), next(iter(levels.values()), []))))})


def _shard(h: str, shards: int):
    """The unsigned hash modulo shards."""
    return F.expr(f"cast(cast({h} as decimal(20)) + if({h} < 0, 18446744073709551616BD, 0BD) as decimal(20)) % {shards}").cast("int")


def cascade(universe: DataFrame, listed: DataFrame, shards: int) -> DataFrame:
    """(shard, level, m, k, bits) over one-column tables of string keys."""
    u, l = universe.columns[0], listed.columns[0]
    keys = universe.select(F.xxhash64(u).alias("h"), F.lit(False).alias("listed"), F.col(u).alias("key")).union(listed.select(F.xxhash64(l), F.lit(True), F.col(l))).where("key is not null")
    keys = keys.groupBy("h").agg(F.max("listed").alias("listed")).withColumn("shard", _shard("h", shards))
    return keep(keys.groupBy("shard").applyInArrow(_build, "shard int, level int, m long, k int, bits binary"), "cascade")


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, most_bytes: int = 64 << 20, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``rows`` with ``listed``: whether the key column is among the listed keys.

    The universe is all keys of ``rows``, so the answer is exact up to equal
    64-bit hashes. Defined cases: a null key isn't listed; null listed keys are
    ignored; listed keys that no row has only take space; without listed keys
    nothing is listed; a column named listed is replaced, all others pass through
    whatever their names; repeated rows stay. An empty table gives an empty table.
    """
    own = rows.drop("listed")
    universe = own.select(key).distinct()
    shards = max(1, -(-own.select(F.approx_count_distinct(key)).first()[0] // shard_keys))
    filters = cascade(universe, listed, shards)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", listed boolean"
    (name,) = fresh(own, "h")
    hashed = own.withColumn(name, F.when(F.col(key).isNotNull(), F.xxhash64(key)))
    total = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if total <= most_bytes:
        return hashed.mapInArrow(_lookup(_levels(filters.toArrow()), shards), schema)
    # only distinct keys go to the shards; the listed ones come back to the rows
    keys = universe.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).distinct().withColumn("shard", _shard("h", shards))
    found = keep(keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_routed, "h long"), "listed").withColumnRenamed("h", name)
    found = found.withColumn("listed", F.lit(True))
    out = hashed.join(F.broadcast(found) if fits(found, 16) else found, name, "left")
    return out.select(*own.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
