"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its word shingles. A document contains it if some
window of as many shingles as the item has holds at least ``threshold`` of them.
Shingles are ordered by rarity in the corpus; a window that contains enough of
an item must hold one of the item's first |item| - required + 1 shingles in
that order, so only those are joined. A candidate goes on if the document is
long enough for the required overlap (length bound) and if the join's place in
the item's order and in the document leave room for it (positional bounds);
then all windows are counted exactly.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .store import fits, fresh, keep

N = 5
THRESHOLD = 0.5


def _item_shingles(n):
    def run(it):
        for batch, data, offsets in K.batches(it):
            grams, at = K.Words(data, offsets).shingles(n)
            item = np.repeat(np.arange(len(at) - 1), np.diff(at))
            ids = batch.column(0).take(pa.array(item))
            size = np.array([len(np.unique(grams[at[d] : at[d + 1]])) for d in range(len(at) - 1)], np.int32)
            length = np.minimum(np.diff(at), 1 << 30).astype(np.int32)
            words = np.diff(K.Words(data, offsets).first).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"item_id": ids, "gram": grams.view(np.int64), "n_grams": size[item], "window": length[item], "short": words[item] < n, "words": words[item]})

    return run


def _hits(known, lengths, n):
    """Places of benchmark shingles in documents: ``known`` are sorted hashes,
    ``lengths`` the word counts of items shorter than a shingle."""

    def run(it):
        for batch, data, offsets in K.batches(it):
            words = K.Words(data, offsets)
            found = []
            for m in (n, *lengths):
                grams, at = words.shingles(m, whole=False)
                place = np.searchsorted(known, grams)
                place[place == len(known)] = 0
                hit = np.flatnonzero(known[place] == grams) if len(known) else np.empty(0, np.int64)
                doc = np.searchsorted(at, hit, side="right") - 1
                found.append((doc, hit - at[doc], grams[hit], np.diff(at)[doc]))
            doc, pos, gram, total = (np.concatenate(x) for x in zip(*found))
            ids = batch.column(0).take(pa.array(doc.astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"dk": batch.column(2).take(pa.array(doc.astype(np.int64))), "doc_id": ids, "gram": gram.view(np.int64), "pos": pos.astype(np.int32), "total": total.astype(np.int32)})

    return run


def _all_grams(n, lengths):
    def run(it):
        for batch, data, offsets in K.batches(it):
            words = K.Words(data, offsets)
            for m in (n, *lengths):
                grams, at = words.shingles(m, whole=False)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                yield pa.RecordBatch.from_pydict({"dk": batch.column(2).take(pa.array(doc)), "doc_id": batch.column(0).take(pa.array(doc)), "gram": grams.view(np.int64), "pos": (np.arange(len(grams)) - at[doc]).astype(np.int32), "total": np.diff(at)[doc].astype(np.int32)})

    return run


def best_window(pos: np.ndarray, gram: np.ndarray, window: int) -> tuple[int, int]:
    """The most distinct shingles in a window of positions, and its first hit."""
    order = np.argsort(pos, kind="stable")
    pos, gram = pos[order], gram[order]
    count: dict[int, int] = {}
    best, at, lo = 0, 0, 0
    for hi in range(len(pos)):
        count[gram[hi]] = count.get(gram[hi], 0) + 1
        while pos[hi] - pos[lo] >= window:
            count[gram[lo]] -= 1
            if not count[gram[lo]]:
                del count[gram[lo]]
            lo += 1
        if len(count) > best:
            best, at = len(count), int(pos[lo])
    return best, at


def _verify(threshold):
    def run(table: pa.Table) -> pa.Table:
        need, window, size = table.column("need")[0].as_py(), table.column("window")[0].as_py(), table.column("n_grams")[0].as_py()
        best, at = best_window(np.asarray(table.column("pos")), np.asarray(table.column("gram")), window)
        ok = best >= need
        return pa.table({"doc_id": table.column("doc_id").slice(0, ok), "dk": table.column("dk").slice(0, ok), "item_id": table.column("item_id").slice(0, ok), "containment": pa.array([best / size][:ok], pa.float64()), "at_word": pa.array([at][:ok], pa.int32())})

    return run


def _matches(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, most_bytes: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    grams = keep(items.mapInArrow(_item_shingles(n), "item_id long, gram long, n_grams int, window int, short boolean, words int"), "item-grams")
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk")).where("text is not null")
    lengths = tuple(sorted(r[0] for r in grams.where("short").select("words").distinct().collect()))
    known = grams.select("gram").distinct()
    if fits(known, 8, most_bytes):
        table = np.sort(known.toArrow().column(0).to_numpy().view(np.uint64))
        hits = own.mapInArrow(_hits(table, lengths, n), "dk long, doc_id long, gram long, pos int, total int")
    else:
        hits = own.mapInArrow(_all_grams(n, lengths), "dk long, doc_id long, gram long, pos int, total int").join(known, "gram", "left_semi").select("dk", "doc_id", "gram", "pos", "total")
    hits = keep(hits, "hits")
    rarity = hits.groupBy("gram").agg(F.countDistinct("dk").alias("df"))
    need = F.ceil(F.col("n_grams") * threshold - 1e-9).cast("int")
    distinct = grams.groupBy("item_id", "gram").agg(F.max("n_grams").alias("n_grams"), F.max("window").alias("window")).withColumn("need", need)
    # A shingle that no document has can't be joined, so it comes first: it uses
    # up the prefix without a row.
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    ranked = keep(distinct.join(rarity, "gram", "left").withColumn("rank", order - 1), "item-ranks")
    prefix = ranked.where("rank <= n_grams - need").select("item_id", "gram", "rank", "need", "n_grams", "window")
    near = hits.join(prefix, "gram")
    # length bound: shingles of the document; positional bounds: what is left of
    # the item's order from this shingle on (it is the first one that matches for
    # some such row) and of the document within a window of this place.
    room = F.least("total", F.col("pos") + F.col("window")) - F.greatest(F.lit(0), F.col("pos") - F.col("window") + 1)
    near = near.where("total >= need and n_grams - rank >= need").where(room >= F.col("need"))
    candidates = near.select("dk", "item_id").distinct()
    full = candidates.join(ranked.select("item_id", "gram", "need", "n_grams", "window"), "item_id").join(hits, ["dk", "gram"])
    return keep(full.select("dk", "doc_id", "item_id", "gram", "pos", "need", "n_grams", "window").groupBy("dk", "item_id").applyInArrow(_verify(threshold), "doc_id long, dk long, item_id long, containment double, at_word int"), "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, containment, at_word) of every document that contains an item.

    ``containment`` is the largest share of the item's distinct shingles in one
    window; ``at_word`` is the window's first matching word. Benchmark shingles
    of at most ``most_bytes`` are broadcast; beyond that the documents' shingles
    are joined to them by a shuffle, with equal results.

    Defined cases: an item of 1..n-1 words is one shingle of that many words;
    null, empty and wordless items and texts match nothing; repeated documents
    each have their row once per distinct (doc_id, text); items with equal texts
    match alike; an item_id that repeats is the union of its texts; a null
    doc_id is reported as null; other columns are ignored.
    """
    return _matches(docs, benchmark, n, threshold, most_bytes).select("doc_id", "item_id", "containment", "at_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most_bytes: int = 64 << 20) -> DataFrame:
    """The documents that contain no benchmark item, with their columns, whatever their names."""
    (name,) = fresh(docs, "dk")
    gone = keep(_matches(docs, benchmark, n, threshold, most_bytes).select(F.col("dk").alias(name)).distinct(), "contaminated-ids")
    side = F.broadcast(gone) if fits(gone, 16) else gone
    return docs.join(side, F.xxhash64(docs["doc_id"], docs["text"]) == gone[name], "left_anti")
