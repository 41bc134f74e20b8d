"""Row flow against lists."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import catalog_queries
from millrace.operators import flow
from millrace.operators.tokenizers import CodePoints, Merges, get_tokenizer
from millrace.plans.tasks import TextTask


@pytest.mark.parametrize("n,batch,ratio", [(10, 3, 0.6), (10, 3, 1), (10, 3, 0.2), (10, 5, 0.5), (0, 3, 0.5), (7, 7, 0.99), (10, 3, 0.95)])
def test_ratio_cut(spark, n, batch, ratio):
    got = sorted(r[0] for r in flow.ratio_cut(spark.range(n), ["id"], batch, ratio).collect())
    want, count = [], 0
    for lo in range(0, n, batch):
        rows = list(range(lo, min(n, lo + batch)))
        count += len(rows)
        if count > n * ratio:
            break
        want += rows
    assert got == want


def test_dense_index_and_offsets(spark):
    r = random.Random(2)
    keys = r.sample(range(-1000, 100000), 500)
    rows = [(k, r.randrange(5)) for k in keys]
    out = flow.running_offset(spark.createDataFrame(rows, "k bigint, w int"), ["k"], F.col("w").cast("long")).orderBy("k").collect()
    total = 0
    for row in out:
        assert row["offset"] == total
        total += row["w"]
    idx = flow.dense_index(spark.createDataFrame(rows, "k bigint, w int"), ["k"]).orderBy("k").collect()
    assert [x["idx"] for x in idx] == list(range(500))


def test_offsets_with_far_keys_nulls_and_clashing_names(spark):
    """One key far away doesn't put the others into one range; nulls come first."""
    keys = [None, None, *range(200), 10**15]
    df = spark.createDataFrame([(k, 1, 2) for k in keys], "k bigint, _mr_range int, _MR_weight int")
    out = flow.running_offset(df, ["k"], F.lit(3).cast("long"))
    assert out.columns == [*df.columns, "offset"]
    rows = out.collect()
    assert sorted(r["offset"] for r in rows) == [3 * k for k in range(203)]
    assert sorted(r["offset"] for r in rows if r.k is None) == [0, 3] and {r.k: r["offset"] for r in rows if r.k is not None} == {k: 3 * (i + 2) for i, k in enumerate(keys[2:])}
    assert flow.dense_index(df.limit(0), ["k"]).count() == 0
    assert [r["idx"] for r in flow.dense_index(df.where("k = 5"), ["k"]).collect()] == [0]


def test_shard_plans(spark):
    assert flow.shard_plan(list("abcd"), 2) == [(["a", "c"], 1, 0), (["b", "d"], 1, 0)]
    assert flow.shard_plan(list("abc"), 2) == [(list("abc"), 2, 0), (list("abc"), 2, 1)]
    rank, worker = flow.worker_of(F.col("id"), 2, 2)
    got = spark.range(8).select("id", rank.alias("r"), worker.alias("w")).collect()
    assert [(x.r, x.w) for x in got] == [((i % 4) // 2, i % 2) for i in range(8)]


def test_pack(spark):
    texts = ["ab", "", "cdefghij", "k"]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    eos = CodePoints()["</s>"]
    stream = [x for t in texts for x in [*map(ord, t), eos]]
    got = flow.pack_stream(df, ["i"], CodePoints().column(F.col("t")), 4, eos).orderBy("chunk").collect()
    assert [x["tokens"] for x in got] == [stream[k : k + 4] for k in range(0, len(stream) - 3, 4)]


def test_pack_long_rows_nulls_and_counts(spark):
    r = random.Random(3)
    rows = [(k, None if k % 9 == 4 else [r.randrange(99) for _ in range(r.choice([0, 1, 7, 40]))]) for k in range(60)]
    df = spark.createDataFrame(rows, "i bigint, ids array<int>")
    stream = [x for _, ids in rows for x in [*(ids or []), 500]]
    for count in (None, F.size("ids")):
        got = flow.pack_stream(df, ["i"], F.col("ids"), 16, 500, count).orderBy("chunk").collect()
        assert [x["tokens"] for x in got] == [stream[k : k + 16] for k in range(0, len(stream) - 15, 16)]
    assert flow.pack_stream(df.limit(0), ["i"], F.col("ids"), 16, 500).count() == 0


@pytest.mark.parametrize("n,parts", [(200, 5), (10, 3), (2, 4), (0, 2)])
def test_split_parts(spark, n, parts):
    got = {r["part"]: r["count"] for r in flow.split_parts(spark.range(n), "id", parts).groupBy("part").count().collect()}
    per = -(-n // parts)
    want = {k: (min(per, max(0, n - k * per)) if k < parts - 1 else max(0, n - k * per)) for k in range(parts)}
    assert got == {k: v for k, v in want.items() if v}


def test_merge_and_last_wins(spark):
    a, b = spark.range(3).toDF("x"), spark.range(10, 12).toDF("x")
    got = [(r.part, r.sample_id, r.x) for r in flow.merge_ordered([b, a], ["x"]).orderBy("sample_id").collect()]
    assert got == [(0, 0, 10), (0, 1, 11), (1, 2, 0), (1, 3, 1), (1, 4, 2)]
    rows = spark.createDataFrame([("k", "old", 0, 5), ("k", "new", 1, 0), ("j", "a", 0, 0)], "key string, text string, f int, p int")
    assert {(r.key, r.text) for r in flow.last_wins(rows, "key", "text", ["f", "p"]).collect()} == {("k", "new"), ("j", "a")}


def test_merges_tokenizer(spark):
    m = Merges({"a": 0, "b": 2, "ab": 3, "aba": 4}, [("a", "b"), ("ab", "a")])
    assert [m.encode(t) for t in ("aba", "abab", "a b", "a")] == [[4], [3, 3], [0, 1, 1, 2], [0]]
    assert m.decode([4, 2]) == "abab"
    with pytest.raises(IndexError):
        m.encode("")
    with pytest.raises(KeyError):
        m.decode([9])
    df = spark.createDataFrame([("abab",), (None,)], "t string")
    assert [r[0] for r in df.select(m.column(F.col("t"))).collect()] == [[3, 3], None]
    assert get_tokenizer() is get_tokenizer(None)


def test_merges_against_plain_merging():
    """Every occurrence of the least pair at a time, as by the definition."""
    r = random.Random(4)

    def plain(text, ranks):
        symbols = list(text)
        while pairs := [p for p in zip(symbols, symbols[1:]) if p in ranks]:
            a, b = min(pairs, key=ranks.get)
            out, k = [], 0
            while k < len(symbols):
                both = symbols[k : k + 2] == [a, b]
                out.append(a + b if both else symbols[k])
                k += 1 + both
            symbols = out
        return symbols

    for _ in range(200):
        pieces = list("abc")
        merges = []
        for _ in range(8):
            pair = (r.choice(pieces), r.choice(pieces))
            if pair not in merges:
                merges.append(pair)
                pieces.append("".join(pair))
        r.shuffle(merges)
        text = "".join(r.choices("abc", k=r.randrange(1, 40)))
        assert Merges({}, merges).tokenize(text) == plain(text, {m: k for k, m in enumerate(merges)})


def test_text_task(spark):
    rows = [(0, "  hello "), (1, ""), (2, "x")]
    df = spark.createDataFrame(rows, "idx bigint, value string")
    got = TextTask().plan(df, length_per_sample=2).orderBy("chunk").collect()
    eos = CodePoints()["</s>"]
    stream = [*map(ord, "hello"), eos, ord("x"), eos]
    assert [r.tokens for r in got] == [stream[k : k + 2] for k in range(0, len(stream), 2)]


def test_tasks_that_number_rows_dont_grow(spark, monkeypatch):
    monkeypatch.setattr(flow, "TASK_ROWS", 500, raising=False)
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") * 7919 % 20_000).alias("k"))
    out = flow.dense_index(df, ["k"])
    assert out.where("k <> idx").isEmpty()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2500


def test_words_are_counted_without_a_row_each(spark, tmp_path):
    texts = ["The other one\n THE on ", "", " ", None, "the the the"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(4, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog_queries.QUERIES["bpe_encode"](spark, str(tmp_path))
    # the | o the r | on e | the | on; the the the and x
    assert sorted(map(tuple, df.collect())) == [(0, 5, 8), (4, 4, 4)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("ArrowEvalPython") == 1
    m = Merges({}, [("a", "b")])
    lists = [["ab", "aab", "", None, "ab"], None, [], ["b"]]
    counted = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id int, w array<string>").coalesce(1).select("id", m.count_words(F.col("w")).alias("n")).orderBy("id")
    assert [tuple(r.n) for r in counted.collect()] == [(3, 4), (0, 0), (0, 0), (1, 1)]
