"""Models, filters, codecs and files: exact round trips and held-out accuracy."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, quality_mil, quality_rules, toxicity, url_filter, warc
from millrace.llm import kernel as K

SF = "/root/testdata/sf0.01"
ODD = ["", None, "...", "x", "word " * 100_000, "é漢字😀", "same", "same"]


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def odd(spark):
    names = "score string, y int, x int, toxic string, keep string, tokens string, language string, listed string"
    return spark.createDataFrame([(k if k else None, t, "a", 1, 2, "b", "c", "d", "e", "f") for k, t in enumerate(ODD)], "doc_id bigint, text string, " + names)


def test_toxicity(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~part))
    truth = labels.where(part).withColumnRenamed("toxic", "truth")
    rows = toxicity.score(docs.join(truth, "doc_id").select("doc_id", "text"), model).join(truth, "doc_id").select("truth", "toxic").collect()
    hit = sum(r.truth and r.toxic for r in rows)
    assert hit >= 0.75 * sum(r.truth for r in rows) and sum(r.toxic for r in rows) <= 1.1 * hit + 3
    assert len(model.index) < 0.2 * (1 << toxicity.BITS)
    df = odd(spark)
    out = toxicity.score(df, model)
    assert out.count() == len(ODD) and toxicity.score(df.limit(0), model).count() == 0
    assert len({r.toxic_score for r in out.where("text is null or text in ('', '...')").collect()}) == 1
    assert toxicity.drop_toxic(docs.limit(5), labels).columns == docs.columns
    assert toxicity.fit(docs, labels.limit(0)).bias == 0


def test_threshold():
    assert toxicity.best_threshold(np.array([3.0, 1, -1]), np.array([1, 1, 0])) == 0
    assert toxicity.best_threshold(np.array([]), np.array([])) == 0


def test_quality_rules(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    forest = quality_rules.fit(docs, labels.where(~part))
    rows = quality_rules.score(docs.join(labels.where(part), "doc_id").select("doc_id", "text"), forest).join(labels, "doc_id").select("quality", "keep").collect()
    assert sum(bool(r.quality) == r.keep for r in rows) >= 0.95 * len(rows)
    df = odd(spark)
    assert quality_rules.score(df, forest).count() == len(ODD) and quality_rules.score(df.limit(0), forest).count() == 0
    empty = {r.quality_score for r in quality_rules.score(df, forest).where("text is null or text = ''").collect()}
    assert len(empty) == 1
    assert quality_rules.fit(docs, labels.limit(0)).score(np.zeros((1, len(quality_rules.FEATURES)))).shape == (1,)


def test_forest_is_monotonic_and_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3)).astype(np.float32)
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=800) * 0.5 > 0).astype(float)
    f = quality_rules.boost(x, y, [1, 0, -1], trees=20)
    for k, d in ((0, 1), (2, -1)):
        z = np.repeat(x[:100], 41, axis=0).reshape(100, 41, 3)
        z[..., k] = np.linspace(-3, 3, 41)
        s = f.score(z.reshape(-1, 3)).reshape(100, 41)
        assert (np.diff(s, axis=1) * d >= -1e-9).all()

    def walk(row, k):
        while f.left[k] != k:
            k = f.right[k] if row[f.feature[k]] > f.cut[k] else f.left[k]
        return f.value[k]

    assert np.allclose(f.score(x[:50]), [f.base + sum(walk(r, k) for k in f.roots) for r in x[:50]])
    assert ((f.score(x) > 0) == (y > 0)).mean() > 0.8


def test_statistics():
    text = "The CAT sat.\nthe cat sat\n\n#1|é"
    data, offsets = K.buffers(K.plain(pa.array([text, ""])))
    x = dict(zip(quality_rules.FEATURES, quality_rules.statistics(data, offsets)[0]))
    n = len(text.encode())
    assert x["words"] == pytest.approx(np.log1p(8)) and x["upper"] == pytest.approx(4 / n) and x["symbols"] == pytest.approx(1 / n)
    assert x["distinct_words"] == pytest.approx(5 / 8) and x["repeated_lines"] == pytest.approx(1 / 3) and x["bars"] == pytest.approx(1 / n)
    assert (quality_rules.statistics(data, offsets)[1] == 0).sum() >= len(x) - 1


def test_quality_mil(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    net = quality_mil.fit(docs, labels.where(~part), per_class=400)
    rows = quality_mil.score(docs.join(labels.where(part), "doc_id").select("doc_id", "text"), net).join(labels, "doc_id").select("quality", "keep", "top_attention", "passages").collect()
    assert sum(bool(r.quality) == r.keep for r in rows) >= 0.93 * len(rows)
    assert all(1 / r.passages - 1e-5 <= r.top_attention <= 1 + 1e-5 for r in rows)
    df = odd(spark)
    out = quality_mil.score(df, net)
    assert [r.passages for r in out.where("doc_id = 4").collect()] == [-(-100_000 // 64)]
    assert out.count() == len(ODD) and quality_mil.score(df.limit(0), net).count() == 0


def test_mil_gradients():
    rng = np.random.default_rng(1)
    f = quality_mil.BUCKETS + quality_mil.KINDS
    net = quality_mil.Net(*(rng.normal(size=s) * 0.3 for s in ((f, quality_mil.WIDTH), (quality_mil.WIDTH,), (quality_mil.WIDTH, quality_mil.GATE), (quality_mil.WIDTH, quality_mil.GATE), (quality_mil.GATE,), (quality_mil.WIDTH + 1,))))
    x, first, y = rng.normal(size=(9, f)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])

    def loss():
        s = net.forward(x, first)[0]
        return np.mean(np.log1p(np.exp(-s)) * y + np.log1p(np.exp(s)) * (1 - y)) + 0.5e-4 * (net.w**2).sum()

    for p, g in zip((net.w, net.b, net.v, net.u, net.a, net.o), net.gradients(x, first, y)):
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_language(spark):
    docs, _ = documents(spark)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = langid.fit(docs.where(~part))
    rows = langid.identify(docs.where(part), model).where("n_chars >= 40").select("lang", "language").collect()
    assert sum(r.lang == r.language for r in rows) >= 0.97 * len(rows)
    df = odd(spark)
    got = {r.doc_id: r.language for r in langid.identify(df, model).collect()}
    assert got[1] is None and got[2] is None and got[6] == got[7] is not None
    assert langid.identify(df.limit(0), model).count() == 0
    assert all(r.language is None for r in langid.identify(df, langid.fit(docs.limit(0))).collect())


def test_backoff_takes_the_longest_known_grams():
    data = b"abc"
    words = K.Words(np.frombuffer(data, np.uint8), np.array([0, 3]))

    def key(s):
        h, _ = langid.word_grams(np.frombuffer(data, np.uint8), np.array([0]), np.array([3]), len(s))
        return h[" abc ".index(s)]

    grams = sorted([(key(" ab"), -1.0), (key("bc "), -3.0)])  # no longer ones are known
    one, _ = langid.word_grams(np.frombuffer(b"b", np.uint8), np.array([0]), np.array([1]), 1)
    keys = np.array([g for g, _ in grams], np.uint64)
    m = langid.Model(["x"], np.empty(0, np.uint64), np.empty((0, 1), np.float32), keys, np.array([[s] for _, s in grams], np.float32))
    got, _ = langid.word_grams(np.frombuffer(data, np.uint8), words.start, words.size, 3)
    assert len(got) == 3 and len(one) == 3
    assert langid.word_scores(m, np.frombuffer(data, np.uint8), words)[0, 0] == pytest.approx(-2 * langid.PENALTY**2)
    known = langid.Model(["x"], words.hash, np.array([[-0.25]], np.float32), keys, m.gram_scores)
    assert langid.word_scores(known, np.frombuffer(data, np.uint8), words)[0, 0] == -0.25


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip_and_ids(codec, text):
    text = text.encode("utf-8", "ignore").decode()
    want = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary(text)
    assert codec.ids(text).tolist() == want and codec.text(codec.ids(text)) == text


def test_bpe_pieces_by_brute_force(codec):
    r = random.Random(1)
    for _ in range(300):
        piece = "".join(r.choice("aeiou thnsr é猫") for _ in range(r.randrange(1, 25))).encode()
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            ranks = [(codec.ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in codec.ranks]
            if not ranks:
                break
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert bpe.encode_piece(piece, codec.ranks) == [codec.ranks[p] for p in parts]


def test_bpe_short_pieces_are_encoded_together(codec, monkeypatch):
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("aeiou thnsr é猫0.") for _ in range(r.randrange(1, n))) for _ in range(60)) for n in (4, 12, 30, 50) for _ in range(5)]
    texts += ["", "a", "x" * 300, " " * 90 + "b", "nnnnnnnn" * 6]
    want = [[t for p in codec.cut(text) for t in bpe.encode_piece(p.encode(), codec.ranks)] for text in texts]
    alone, one = [], bpe.encode_piece
    monkeypatch.setattr(bpe, "encode_piece", lambda piece, ranks: alone.append(piece) or one(piece, ranks))
    for cache in (bpe.CACHE, 100):
        monkeypatch.setattr(bpe, "CACHE", cache)
        own = bpe.Codec(codec.ranks)
        assert [x.tolist() for x in own.all_ids(texts)] == want
        assert alone and all(len(p) >= bpe._LONG for p in alone)
        for text, ids in zip(texts * 2, want * 2):
            assert own.all_ids([text])[0].tolist() == ids
        alone.clear()


def test_bpe_tables(spark):
    df = odd(spark)
    out = bpe.encode(df).select("doc_id", "text", "tokens", "n_tokens", "round_trip")
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].tokens is None and rows[1].n_tokens is None and rows[1].round_trip is None and rows[None].tokens == []
    assert all(r.round_trip and len(r.tokens) == r.n_tokens for r in rows.values() if r.text is not None)
    assert [(r.doc_id, r.text) for r in bpe.decode(out.drop("text").orderBy("doc_id")).orderBy("doc_id").collect()] == [(r.doc_id, r.text) for r in out.orderBy("doc_id").collect()]
    assert bpe.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("listed,others", [(0, 50), (50, 0), (1, 1), (3000, 20000), (20000, 300)])
def test_cascade_is_exact(listed, others):
    keys = np.unique(np.random.default_rng(listed).integers(0, 1 << 63, size=listed + others).astype(np.uint64))
    np.random.default_rng(1).shuffle(keys)
    levels = url_filter.build(keys[:listed], keys[listed:])
    assert (url_filter.member(keys, levels) == (np.arange(len(keys)) < listed)).all()
    if listed == 3000:
        assert len(levels) > 2 and sum(len(b) for _, _, b in levels) < listed * 8


@pytest.mark.parametrize("options", [{}, {"most_bytes": 0}, {"shard_keys": 40}, {"most_bytes": 0, "shard_keys": 40}])
def test_marks(spark, options):
    keys = [f"host{k}/p" for k in range(300)] + [None, "", "", "host1/p"]
    rows = spark.createDataFrame([(k, x, "old") for k, x in enumerate(keys)], "id int, key string, listed string")
    listed = spark.createDataFrame([(f"host{k}/p",) for k in range(0, 400, 3)] + [("",), (None,)], "key string")
    got = {r.id: r.listed for r in url_filter.mark_listed(rows, "key", listed, **options).collect()}
    assert got == {k: x is not None and (x == "" or int(x[4:-2]) % 3 == 0) for k, x in enumerate(keys)}
    assert url_filter.mark_listed(rows.limit(0), "key", listed, **options).count() == 0
    assert not any(r.listed for r in url_filter.mark_listed(rows, "key", listed.limit(0), **options).collect())


def test_url_keys(spark):
    urls = ["HTTP://www.A.com:80/x.html?q#f", "https://a.com/x/", " a.com/x ", None, "", "ftp://b.org", "http://c.net/#top"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").orderBy("k")
    assert [r[0] for r in df.select(url_filter.url_key("u")).collect()] == ["a.com/x", "a.com/x", "a.com/x", None, "", "b.org", "c.net"]


def record(k, body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, extra, len(body), body)


def test_warc_members(tmp_path):
    rng = random.Random(1)
    bodies = [b"", b"a\r\n\r\nWARC/1.0\r\n", bytes(rng.randrange(256) for _ in range(3_000_000)), b"end"]
    records = [record(k, b, b"X-Odd: 1\r\nX-Odd: 2\r\n") for k, b in enumerate(bodies)]
    for stream in (gzip.compress(b"".join(records)), gzip.compress(records[0] + records[1][:20]) + gzip.compress(records[1][20:] + records[2] + records[3]) + b"\0" * 9):
        out = io.BytesIO()
        rows = list(warc.normalise_file(io.BytesIO(stream), out))
        data = out.getvalue()
        assert [zlib.decompress(data[r[1] : r[1] + r[2]], 31) for r in rows] == records
        assert [r[6] for r in rows] == [len(b) for b in bodies] and sum(r[2] for r in rows) == len(data)
        assert gzip.decompress(data) == b"".join(records)
    assert list(warc.normalise_file(io.BytesIO(gzip.compress(b"")), io.BytesIO())) == [] == list(warc.normalise_file(io.BytesIO(b""), io.BytesIO()))
    for bad in (gzip.compress(records[2])[:-500], gzip.compress(records[3][:-6]), gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises((EOFError, ValueError, zlib.error)):
            list(warc.normalise_file(io.BytesIO(bad), io.BytesIO()))


def test_warc_pages(spark, tmp_path):
    html = ["<p>x</p>", "", None, "é\r\n\r\n漢" * 50_000, "dup", "dup"]
    pages = spark.createDataFrame([(k if k < 5 else 4, None if k == 1 else f"http://h/{k}", h, 1) for k, h in enumerate(html)] + [(None, "u", "gone", 1)], "page_id bigint, url string, html string, file int")
    got = sorted((r.page_id, r.url or "", r.html_bytes) for r in warc.pages_round_trip(pages).collect())
    assert got == sorted((k if k < 5 else 4, "" if k == 1 else f"http://h/{k}", len((h or "").encode())) for k, h in enumerate(html))
    assert warc.pages_round_trip(pages.limit(0)).count() == 0
    target = str(tmp_path / "m")
    files = warc.write_monolithic(pages.where("page_id is not null").coalesce(1), str(tmp_path / "in"))
    index = warc.normalise(spark, files, target)
    side = spark.read.parquet(f"{target}/*.idx.parquet")
    assert side.exceptAll(index).count() == 0 and side.count() == index.count() == 6 and warc.normalise(spark, [], target).count() == 0


def test_warc_records_of_other_types(spark, tmp_path):
    """Bytes come back as they were; files of one name in two folders stay apart."""
    raw = bytes(range(256)) + b"\r\n\r\n" + bytes(range(255, -1, -1))
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + raw
    records = [("warcinfo", "application/warc-fields", b"software: x\r\n"), ("resource", "image/png", raw), ("response", "application/http; msgtype=response", http), ("metadata", "", b"")]
    sources = []
    for k in range(2):
        (tmp_path / f"in{k}").mkdir()
        body = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Type: %s\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (t.encode(), c.encode(), k, len(b), b) for t, c, b in records)
        (tmp_path / f"in{k}" / "a.warc.gz").write_bytes(gzip.compress(body))
        sources.append(str(tmp_path / f"in{k}" / "a.warc.gz"))
    index = warc.normalise(spark, sources, str(tmp_path / "out"))
    assert index.select("file").distinct().count() == 2
    got = sorted((r.record_id, r.type, bytes(r.payload)) for r in warc.read_records(index).collect())
    assert got == sorted((f"<{k}>", t, raw if t == "response" else b) for k in range(2) for t, _, b in records)
    assert {(r.payload_bytes, r.payload_md5) for r in index.collect()} == {(len(x), hashlib.md5(x).hexdigest()) for x in (b"software: x\r\n", raw, b"")}
    with pytest.raises(ValueError):
        warc.normalise(spark, sources[:1] * 2, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.normalise_file(io.BytesIO(gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")), io.BytesIO()))


@pytest.mark.parametrize("options", [{}, {"most_bytes": 0, "shard_keys": 3}])
def test_listed_with_clashing_names(spark, options):
    rows = spark.createDataFrame([(k % 7, "s", k, "x", None) for k in range(21)] + [(None, "s", 1, "x", True)], "key int, shard string, _mr_h int, H string, listed boolean").withColumn("key", F.col("key").cast("string"))
    listed = spark.createDataFrame([("3",), ("5",), (None,), ("99",)], "key string")
    out = url_filter.mark_listed(rows, "key", listed, **options)
    assert out.columns == ["key", "shard", "_mr_h", "H", "listed"]
    got = sorted((r.key or "", r["_mr_h"], r.listed) for r in out.collect())
    assert got == sorted([(str(k % 7), k, k % 7 in (3, 5)) for k in range(21)] + [("", 1, False)])
