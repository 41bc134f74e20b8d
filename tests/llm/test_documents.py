"""Operators over documents against brute force, and their defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, line_dedup, ngram_join
from millrace.llm.kernel import WORD_RE

SCHEMA = "doc_id bigint, text string, lang string, h string, _mr_x int, a int, id int, key string, line string"
WORDS = [a + b for a in ("tion", "ster", "ment", "ber", "lo", "vi", "quer", "das") for b in ("an", "er", "ou", "el", "ist", "ung", "ad", "ix", "om")]


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with inner ones."""
    rows = [(k if ids is None else ids[k], t, "en", "h", 1, 2, 3, "k", "l") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return WORD_RE.findall((t or "").lower())


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs, similarity=line_dedup.SIMILARITY, fuzzy=line_dedup.FUZZY_BYTES):
    """What stays of each (doc_id, text), by all pairs of lines."""
    places = [(d, k, words(x)) for d, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    places = sorted({(d, k, tuple(w)) for d, k, w in places if w})
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            b = places[j][2]
            ok = a == b
            if not ok and min(len(" ".join(a).encode()), len(" ".join(b).encode())) >= fuzzy:
                most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
                ok = abs(len(a) - len(b)) <= most and len(set(a) & set(b)) >= 0.5 * max(len(set(a)), len(set(b))) and distance(a, b) <= most
                if ok:
                    pairs.add((j, i))
            if ok:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(d, k) for i, (d, k, _) in enumerate(places) if find(i) != i}, len(pairs)


def test_lines_against_brute_force(spark):
    r = random.Random(11)
    base = [sentence(r, r.choice([3, 12, 25, 40, 60])) for _ in range(60)]
    lines = base + [edited(r, x, 1 + len(x.split()) // 30) for x in base for _ in range(3)] + [x.upper() + "!" for x in base[:20]] + [sentence(r, 30) for _ in range(40)]
    r.shuffle(lines)
    docs = [(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(-(-len(lines) // 5))]
    gone, pairs = brute_lines(docs)
    out = line_dedup.dedup_lines(table(spark, [t for _, t in docs])).collect()
    got = set()
    for row in out:
        left = row.text.split("\n") if row.n_removed < row.n_lines else []
        all_ = docs[row.doc_id][1].split("\n")
        k = 0
        for i, x in enumerate(all_):
            if k < len(left) and left[k] == x and (row.doc_id, i) not in got:
                k += 1
            else:
                got.add((row.doc_id, i))
        assert row.n_removed == len(all_) - len(left)
    assert pairs > 60 and len(got & gone) >= 0.9 * len(gone) and got <= gone


def test_line_cases(spark):
    long = "\n".join(["very long line " * 5000 + str(k) for k in range(2)])
    texts = ["a b\n\nA, b.\n...\nx", None, "", "x\n...\n", long, "a b", "solo"]
    df = table(spark, texts + ["solo"], ids=[0, 1, 2, 3, 4, 5, 6, 6])
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns + ["n_lines", "n_removed"]
    rows = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in out.collect()}
    assert rows == {
        (0, "a b\n\n...\nx"): (5, 1), (1, None): (None, None), (2, ""): (1, 0), (3, "...\n"): (3, 1),
        (4, long.split("\n")[0]): (2, 1), (5, ""): (1, 1), (6, "solo"): (1, 0),
    }
    assert out.count() == 8 and line_dedup.dedup_lines(df.limit(0)).count() == 0
    null_id = line_dedup.dedup_lines(table(spark, ["same line", "same line"], ids=[None, 3])).collect()
    assert {(r.doc_id, r.text) for r in null_id} == {(None, "same line"), (3, "")}


def shingles(t, n):
    w = words(t)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None


def brute_classes(docs, n, t):
    """(doc_id, class_id, n_links) of every row, by all pairs."""
    s = [shingles(x, n) for _, x in docs]
    root, links = list(range(len(s))), [0] * len(s)
    for i, x in enumerate(s):
        for j, y in enumerate(s[:i]):
            if x and y and len(x & y) >= t * len(x | y):
                links[i] += 1
                links[j] += 1
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for r, (d, _) in zip(root, docs):
        least[r] = min(d, least.get(r, d))
    return sorted((d, least[r], k) for (d, _), r, k in zip(docs, root, links))


def as_rows(df):
    assert df.columns == ["doc_id", "class_id", "n_links"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most_bytes, short_run, block", [(ngram_join.GROUP_BYTES, 8, 8192), (3000, 8, 8192), (ngram_join.GROUP_BYTES, 1, 4)])
def test_join_against_brute_force(spark, most_bytes, short_run, block):
    r = random.Random(5)
    base = [sentence(r, r.choice([1, 2, 3, 20, 80, 300])) for _ in range(25)]
    texts = base + [edited(r, x, r.choice([0, 1, len(x.split()) // 15])) for x in base for _ in range(4)] + [x + " " + sentence(r, 10) for x in base] + [base[-1]] * 30
    texts += [edited(r, base[3] + base[4], k) for k in range(0, 60, 2)]  # a family about the threshold
    docs = list(enumerate(texts))
    want = brute_classes(docs, ngram_join.N, ngram_join.THRESHOLD)
    assert sum(k for _, _, k in want) > 1000
    assert as_rows(ngram_join.ngram_join(table(spark, texts), most_bytes=most_bytes, short_run=short_run, block=block)) == want


@pytest.mark.parametrize("filter_bytes", [0, 20_000, 40_000])
def test_join_without_filters_of_low_levels(spark, filter_bytes):
    r = random.Random(21)
    base = [sentence(r, r.choice([3, 20, 80, 300])) for _ in range(12)]
    texts = base + [edited(r, x, len(x.split()) // r.choice([10, 15, 30])) for x in base for _ in range(5)]
    got = ngram_join.ngram_join(table(spark, texts), filter_bytes=filter_bytes)
    assert as_rows(got) == brute_classes(list(enumerate(texts)), ngram_join.N, ngram_join.THRESHOLD)


def test_only_ngrams_of_several_sets_are_shuffled(spark):
    """Of texts with n-grams of their own but a few, nothing goes to the runs; of a text and its copy, what both have does."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm import kernel as K

    r = random.Random(22)
    common = sentence(r, 6)
    texts = [sentence(r, 200) + " " + common for _ in range(40)]
    texts.append(edited(r, texts[0], 6))
    docs = table(spark, texts).selectExpr("doc_id", "text", "doc_id dk")
    numbers, _ = ngram_join._count(docs.select("text"), 3, ngram_join.FILTER_BYTES)
    rows = docs.mapInArrow(ngram_join._prefixes(3, 0.5, numbers, 8), ngram_join._SETS).collect()
    sent = np.concatenate([np.frombuffer(bytes(x.fps), np.int64) for x in rows if x.part is not None])
    fp = {x.doc_id: x.fp for x in rows if x.part is None}
    assert len(fp) == len(texts) and set(sent.tolist()) <= {fp[0], fp[40]} and len(sent) >= 2 * ngram_join.SHARED
    sets = [ngram_join.sets_of(*K.buffers(K.plain(pa.array([x]))), 3)[0] for x in texts]
    grams, count = np.unique(np.concatenate(sets), return_counts=True)
    level = numbers.of(grams)
    assert np.all(level >= np.searchsorted(ngram_join.LEVELS, count, side="right")) and (level[count == 1] > 0).mean() < 0.1
    places = np.unique(r.sample(range(1 << 26), 500) + [0, 65534, 65535, 65536])
    assert np.array_equal(ngram_join.unpacked(ngram_join.packed(places)), places)


def test_trie_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(40):
        sets = [np.unique(r.integers(0, 25, size=r.integers(1, 15)).astype(np.uint64)) for _ in range(12)]
        sets += [sets[0], sets[0][:1], np.unique(np.append(sets[1], np.uint64(99)))]
        probes = np.sort(r.choice(len(sets), 6, replace=False))
        for t in (0.2, 0.5, 0.9, 1.0):
            got = sorted((k, int(p), int(o)) for k, who, over in ngram_join.Trie(sets).search(probes, t) for p, o in zip(who, over) if k != p)
            pairs = [(k, int(p), len(np.intersect1d(s, sets[p]))) for k, s in enumerate(sets) for p in probes if k != p]
            assert got == [(k, p, o) for k, p, o in pairs if o >= t * (len(sets[k]) + len(sets[p]) - o) - 1e-9]


def test_join_cases(spark):
    texts = ["one two three four", "one two three four", None, "", "...", "one", "one", "x y z", "x y z"]
    df = table(spark, texts, ids=[0, 1, 2, 3, 4, 5, 6, None, 8]).withColumn("_mr_gone", F.lit(1)).withColumn("fp", F.lit(2))
    assert as_rows(ngram_join.ngram_join(df)) == [(0, 0, 1), (1, 0, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (8, 8, 0)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "2", "3", "4", "5", "None", "8"])
    assert ngram_join.ngram_join(df.limit(0)).count() == 0 == ngram_join.keep_one(df.limit(0)).count()
    again = table(spark, ["a b c d", "a b c d", "e f g h", "a b c d"], ids=[7, 7, 7, 9])
    assert as_rows(ngram_join.ngram_join(again)) == [(7, 7, 0), (7, 7, 2), (7, 7, 2), (9, 7, 2)]
    assert [r.doc_id for r in ngram_join.keep_one(again).collect()] == [7, 7, 7]
    long = "word " * 200_000
    assert as_rows(ngram_join.ngram_join(table(spark, [long, long + "end"]))) == [(0, 0, 1), (1, 0, 1)]  # one n-gram against two
    assert ngram_join.keep_one(table(spark, [long, long])).count() == 1


def test_groups_are_connected(spark):
    r = random.Random(9)
    chain = [sentence(r, 60)]
    for _ in range(8):
        chain.append(edited(r, chain[-1], 5))
    assert [x.doc_id for x in ngram_join.keep_one(table(spark, chain)).collect()] == [0]


def brute_leaks(docs, items, n, t):
    out = {}
    for i, x in items:
        w = words(x)
        m = min(n, len(w))
        grams = [tuple(w[k : k + m]) for k in range(len(w) - m + 1)] if w else []
        for d, y in docs:
            v = words(y)
            places = [(k, tuple(v[k : k + m])) for k in range(len(v) - m + 1)] if grams else []
            best = 0
            for p, g in places:
                if g in grams:
                    best = max(best, len({q for k, q in places if p <= k < p + len(grams) and q in grams}))
            if grams and best >= t * len(set(grams)) - 1e-9 and best:
                out[d, i] = best / len(set(grams))
    return out


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_leaks_against_brute_force(spark, most_bytes):
    r = random.Random(2)
    items = [(k, sentence(r, n)) for k, n in enumerate([40, 40, 25, 9, 8, 3, 1])] + [(7, None), (8, ""), (9, "!"), (10, "a b " * 20)]
    texts = [sentence(r, 50) for _ in range(5)]
    for _, x in items[:7]:
        texts += [sentence(r, 30) + "\n" + x.upper() + " " + sentence(r, 9), sentence(r, 5) + edited(r, " " + x, 1), x[: len(x) // 2], x[: len(x) // 2] + " " + sentence(r, 80) + " " + x[len(x) // 2 :], x]
    texts += [None, "", "a b " * 15, items[0][1] + " " + items[1][1]]
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.containment for x in decontam.contaminated(table(spark, texts), bench, most_bytes=most_bytes).collect()}
    want = brute_leaks(docs, items, decontam.N, decontam.THRESHOLD)
    assert len(want) > 15 and got == pytest.approx(want)


def test_leak_cases(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "one two three four five six seven eight nine")], "item_id bigint, text string")
    text = "zero one two three four five six seven eight nine"
    df = table(spark, [text, text, None, "", "clean", text], ids=[0, 0, 1, 2, 3, None])
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(df, bench).collect()) == [("0", 1), ("0", 2), ("None", 1), ("None", 2)]
    left = decontam.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert decontam.contaminated(df.limit(0), bench).count() == 0 == decontam.contaminated(df, bench.limit(0)).count()
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == 6
    named = decontam.drop_contaminated(df.withColumn("_mr_dk", F.lit("own")).withColumn("GRAM", F.lit(3)), bench)
    assert sorted((r.doc_id, r["_mr_dk"], r["GRAM"]) for r in named.collect()) == [(k, "own", 3) for k in (1, 2, 3)]
    assert decontam.contaminated(df.withColumn("gram", F.lit(1)), bench.withColumn("gram", F.lit(2))).count() == 4


def test_pairs_of_a_long_run_come_in_bounded_batches():
    r = np.random.default_rng(3)
    n, most = 2000, 50_000
    fp, g, size, block = r.permutation(n), r.integers(0, 800, n), r.integers(100, 260, n).astype(np.int32), r.integers(0, 2, n).astype(np.int32)
    for q in (0, 1):
        one = np.zeros(n, np.int32)
        table = pa.table({"fp": fp, "g": g, "size": size, "most": np.full(n, 200), "block": block, "p": one, "q": one + q})
        out = list(ngram_join._across(0.5, most)(iter(table.to_batches())))
        assert len(out) > 1 and max(len(x) for x in out) < most + n
        got = sorted((a, b) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()))
        i, j = np.triu_indices(n, 1)
        ok = (g[i] != g[j]) & (np.minimum(size[i], size[j]) >= 0.5 * np.maximum(size[i], size[j])) & ((q == 0) | (block[i] != block[j]))
        assert got == sorted(zip(np.minimum(fp[i], fp[j])[ok].tolist(), np.maximum(fp[i], fp[j])[ok].tolist()))
