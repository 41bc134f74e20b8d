"""Models and scores against plain Python, and the fits' defined cases."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm import langid, quality_mil, quality_rules, toxicity
from millrace.llm.kernel import WORD_RE

TEXTS = [
    "", "...", "Hello, World!\nhello world\n\nHello,  world!", "ÄÖÜ straße 漢字 été\tx|y|z", "a b c aa bbb 12 345 $%& <b>",
    "One two three four five six seven eight nine ten. " * 30, "line\n" * 20, "| |\n||", "MIXED Case 99 bottles; of (beer) [on] the-wall 'x'",
]


def raw(texts):
    return K.buffers(K.plain(pa.array(texts)))


def plain_statistics(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = WORD_RE.findall(low)
    lines = [tuple(WORD_RE.findall(x)) for x in low.split("\n")]
    used = [x for x in lines if x]
    b = t.encode()
    share = lambda s: sum(x in s for x in b) / max(len(b), 1)
    ratio = lambda x: x / max(len(words), 1)
    return {
        "words": math.log1p(len(words)), "word_bytes": ratio(sum(len(w.encode()) for w in words)), "letters": share(b"abcdefghijklmnopqrstuvwxyz"), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share(b"0123456789"), "symbols": share(b"#$%&*+<=>@\\^_`{}~/!"), "punctuation": share(b".,;:?'\"()-[]"), "non_ascii": share(range(128, 256)), "spaces": share(b" \t\r\n\x0b\x0c"),
        "lines": math.log1p(len(lines)), "line_words": len(words) / max(len(used), 1), "distinct_words": ratio(len(set(words))), "repeated_lines": 1 - len(set(used)) / len(used) if used else 0,
        "short_words": ratio(sum(len(w.encode()) <= 3 for w in words)), "bars": share(b"|"),
    }


def test_statistics():
    got = quality_rules.statistics(*raw(TEXTS))
    for row, t in zip(got, TEXTS):
        want = plain_statistics(t)
        assert list(want) == list(quality_rules.FEATURES)
        assert dict(zip(want, row.tolist())) == pytest.approx(want, abs=1e-5), t


def test_attention_scores():
    r = np.random.default_rng(2)
    f, w, g = quality_mil.BUCKETS + quality_mil.KINDS, quality_mil.WIDTH, quality_mil.GATE
    net = quality_mil.Net(*(r.normal(0, 0.4, s) for s in ((f, w), w, (w, g), (w, g), g, w + 1)))
    texts = [t for t in TEXTS if t] + [" ".join(f"w{k % 37}" for k in range(200))]
    x, first = quality_mil.passages(*raw(texts))
    assert np.diff(first).tolist() == [max(1, -(-len(WORD_RE.findall(t.lower())) // quality_mil.PASSAGE)) for t in texts]
    scores, alpha, _ = net.forward(x, first)
    for d, (lo, hi) in enumerate(zip(first, first[1:])):
        hidden = [[math.tanh(sum(x[p][k] * net.w[k][j] for k in range(f)) + net.b[j]) for j in range(w)] for p in range(lo, hi)]
        energy = []
        for h in hidden:
            energy.append(sum(math.tanh(sum(h[j] * net.v[j][q] for j in range(w))) / (1 + math.exp(-sum(h[j] * net.u[j][q] for j in range(w)))) * net.a[q] for q in range(g)))
        weight = [math.exp(e) for e in energy]
        weight = [e / sum(weight) for e in weight]
        assert alpha[lo:hi] == pytest.approx(weight)
        bag = [sum(a * h[j] for a, h in zip(weight, hidden)) for j in range(w)]
        assert scores[d] == pytest.approx(sum(b * o for b, o in zip(bag, net.o[:-1])) + net.o[-1])


def plain_ftrl(examples, alpha, beta, l1, l2, epochs, seed):
    z, n = Counter(), Counter()

    def weight(k):
        if k == "bias":
            return -z[k] / ((beta + math.sqrt(n[k])) / alpha)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    fit = [e for k, e in enumerate(examples) if k % 5]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            x, y = fit[k]
            keys = [*x.tolist(), "bias"]
            ws = {i: weight(i) for i in keys}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(ws.values()))))) - y
            for i in keys:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * ws[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, weight("bias")


def test_ftrl_and_its_scores(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choices(words, k=12)) + (" bad worse" if k % 3 == 0 else "") for k in range(80)]
    data, offsets = raw(texts)
    at, unit = toxicity.features(K.Words(data, offsets))
    sets = [np.unique(at[unit == k]).astype(np.int32) for k in range(len(texts))]
    for t, s in zip(texts, sets):
        w = t.split(" ")
        assert len(s) == len({(-1, x) for x in w} | {(gap, a, b) for gap in (0, 1, 2) for a, b in zip(w, w[gap + 1 :])})
    options = dict(alpha=0.7, beta=1.0, l1=1.5, l2=0.5, epochs=3, seed=4)
    model = toxicity.ftrl([(s, int(k % 3 == 0)) for k, s in enumerate(sets)], **options)
    weights, bias = plain_ftrl([(s, int(k % 3 == 0)) for k, s in enumerate(sets)], **options)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(weights, rel=1e-5) and len(weights) > 5
    assert model.bias == pytest.approx(bias)
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for row in out:
        want = sum(weights.get(k, 0) for k in sets[row.doc_id].tolist()) + bias
        assert row.toxic_score == pytest.approx(want, rel=1e-4, abs=1e-5) and row.toxic == (row.toxic_score > model.threshold)


def plain_language(counts, languages, text):
    """Scores by language, from (kind, key) counts a language: kind 0 are words, 1 to 5 n-grams."""
    vocabulary = {k for c in counts.values() for k in c}
    sizes = {(name, w): sum(v for k, v in counts[name].items() if (k[0] == 0) == w) for name in languages for w in (True, False)}
    kinds = {w: sum((k[0] == 0) == w for k in vocabulary) for w in (True, False)}
    log = lambda name, key: math.log((counts[name][key] + 0.1) / (sizes[name, key[0] == 0] + 0.1 * max(1, kinds[key[0] == 0])))
    total = Counter()
    for w in WORD_RE.findall(text.lower()):
        if (0, w) in vocabulary:
            found, factor = [(0, w)], 1.0
        else:
            for n in range(langid.LONGEST, 0, -1):
                m = f" {w} "
                found = [(n, m[k : k + n]) for k in range(len(m) - n + 1) if (n, m[k : k + n]) in vocabulary]
                factor = langid.PENALTY ** (langid.LONGEST - n)
                if found:
                    break
        for name in languages:
            total[name] += factor * sum(log(name, k) for k in found) / len(found) if found else 0
    return total


def test_language_scores(spark):
    r = random.Random(7)
    make = {"aa": ["tion", "ing", "the"], "bb": ["ung", "der", "ich"], "cc": ["ção", "éro", "漢字"]}
    rows, counts = [], {name: Counter() for name in make}
    for k in range(60):
        name = list(make)[k % 3]
        text = " ".join("".join(r.choices(make[name], k=r.choice([1, 2]))) for _ in range(8))
        rows.append((k, text, name))
        for w in WORD_RE.findall(text.lower()):
            counts[name][0, w] += 1
            for n in range(1, langid.LONGEST + 1):
                counts[name].update((n, f" {w} "[q : q + n]) for q in range(len(w) + 3 - n))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    texts = [t for _, t, _ in rows[:9]] + ["tionungungx", "ichção zzz 漢", "qqq", "the der éro éroéroéro", ""]
    out = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for row in out:
        want = plain_language(counts, sorted(make), row.text)
        if not WORD_RE.findall(row.text):
            assert row.language is None and row.language_margin is None
            continue
        first, second = sorted(want.values(), reverse=True)[:2]
        assert row.language_margin == pytest.approx((first - second) / len(WORD_RE.findall(row.text)), rel=1e-4, abs=1e-5)
        assert want[row.language] == pytest.approx(first, rel=1e-5)


def test_language_fit_cases(spark):
    """Bounds hold for each language; the first language has an id that two have; nulls are left out."""
    rows = [(k, f"w{k} common", "big") for k in range(400)] + [(1000 + k, f"v{k} rare", "small") for k in range(3)] + [(5, "x y z", "small"), (None, "n", "big"), (9, None, "big"), (8, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, most_words=5, most_grams=7)
    assert model.languages == ["big", "small"] and len(model.words) == 9 and len(model.grams) <= 14
    few = langid.fit(docs, per_language=10)
    assert len(few.words) == 10 + 1 + 4 + 3  # ten of the large language, and all of the small one
    both = langid.fit(docs.where("lang = 'small' or doc_id = 5"))
    assert K.Words(*raw(["x"])).hash[0] not in both.words and K.Words(*raw(["v0"])).hash[0] in both.words


FITS = [
    (quality_rules, "quality", lambda m, d: quality_rules.score(d, m), "quality_score"),
    (quality_mil, "quality", lambda m, d: quality_mil.score(d, m), "quality_score"),
    (toxicity, "toxic", lambda m, d: toxicity.score(d, m), "toxic_score"),
]


@pytest.mark.parametrize("module, label, apply, column", FITS, ids=["trees", "attention", "ftrl"])
def test_fits_with_odd_labels(spark, module, label, apply, column):
    """No labels, one class only, null and repeated labels and ids, extra columns: scores are numbers."""
    docs = spark.createDataFrame([(k % 40, f"good words here number {k}" if k % 2 else f"bad || ## {k}", 1, 2) for k in range(45)] + [(None, "x", 1, 2), (99, None, 1, 2)], "doc_id bigint, text string, y int, hash int")
    good = [(k, k % 2) for k in range(40)]
    for rows in ([], [(k, 1) for k in range(40)], [(k, 0) for k in range(40)], good, [*good, *good, (3, None), (None, 1), (99, 1), (5, 7)]):
        labels = spark.createDataFrame(rows, f"doc_id bigint, {label} int")
        out = apply(module.fit(docs, labels), docs).collect()
        assert len(out) == 47 and all(math.isfinite(row[column]) for row in out)
    once, twice = (module.fit(docs, spark.createDataFrame(x, f"doc_id bigint, {label} int")) for x in (good, good + good))
    a, b = ({r.text: r[column] for r in apply(m, docs).collect()} for m in (once, twice))
    assert a == pytest.approx(b, rel=1e-5)


def test_examples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 3 + "x " * k) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    whole, few, one = (toxicity.fit(docs, labels, class_bytes=n) for n in (1 << 20, 400, 1))
    assert all(math.isfinite(m.bias) for m in (whole, few, one))
    assert docs.where(F.col("doc_id") < 0).count() == 0


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    """The driver neither gathers the examples nor fits; the model is that of all examples, in the order of their ids."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(12)) + (" bad worse" if k % 3 == 0 else "") for k in range(90)]
    data, offsets = raw(texts)
    at, unit = toxicity.features(K.Words(data, offsets))
    want = toxicity.ftrl([(np.unique(at[unit == k]).astype(np.int32), int(k % 3 == 0)) for k in range(len(texts))])
    real, driver = toxicity.ftrl, os.getpid()

    def elsewhere(*args, **options):
        assert os.getpid() != driver
        return real(*args, **options)

    monkeypatch.setattr(toxicity, "ftrl", elsewhere)
    got = toxicity.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(len(texts))], "doc_id bigint, toxic int"))
    assert got.index.tolist() == want.index.tolist() and len(got.index) > 0
    assert got.weight.tolist() == want.weight.tolist() and got.bias == want.bias
