"""Words, shingles and components against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import graph as G
from millrace.llm import kernel as K

TEXT = st.text(st.sampled_from(list("ab cZ9é«—猫\n\t.ª　😀İ")), max_size=40)


def run(texts, offsets=None):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    return list(K.batches([batch], most=64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_words_and_lines(texts):
    got, lines = [], []
    for batch, data, offsets in run(texts):
        w = K.Words(data, offsets)
        got += [[bytes(data[s : s + z]).decode() for s, z in zip(w.start[a:b], w.size[a:b])] for a, b in zip(w.first, w.first[1:])]
        at, first = K.line_offsets(data, offsets)
        lines += [[bytes(data[a:b]).decode() for a, b in zip(at[i:j], at[i + 1 : j + 1])] for i, j in zip(first, first[1:])]
    lowered = [pa.compute.utf8_lower(pa.scalar(t or "")).as_py() for t in texts]
    assert got == [K.WORD_RE.findall(t) for t in lowered]
    assert [[x.rstrip("\n") if x.endswith("\n") else x for x in d] for d in lines] == [t.split("\n") for t in lowered]


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(2, 4))
def test_shingles_and_pairs(texts, n):
    seen = {}
    for batch, data, offsets in run(texts):
        w = K.Words(data, offsets)
        grams, at = w.shingles(n)
        h = w.sequence_hash()
        for d in range(len(offsets) - 1):
            words = [bytes(data[s : s + z]).decode() for s, z in zip(w.start[w.first[d] : w.first[d + 1]], w.size[w.first[d] : w.first[d + 1]])]
            want = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] or ([tuple(words)] if words else [])
            assert len(want) == at[d + 1] - at[d]
            for t, g in zip(want, grams[at[d] : at[d + 1]]):
                assert seen.setdefault(("g", t), g) == g
            assert (h[d] == 0) == (not words) and seen.setdefault(("s", tuple(words)), h[d]) == h[d]
        p, u = w.pairs(1)
        assert len(p) == sum(max(0, c - 2) for c in np.diff(w.first))
    values = [v for k, v in seen.items() if k[0] == "g"]
    assert len(set(values)) == len(values)


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [tuple(map(int, e)) for e in rng.integers(-50, 250, size=(170, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (5, 6), (6, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = components(edges)
    for limit in (G.ONE_TASK, 0):
        got = {r.node: r.root for r in G.connected_components(df, one_task=limit).collect()}
        assert got == want
    assert G.connected_components(df.limit(0)).count() == 0 == G.connected_components(df.limit(0), one_task=0).count()
