"""The search for near lines against character-level brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm import line_dedup
from millrace.llm.edit import within
from tests.llm.test_documents import distance, sentence, table, words


def edits(r, text, n, letters="abcdefghijklmnopqrst"):
    """n characters put in, taken out or changed at random places, never at a space."""
    s = list(text)
    for _ in range(n):
        at = r.choice([k for k, c in enumerate(s) if c != " "])
        s[at : at + 1] = r.choice([[r.choice(letters)], [s[at], r.choice(letters)], []])
    return "".join(s)


def removed(spark, lines):
    return {x.doc_id for x in line_dedup.dedup_lines(table(spark, lines)).collect() if x.n_removed}


def brute(lines):
    norms = [" ".join(words(x)) for x in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(norms):
        for j, b in enumerate(norms[:i]):
            most = int(max(len(a), len(b)) * 0.1 + 1e-9)
            if a == b or abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                root = [root[j] if x == root[i] else x for x in root]
    return {i for i in range(len(lines)) if root.index(root[i]) != i}


@pytest.mark.parametrize("lines", [2_500_000, 150_000_000])
def test_recall_with_the_keys_of_large_corpora(lines):
    r = random.Random(3)
    for length in (50, 60, 90, 100, 130, 250, 500):
        base = [sentence(r, length // 4)[:length].replace(" ", "x", 1) for _ in range(150)]
        texts = [x for a in base for x in (a, edits(r, a, length // 10))]
        chars, first = line_dedup.code_points(*K.buffers(K.plain(pa.array(texts))))
        keys = [set() for _ in texts]
        for line, key in line_dedup.line_keys(chars, first, line_dedup.gram_size(lines)):
            for at, k in zip(line, key.tolist()):
                keys[at].add(k)
        both = line_dedup.Lines(np.diff(first), list(line_dedup.simhash(chars, first).T), 0.9)
        a = np.arange(0, len(texts), 2)
        found = sum(bool(keys[k] & keys[k + 1]) for k in a[both.near(a, a + 1)])
        assert found >= 0.9 * len(base), (length, found)


def test_edit_distance():
    r = random.Random(1)
    xs, ys, most, want = [], [], [], []
    for _ in range(600):
        letters = "abcd"[: r.choice([1, 2, 4])] if r.random() < 0.5 else "abcdefghijklmnopq\u00e9\u4e2d"
        a = "".join(r.choices(letters, k=r.choice([0, 1, 3, 10, 40, 70, 130])))
        b = edits(r, a, r.randrange(0, len(a) // 3 + 2), letters) if a else "b" * r.randrange(3)
        d = distance(a, b)
        xs.append(a), ys.append(b), most.append(max(0, d + r.choice([-2, -1, 0, 1, 60])))
        want.append(d <= most[-1])
    size = np.array([len(x) for x in xs + ys])
    start = np.cumsum(size) - size
    chars = np.frombuffer("".join(xs + ys).encode("utf-32-le"), np.uint32)
    k = len(xs)
    assert within(chars, start[:k], size[:k], start[k:], size[k:], np.array(most)).tolist() == want and 100 < sum(want) < 500
    few = [within(chars, start[q : q + 1], size[q : q + 1], start[k + q : k + q + 1], size[k + q : k + q + 1], np.array(most[q : q + 1]))[0] for q in range(k)]
    assert few == want


@pytest.mark.parametrize("short_run, block", [(8, 16_384), (2, 16_384), (2, 4)])
def test_long_runs_give_the_same_groups(spark, short_run, block):
    """Families of lines with one template: their pairs come in two rounds, by blocks."""
    r = random.Random(8)
    lines = []
    for _ in range(4):
        base = sentence(r, 20)
        lines += [base] + [edits(r, base, r.choice([1, 3, 9, 14])) for _ in range(14)] + [base[:60] + sentence(r, 12) for _ in range(4)]
    want = brute(lines)
    got = {x.doc_id for x in line_dedup.dedup_lines(table(spark, lines), short_run=short_run, block=block).collect() if x.n_removed}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40


def test_a_long_token_or_many_lines(spark):
    """One word of 200 characters doesn't hide a line's copies; many equal lines in a document take time in proportion."""
    r = random.Random(12)
    base = sentence(r, 20)
    token = "".join(r.choices("abcdefghij", k=200))
    lines = [base + " " + token, edits(r, base, 4) + " " + token, *(["the same line again"] * 100_000)]
    df = table(spark, ["\n".join(lines)]).withColumn("_mr_gone", F.lit(1)).withColumn("_MR_dk", F.lit("x"))
    (row,) = line_dedup.dedup_lines(df).collect()
    assert row.text == "\n".join([lines[0], lines[2]]) and row.n_removed == 100_000 and row.n_lines == 100_002
    assert row["_mr_gone"] == 1 and row["_MR_dk"] == "x"


def test_edits_are_counted_in_characters(spark):
    r = random.Random(4)
    hanzi = [chr(0x4E00 + k) for k in range(2000)]
    base = ["International Conference Proceedings Copyright 2023 Publishing Association Incorporated", *(sentence(r, 8) for _ in range(8)), *("".join(r.choices(hanzi, k=60)) for _ in range(8))]
    lines = base + [base[0].replace("2023", "2024")] + [edits(r, x, k) for x in base[1:] for k in (2, 9)]
    want = brute(lines)
    assert {17, 18, 34, 36, 48} <= want and len(want) < 40
    got = removed(spark, lines)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_short_lines(spark):
    r = random.Random(6)
    base = ["a b c d e f g h i j k l", "Chapter 12", "Chapter 9", *(sentence(r, 9)[:n].strip() for n in range(9, 48) for _ in range(2))]
    lines = base + ["a b c d e f g h i j k z", "Chapter 13", "Chapter 8"] + [edits(r, x, 1 + (k % 2) * (len(x) // 20)) for k, x in enumerate(base[3:])]
    want = brute(lines)
    first = len(base)
    assert {first, first + 1} <= want and first + 2 not in want
    got = removed(spark, lines)
    assert {first, first + 1} <= got <= want and len(got) >= 0.9 * len(want)


def test_a_shared_passage_at_other_places_makes_no_candidates():
    """Lines with one gram in common, at places that no alike lines have it, give no pairs; edited copies still do."""
    r = random.Random(15)
    passage = sentence(r, 8)[:24]
    texts = []
    for at in range(0, 240, 40):
        rest = "".join(r.choices("abcdefghijklmnopqrst", k=276))
        texts.append(rest[:at] + passage + rest[at:])
    texts.append(edits(r, texts[2], 30))
    chars, first = line_dedup.code_points(*K.buffers(K.plain(pa.array(texts))))
    keyed = {}
    for line, key, place in line_dedup.placed_keys(chars, first, 15):
        for at, k, p in zip(line.tolist(), key.tolist(), place.tolist()):
            keyed.setdefault(k, []).append((at, p))
    code, pairs, shared = line_dedup.length_code(np.diff(first)), set(), set()
    for own in keyed.values():
        own.sort(key=lambda x: code[x[0]])
        at, place = np.array([x[0] for x in own]), np.array([x[1] for x in own], np.uint8)
        i, j, _ = line_dedup.run_pairs(np.zeros(len(own), np.int64), np.array([len(own)]), code[at].astype(np.int16), place, 0.9, 8)
        pairs |= {tuple(sorted((int(at[a]), int(at[b])))) for a, b in zip(i, j)}
        shared |= {(x, y) for x, _ in own for y, _ in own if x < y}
    assert pairs == {(2, 6)} and len(shared) > 1


def test_places_lose_no_pair_of_edited_lines():
    """A gram that survives edits passes the test of places, whatever the length and where the edits are."""
    r = random.Random(16)
    seen = 0
    for length in (20, 33, 50, 97, 130, 260, 700, 3000, 9000):
        for _ in range(12):
            a = "".join(r.choices("abcdefghijklmnopqrst", k=length))
            d = length // 10
            b = r.choice([lambda: edits(r, a, d), lambda: a[d:], lambda: a[: length - d], lambda: a[: length // 3] + a[length // 3 + d :]])()
            chars, first = line_dedup.code_points(*K.buffers(K.plain(pa.array([a, b]))))
            code, n = line_dedup.length_code(np.diff(first)), np.diff(first)
            of = ({}, {})
            for line, key, place in line_dedup.placed_keys(chars, first, 15):
                for at, k, p in zip(line, key.tolist(), place.tolist()):
                    of[at][k] = p
            lo, hi = (0, 1) if n[0] <= n[1] else (1, 0)
            for k in of[0].keys() & of[1].keys():
                x, y = np.array([of[lo][k]], np.uint8), np.array([of[hi][k]], np.uint8)
                assert line_dedup.placed(code[[lo]], x, code[[hi]], y, 0.9).all(), (length, x, y)
                both = line_dedup.Lines(n[[lo, hi]], [np.zeros(2, np.int64)] * 4, 0.9, np.concatenate([x, y]).astype(np.int64))
                assert both.placed(np.array([0]), np.array([1])).all(), (length, x, y)
                seen += 1
    assert seen > 500


def test_working_tables_go(spark):
    """Only the table that the result reads is left in the shared folder."""
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/millrace/"
    before = set(glob.glob(folder + "*"))
    out = line_dedup.dedup_lines(table(spark, ["one line of some length here", "one line of some length there", "another"]))
    (left,) = set(glob.glob(folder + "*")) - before
    assert "line-removals" in left and sum(x.n_removed for x in out.collect()) == 1


def test_lines_of_long_runs_are_joined_once(spark, monkeypatch):
    """Their lengths and SimHashes are joined to them once; small tables of groups and runs then come to them, not they to these."""
    plans = []
    keep = line_dedup.keep

    def seen(df, name, *more, **named):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name, *more, **named)

    monkeypatch.setattr(line_dedup, "keep", seen)
    r = random.Random(31)
    base = sentence(r, 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.doc_id for x in line_dedup.dedup_lines(table(spark, [base] + [edits(r, base, 2) for _ in range(12)]), short_run=2).collect() if x.n_removed}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == set(range(1, 13))
    beside, rest = (plan for name, plan in plans if name == "line-pairs")
    assert "SortMergeJoin" not in rest and "BroadcastHashJoin" in rest


def test_runs_are_searched_together():
    """A call has many runs: only pairs within one, of different groups, and all of them that are near."""
    r = random.Random(21)
    texts, unit = [], []
    for k in range(30):
        base = sentence(r, 14)
        texts += [edits(r, base, r.choice([0, 2, 5, 9])) + "x" * r.randrange(4) for _ in range(r.choice([1, 2, 3, 20]))]
        unit += [k // 2] * (len(texts) - len(unit))
    order = r.sample(range(len(texts)), len(texts))
    unit, g = np.array(unit)[order], np.array([r.randrange(5) for _ in texts])
    chars, first = line_dedup.code_points(*K.buffers(K.plain(pa.array([texts[k] for k in order]))))
    lines = line_dedup.Lines(np.diff(first), list(line_dedup.simhash(chars, first).T), 0.9)
    i, j = np.triu_indices(len(texts), 1)
    at = lines.near(i, j)
    near = {(int(a), int(b)) for a, b in zip(i[at], j[at]) if unit[a] == unit[b]}
    got = [tuple(sorted((int(a), int(b)))) for a, b in zip(*line_dedup.unconnected(lines, g, unit))]
    assert len(got) == len(set(got)) > 50 and set(got) == {(a, b) for a, b in near if g[a] != g[b]}
    beside = {tuple(sorted((int(a), int(b)))) for a, b in zip(*line_dedup.neighbours(lines, unit))}
    assert beside <= near and len(beside) > 50
    none = np.empty(0, np.int64)
    empty = line_dedup.Lines(none, [none] * 4, 0.9)
    assert all(len(x) == 0 for x in (*line_dedup.unconnected(empty, none, none), *line_dedup.neighbours(empty, none)))


def test_simhash_counts_every_gram():
    """Lines of any length, around the ends of the lanes' sums, against plain sums."""
    r = random.Random(22)
    texts = ["".join(r.choices("abcdef é中", k=n)) for n in (0, 3, 4, 5, 17, 18, 19, 33, 34, 257, 258, 259, 273, 513, 514, 4000, 0, 9_000)]
    chars, first = line_dedup.code_points(*K.buffers(K.plain(pa.array(texts))))
    signs = np.random.default_rng(20240229).integers(0, 2, size=(4096, 256), dtype=np.uint8)
    for text, got in zip(texts, line_dedup.simhash(chars, first)):
        c = [ord(x) for x in text]
        total, n = np.zeros(256, np.int64), max(0, len(c) - 3)
        for p in range(n):
            h = sum(x * m for x, m in zip(c[p : p + 4], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))) & 0xFFFFFFFF
            total += signs[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20]
        assert np.packbits(2 * total > n).tobytes() == got.tobytes()
