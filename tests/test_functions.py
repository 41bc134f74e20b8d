"""Column functions against short specifications in plain Python."""

import json

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import strings as S
from millrace.functions import tokens as T

SPACES = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_strip_takes_all_white_space(spark):
    texts = [a + "x y" + b for a, b in zip(SPACES, reversed(SPACES))] + ["", " ", "\n\na\n b\n", "​z"]
    assert column(spark, texts, S.strip) == [t.strip() for t in texts]


def test_small_string_functions(spark):
    paths = ["a/b/c.jpg.bak", "x", ".hidden", "d/", "猫.png"]
    assert column(spark, paths, S.basename_key) == [p.rsplit("/", 1)[-1].split(".")[0] for p in paths]
    assert column(spark, ["abc", "a", ""], lambda c: S.drop_last(c, 2)) == ["a", "", ""]
    assert column(spark, ["", "a", "a\n", "a\nb", "\n\n"], S.line_count) == [0, 1, 1, 2, 2]
    assert column(spark, ["", None, "12"], S.int_or_zero) == [0, 0, 12]
    assert column(spark, [1, 8, 6], S.is_power_of_two, "int") == [True, True, False]
    assert column(spark, [300, -1, 255], S.wrap_unsigned_byte, "bigint") == [44, 255, 255]
    assert column(spark, [2**31, -(2**31) - 1, 5], S.wrap_int, "bigint") == [-(2**31), 2**31 - 1, 5]
    assert [S.format_size(n) for n in (0, 1023, 1536, 1 << 40, 1 << 50)] == ["0.0Bytes", "1023.0Bytes", "1.5KB", "1.0TB", "1024.0TB"]
    assert S.sqrt_int(1024) == 32
    with pytest.raises(ValueError):
        S.sqrt_int(2)


LINES = {
    "jsonl": [({"text": "a"}, "a"), ({}, None), ({"text": None}, None), ("not json", None)],
    "ccnews": [
        ({"title": " T ", "description": " d ", "maintext": "m" * 100}, "T d " + "m" * 100),
        ({"title": "", "description": "mm", "maintext": "m" * 101}, "m" * 101),
        ({"maintext": "m" * 100}, None),
        ({"title": "t" * 101}, "t" * 101 + " "),
    ],
    "baike": [({}, None), ({"title": "a", "content": "c"}, "ac")],
    "zhihu": [
        ({"q_title": "q", "q-content": None, "ans-content": "a" * 101, "ans-up-num": ""}, "问题：q回答：" + "a" * 101),
        ({"q_title": "q", "q-content": "", "ans-content": "a", "ans-up-num": "1001"}, "问题：q问题描述：回答：a"),
        ({"q_title": "q", "q-content": "c", "ans-content": "a" * 100, "ans-up-num": "1000"}, None),
    ],
    "zhidao": [
        ({"title": "q", "content": "c", "best_answer": {"content": "b" * 11}, "other_answers": [{"content": "o" * 100}, {"content": "p" * 101}]}, "问题：q问题描述：c回答：" + "b" * 11 + "p" * 101),
        ({"title": "q", "best_answer": {"content": "b" * 10}}, "问题：q回答："),
        ({"content": "c"}, None),
    ],
    "pile": [({"text": "t", "meta": {"pile_set_name": "Pile-CC"}}, "t"), ({"text": "t", "meta": {"pile_set_name": "x"}}, None), ({"text": "t", "meta": {}}, None), ({"meta": {"pile_set_name": "Wikipedia (en)"}}, "")],
}


@pytest.mark.parametrize("name", LINES)
def test_normalisers(spark, name):
    lines = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x, _ in LINES[name]]
    assert column(spark, lines, N.normalizer(name)) == [y for _, y in LINES[name]]


def test_unknown_format():
    with pytest.raises(ValueError):
        N.normalizer("nope")
    assert N.normalizer("") is N.normalizer(None) is N.raw_txt


def test_token_arrays(spark):
    assert column(spark, ["", "aé猫😀"], T.code_points) == [[], [ord(c) for c in "aé猫😀"]]
    assert column(spark, [[1, 2, 3], []], lambda c: T.pad_or_cut(c, 2), "array<int>") == [[1, 2], [-1, -1]]
    assert column(spark, [[1, 2, 3]], lambda c: T.pad_or_cut(c, 3, 0, spare=1), "array<int>") == [[1, 2, 0]]
    assert column(spark, [[5, 6]], lambda c: T.replace_id(c, 5, 0), "array<int>") == [[0, 6]]
    assert T.row_width(64, [256, 512, 128]) == 5440


def segments(ids, space):
    out, img, txt, base = [], [], [], space.img_n + space.txt_n
    for x in ids:
        if x >= base:
            if x in [space[f"[EOI{k}]"] for k in (1, 2, 3)] and img:
                out.append(("image", img))
                img = []
            if txt:
                out.append(("text", txt))
                txt = []
            out.append(("command", [x - base]))
        elif x < space.img_n:
            img = img + [x]
        else:
            txt = txt + [x - space.img_n]
    return out + ([("image", img)] if img else []) + ([("text", txt)] if txt else [])


def test_decode_segments(spark):
    space = T.IdSpace(10, 20)
    import random

    r = random.Random(4)
    cases = [[r.choice([-1, 3, 9, 10, 29, 30, 34, 35, 40, 56]) for _ in range(r.randrange(12))] for _ in range(60)]
    got = column(spark, cases, space.segments, "array<int>")
    assert [[(s["kind"], s["ids"]) for s in x] for x in got] == [segments(c, space) for c in cases]


def test_wrap_and_parse(spark):
    space = T.IdSpace(8192, 50000)
    codes = list(range(64))
    assert column(spark, [codes], lambda c: space.wrap(c, 2), "array<int>")[0] == [space["[TINY]"], space["[BOI2]"], *codes, space["[EOI2]"]]
    enc = lambda t: [ord(c) for c in t]
    t = lambda s: [x + 8192 for x in enc(s)]
    assert space.parse("[CLS] a b [MASK]*2 c [MASK] d", enc) == [space["[CLS]"], *t("a b"), -1, -1, *t("c"), -1, *t("d")]
    assert space.parse("x [Image2]p [SEP]", enc, lambda p: [7, 8, 9]) == [7, 8, -1, *t("x"), space["[SEP]"]]
    assert len(space) == 58219 and space["[POS0]"] == 58210


@given(st.integers(0, 10**6), st.integers(1, 1000))
def test_ceil_div_formula(a, n):
    assert (a + n - 1 - (a + n - 1) % n) // n == -(-a // n)


def test_parse_holds_few_ids_at_a_time(spark):
    space, queries = T.IdSpace(), [None, "", *("[CLS] " + "é" * 150_000 + f" {k} [MASK]*2" for k in range(20)), None]
    run = space.parse_udf(lambda x: [ord(c) for c in x])
    parts = list(run.func(iter([pa.array(queries), pa.array([], pa.string()), pa.array(queries)[3:5]])))
    assert max(len(x.flatten()) for x in parts) < 1_000_000
    assert [x for part in parts for x in part.to_pylist()] == [None if q is None else space.parse(q, lambda x: [ord(c) for c in x]) for q in queries + queries[3:5]]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(queries)], "k int, q string").coalesce(1).select("k", run("q").alias("ids")).collect()
    assert [r.ids for r in sorted(rows)] == [None if q is None else space.parse(q, lambda x: [ord(c) for c in x]) for q in queries]
