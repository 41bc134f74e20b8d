"""Archives, fixed-width files and captions over generated fixtures."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException

from millrace import catalog_queries
from millrace.sources import captions as C
from millrace.sources.text import count_lines, read_lines


def test_fixed_binary(spark, tmp_path):
    path = tmp_path / "fake.bin"
    np.arange(100, dtype="<i4").tofile(path)
    df = spark.read.format("fixedbin").option("length_per_sample", 5).load(str(path)).orderBy("sample_id").collect()
    assert len(df) == 20 and df[3]["sample"][2] == 17 and df[-1]["sample"] == list(range(95, 100))
    np.arange(11, dtype="<i4").tofile(path)
    assert spark.read.format("fixedbin").option("length_per_sample", 5).load(str(path)).count() == 2
    path.write_bytes(b"")
    assert spark.read.format("fixedbin").option("length_per_sample", 5).load(str(path)).count() == 0


@pytest.mark.parametrize("dtype,kind,values", [("int32", "int", [1, -2]), ("int64", "bigint", [1 << 40, -1]), ("float32", "float", [0.5, -1.25]), ("uint8", "int", [255, 7]), ("bool", "boolean", [True, False])])
def test_dtypes(spark, tmp_path, dtype, kind, values):
    df = spark.createDataFrame([(values,)], f"sample array<{kind}>").coalesce(1)
    df.write.format("fixedbin").option("dtype", dtype).mode("append").save(str(tmp_path / "o"))
    back = spark.read.format("fixedbin").option("dtype", dtype).option("length_per_sample", 2).load(str(tmp_path / "o")).collect()
    assert [r["sample"] for r in back] == [values]


def test_wrapping_and_overwrite(spark, tmp_path):
    out = str(tmp_path / "o")
    for value in (300, 257):
        spark.createDataFrame([([value],)], "sample array<int>").coalesce(1).write.format("fixedbin").option("dtype", "uint8").mode("overwrite").save(out)
    back = spark.read.format("fixedbin").option("dtype", "uint8").option("length_per_sample", 1).load(out).collect()
    assert [r["sample"] for r in back] == [[1]]
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith(".")]


def make_zip(path):
    with zipfile.ZipFile(path, "w") as z:
        z.mkdir("d")
        z.writestr("d/a.jpg.bak", b"one")
        z.writestr(".dot", b"")
        z.writestr("bad", b"payload" * 20)
    data = path.read_bytes().replace(b"payloadpayload", b"paylOadpayload", 1)
    path.write_bytes(data)


def test_zip(spark, tmp_path):
    make_zip(tmp_path / "x.zip")
    (tmp_path / "y.zip").write_bytes(b"no zip")
    load = lambda **o: spark.read.format("zip").options(**o).load(f"{tmp_path}/x.zip,{tmp_path}/y.zip").orderBy("file_ix", "idx")
    rows = load(members_per_task=2).collect()
    assert [(r.idx, r.full_filename, r.content and bytes(r.content)) for r in rows[:3]] == [(0, "d/", None), (1, "d/a.jpg.bak", b"one"), (2, ".dot", b"")]
    assert rows[3].content is None and "BadZipFile" in rows[3].error and "BadZipFile" in rows[4].error
    assert [r.full_filename for r in load(on_error="drop").collect()] == ["d/", "d/a.jpg.bak", ".dot"]
    assert all(r.content is None and r.error is None for r in load(include_content="false", on_error="drop").collect())
    with pytest.raises(PySparkException):
        load(on_error="fail").collect()


def test_tar_round_trip(spark, tmp_path):
    with tarfile.TarFile(tmp_path / "in.tar", "w") as t:
        t.addfile(_dir("dir"))
        for name, data in (("dir/a", b"1" * 1000), ("b.x.y", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    df = spark.read.format("tar").load(str(tmp_path / "in.tar"))
    assert sorted((r.full_filename, r.file_size, bytes(r.content)) for r in df.collect()) == [("b.x.y", 0, b""), ("dir/a", 1000, b"1" * 1000)]
    df.coalesce(1).write.format("tar").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("tar").load(str(tmp_path / "out")).collect()
    assert sorted((r.full_filename, bytes(r.content)) for r in back) == [("b.x.y", b""), ("dir/a", b"1" * 1000)]


def _dir(name):
    info = tarfile.TarInfo(name)
    info.type = tarfile.DIRTYPE
    return info


def test_rar_needs_a_backend(spark, tmp_path):
    (tmp_path / "x.rar").write_bytes(b"")
    with pytest.raises(PySparkException, match="rarfile"):
        spark.read.format("rar").load(str(tmp_path / "x.rar")).collect()


def test_lines(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("".join(f"{str(i) * 10}\n" for i in range(1000)))
    rows = read_lines(spark, [str(p)])
    assert rows.count() == 1000 == count_lines(spark, str(p)) and rows.distinct().count() == 1000
    p.write_bytes(b" ok \n\xff\xfe\nend")
    assert [r.value for r in read_lines(spark, [str(p)], blank_bad_bytes=True).collect()] == ["ok", "", "end"]


def write(tmp_path, *texts):
    out = []
    for k, x in enumerate(texts):
        p = tmp_path / f"c{k}"
        p.write_text(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), encoding="utf-8")
        out.append(str(p))
    return out


def test_captions(spark, tmp_path):
    read = lambda mode, *texts, **kw: {r.key: r.text for r in C.read_captions(spark, write(tmp_path, *texts), mode, **kw).collect()}
    assert read("json_ks", {"RECORDS": [{"uniqueKey": "1128378520", "cnShortText": "猫猫猫"}, {"uniqueKey": "2", "cnShortText": "x"}, {"uniqueKey": "3"}]}) == {"1128378520": "猫猫猫"}
    both = [{"uniqueKey": "1", "cnShortText": "a", "enShortText": "b"}, {"uniqueKey": "2", "cnShortText": "", "enShortText": "b"}, {"uniqueKey": "3", "cnShortText": "a"}, {"uniqueKey": "4", "cnShortText": ""}]
    assert read("json_ks", {"RECORDS": both}, bilingual=True) == {"1": "a<n>b", "2": "b", "3": "a"}
    assert read("json", {"x": {"uniqueKey": "1", "cnShortText": "old"}}, {"y": {"uniqueKey": "1", "cnShortText": "new"}}) == {"1": "new"}
    assert read("json", {"x": {"uniqueKey": "1", "cnShortText": "a", "enShortText": ""}}, bilingual=True) == {"1": "a<n>"}
    assert read("dict", {"a": "1", "b": "2"}, {"a": "3"}) == {"a": "3", "b": "2"}
    assert read("txt", "key.j\tone\nk2.j\ttwo") == {"key": "one", "k2": "two"}
    assert read("tsv", 'key\ttext\n007\tbond\n8\t"a ""b"""\n') == {"007": "bond", "8": 'a "b"'}
    assert C.read_captions(spark, None, "json").count() == 0 == C.read_captions(spark, ["x"], "nope", strict=False).count()
    with pytest.raises(ValueError):
        C.read_captions(spark, write(tmp_path, "{}"), "nope")
    with pytest.raises(PySparkException):
        read("txt", "one field\n")


def test_tsv_keeps_every_character(spark, tmp_path):
    texts = ["", "\0", "a\0b", "\0 ", " \n", "a\n", "back\\", None, "x" * 1_048_573 + "\0\nabc"]
    spark.createDataFrame([(k, t, "src1", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog_queries.QUERIES["caption_tsv"](spark, str(tmp_path)).collect()
    assert {r.key: r.text for r in rows} == {str(k): t and t.replace("\n", " ") for k, t in enumerate(texts)}
    lines = spark.createDataFrame([(0, 1, '"a ""b"""\t"""\0"""'), (0, 2, "k\t"), (0, 3, '""\t"\0""x"'), (0, 4, '"q"\t""')], "file_ix int, pos int, value string")
    got = [(r.key, r.text) for r in C.parse_tsv(lines).orderBy("pos").collect()]
    assert got == [('a "b"', '"\0"'), ("k", None), ("", '\0"x'), ("q", "")]
