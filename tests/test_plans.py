"""Tasks, the catalogue, vectors, the command line and streaming."""

import io
import zipfile

import numpy as np
import pytest

from millrace import cli, registry
from millrace.operators import vision as V
from millrace.operators.tokenizers import CodePoints
from millrace.plans.catalog import Catalog, merge_frames, merge_name, split_frame
from millrace.plans.tasks import ConvertToTarTask, ImageTextTask, PaddedImageTextTask, TextTask, decode_image
from millrace.streaming.text import encode_stream, stream_lines, write_stream


def npy(x):
    f = io.BytesIO()
    np.save(f, x)
    return f.getvalue()


def test_nearest_codes(spark):
    r = np.random.default_rng(1)
    book, x = r.normal(size=(17, 5)), r.normal(size=(300, 5))
    want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (V.nearest(x, book) == want).all()
    assert V.nearest(np.zeros((1, 2)), np.array([[1.0, 0], [1, 0], [0, 1]]))[0] == 0
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)] + [(300, None)], "k int, v array<double>")
    got = [r.code for r in V.quantize(df, "v", book).orderBy("k").collect()]
    assert got == [*want.tolist(), None]
    with pytest.raises(ValueError):
        V.quantize(df, "v", book, most_bytes=8)


def test_pictures():
    x = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (decode_image(b"P6\n# c\n6 4\n255\n" + x.tobytes()) == x).all() and (decode_image(npy(x)) == x).all()
    with pytest.raises(ValueError):
        decode_image(b"junk")
    assert V.resize_crop(x, 2).shape == (2, 2, 3)
    y = V.normalize(np.dstack([x, x[..., :1]]))
    assert y.shape == (3, 4, 6) and np.allclose(V.denormalize(y), x / 255)
    assert np.allclose(V.resize(np.full((5, 7, 3), 9.0), 3, 2), 9)
    assert V.commitment(np.zeros((2, 2)), np.array([0, 0]), np.ones((1, 2))) == 1


def members(spark, rows):
    return spark.createDataFrame([(0, k, n, len(c or b""), c) for k, (n, c) in enumerate(rows)], "file_ix int, idx bigint, full_filename string, file_size bigint, content binary")


def test_image_text_tasks(spark):
    book = np.array([[-9.0] * 3, [9.0] * 3])
    encode = lambda x: V.patch_codes(x, book)
    white, small = npy(np.full((64, 80, 3), 255, np.uint8)), npy(np.zeros((8, 8, 3), np.uint8))
    df = members(spark, [("d/1.npy", white), ("2.npy", b"corrupt"), ("3.npy", white), ("4.npy", None), ("1.npy", small)])
    caps = spark.createDataFrame([("1", "ab"), ("2", "x"), ("9", "y")], "key string, text string")
    rows = ImageTextTask(encode, img_sizes=[64, 32], txt_len=4).plan(df, caps).orderBy("full_filename").collect()
    assert [r.full_filename for r in rows] == ["1.npy", "d/1.npy"]
    assert rows[1].tokens == [97, 98, -1, -1] + [1] * (16 + 64)
    rows = PaddedImageTextTask(encode, img_sizes=[64], txt_len=2).plan(df, caps).collect()
    pad = CodePoints()["<pad>"]
    assert [(r.full_filename, r.tokens[:2]) for r in rows] == [("d/1.npy", [97, pad])]
    assert ImageTextTask(encode, img_sizes=[64]).plan(df).count() == 0
    assert ImageTextTask(encode, img_sizes=[64], on_missing_caption="empty").plan(df).count() == 3
    tar = ConvertToTarTask().plan(df, spark.createDataFrame([("d/1.npy", "t"), ("4.npy", "t")], "key string, text string"))
    assert [r.full_filename for r in tar.collect()] == ["d/1.npy"]


def test_catalog(spark, tmp_path):
    c = Catalog(str(tmp_path), spark)
    for name in ("d0", "d1", "d2"):
        c.create_dataset(name, ["f"], "txt")
        (tmp_path / name / "f").write_bytes(b"x" * 2048)
    with pytest.raises(FileExistsError):
        c.create_dataset("d0", [], "txt")
    c.create_task("t", "TextTask", "binary", length_per_sample=5)
    with pytest.raises(FileExistsError):
        c.create_task("t", "TextTask", "binary")

    def run(info, options, folder):
        if info["name"] == "d2":
            raise RuntimeError("lost")
        np.arange(500, dtype="<i4").tofile(f"{folder}/{info['name']}.bin.part_0.samples")

    assert c.process("t", run, ["d0", "d1"]) == ["d0", "d1"]
    with pytest.raises(RuntimeError):
        c.process("t", run)
    with pytest.raises(ValueError):
        c.process("t", run, ["d0"])
    states = c.states("t")
    assert (states["processed"], states["hanging"], states["unprocessed"]) == (["d0", "d1"], ["d2"], [])
    assert {(r.dataset, r.state) for r in c.states_frame("t").collect()} == {("d0", "processed"), ("d1", "processed"), ("d2", "hanging")}
    assert "d0(2.0KB => 2." in c.report("t") and "Total 3 datasets, 6.0KB" in c.report()
    merged = c.merge("t")
    data = np.fromfile(merged, "<i4")
    assert len(data) == 1000 and data[17] == 17
    parts = c.split("t", 5)
    one = np.fromfile(parts[1], "<i4").reshape(-1, 5)
    assert one[3][2] == 217 and one[-1].tolist() == list(range(395, 400))
    with pytest.raises(FileExistsError):
        c.split("t", 3)
    frame = split_frame(merge_frames(spark, c.part_files("t"), 5, "int32"), 5)
    rows = frame.where("part = 1").orderBy("sample_id").collect()
    assert len(rows) == 40 and rows[3]["sample"][2] == 217
    assert c.clean("t") == ["d2"] and c.states("t")["unprocessed"] == ["d2"]
    (tmp_path / "d1" / "dataset.json").unlink()
    assert c.states("t")["additional"] == ["d1"]
    assert {(r.dataset, r.state) for r in c.states_frame("t").collect()} == {("d0", "processed"), ("d2", "unprocessed"), ("d1", "additional")}
    assert merge_name(["a" * 40, "b"], ".bin") == "merge_" + "a" * 29 + "...2ds.bin" and merge_name([], ".tar") == "merge.tar"


def test_command_line(spark, tmp_path, capsys):
    base = ["--base", str(tmp_path)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("ab\n\ncd\n")
    assert cli.main([*base, "data", "d", "--data_files", "x.txt", "--data_format", "txt"]) == 0
    assert cli.main([*base, "task", "t", "--task_type", "TextTask", "--saver_type", "binary", "--length_per_sample", "3"]) == 0
    assert cli.main([*base, "process", "-t", "t"]) == 0
    assert cli.main([*base, "merge", "-t", "t"]) == 0
    eos = CodePoints()["</s>"]
    assert np.fromfile(tmp_path / "task_t" / "merge.bin", "<i4").tolist() == [97, 98, eos, 99, 100, eos]
    assert cli.main([*base, "split", "-t", "t", "2"]) == 0 and cli.main([*base, "list", "-t", "t"]) == 0
    assert "processed: d(" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([*base, "data", "e", "--data_files", "x", "--data_format", "nope"])


def test_registry(tmp_path):
    code = tmp_path / "mine_task.py"
    code.write_text("from millrace.registry import register\nfrom millrace.plans.tasks import Task\n@register\nclass MineTask(Task):\n    pass\n")
    registry.load_code(str(code))
    assert registry.registered("MineTask").__name__ == "MineTask" and "TextTask" in registry.names()
    with pytest.raises(AssertionError):
        registry.register(type("MineTask", (), {}))
    with pytest.raises(KeyError):
        registry.registered("Nobody")


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f" line {k} \n\n")
    task = TextTask()
    q = write_stream(encode_stream(stream_lines(spark, str(tmp_path / "in"), 1), task), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.text, tuple(r.ids)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"line {k}", tuple(map(ord, f"line {k}"))) for k in range(3)}


def test_zip_to_tar(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a", b"1")
        z.writestr("b", b"2")
    caps = spark.createDataFrame([("b", "text")], "key string, text string")
    ConvertToTarTask().plan(spark.read.format("zip").load(str(tmp_path / "x.zip")), caps).coalesce(1).write.format("tar").mode("append").save(str(tmp_path / "o"))
    assert [r.full_filename for r in spark.read.format("tar").load(str(tmp_path / "o")).collect()] == ["b"]
