"""Progress files, logs, and user code by name through the command line."""

import json

import pytest

from millrace import cli, registry
from millrace.operators.tokenizers import VocabularyOnly
from millrace.plans.monitor import Progress, logger_to, read_all, throughput, watched


def test_progress(tmp_path):
    p = Progress(tmp_path / "a.progress")
    assert p.read() == (None, None, None)
    p.update(3, 10, 2.5)
    assert p.read() == (3, 10, 2.5)
    p.update(10, 10)
    assert p.read()[:2] == (10, 10) and p.read()[2] > 0
    (tmp_path / "b.progress").write_text("1/2")
    assert read_all(tmp_path)["b"] == (None, None, None) and set(read_all(tmp_path)) == {"a", "b"}
    assert throughput([3, 5], 1.0, 3.0) == 4


def test_watched(spark, tmp_path):
    with watched(spark, tmp_path, "job", every=0.05) as log:
        assert spark.range(1000, numPartitions=7).repartition(3).count() == 1000
        log.info("half")
    done, total, speed = read_all(tmp_path)["job"]
    assert done == total >= 7 and speed > 0
    with pytest.raises(ValueError), watched(spark, tmp_path, "bad"):
        raise ValueError("no")
    assert "half" in (tmp_path / "job.log").read_text() and "ValueError: no" in (tmp_path / "bad.log").read_text()
    logger_to(tmp_path, "job").info("once")
    assert (tmp_path / "job.log").read_text().count("once") == 1
    assert len(VocabularyOnly(9)) == 9


CODE = '''
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.plans.tasks import Task
from millrace.registry import Sink, register


def twice(x):
    return x + x


@register
class Letters(DataSource):
    """A member for each letter of each file."""

    @classmethod
    def name(cls):
        return "letters"

    def schema(self):
        return "full_filename string, content binary"

    def reader(self, schema):
        return LettersReader(self.options["path"])


class LettersReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        for k, c in enumerate(open(partition.value).read()):
            yield f"{k}.txt", c.encode()


@register
class Doubled(Task):
    def plan(self, df, captions=None, **options):
        from pyspark.sql import functions as F

        return df.select("full_filename", F.udf(twice)(F.col("content").cast("string")).alias("text"))


@register
class Joined(Sink):
    def save(self, samples, folder, options):
        rows = samples.orderBy("full_filename").collect()
        with open(f"{folder}/all.samples", "w") as f:
            f.write(",".join(r["text"] for r in rows))
'''


def test_user_source_task_and_sink(spark, tmp_path):
    """The task's function is a module's, so that executors must be able to import it."""
    (tmp_path / "own_code_of_test.py").write_text(CODE)
    base = tmp_path / "base"
    (base / "d").mkdir(parents=True)
    (base / "d" / "x.let").write_text("abc")
    common = ["--extra_code", str(tmp_path / "own_code_of_test.py"), "--base", str(base)]
    kept = dict(registry._REGISTERED)
    try:
        for argv in (["data", "d", "--data_files", "x.let", "--data_format", "Letters"], ["task", "t", "--task_type", "Doubled", "--saver_type", "Joined"], ["process", "-t", "t"]):
            registry._REGISTERED.clear()
            registry._REGISTERED.update(kept)
            assert cli.main([*common, *argv]) == 0
        assert (base / "task_t" / "d" / "all.samples").read_text() == "aa,bb,cc"
        assert json.loads((base / "task_t" / "d" / "state.json").read_text())["state"] == 1
        assert read_all(base / "task_t" / "d")["d"][0] > 0 and "end after" in (base / "task_t" / "d" / "d.log").read_text()
    finally:
        registry._REGISTERED.clear()
        registry._REGISTERED.update(kept)
    for argv in (["data", "e", "--data_files", "x", "--data_format", "Letters"], ["task", "u", "--task_type", "TextTask", "--saver_type", "Joined"], ["task", "u", "--task_type", "Joined", "--saver_type", "tar"]):
        with pytest.raises(SystemExit):
            cli.main(["--base", str(base), *argv])
