"""The catalogue of datasets and tasks below a base folder.

    <base>/<dataset>/dataset.json
    <base>/task_<id>/task.json
    <base>/task_<id>/<dataset>/state.json and its part files

A dataset is, for a task, processed (state 1), hanging (state 0) or unprocessed
(no state); additional results belong to datasets that are gone.
"""

from __future__ import annotations

import json
import shutil
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import format_size
from ..operators.flow import split_parts
from ..sources.archives import DTYPES

DATASET, TASK, STATE = "dataset.json", "task.json", "state.json"


def classify(datasets: DataFrame, states: DataFrame) -> DataFrame:
    """(dataset, state) from (dataset) and (dataset, state INT): a left join for
    the datasets, an anti join for results without one."""
    name = F.when(F.col("state") == 1, "processed").when(F.col("state") == 0, "hanging").otherwise("unprocessed")
    known = datasets.select("dataset").join(states, "dataset", "left").select("dataset", name.alias("state"))
    gone = states.where("state = 1").join(datasets, "dataset", "left_anti").select("dataset", F.lit("additional").alias("state"))
    return known.unionByName(gone)


def size_rollup(files: DataFrame) -> DataFrame:
    """(dataset, bytes, files) from (dataset, bytes)."""
    return files.groupBy("dataset").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def merge_name(names: Sequence[str], suffix: str) -> str:
    """``merge``, the names clipped at 30 characters with their number, and a suffix."""
    middle = "_" + ",".join(names) if names else ""
    if len(middle) > 30:
        middle = f"{middle[:30]}...{len(names)}ds"
    return f"merge{middle}{suffix}"


class Catalog:
    def __init__(self, base: str, spark: SparkSession | None = None):
        self.base, self.spark = Path(base), spark

    # datasets and tasks
    def datasets(self) -> list[str]:
        return sorted(p.parent.name for p in self.base.glob(f"*/{DATASET}"))

    def dataset(self, name: str) -> dict:
        return json.loads((self.base / name / DATASET).read_text())

    def create_dataset(self, name: str, data_files: Sequence[str], data_format: str, description: str = "", text_files: Sequence[str] = (), text_format: str = "", overwrite: bool = False) -> Path:
        path = self.base / name / DATASET
        if path.exists() and not overwrite:
            raise FileExistsError(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"name": name, "description": description, "data_files": list(data_files), "data_format": data_format, "text_files": list(text_files), "text_format": text_format}, ensure_ascii=False, indent=1))
        return path

    def task_folder(self, task: str) -> Path:
        return self.base / f"task_{task}"

    def create_task(self, task: str, task_type: str, saver_type: str, **options) -> Path:
        path = self.task_folder(task) / TASK
        if path.exists():
            raise FileExistsError(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        defaults = {"description": "", "length_per_sample": 1089, "img_sizes": [256], "txt_len": 64, "dtype": "int32", "model_path": ""}
        path.write_text(json.dumps(defaults | options | {"task_type": task_type, "saver_type": saver_type}, ensure_ascii=False, indent=1))
        return path

    def task(self, task: str) -> dict:
        config = json.loads((self.task_folder(task) / TASK).read_text())
        if not isinstance(config.get("task_type"), str):
            raise ValueError(f"task {task} has no task_type")
        return config

    # states
    def meta(self, task: str, dataset: str) -> dict | None:
        path = self.task_folder(task) / dataset / STATE
        return json.loads(path.read_text()) if path.exists() else None

    def states(self, task: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {"all": self.datasets(), "processed": [], "hanging": [], "unprocessed": [], "additional": []}
        for name in out["all"]:
            meta = self.meta(task, name)
            out["unprocessed" if meta is None else "processed" if meta.get("state", 0) == 1 else "hanging"].append(name)
        for path in sorted(self.task_folder(task).glob(f"*/{STATE}")):
            if path.parent.name not in out["all"] and json.loads(path.read_text()).get("state", 0) == 1:
                out["additional"].append(path.parent.name)
        return out

    def states_frame(self, task: str) -> DataFrame:
        states = [(p.parent.name, json.loads(p.read_text()).get("state", 0)) for p in self.task_folder(task).glob(f"*/{STATE}")]
        return classify(self.spark.createDataFrame([(n,) for n in self.datasets()], "dataset string"), self.spark.createDataFrame(states, "dataset string, state int"))

    def targets(self, task: str, names: Sequence[str] = ()) -> list[str]:
        """The named datasets, all of which must be unprocessed, or all that are."""
        free = self.states(task)["unprocessed"]
        if wrong := [n for n in names if n not in free]:
            raise ValueError(f"not unprocessed: {', '.join(wrong)}")
        return list(names) or free

    def process(self, task: str, run: Callable[[dict, dict, str], None], names: Sequence[str] = (), **options) -> list[str]:
        """Run ``run(dataset, options, folder)`` for each target; the task's options
        win over those given and those over the dataset's. A dataset is processed
        only when its Spark job has committed."""
        done, config = [], self.task(task)
        for name in self.targets(task, names):
            folder = self.task_folder(task) / name
            folder.mkdir(parents=True, exist_ok=True)
            began = time.strftime("%Y-%m-%d %H:%M:%S %Z")
            (folder / STATE).write_text(json.dumps({"create_time": began, "state": 0}))
            info = self.dataset(name)
            run(info, {**info, **options, **config}, str(folder))
            (folder / STATE).write_text(json.dumps({"create_time": began, "state": 1, "finish_time": time.strftime("%Y-%m-%d %H:%M:%S %Z")}))
            done.append(name)
        return done

    def clean(self, task: str) -> list[str]:
        """Delete the results of hanging datasets."""
        hanging = self.states(task)["hanging"]
        for name in hanging:
            shutil.rmtree(self.task_folder(task) / name)
        return hanging

    # results
    def part_files(self, task: str, names: Sequence[str] = ()) -> list[str]:
        names = list(names) or self.states(task)["processed"]
        return [str(p) for n in names for p in sorted((self.task_folder(task) / n).glob("*.samples"))]

    def merge(self, task: str, names: Sequence[str] = ()) -> Path:
        """All part files in one, by dataset and part; removes earlier splits."""
        config = self.task(task)
        folder = self.task_folder(task)
        shutil.rmtree(folder / "split_merged_files", ignore_errors=True)
        suffix = ".tar" if config["saver_type"].lower().startswith("tar") else ".bin"
        out, parts = folder / merge_name(names, suffix), self.part_files(task, names)
        partial = out.with_name(f".{out.name}.partial")
        if suffix == ".bin":
            with partial.open("wb") as f:
                for p in parts:
                    with open(p, "rb") as part:
                        shutil.copyfileobj(part, f, 64 << 20)
        else:
            import tarfile

            with tarfile.TarFile(partial, "w") as t:
                for p in parts:
                    with tarfile.TarFile(p) as part:
                        for m in part:
                            t.addfile(m, part.extractfile(m))
        partial.replace(out)
        return out

    def split(self, task: str, n: int) -> list[Path]:
        """The merged file in ``n`` runs of ceil(N / n) samples; needs a merge and
        no earlier split."""
        config, folder = self.task(task), self.task_folder(task)
        merged, to = folder / "merge.bin", folder / "split_merged_files"
        if not merged.exists():
            raise FileNotFoundError(merged)
        if to.exists():
            raise FileExistsError(to)
        return split_file(merged, to, n, config["dtype"], config["length_per_sample"])

    def report(self, task: str | None = None) -> str:
        """Sizes of all datasets and, for a task, what is in each state."""
        sizes = {n: sum((self.base / n / f).stat().st_size for f in self.dataset(n)["data_files"]) for n in self.datasets()}
        lines = [" ".join(f"{n}({format_size(s)})" for n, s in sizes.items()), f"Total {len(sizes)} datasets, {format_size(sum(sizes.values()))}"]
        if task is not None:
            config, states = self.task(task), self.states(task)
            lines += [f"Task {task}: {config['task_type']}. {config['description']}"]

            def done(n):
                return format_size(sum(p.stat().st_size for p in (self.task_folder(task) / n).iterdir() if p.is_file()))

            lines.append("processed: " + " ".join(f"{n}({format_size(sizes[n])} => {done(n)})" for n in states["processed"]))
            lines.append("hanging: " + " ".join(f"{n}({format_size(sizes[n])})[{self.meta(task, n)['create_time']}]" for n in states["hanging"]))
            lines.append("additional: " + " ".join(f"{n}({done(n)})" for n in states["additional"]))
            lines.append("unprocessed: " + " ".join(f"{n}({format_size(sizes[n])})" for n in states["unprocessed"]))
        return "\n".join(lines)


def split_file(merged: Path, to: Path, n: int, dtype: str, length: int) -> list[Path]:
    import numpy as np

    width = np.dtype(DTYPES[dtype]).itemsize * length
    size = merged.stat().st_size
    if size % width:
        raise ValueError(f"{merged} isn't a whole number of samples")
    samples = size // width
    per = -(-samples // n)
    to.mkdir(parents=True)
    out = []
    with merged.open("rb") as f:
        for k in range(n):
            left = (min(per, max(0, samples - k * per)) if k < n - 1 else max(0, samples - k * per)) * width
            out.append(to / f"{merged.name}.part{k}")
            with out[-1].open("wb") as part:
                while left:
                    block = f.read(min(left, 64 << 20))
                    part.write(block)
                    left -= len(block)
    return out


def merge_frames(spark: SparkSession, files: Sequence[str], length: int, dtype: str) -> DataFrame:
    """(sample_id, file_ix, sample) of part files in their order."""
    return spark.read.format("fixedbin").option("length_per_sample", length).option("dtype", dtype).load(",".join(files))


def split_frame(samples: DataFrame, n: int) -> DataFrame:
    return split_parts(samples, "sample_id", n)
