"""Progress and logs of running tasks, as small files beside their results.

A progress file holds ``done/total/speed``. Spark's status tracker knows how many
tasks of a job group have ended; a thread on the driver copies that now and
then, so nothing runs on the executors for it.
"""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def throughput(sizes, began: float, ended: float) -> float:
    """Samples a second of parts that ran from ``began`` to ``ended``."""
    return sum(sizes) / max(ended - began, 1e-9)


class Progress:
    """The progress file of one run. Without a speed, an update has that since the last one."""

    def __init__(self, path: str | Path):
        self.path, self._last = Path(path), (0, time.monotonic())

    def update(self, done: int, total: int, speed: float | None = None) -> None:
        now = time.monotonic()
        if speed is None:
            speed = (done - self._last[0]) / max(now - self._last[1], 1e-9)
        self._last = (done, now)
        part = self.path.with_name(f".{self.path.name}.part")
        part.write_text(f"{done}/{total}/{speed:.6g}")
        os.replace(part, self.path)

    def read(self) -> tuple[int, int, float] | tuple[None, None, None]:
        """(done, total, speed), or Nones where the file is missing or malformed."""
        try:
            done, total, speed = self.path.read_text().split("/")
            return int(done), int(total), float(speed)
        except (OSError, ValueError):
            return None, None, None


def read_all(folder: str | Path) -> dict[str, tuple]:
    """The progress of every run below a folder, by name."""
    return {p.name.removesuffix(".progress"): Progress(p).read() for p in sorted(Path(folder).glob("*.progress"))}


def logger_to(folder: str | Path, name: str) -> logging.Logger:
    """A logger that writes ``<folder>/<name>.log`` from INFO on; asked twice, it writes once."""
    path = os.path.abspath(Path(folder) / f"{name}.log")
    log = logging.getLogger(f"millrace.{name}")
    log.setLevel(logging.INFO)
    for h in list(log.handlers):
        if getattr(h, "baseFilename", None) != path:
            log.removeHandler(h)
            h.close()
    if not log.handlers:
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    return log


def tasks_of(spark: SparkSession, group: str) -> tuple[int, int]:
    """(ended, all) tasks of the group's stages that Spark knows of."""
    tracker, done, total = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            # a stage that a finished job has nothing of was skipped, as its output was there
            if (s := tracker.getStageInfo(stage)) and (s.numCompletedTasks or info.status == "RUNNING"):
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total


@contextmanager
def watched(spark: SparkSession, folder: str | Path, name: str, every: float = 1.0) -> Iterator[logging.Logger]:
    """Runs its block as a job group whose progress is in ``<name>.progress`` and whose log is in ``<name>.log``.

    An error is logged and raised again; the progress then stays where it was.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)
    log, progress, stop = logger_to(folder, name), Progress(Path(folder) / f"{name}.progress"), threading.Event()
    group = f"millrace-{name}-{time.monotonic_ns()}"
    spark.sparkContext.setJobGroup(group, name)

    def poll():
        while not stop.wait(every):
            progress.update(*tasks_of(spark, group))

    thread = threading.Thread(target=poll, daemon=True)
    began = time.monotonic()
    log.info("begin")
    thread.start()
    try:
        yield log
    except Exception:
        log.exception("failed")
        raise
    finally:
        stop.set()
        thread.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    done, total = tasks_of(spark, group)
    progress.update(done, total, throughput([done], began, time.monotonic()))
    log.info("end after %.1f s, %d tasks", time.monotonic() - began, done)
