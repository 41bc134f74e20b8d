"""The command line: data, task, list, process, merge, split, clean."""

from __future__ import annotations

import argparse
import os
import sys

import numpy as np
from pyspark.sql import functions as F

from . import registry
from .operators.tokenizers import get_tokenizer
from .operators.vision import patch_codes
from .plans import tasks  # noqa: F401  (registers the tasks)
from .plans.catalog import Catalog
from .plans.monitor import watched
from .plans.tasks import ImageTextTask, TextTask
from .ship import ship
from .sources.archives import DTYPES, SOURCES, register
from .sources.captions import read_captions
from .sources.text import read_lines

SAVERS = ("binary", "tar")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--extra_code", help="a Python file to run first, e.g. to register tasks")
    top.add_argument("--base", default=".", help="the folder of datasets and tasks")
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("create_dataset", aliases=["data"])
    p.add_argument("name")
    p.add_argument("--description", default="")
    p.add_argument("--data_files", nargs="+", required=True)
    p.add_argument("--data_format", required=True)
    p.add_argument("--text_files", nargs="+", default=[])
    p.add_argument("--text_format", default="")
    p.add_argument("--overwrite", action="store_true")

    p = commands.add_parser("create_task", aliases=["task"])
    p.add_argument("task_id")
    p.add_argument("--description", default="")
    p.add_argument("--task_type", required=True)
    p.add_argument("--saver_type", required=True, help="binary, tar or a registered sink")
    p.add_argument("--length_per_sample", type=int, default=1089, help="values in a sample")
    p.add_argument("--img_sizes", type=int, nargs="+", default=[256])
    p.add_argument("--txt_len", type=int, default=64)
    p.add_argument("--dtype", default="int32", choices=list(DTYPES))
    p.add_argument("--model_path", default="")

    for name in ("list", "process", "merge", "split", "clean"):
        p = commands.add_parser(name)
        if name in ("process", "merge"):
            p.add_argument("datasets", nargs="*")
        p.add_argument("--task_id", "-t", required=name != "list")
        if name == "split":
            p.add_argument("n", type=int, nargs="?", default=8)
        if name == "process":
            p.add_argument("--batch_size", type=int, default=128)
            p.add_argument("--ratio", type=float, default=1.0)
    return top


def check(args) -> None:
    """Names must be built in or registered, by the extra code for instance."""
    wanted = []
    if args.command in ("create_dataset", "data"):
        wanted = [("data_format", args.data_format, [*SOURCES, "txt", *registry.sources()])]
    elif args.command in ("create_task", "task"):
        wanted = [("task_type", args.task_type, registry.tasks()), ("saver_type", args.saver_type, [*SAVERS, *registry.sinks()])]
    for what, name, known in wanted:
        if name not in known:
            raise SystemExit(f"{what} {name!r} isn't one of {', '.join(known)}")


def read_members(spark, data_format: str, files: list[str]):
    """Members of files in a built-in or a registered format."""
    if data_format in registry.sources():
        cls = registry.registered(data_format)
        spark.dataSource.register(cls)
        data_format = cls.name()
    return spark.read.format(data_format).load(",".join(files))


def save(spark, samples, saver: str, info: dict, options: dict, folder: str) -> None:
    """Part files of a dataset's samples in the task's folder."""
    if saver in registry.sinks():
        cls = registry.registered(saver)
        if issubclass(cls, registry.Sink):
            return cls().save(samples, folder, options)
        spark.dataSource.register(cls)
        samples.write.format(cls.name()).option("dtype", options["dtype"]).mode("overwrite").save(folder + "/parts")
    elif saver == "tar":
        samples.select("full_filename", "content").write.format("tar").option("prefix", f"{info['name']}.tar.part").option("suffix", ".samples").mode("overwrite").save(folder + "/parts")
    else:
        samples.write.format("fixedbin").option("dtype", options["dtype"]).option("prefix", f"{info['name']}.bin.part").mode("overwrite").save(folder + "/parts")
    for name in sorted(os.listdir(folder + "/parts")):
        os.replace(f"{folder}/parts/{name}", f"{folder}/{name}")
    os.rmdir(folder + "/parts")


def run_task(spark, base):
    """What ``Catalog.process`` calls for a dataset."""

    def run(info: dict, options: dict, folder: str) -> None:
        files = [f"{base}/{info['name']}/{f}" for f in info["data_files"]]
        captions = read_captions(spark, [f"{base}/{info['name']}/{f}" for f in info["text_files"]], info["text_format"], strict=False)
        cls = registry.registered(options["task_type"])
        if issubclass(cls, TextTask):
            lines = read_lines(spark, files).withColumn("idx", F.monotonically_increasing_id())
            samples = cls(get_tokenizer(options["model_path"] or None), options["text_format"]).plan(lines, ["idx"], length_per_sample=options["length_per_sample"], ratio=options.get("ratio", 1.0), batch_size=options.get("batch_size", 128)).orderBy("chunk").select("tokens")
        else:
            members = read_members(spark, info["data_format"], files)
            if issubclass(cls, ImageTextTask):
                if not options["model_path"].endswith(".npy"):
                    raise ValueError("model_path must be a codebook in a .npy file")
                book = np.load(options["model_path"])
                task = cls(lambda x: patch_codes(x, book), img_sizes=options["img_sizes"], txt_len=options["txt_len"])
                samples = task.plan(members, captions, ratio=options.get("ratio", 1.0)).orderBy("full_filename").select("tokens")
            else:
                samples = cls().plan(members, captions)
        with watched(spark, folder, info["name"]):
            save(spark, samples, options["saver_type"], info, options, folder)

    return run


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.extra_code:
        registry.load_code(args.extra_code)
    check(args)
    catalog = Catalog(args.base)
    if args.command in ("create_dataset", "data"):
        catalog.create_dataset(args.name, args.data_files, args.data_format, args.description, args.text_files, args.text_format, args.overwrite)
    elif args.command in ("create_task", "task"):
        catalog.create_task(args.task_id, args.task_type, args.saver_type, description=args.description, length_per_sample=args.length_per_sample, img_sizes=args.img_sizes, txt_len=args.txt_len, dtype=args.dtype, model_path=args.model_path)
    elif args.command == "list":
        print(catalog.report(args.task_id))
    elif args.command == "merge":
        print(catalog.merge(args.task_id, args.datasets))
    elif args.command == "split":
        print(*catalog.split(args.task_id, args.n), sep="\n")
    elif args.command == "clean":
        print(*catalog.clean(args.task_id), sep="\n")
    elif args.command == "process":
        from pyspark.sql import SparkSession

        spark = register(ship(SparkSession.builder.appName("millrace").getOrCreate()))
        if args.extra_code:
            spark.sparkContext.addPyFile(args.extra_code)
        done = catalog.process(args.task_id, run_task(spark, args.base), args.datasets, batch_size=args.batch_size, ratio=args.ratio)
        print(*done, sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
