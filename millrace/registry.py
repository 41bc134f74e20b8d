"""User extensions by name: sources, sinks, tasks, normalisers."""

from __future__ import annotations

import importlib.util
import os
import sys
from abc import ABC, abstractmethod
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

_REGISTERED: dict[str, type] = {}


def register(cls: type) -> type:
    """A class decorator; the name is ``REGISTER_NAME`` or the class's own."""
    name = getattr(cls, "REGISTER_NAME", cls.__name__)
    if name in _REGISTERED:
        raise AssertionError(f"{name} is already registered")
    _REGISTERED[name] = cls
    return cls


def registered(name: str) -> type:
    return _REGISTERED[name]


def names() -> list[str]:
    return sorted(_REGISTERED)


class Sink(ABC):
    """The base of user-defined sinks that aren't Spark data sources.

    ``save`` writes samples below a folder, as files that end in ``suffix`` and
    appear under their final names only when complete.
    """

    suffix = ".samples"

    @abstractmethod
    def save(self, samples: DataFrame, folder: str, options: dict) -> None: ...


def sources() -> list[str]:
    """Registered classes that can be read from."""
    return [n for n in names() if issubclass(_REGISTERED[n], DataSource)]


def sinks() -> list[str]:
    """Registered classes that can be written to."""
    return [n for n in names() if issubclass(_REGISTERED[n], (DataSource, Sink))]


def tasks() -> list[str]:
    return [n for n in names() if n not in sinks()]


def load_code(path: str, spark: SparkSession | None = None) -> ModuleType:
    """Run a Python file, with its folder importable; send it to the executors."""
    folder = os.path.dirname(os.path.abspath(path))
    if folder not in sys.path:
        sys.path.append(folder)
    name = os.path.splitext(os.path.basename(path))[0]
    spec = importlib.util.spec_from_file_location(name, path)
    module = sys.modules[name] = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if spark is not None:
        spark.sparkContext.addPyFile(path)
    return module
