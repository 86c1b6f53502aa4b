"""Listing and opening files for the Python data sources, on any file system Arrow knows."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual


def resolved(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the session's file system gives it, so that every machine that
    opens it later looks in the same place."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(hadoop).toString()


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def allow_pushdown(spark: SparkSession) -> None:
    """Spark hands filters to Python sources only if this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, a glob or a single file, in name order."""
    system, inner = open_filesystem(path)
    folder, _, last = inner.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        infos = system.get_file_info(fs.FileSelector(folder))
        infos = [i for i in infos if fnmatch.fnmatch(i.base_name, last)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(inner))
            infos = [i for i in infos if i.base_name.endswith(suffix)]
        elif info.type == fs.FileType.File:
            infos = [info]
        else:
            raise FileNotFoundError(path)
    found = [(i.path, i.size) for i in infos if i.type == fs.FileType.File]
    return sorted(found, key=lambda f: f[0].rpartition("/")[2])


_COMPARE = {
    EqualTo: lambda x, y: x == y,
    In: lambda x, y: x in y,
    GreaterThan: lambda x, y: x > y,
    GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y,
}


@dataclass
class PushedFilters:
    """Comparisons of some columns with constants, to be applied by a reader."""

    columns: tuple[str, ...]
    taken: list[tuple[str, type, object]]

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what can be applied and hand back the rest."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in _COMPARE and name in self.columns and f.value is not None:
                self.taken.append((name, type(f), set(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def on(self, name: str) -> bool:
        return any(n == name for n, _, _ in self.taken)

    def passes(self, name: str, value) -> bool:
        """Whether a row with this value may pass; a null passes no comparison."""
        tests = [(kind, given) for n, kind, given in self.taken if n == name]
        return not tests or (value is not None and all(_COMPARE[kind](value, given) for kind, given in tests))
