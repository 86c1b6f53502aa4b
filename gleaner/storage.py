"""Where intermediate tables live."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()  # the tables of every open scope, innermost last


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A machine-local folder is made only where that setting is absent and the session runs in
    local mode; on a cluster other machines could not read it.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="gleaner-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/gleaner/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return found is not None and len(found) > 0


def _on_disk(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_once(spark: SparkSession, name: str, text: str) -> None:
    """A small file that is there whole or not at all; one that is there already stays."""
    target, system = _on_disk(spark, name)
    system.mkdirs(target.getParent())
    waiting, _ = _on_disk(spark, f"{name}.{uuid.uuid4().hex}")
    out = system.create(waiting, False)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(target) or not system.rename(waiting, target):
        system.delete(waiting, False)
        if not system.exists(target):
            raise OSError(f"could not write {name}")


def read_text(spark: SparkSession, name: str) -> str | None:
    """A small file's text, None if it is not there."""
    path, system = _on_disk(spark, name)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes in this scope are dropped where it ends, however it ends.

    What is returned from it has to be written with ``lasting=True``: such a table belongs to the
    scope around, and stays if there is none.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for name in scopes.pop():
            path, system = _on_disk(spark, name)
            system.delete(path, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run here go when their query has ended."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str = "table", lasting: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, keeps later scans columnar, and
    gives Catalyst the true size, so that its choice of a broadcast join is a checked one. The shuffle
    files behind the table are of no more use and go at once. ``compression`` is for tables of texts;
    None is the session's own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    scopes = getattr(_open, "scopes", [])
    level = len(scopes) - (2 if lasting else 1)
    if level >= 0:
        scopes[level].append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
