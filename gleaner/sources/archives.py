"""Spark data source for sample archives: tar files whose members share a name per sample.

``spark.read.format("sample_archives").load(folder)`` gives one row per sample: ``url`` (the
archive), ``shard`` and ``position`` (order inside the archive), ``sample_key`` (the name without
suffix), ``key`` (the same as a number, null if it is none) and ``files`` (suffix -> content).
One archive is one task and is read as a stream.

Filters on ``url``, ``shard`` and ``key`` reach the reader: other archives are not opened, and the
contents of other samples are passed over. With the option ``index`` only the headers are read, and
``members`` (suffix, start, size) takes the place of ``files``. ``fetch`` turns rows of an index into
samples again. So a selection of any size is made on the index, and nothing else is ever read.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    Filter,
    InputPartition,
    WriterCommitMessage,
)

from gleaner.functions.keys import KEYS_PER_SHARD
from gleaner.operators.ranking import row_index
from gleaner.sources.files import PushedFilters, allow_pushdown, list_files, open_filesystem, resolved
from gleaner.storage import materialize

_COLUMNS = "url string, shard string, position bigint, sample_key string, key bigint, "
SCHEMA = _COLUMNS + "files map<string,binary>"
INDEX_SCHEMA = _COLUMNS + "members array<struct<suffix:string,start:bigint,size:bigint>>"
# Bytes of content handed on at one time; one sample is never cut.
FETCH_BYTES = 32 * 1024 * 1024
# Tasks that write archives at most.
WRITE_TASKS = 20_000


def split_name(name: str) -> tuple[str, str] | None:
    """(sample name, lower-case suffix): the suffix starts at the first dot of the last path part.
    None for a member without a suffix."""
    folder, slash, base = name.rpartition("/")
    stem, dot, suffix = base.partition(".")
    if not dot or not stem:
        return None
    return folder + slash + stem, suffix.lower()


def group_members(members: Iterator[tuple[str, object]]) -> Iterator[tuple[str, dict[str, object]]]:
    """Consecutive members with one name form a sample. A new name or a repeated suffix starts the
    next one. What belongs to a member, its content or its place, is passed on as it is."""
    name, files = None, {}
    for path, content in members:
        parts = split_name(path)
        if parts is None:
            continue
        if name is not None and (parts[0] != name or parts[1] in files):
            yield name, files
            files = {}
        name = parts[0]
        files[parts[1]] = content
    if name is not None:
        yield name, files


def number_of(name: str) -> int | None:
    """The key a sample's name stands for, None if it is no number."""
    if not (name.isascii() and name.isdigit()):
        return None
    if int(name) >= 1 << 63:
        raise ValueError(f"key {name} does not fit 64 bits")
    return int(name)


@dataclass
class _Archive(InputPartition):
    path: str


def _shard_name(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0]


def _places(file) -> Iterator[tuple[str, tuple[int, int]]]:
    """(name, (start, size)) of the members, by their headers alone."""
    with tarfile.open(fileobj=file, mode="r:") as tar:
        for m in tar:
            if m.isfile():
                yield m.name, (m.offset_data, m.size)


# Members of one sample that lie this near to each other are read together.
GAP_BYTES = 1 << 16


def read_places(file, places: list[tuple[int, int]]) -> list[bytes]:
    """The contents at (start, size), with one read for neighbours; nothing else is read."""
    out: list[bytes] = [b""] * len(places)
    order = sorted(range(len(places)), key=lambda i: places[i])
    while order:
        near = [order.pop(0)]
        first = places[near[0]][0]
        end = first + places[near[0]][1]
        while order and places[order[0]][0] - end <= GAP_BYTES:
            near.append(order.pop(0))
            end = max(end, sum(places[near[-1]]))
        data = file.read_at(end - first, first)
        for i in near:
            start, size = places[i]
            out[i] = data[start - first : start - first + size]
            if len(out[i]) != size:
                raise EOFError(f"{size} bytes at {start} are not there: the archive has changed")
    return out


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, index: bool):
        self.path, self.index = options["path"], index
        self.filters = PushedFilters(("url", "shard", "key"), [])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.filters.take(filters)

    def partitions(self) -> list[_Archive]:
        passes = self.filters.passes
        paths = [path for path, _ in list_files(self.path, ".tar")]
        wanted = [p for p in paths if passes("url", p) and passes("shard", _shard_name(p))]
        return [_Archive(path) for path in wanted]

    def read(self, part: _Archive | None) -> Iterator[tuple]:
        if part is None:
            return
        system, _ = open_filesystem(self.path)
        shard = _shard_name(part.path)
        if not self.index and not self.filters.on("key"):
            with system.open_input_stream(part.path) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                members = ((m.name, tar.extractfile(m).read()) for m in tar if m.isfile())
                for position, (name, files) in enumerate(group_members(members)):
                    yield part.path, shard, position, name, number_of(name), files
            return
        with system.open_input_file(part.path) as headers, system.open_input_file(part.path) as contents:
            for position, (name, places) in enumerate(group_members(_places(headers))):
                key = number_of(name)
                if not self.filters.passes("key", key):
                    continue
                if self.index:
                    last = [(suffix, start, size) for suffix, (start, size) in places.items()]
                else:
                    last = dict(zip(places, read_places(contents, list(places.values())), strict=True))
                yield part.path, shard, position, name, key, last


class _ArchiveWriter(DataSourceArrowWriter):
    """Writes the rows of a task, sorted by ``shard_out``, one archive per shard. An archive is
    written under a temporary name and renamed when it is whole, so a task that runs twice leaves
    one copy. All archives wait in a folder of the job until it commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, batches) -> WriterCommitMessage:
        system, inner = open_filesystem(self.path)
        waiting = f"{inner}/{self.job}"
        system.create_dir(waiting, recursive=True)
        current, tar, stream, temporary = None, None, None, None

        def finish():
            if tar is not None:
                tar.close()
                stream.close()
                system.move(temporary, f"{waiting}/{current:06d}.tar")

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard_out"] != current:
                    finish()
                    current = row["shard_out"]
                    temporary = f"{waiting}/.{current:06d}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                    tar = tarfile.open(fileobj=stream, mode="w|")
                for suffix, content in row["files"]:
                    _add(tar, f"{row['sample_key']}.{suffix}", content)
        finish()
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        system, inner = open_filesystem(self.path)
        waiting = f"{inner}/{self.job}"
        if system.get_file_info(waiting).type != fs.FileType.Directory:
            system.create_dir(waiting, recursive=True)
        earlier = list_files(self.path, ".tar")
        new = {i.base_name: i.path for i in system.get_file_info(fs.FileSelector(waiting)) if i.base_name.endswith(".tar")}
        for name, path in new.items():
            system.move(path, f"{inner}/{name}")
        if self.overwrite:
            for path, _ in earlier:
                if path.rpartition("/")[2] not in new:
                    system.delete_file(path)
        system.delete_dir(waiting)

    def abort(self, messages) -> None:
        system, inner = open_filesystem(self.path)
        waiting = f"{inner}/{self.job}"
        if system.get_file_info(waiting).type == fs.FileType.Directory:
            system.delete_dir(waiting)


def _add(tar: tarfile.TarFile, name: str, content: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(content)
    tar.addfile(info, io.BytesIO(content))


class SampleArchives(DataSource):
    """The ``sample_archives`` format."""

    @classmethod
    def name(cls) -> str:
        return "sample_archives"

    def _index(self) -> bool:
        return str(self.options.get("index", "false")).lower() == "true"

    def schema(self) -> str:
        return INDEX_SCHEMA if self._index() else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(dict(self.options), self._index())

    def writer(self, schema, overwrite: bool):
        return _ArchiveWriter(self.options["path"], overwrite)


def _load(spark: SparkSession, path: str, index: bool) -> DataFrame:
    spark.dataSource.register(SampleArchives)
    allow_pushdown(spark)
    return spark.read.format("sample_archives").option("index", str(index).lower()).load(resolved(spark, path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a folder. Filters on url, shard and key keep contents from being read."""
    return _load(spark, path, False)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a folder without their contents: where each member begins and how long it is.

    Archives must not be compressed as a whole, or a member has no place of its own.
    """
    return _load(spark, path, True)


def fetch(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` of an index with ``files`` (suffix -> content) in place of ``members``.

    ``root`` is the folder the index was made of. Reads the listed bytes only. Rows should come
    sorted by archive and position, so that each archive is opened once.
    """
    names = [c for c in rows.columns if c != "members"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("files", T.MapType(T.StringType(), T.BinaryType()))])
    root = resolved(rows.sparkSession, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_filesystem(root)
        at, file = None, None

        def part(batch: pa.RecordBatch, start: int, files: list) -> pa.RecordBatch:
            whole = batch.select(names).slice(start, len(files))
            kind = pa.map_(pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(files, kind)], [*names, "files"])

        for batch in batches:
            start, files, held = 0, [], 0
            places = batch.column("members").to_pylist()
            for url, members in zip(batch.column("url").to_pylist(), places, strict=True):
                if url != at:
                    if file is not None:
                        file.close()
                    at, file = url, system.open_input_file(url)
                contents = read_places(file, [(m["start"], m["size"]) for m in members])
                files.append([(m["suffix"], c) for m, c in zip(members, contents, strict=True)])
                held += sum(map(len, contents))
                if held > FETCH_BYTES:
                    yield part(batch, start, files)
                    start, files, held = start + len(files), [], 0
            if files:
                yield part(batch, start, files)
        if file is not None:
            file.close()

    return rows.mapInArrow(read, schema)


def with_output_shard(
    samples: DataFrame, order: list[str], max_rows: int = KEYS_PER_SHARD, name: str = "shard_out"
) -> DataFrame:
    """``samples`` with the number of the archive each goes to: ``max_rows`` per archive, numbered
    from 0 without gaps. Only the ``order`` columns, which must be unique, are sorted."""
    placed = row_index(samples.select(*order), [F.col(c) for c in order], "_row")
    return samples.join(
        placed.select(*order, F.expr(f"cast(_row div {max_rows} as int)").alias(name)), order
    )


def write_archives(samples: DataFrame, path: str, order: list[str], max_rows: int = KEYS_PER_SHARD, mode: str = "overwrite") -> None:
    """Rewrite samples (``sample_key``, ``files``) as archives of at most ``max_rows``.

    ``overwrite`` also removes the archives of an earlier, longer run; ``append`` leaves them. The
    contents are shuffled; ``copy_archives`` does without if the samples lie in archives already.
    """
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_output_shard(samples, order, max_rows).repartition(n, "shard_out")
    _save(placed.sortWithinPartitions("shard_out", *order), path, mode)


def _save(placed: DataFrame, path: str, mode: str) -> None:
    """Rows of a task must be sorted by ``shard_out``, and a shard must lie in one task."""
    spark = placed.sparkSession
    spark.dataSource.register(SampleArchives)
    writer = placed.select("shard_out", "sample_key", "files").write.format("sample_archives")
    writer.mode(mode).save(resolved(spark, path))


def copy_archives(chosen: DataFrame, root: str, path: str, max_rows: int = KEYS_PER_SHARD, mode: str = "overwrite") -> None:
    """Write the samples of an index, ``chosen`` from ``root``, as new archives of ``max_rows``.

    They keep the order of archive and position. Rows of the index are numbered and dealt to tasks;
    a task reads the contents it writes, so that no content is shuffled and none is read in vain.
    """
    narrow = chosen.select("url", "position", "sample_key", "members")
    numbered = materialize(row_index(narrow, [F.col("url"), F.col("position")], "_row"), "chosen")
    archives = max(1, -(-numbered.count() // max_rows))
    tasks = min(archives, WRITE_TASKS)
    placed = numbered.withColumn("shard_out", F.expr(f"cast(_row div {max_rows} as int)"))
    dealt = placed.repartitionById(tasks, F.expr(f"cast(cast(shard_out as bigint) * {tasks} div {archives} as int)"))
    _save(fetch(dealt.sortWithinPartitions("_row"), root), path, mode)
