import io
import tarfile

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan

from catalog import content
from gleaner.functions import captions
from gleaner.operators import joins
from gleaner.plans import coresets
from gleaner.sources import archives, buckets, sinks, tables, vectors
from gleaner.streaming import streams


def test_vector_files(spark, tmp_path):
    r = np.random.default_rng(0)
    parts = [r.normal(size=(n, 6)).astype(np.float32) for n in (5, 1, 12)]
    for i, part in enumerate(parts):
        np.save(tmp_path / f"img_emb_{i:04d}.npy", part)
    df = vectors.read_embeddings(spark, str(tmp_path), "npy")
    found = df.orderBy("file_id", "row_id").collect()
    assert np.array_equal(np.array([x["embedding"] for x in found], dtype=np.float32), np.concatenate(parts))
    spark.dataSource.register(vectors.VectorFiles)
    ranged = spark.read.format("vector_files").option("range_bytes", 60).load(str(tmp_path))
    assert ranged.rdd.getNumPartitions() > 3
    assert ranged.exceptAll(df).isEmpty() and ranged.count() == 18
    offsets = joins.row_offsets(df, "file")
    assert [(x["rows"], x["start"]) for x in offsets.orderBy("file").collect()] == [(5, 0), (1, 5), (12, 6)]
    local = joins.global_to_local(spark.range(18), "id", offsets, "file").orderBy("id").collect()
    assert [(x["file"][-5], x["row_id"]) for x in local] == [
        (str(i), j) for i, n in enumerate((5, 1, 12)) for j in range(n)
    ]


def test_score_files(spark, tmp_path):
    np.save(tmp_path / "clip_score_0000.npy", np.array([0.25, 0.5]))
    np.save(tmp_path / "clip_score_0001.npy", np.array([0.75]))
    found = vectors.read_scores(spark, str(tmp_path), "npy").orderBy("file_id", "row_id").collect()
    assert [x["value"] for x in found] == [0.25, 0.5, 0.75]


def add(tar, name, content=b"x"):
    info = tarfile.TarInfo(name)
    info.size = len(content)
    tar.addfile(info, io.BytesIO(content))


def test_archives_group_by_name(spark, tmp_path):
    """A new name or a repeated suffix starts a sample; suffixes are lower-cased; members without
    a suffix are skipped."""
    with tarfile.open(tmp_path / "000012.tar", "w") as tar:
        for name in ("0000120000.JPG", "0000120000.txt", "readme", "0000120001.jpg", "0000120001.jpg", "a/b.c/7.x.json"):
            add(tar, name)
    with tarfile.open(tmp_path / "000013.tar", "w") as tar:
        add(tar, "0000130000.txt", "é".encode())
    found = archives.read_archives(spark, str(tmp_path)).orderBy("shard", "position").collect()
    assert [(x["shard"], x["sample_key"], x["key"], sorted(x["files"])) for x in found] == [
        ("000012", "0000120000", 120000, ["jpg", "txt"]),
        ("000012", "0000120001", 120001, ["jpg"]),
        ("000012", "0000120001", 120001, ["jpg"]),
        ("000012", "a/b.c/7", None, ["x.json"]),
        ("000013", "0000130000", 130000, ["txt"]),
    ]
    assert bytes(found[-1]["files"]["txt"]).decode() == "é"


def test_archive_round_trip_with_a_coreset(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for shard in range(3):
        with tarfile.open(source / f"{shard:06d}.tar", "w") as tar:
            for i in range(10):
                add(tar, f"{shard * 10000 + i:010d}.txt", f"{shard}-{i}".encode())
                add(tar, f"{shard * 10000 + i:010d}.jpg")
            add(tar, "0000000004.txt", b"again")
    samples = archives.read_archives(spark, str(source))
    coreset = samples.filter("key % 2 = 0").select("key").distinct()
    kept = joins.first_by_key(joins.coreset_semi_join(samples, coreset), "key", ["shard", "position"])
    assert kept.count() == 15
    archives.write_archives(kept, target, ["key"], max_rows=4)
    back = archives.read_archives(spark, target)
    assert [r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()] == [4, 4, 4, 3]
    text = {r["key"]: bytes(r["files"]["txt"]).decode() for r in back.collect()}
    assert text[4] == "0-4" and text[20008] == "2-8"


def test_file_lists_keep_their_order(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("".join(f"/c{i % 3}/img{i}.jpeg {i % 3}\n" for i in range(100)))
    df = tables.read_file_list(spark, str(path))
    found = df.orderBy("sample_id").collect()
    assert [r["path"] for r in found] == [f"/c{i % 3}/img{i}.jpeg" for i in range(100)]
    assert [r["label"] for r in found] == [i % 3 for i in range(100)]
    sinks.write_file_list(df.filter("sample_id % 2 = 1"), str(tmp_path / "kept"))
    again = tables.number_lines(spark, str(tmp_path / "kept")).orderBy("line_id").collect()
    assert [r["value"] for r in again] == [f"/c{i % 3}/img{i}.jpeg {i % 3}" for i in range(1, 100, 2)]


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        found = tables.number_lines(spark, str(tmp_path)).orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line_id"] for r in found] == list(range(4000))
    assert [r["value"] for r in found] == [f"{n} {i}" for n in ("a.txt", "b.txt") for i in range(2000)]


def test_prob_history_sorts_epochs_as_numbers(spark, tmp_path):
    for epoch in (0, 2, 10):
        (tmp_path / f"prob_{epoch}.txt").write_text("".join(f"{epoch + i / 10:.18e}\n" for i in range(3)))
    found = tables.read_prob_history(spark, str(tmp_path)).orderBy("epoch", "sample_id").collect()
    assert [(r["epoch"], r["sample_id"], r["prob"]) for r in found] == [
        (e, i, e + i / 10) for e in (0, 2, 10) for i in range(3)
    ]


def test_prob_history_in_several_files_per_epoch(spark, tmp_path):
    for epoch in (1, 2):
        folder = tmp_path / f"epoch={epoch}"
        folder.mkdir()
        for part in range(3):
            (folder / f"part-{part}.txt").write_text("".join(f"{epoch + part / 10 + i / 100}\n" for i in range(4)))
    found = tables.read_prob_history(spark, str(tmp_path), r"epoch=(\d+)").orderBy("epoch", "sample_id").collect()
    assert [(r["epoch"], r["sample_id"]) for r in found] == [(e, i) for e in (1, 2) for i in range(12)]
    assert [r["prob"] for r in found] == [e + p / 10 + i / 100 for e in (1, 2) for p in range(3) for i in range(4)]


def test_captions_with_line_breaks(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('filepath\ttitle\na.jpg\t"one\ntwo ""three"""\nb.jpg\tfour\n')
    found = tables.read_caption_csv(spark, str(tmp_path / "c.tsv")).orderBy("filepath").collect()
    assert [tuple(r) for r in found] == [("a.jpg", 'one\ntwo "three"'), ("b.jpg", "four")]


def test_archives_are_replaced(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    with tarfile.open(source / "000000.tar", "w") as tar:
        for i in range(10):
            add(tar, f"{i:010d}.txt")
    samples = archives.read_archives(spark, str(source))
    archives.write_archives(samples, target, ["key"], max_rows=3)
    archives.write_archives(samples.filter("key < 4"), target, ["key"], max_rows=3)
    back = archives.read_archives(spark, target)
    assert sorted(r["key"] for r in back.collect()) == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["000000.tar", "000001.tar"]


def test_empty_shards_are_listed(spark):
    kept = spark.createDataFrame([(123450003,), (123450001,), (123450003,), (20001,)], "key bigint")
    found = {r["shard"]: r["keys"] for r in sinks.coreset_by_shard(kept, 12346).filter("shard in (0, 2, 12345)").collect()}
    assert found == {0: [], 2: [20001], 12345: [123450001, 123450003]}


def test_missing_class_is_an_error(spark):
    train = spark.createDataFrame([("a",), ("c",), ("b",)], "name string")
    found = joins.class_map(train, spark.createDataFrame([("c",), ("a",)], "name string"), "name")
    assert {(r["name"], r["idx_validation"], r["idx_train"]) for r in found.collect()} == {("a", 0, 0), ("c", 1, 2)}
    with pytest.raises(ValueError):
        joins.class_map(train, spark.createDataFrame([("z",)], "name string"), "name")


def test_unlisted_shard_is_an_error(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 4)], "shard string, size bigint")
    assert tables.source_size(sizes.select("shard"), sizes).first().asDict() == {"total_size": 7, "num_shards": 2}
    with pytest.raises(Exception, match="no size listed"):
        tables.source_size(spark.createDataFrame([("c",)], "shard string"), sizes).collect()


def test_captions(spark):
    df = spark.createDataFrame(
        [("  A &amp;amp; B\t\n it's 2&nbsp;x42!! ",), ("<start_of_text>Éa-b",)], "text string"
    )
    cleaned = df.select(captions.clean_caption("text").alias("c"))
    assert [r["c"] for r in cleaned.collect()] == ["a & b it's 2 x42!!", "<start_of_text>éa-b"]
    words = cleaned.select(captions.caption_tokens("c").alias("w")).collect()
    assert words[0]["w"] == ["a", "&", "b", "it", "'s", "2", "x", "4", "2", "!!"]
    assert words[1]["w"] == ["<start_of_text>", "éa", "-", "b"]


def test_prompts(spark):
    classes = spark.createDataFrame([("hen",), ("kite (bird of prey)",)], "class_name string")
    assert captions.prompt_expand(classes, captions.SIMPLE_TEMPLATES[:3]).count() == 6
    found = captions.prompt_expand(classes, ["a {} in a video game."]).orderBy("class_name").collect()
    assert [r["prompt"] for r in found] == ["a hen in a video game.", "a kite (bird of prey) in a video game."]


def test_finished_clusters_are_skipped(spark, tmp_path):
    wanted = spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("cluster_id"))
    path = str(tmp_path / "out")
    assert sinks.pending_clusters(wanted, path).count() == 100
    sinks.write_cluster_map(wanted.filter("cluster_id < 4"), path, buckets=3)
    assert sinks.pending_clusters(wanted, path).select("cluster_id").distinct().count() == 6


def test_stream_dedup_over_several_batches(spark, tmp_path):
    rows = [(i, i % 2, [float(np.cos(i % 7)), float(np.sin(i % 7))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, cluster_id int, embedding array<float>")
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    for k in range(3):
        df.filter(f"id div 20 = {k}").coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (
        streams.stream_semdedup(arriving, kept, 0.999)
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(kept).collect()) == list(range(14))


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_in_one_file_or_many(spark, tmp_path, files):
    """A table may be a file or a folder of files; a stream has to take the rows of both."""
    rows = [(i, [float(np.cos(i % 7)), float(np.sin(i % 7))], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    if files == 1:
        pq.write_table(df.toArrow(), str(tmp_path / "embeddings.parquet"))
    else:
        df.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    kept = content.stream_semdedup(spark, str(tmp_path))
    expected = {}
    for i, v, c in rows:  # a reader of ascending ids
        if all(np.dot(v, w) <= 0.35 for j, w in expected.items() if j % 2 == c):
            expected[i] = v
    assert sorted(r["id"] for r in kept.collect()) == sorted(expected)
    assert content.stream_assign_clusters(spark, str(tmp_path)).count() == 60


class _Counting:
    """A local file system that notes which bytes are read with ``read_at``."""

    def __init__(self):
        self.read = []

    def open_input_file(self, path):
        from pyarrow import fs

        noted, inner = self.read, fs.LocalFileSystem().open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                inner.close()

            def __getattr__(self, name):
                return getattr(inner, name)

            def read(self, n):
                noted.append((inner.tell(), n))
                return inner.read(n)

            def read_at(self, n, start):
                noted.append((start, n))
                return inner.read_at(n, start)

        return File()


def _archive(folder, names, size=5000):
    folder.mkdir()
    with tarfile.open(folder / "000000.tar", "w") as tar:
        for name in names:
            for suffix in ("txt", "JPG"):
                content = f"{name}.{suffix} ".encode() * size
                info = tarfile.TarInfo(f"{name}.{suffix}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))


def test_bytes_of_other_samples_are_not_read(tmp_path, monkeypatch):
    names = [f"{i:010d}" for i in range(20)]
    _archive(tmp_path / "in", names)
    reader = archives._ArchiveReader({"path": str(tmp_path / "in")}, False)
    rest = list(reader.pushFilters([In(("key",), (3, 17)), LessThan(("key",), 10), IsNotNull(("key",)), EqualTo(("position",), 3)]))
    assert [type(f) for f in rest] == [IsNotNull, EqualTo]
    (part,) = reader.partitions()
    counting = _Counting()
    monkeypatch.setattr(archives, "open_filesystem", lambda path: (counting, path))
    (row,) = list(reader.read(part))
    assert row[2:5] == (3, names[3], 3)
    assert row[5] == {s.lower(): f"{names[3]}.{s} ".encode() * 5000 for s in ("txt", "JPG")}
    with tarfile.open(part.path) as tar:
        contents = {m.name: (m.offset_data, m.offset_data + m.size) for m in tar}
    for name, (start, end) in contents.items():
        touched = sum(max(0, min(at + n, end) - max(at, start)) for at, n in counting.read)
        # An archive's headers may be read ahead by a block.
        assert touched >= end - start if name.startswith(names[3]) else touched <= tarfile.RECORDSIZE


def test_filters_reach_the_archives(spark, tmp_path):
    _archive(tmp_path / "in", [f"{i:010d}" for i in range(6)], 3)
    found = archives.read_archives(spark, str(tmp_path / "in"))
    assert [r.key for r in found.filter("key in (1, 4) and key > 2").collect()] == [4]
    assert found.filter("shard = '000001'").count() == 0
    assert found.filter("key is not null and position < 2").count() == 2
    index = archives.read_index(spark, str(tmp_path / "in"))
    back = archives.fetch(index.filter("key % 2 = 0"), str(tmp_path / "in"))
    want = {r.sample_key: r.files for r in found.collect() if r.key % 2 == 0}
    assert {r.sample_key: r.files for r in back.collect()} == want


def test_coreset_is_applied_once_per_key(spark, tmp_path):
    names = [f"{i:010d}" for i in (5, 1, 1, 9, 3, 5)]
    _archive(tmp_path / "in", [*names, "word"], 2)
    keys = spark.createDataFrame([(1,), (5,), (5,), (77,)], "key int")
    coresets.apply_coreset(str(tmp_path / "in"), keys, str(tmp_path / "out"), max_rows=1)
    back = archives.read_archives(spark, str(tmp_path / "out")).orderBy("shard").collect()
    assert [(r.shard, r.key) for r in back] == [("000000", 5), ("000001", 1)]
    assert back[0].files["jpg"] == b"0000000005.JPG " * 2
    coresets.apply_coreset(str(tmp_path / "in"), keys.limit(0), str(tmp_path / "out"))
    assert archives.read_archives(spark, str(tmp_path / "out")).count() == 0


def test_keys_that_do_not_fit_raise(spark, tmp_path):
    _archive(tmp_path / "in", ["9" * 19], 1)
    with pytest.raises(Exception, match="does not fit"):
        archives.read_archives(spark, str(tmp_path / "in")).collect()
    assert archives.number_of("9" * 18) == 10**18 - 1 and archives.number_of("٣") is None


def test_truncated_archives_raise(spark, tmp_path):
    _archive(tmp_path / "in", ["0000000001"], 1000)
    index = archives.read_index(spark, str(tmp_path / "in")).cache()
    assert index.count() == 1
    path = tmp_path / "in" / "000000.tar"
    path.write_bytes(path.read_bytes()[:2000])
    with pytest.raises(Exception, match="archive has changed"):
        archives.fetch(index, str(tmp_path / "in")).collect()
    index.unpersist()


def test_vector_files_appear_together(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 4).select(F.array(F.col("id").cast("float")).alias("embedding"))
    vectors.write_embeddings(df, path, rows_per_file=4)
    assert len(list((tmp_path / "out").glob("*.npy"))) == 12 and not list((tmp_path / "out").glob(".job*"))
    with pytest.raises(Exception, match="earlier run"):
        vectors.write_embeddings(df, path, rows_per_file=4)
    broken = df.withColumn("embedding", F.when(F.col("embedding")[0] < 35, F.col("embedding")).otherwise(F.raise_error(F.lit("gone"))))
    with pytest.raises(Exception, match="gone"):
        vectors.write_embeddings(broken, path, rows_per_file=4, mode="overwrite")
    assert vectors.read_embeddings(spark, path, "npy").count() == 40
    vectors.write_embeddings(df.limit(3), path, rows_per_file=4, mode="overwrite")
    assert sorted(r.embedding[0] for r in vectors.read_embeddings(spark, path, "npy").collect()) == [0, 1, 2]
    assert not list((tmp_path / "out").glob(".job*"))


def test_wide_vectors_are_not_cut(spark, tmp_path):
    np.save(tmp_path / "0.npy", np.ones((2, 3)))
    with pytest.raises(Exception, match="do not fit 32 bits"):
        vectors.read_embeddings(spark, str(tmp_path), "npy").collect()
    exact = np.array([[1 / 3, 2 / 3], [0.1, 1e-300]])
    df = spark.createDataFrame([(x.tolist(),) for x in exact], "embedding array<double>").coalesce(1)
    vectors.write_embeddings(df, str(tmp_path / "w"))
    found = vectors.read_embeddings(spark, str(tmp_path / "w"), "npy", wide=True).orderBy("row_id").collect()
    assert [r.embedding for r in found] == exact.tolist()


def _exchanges(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return final.count("Exchange hashpartitioning")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") * 3).alias("a b"))
    right = spark.range(0, 9000, 3).select(F.col("id").alias("key"), F.array(F.col("id").cast("float")).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one = buckets.write_bucketed(left, str(tmp_path / "one"), ["key"], 6)
        buckets.write_bucketed(right, str(tmp_path / "two"), ["key"], 6)
        two = buckets.read_bucketed(spark, str(tmp_path / "two"))
        both = joins.attach_embeddings(one, two)
        assert _exchanges(both) == 0 and _exchanges(joins.attach_embeddings(left, right)) == 2
        assert sorted(both.collect()) == sorted(joins.attach_embeddings(left, right).collect())
        chosen = joins.coreset_semi_join(two, left.filter("key % 7 = 0"))
        assert _exchanges(chosen) == 1 and chosen.count() == 239
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_refuse_hot_keys_and_folders_in_use(spark, tmp_path):
    rows = spark.range(4000)
    hot = rows.select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("key"), "id")
    with pytest.raises(ValueError, match="one bucket"):
        buckets.write_bucketed(hot, str(tmp_path / "hot"), ["key"], 16)
    spread = buckets.write_bucketed(hot, str(tmp_path / "spread"), ["key", "id"], 16)
    assert spread.count() == 4000
    with pytest.raises(ValueError, match="already"):
        buckets.write_bucketed(hot, str(tmp_path / "spread"), ["key", "id"], 16)
    with pytest.raises(FileNotFoundError):
        buckets.read_bucketed(spark, str(tmp_path / "nothing"))
    empty = rows.filter("id < 0").select(F.col("id").alias("key"))
    assert buckets.write_bucketed(empty, str(tmp_path / "empty"), ["key"], 4).count() == 0
