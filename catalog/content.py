"""Sources, captions, samples and streams."""

from pyspark.sql import functions as F

from catalog.inputs import (
    BASE_SQL,
    GRID_SQL,
    HISTORY_SQL,
    SAMPLES_SQL,
    centroids,
    history,
    pair_scores,
    r5,
    samples,
    table,
    vectors,
    with_sql,
)
from gleaner.functions import captions
from gleaner.operators import evaluation, ranking
from gleaner.operators.joins import attach_metadata, row_offsets
from gleaner.plans import coresets
from gleaner.sources import archives, buckets, tables
from gleaner.sources import vectors as vector_files
from gleaner.storage import materialize, scratch_path
from gleaner.streaming import streams

WINDOW = 5

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# --- vector and key files -------------------------------------------------------------------

_ENTRIES = """round(v[1], 5) + 0.0 AS first_entry, round(list_sum(v), 5) + 0.0 AS total"""


def _entries(df):
    wide = F.col("embedding").cast("array<double>")
    return [
        r5(F.get(wide, F.lit(0))).alias("first_entry"),
        r5(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)).alias("total"),
    ]


@query("read_embeddings", with_sql(BASE_SQL, select=f"SELECT id, {_ENTRIES} FROM vec"))
def read_embeddings(spark, sf):
    rows = vector_files.read_embeddings(spark, f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), *_entries(rows))


@query(
    "read_embeddings_npy",
    with_sql(BASE_SQL, select=f"SELECT row_number() OVER (ORDER BY id) - 1 AS position, {_ENTRIES} FROM vec"),
)
def read_embeddings_npy(spark, sf):
    """Written as vector files in id order and read back in name order: (file, row) gives the
    global position through the row offsets."""
    path = scratch_path(spark, "npy")
    ordered = vectors(spark, sf).repartitionByRange(4, "id").sortWithinPartitions("id")
    vector_files.write_embeddings(ordered, path, rows_per_file=300)
    rows = vector_files.read_embeddings(spark, path, "npy")
    starts = materialize(row_offsets(rows, "file"), "offsets").select("file", "start")
    return rows.join(starts, "file").select((F.col("start") + F.col("row_id")).alias("position"), *_entries(rows))


@query(
    "file_sizes",
    """WITH v AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 90 AS f FROM embeddings)
    SELECT f::INTEGER AS file_id, '000000_' || lpad(f::VARCHAR, 4, '0') || '.npy' AS file, count(*) AS rows, 90 * f AS start
    FROM v GROUP BY f""",
)
def file_sizes(spark, sf):
    path = scratch_path(spark, "npy")
    vector_files.write_embeddings(vectors(spark, sf).coalesce(1).sortWithinPartitions("id"), path, rows_per_file=90)
    return vector_files.file_sizes(spark, path)


@query("read_scores", with_sql(BASE_SQL, select="SELECT round(clip_score, 5) + 0.0 AS value, count(*) AS n FROM geo GROUP BY 1"))
def read_scores(spark, sf):
    path = scratch_path(spark, "scores")
    one = pair_scores(spark, sf).select(F.array("clip_score").alias("embedding"))
    vector_files.write_embeddings(one, path)
    found = vector_files.read_scores(spark, path, "npy")
    return found.groupBy(r5("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("read_keys", "SELECT doc_id * 37 AS key FROM documents")
def read_keys(spark, sf):
    path = scratch_path(spark, "metadata")
    table(spark, sf, "documents").select(F.format_string("%010d", F.col("doc_id") * 37).alias("key"), "lang").write.parquet(path)
    return tables.read_keys(spark, path).select("key")


@query(
    "align_by_position",
    with_sql(
        BASE_SQL,
        select=f"""SELECT id * 37 AS key, (row_number() OVER (ORDER BY id) - 1) // 90 AS file_id, {_ENTRIES},
      round(clip_score, 5) + 0.0 AS clip_score FROM geo""",
    ),
)
def align_by_position(spark, sf):
    """Vectors, scores and keys in three sets of files that have nothing in common but their order."""
    paths = [scratch_path(spark, name) for name in ("vectors", "scores", "keys")]
    numbered = ranking.row_index(pair_scores(spark, sf).select("id", "clip_score"), [F.col("id")], "n")
    laid = materialize(vectors(spark, sf).join(numbered, "id").withColumn("f", F.expr("cast(n div 90 as int)")), "laid")
    files = laid.agg(F.max("f")).first()[0] + 1
    dealt = laid.repartitionById(files, F.col("f")).sortWithinPartitions("id")
    vector_files.write_embeddings(dealt.select("embedding"), paths[0])
    vector_files.write_embeddings(dealt.select(F.array("clip_score").alias("embedding")), paths[1])
    dealt.select(F.format_string("%010d", F.col("id") * 37).alias("key")).write.parquet(paths[2])
    found = tables.align_by_position(
        embeddings=vector_files.read_embeddings(spark, paths[0], "npy").drop("file"),
        scores=vector_files.read_scores(spark, paths[1], "npy").drop("file"),
        keys=tables.with_file_id(tables.read_keys(spark, paths[2])).drop("file"),
    )
    return found.select("key", F.col("file_id").cast("bigint").alias("file_id"), *_entries(found), r5("value").alias("clip_score"))


# --- samples --------------------------------------------------------------------------------


@query(
    "has_caption_and_image",
    with_sql(
        SAMPLES_SQL,
        select="SELECT key, position, caption IS NOT NULL AND suffix <> 'gif' AS usable FROM sample",
    ),
)
def has_caption_and_image(spark, sf):
    return samples(spark, sf).select("key", "position", captions.has_caption_and_image("files").alias("usable"))


@query(
    "pick_image",
    with_sql(
        SAMPLES_SQL,
        select="""SELECT key, position, CASE WHEN suffix <> 'gif' THEN picture END AS image,
          CAST(length(caption) AS INTEGER) AS caption_chars FROM sample""",
    ),
)
def pick_image(spark, sf):
    return samples(spark, sf).select(
        "key",
        "position",
        captions.pick_image("files").cast("string").alias("image"),
        F.length(captions.pick_caption("files").cast("string")).alias("caption_chars"),
    )


@query(
    "count_samples",
    with_sql(
        SAMPLES_SQL,
        select="""SELECT shard, CAST(count(*) FILTER (caption IS NOT NULL AND suffix <> 'gif') AS BIGINT) AS n_samples
          FROM sample GROUP BY ROLLUP (shard)""",
    ),
)
def count_samples(spark, sf):
    return evaluation.count_samples(samples(spark, sf))


_ARCHIVE_SQL = with_sql(
    SAMPLES_SQL,
    """
ranked AS (SELECT *, row_number() OVER (ORDER BY key, position) - 1 AS r FROM sample)""",
    select="""SELECT lpad(CAST(r // {size} AS VARCHAR), 6, '0') AS shard, r % {size} AS position, key,
      CASE WHEN caption IS NULL THEN suffix ELSE least(suffix, 'txt') || ' ' || greatest(suffix, 'txt') END AS suffixes,
      CAST(coalesce(strlen(caption), 0) + strlen(picture) AS BIGINT) AS n_bytes FROM ranked""",
    size=150,
)


def _archive_rows(read):
    content = F.transform(F.map_values("files"), lambda b: F.octet_length(b))
    return read.select(
        "shard",
        "position",
        "key",
        F.concat_ws(" ", F.array_sort(F.map_keys("files"))).alias("suffixes"),
        F.aggregate(content, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_bytes"),
    )


@query("write_archives", _ARCHIVE_SQL)
def write_archives(spark, sf):
    """Samples written as tar archives of 150 and read back."""
    path = scratch_path(spark, "archives")
    archives.write_archives(samples(spark, sf), path, ["key", "position"], max_rows=150)
    return _archive_rows(archives.read_archives(spark, path))


@query(
    "read_archives",
    with_sql(
        SAMPLES_SQL,
        select="""SELECT key, count(*) AS n_samples, CAST(sum(coalesce(strlen(caption), 0)) AS BIGINT) AS caption_bytes
          FROM sample WHERE caption IS NOT NULL AND suffix <> 'gif' GROUP BY 1""",
    ),
)
def read_archives(spark, sf):
    path = scratch_path(spark, "archives")
    archives.write_archives(samples(spark, sf), path, ["key", "position"])
    usable = archives.read_archives(spark, path).filter(captions.has_caption_and_image("files"))
    return usable.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.octet_length(captions.pick_caption("files"))).cast("bigint").alias("caption_bytes"),
    )


@query(
    "apply_coreset",
    with_sql(
        SAMPLES_SQL,
        """kept AS (SELECT doc_id * 37 AS key FROM documents
      QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) <= (SELECT count(*) FROM documents) // 2),
placed AS (SELECT s.*, dense_rank() OVER (ORDER BY s.key) - 1 AS n FROM sample s JOIN kept USING (key)
      QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY s.position) = 1)""",
        select="""SELECT lpad(CAST(n // 70 AS VARCHAR), 6, '0') AS shard, n % 70 AS position, key,
      array_to_string(list_sort(list_filter([suffix || ':' || sha256(picture), 'txt:' || sha256(caption)],
        lambda x: x IS NOT NULL)), ' ') AS digests FROM placed""",
    ),
)
def apply_coreset(spark, sf):
    """The longer half of the documents, copied from archives to archives."""
    source, target = scratch_path(spark, "archives"), scratch_path(spark, "coreset")
    archives.write_archives(samples(spark, sf), source, ["key", "position"], max_rows=150)
    longest = ranking.top_fraction(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 0.5)
    coresets.apply_coreset(source, longest.select((F.col("doc_id") * 37).alias("key")), target, max_rows=70)
    entries = F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit(":"), F.sha2(e["value"], 256)))
    return archives.read_archives(spark, target).select(
        "shard", "position", "key", F.concat_ws(" ", F.array_sort(entries)).alias("digests")
    )


# --- captions -------------------------------------------------------------------------------


def _unescape_sql(text):
    """The entities of the test pages, some cut off before the semicolon, resolved twice."""
    for _ in range(2):
        for name, plain in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
            text = f"regexp_replace({text}, '&{name};?', '{plain}', 'g')"
    return text


_CLEAN = "lower(trim(regexp_replace({text}, '\\s+', ' ', 'g')))"


@query(
    "clean_caption",
    f"""SELECT page_id, {_CLEAN.format(text=_unescape_sql("html"))} AS caption FROM pages""",
)
def clean_caption(spark, sf):
    return table(spark, sf, "pages").select("page_id", captions.clean_caption("html").alias("caption"))


@query(
    "caption_tokens",
    f"""WITH c AS (SELECT doc_id, {_CLEAN.format(text="text")} AS caption FROM documents),
    t AS (SELECT doc_id, regexp_extract_all(caption,
      '(?i)<start_of_text>|<end_of_text>|''s|''t|''re|''ve|''m|''ll|''d|[\\p{{L}}]+|[\\p{{N}}]|[^\\s\\p{{L}}\\p{{N}}]+', 0) AS w
      FROM c)
    SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, w[1] AS first_token, w[len(w)] AS last_token,
      CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM t""",
)
def caption_tokens(spark, sf):
    words = table(spark, sf, "documents").select(
        "doc_id", captions.caption_tokens(captions.clean_caption("text")).alias("w")
    )
    return words.select(
        "doc_id",
        F.size("w").alias("n_tokens"),
        F.get("w", F.lit(0)).alias("first_token"),
        F.try_element_at("w", F.lit(-1)).alias("last_token"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )


_TEMPLATES_SQL = "[" + ", ".join("'" + t + "'" for t in captions.PROMPT_TEMPLATES) + "]"


@query(
    "prompt_expand",
    f"""SELECT n_name AS class_name, CAST(i - 1 AS INTEGER) AS template_id, replace(t[i], '{{}}', n_name) AS prompt
    FROM nation CROSS JOIN (SELECT {_TEMPLATES_SQL} AS t) CROSS JOIN range(1, {len(captions.PROMPT_TEMPLATES) + 1}) r(i)""",
)
def prompt_expand(spark, sf):
    return captions.prompt_expand(table(spark, sf, "nation").select(F.col("n_name").alias("class_name")))


@query(
    "read_caption_csv",
    f"""SELECT 'images/' || doc_id || '.jpg' AS filepath, {_CLEAN.format(text="text")} AS title FROM documents""",
)
def read_caption_csv(spark, sf):
    path = scratch_path(spark, "captions")
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filepath"),
        captions.clean_caption("text").alias("title"),
        "n_chars",
    )
    docs.write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return tables.read_caption_csv(spark, path)


@query(
    "bucketed_join",
    """SELECT l_orderkey AS key, l_linenumber AS line, o_orderpriority AS priority, o_totalprice AS price
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def bucketed_join(spark, sf):
    """Both sides laid out by key once, the second one read as another session would."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
    left = buckets.write_bucketed(lines, scratch_path(spark, "buckets-lines"), ["key"], 8)
    path = scratch_path(spark, "buckets-orders")
    buckets.write_bucketed(orders, path, ["key"], 8)
    right = buckets.read_bucketed(spark, path)
    return attach_metadata(left, right.select("key", "priority"), right.select("key", "price"))


# --- streams --------------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A test table as a file stream, be it one file or a folder of files."""
    schema = table(spark, sf, name).schema
    # A stream takes a single file only from a pattern.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _finish(writer, spark, label):
    """Run a stream over what is there and wait."""
    run = writer.option("checkpointLocation", scratch_path(spark, f"{label}-log")).trigger(availableNow=True).start()
    run.awaitTermination()


def _to_table(stream, spark, label):
    path = scratch_path(spark, label)
    _finish(stream.writeStream.format("parquet").option("path", path), spark, label)
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_filter_coreset",
    """SELECT l_orderkey AS key, l_linenumber AS line FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def stream_filter_coreset(spark, sf):
    arriving = _stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")
    )
    coreset = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return _to_table(streams.stream_filter_coreset(arriving, coreset), spark, "stream-coreset")


@query(
    "stream_assign_clusters",
    with_sql(
        BASE_SQL,
        select="""SELECT id, nearest AS cluster_id FROM (
            SELECT vec.id, cent.cluster_id AS nearest,
              row_number() OVER (PARTITION BY vec.id ORDER BY list_distance(v, c), cent.cluster_id) AS r
            FROM vec CROSS JOIN cent) WHERE r = 1""",
    ),
)
def stream_assign_clusters(spark, sf):
    arriving = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    assigned = streams.stream_assign_clusters(arriving, centroids(spark, sf)).select("id", "cluster_id")
    return _to_table(assigned, spark, "stream-clusters")


@query(
    "stream_semdedup",
    # Whether a row stays depends on which earlier rows stayed: one step per row of a cluster.
    """WITH RECURSIVE
v AS (SELECT vec_id AS id, label AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS pos, sqrt(list_dot_product(v, v)) AS norm
  FROM v WHERE list_dot_product(v, v) > 0),
near AS (
  SELECT a.id, list(b.id) AS earlier FROM n a JOIN n b ON a.cluster_id = b.cluster_id AND b.id < a.id
  WHERE round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) > 0.35 GROUP BY a.id),
steps AS (
  SELECT n.cluster_id, n.pos, n.id, coalesce(near.earlier, []) AS earlier FROM n LEFT JOIN near USING (id)),
walk AS (
  SELECT DISTINCT cluster_id, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM steps
  UNION ALL
  SELECT w.cluster_id, s.pos,
         CASE WHEN list_has_any(w.kept, s.earlier) THEN w.kept ELSE list_append(w.kept, s.id) END
  FROM walk w JOIN steps s ON s.cluster_id = w.cluster_id AND s.pos = w.pos + 1),
ends AS (SELECT cluster_id, kept FROM walk QUALIFY pos = max(pos) OVER (PARTITION BY cluster_id))
SELECT unnest(kept) AS id, cluster_id FROM ends""",
)
def stream_semdedup(spark, sf):
    arriving = _stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), "embedding"
    )
    path = scratch_path(spark, "stream-kept")
    _finish(streams.stream_semdedup(arriving, path, 0.35), spark, "stream-kept")
    return spark.read.parquet(path).select("id", "cluster_id")


@query(
    "stream_uncertainty",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        select="SELECT sample_id, epoch, round(uncertainty, 5) AS uncertainty FROM unc WHERE prob <> 0",
        window=WINDOW,
    ),
)
def stream_uncertainty(spark, sf):
    path = scratch_path(spark, "stream-history")
    history(spark, sf).write.parquet(path)
    arriving = spark.readStream.schema("epoch int, sample_id bigint, prob double").parquet(path)
    found = streams.stream_uncertainty(arriving, WINDOW)
    return _to_table(found, spark, "stream-uncertainty").withColumn("uncertainty", r5("uncertainty"))


@query(
    "stream_uncertainty_late",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        select="SELECT sample_id, epoch, round(uncertainty, 5) AS uncertainty FROM unc WHERE prob <> 0",
        window=WINDOW,
    ),
)
def stream_uncertainty_late(spark, sf):
    """Epochs arrive in three files, dealt by a hash."""
    source, target = scratch_path(spark, "stream-late"), scratch_path(spark, "stream-updates")
    rows = history(spark, sf)
    lateness = rows.agg(F.max("epoch") - F.min("epoch")).first()[0] or 0
    rows.repartition(3, F.xxhash64("epoch")).write.parquet(source)
    arriving = spark.readStream.schema("epoch int, sample_id bigint, prob double")
    found = streams.stream_uncertainty_late(arriving.option("maxFilesPerTrigger", 1).parquet(source), WINDOW, lateness)
    _finish(streams.write_updates(found, target), spark, "stream-updates")
    updates = spark.read.schema("sample_id bigint, epoch int, uncertainty double, batch int").parquet(target)
    return streams.latest(updates, ["sample_id", "epoch"]).withColumn("uncertainty", r5("uncertainty"))
