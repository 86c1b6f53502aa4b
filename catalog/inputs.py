"""Inputs of the registered queries, derived by Spark from the test tables, and the same inputs as
SQL. Each pair must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.vectors import COMPARE_DECIMALS, cosine
from gleaner.functions.wordcounts import hashed_word_counts
from gleaner.operators.clustering import centroid_geometry, mean_vectors
from gleaner.operators.dynamics import merge_ranks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r5(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 5)


# --- vectors --------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cluster_id, embedding): the label stands for the cluster."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), "embedding"
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, embedding): the partner vector of each row, its entries weighted by a pattern."""
    weighted = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x, i: x * (((i + 1) * 7 + F.col("vec_id")) % 5 - 1).cast("double"),
    )
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), weighted.alias("embedding"))


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(id, clip_score)."""
    both = vectors(spark, sf).join(texts(spark, sf).withColumnRenamed("embedding", "_text"), "id")
    return both.select(
        "id", F.round(cosine("embedding", "_text"), COMPARE_DECIMALS).alias("clip_score")
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return mean_vectors(vectors(spark, sf), "cluster_id", "embedding")


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """``vectors`` with the geometry to the cluster's mean."""
    return centroid_geometry(vectors(spark, sf), centroids(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``measured`` with the pair score."""
    return measured(spark, sf).join(pair_scores(spark, sf), "id")


BASE_SQL = """
vec AS (SELECT vec_id AS id, label AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings),
txt AS (SELECT vec_id AS id,
    list_transform(embedding::DOUBLE[], lambda x, i: x * (((i * 7 + vec_id) % 5) - 1)) AS t
  FROM embeddings),
dims AS (SELECT id, cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec),
cent AS (SELECT cluster_id, list(m ORDER BY d) AS c
  FROM (SELECT cluster_id, d, avg(x) AS m FROM dims GROUP BY cluster_id, d) GROUP BY cluster_id),
geo AS (SELECT vec.id, vec.cluster_id, v,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u,
    round(list_distance(v, c), 9) AS centroid_dist,
    round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 9)
      AS centroid_cosine,
    round(list_dot_product(v, t) / sqrt(list_dot_product(v, v) * list_dot_product(t, t)), 9)
      AS clip_score
  FROM vec JOIN cent USING (cluster_id) JOIN txt USING (id))"""

# Duplicate scores under an order given as an expression, lowest first.
SCORES_SQL = """
ord AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}, id) AS rk FROM geo),
scores AS (SELECT b.id, b.cluster_id, b.clip_score, b.centroid_dist, b.centroid_cosine,
    CAST(b.rk - 1 AS INTEGER) AS dis_rank,
    round(greatest(0.0, coalesce(max(list_dot_product(a.u, b.u)), 0.0)), 9) AS semdedup_score
  FROM ord b LEFT JOIN ord a ON a.cluster_id = b.cluster_id AND a.rk < b.rk
  GROUP BY ALL)"""

# Groups of rows connected by similarity above a threshold.
GROUPS_SQL = """
edge AS (SELECT a.id AS src, b.id AS dst FROM geo a JOIN geo b
  ON a.cluster_id = b.cluster_id AND a.id <> b.id
  WHERE round(list_dot_product(a.u, b.u), 9) > {threshold}),
walk AS (SELECT id AS root, id AS node FROM geo
  UNION SELECT walk.root, edge.dst FROM walk JOIN edge ON edge.src = walk.node),
grp AS (SELECT node AS id, min(root) AS component FROM walk GROUP BY node)"""


def with_sql(*parts: str, select: str, **values) -> str:
    """A query over the named parts."""
    keyword = "WITH RECURSIVE" if any("walk AS" in p for p in parts) else "WITH"
    body = ",".join(parts)
    for name, value in values.items():
        body = body.replace("{" + name + "}", str(value))
        select = select.replace("{" + name + "}", str(value))
    return f"{keyword} {body}\n{select}"


# --- documents ------------------------------------------------------------------------------

WORD_DIMS = 64


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cluster_id, embedding, clip_score): hashed word counts of whole documents. Near copies
    of a text are near-duplicates here, copies are copies. The language is the cluster; the pair
    score follows the text length."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.split(F.lower("text"), r"\s+").alias("words"))
    return (
        hashed_word_counts(words, "doc_id", "words", WORD_DIMS)
        .withColumnRenamed("counts", "embedding")
        .join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.expr("instr('de en es fr', lang)").alias("cluster_id"),
            "embedding",
            ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("clip_score"),
        )
    )


DOCUMENTS_SQL = """
word AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
slot AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) % 64 AS s, count(*) AS n
  FROM word WHERE w <> '' GROUP BY ALL),
full_slot AS (SELECT d.doc_id, i.s, coalesce(slot.n, 0)::DOUBLE AS n
  FROM (SELECT DISTINCT doc_id FROM slot) d CROSS JOIN (SELECT unnest(range(64)) AS s) i
  LEFT JOIN slot ON slot.doc_id = d.doc_id AND slot.s = i.s),
docvec AS (SELECT doc_id AS id, list(n ORDER BY s) AS v FROM full_slot GROUP BY doc_id),
vec AS (SELECT docvec.id, instr('de en es fr', lang)::INTEGER AS cluster_id, v,
    (n_chars % 1000) / 1000.0::DOUBLE AS clip_score
  FROM docvec JOIN documents ON doc_id = docvec.id),
dims AS (SELECT id, cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec),
cent AS (SELECT cluster_id, list(m ORDER BY d) AS c
  FROM (SELECT cluster_id, d, avg(x) AS m FROM dims GROUP BY cluster_id, d) GROUP BY cluster_id),
geo AS (SELECT vec.id, vec.cluster_id, v,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u,
    round(list_distance(v, c), 9) AS centroid_dist,
    round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 9)
      AS centroid_cosine,
    clip_score
  FROM vec JOIN cent USING (cluster_id))"""


# --- histories ------------------------------------------------------------------------------


def worker_history(spark: SparkSession, sf: str) -> DataFrame:
    """(epoch, sample_id, worker, prob): the day is the epoch, the user the sample, the event type
    the worker. Some reports are 0 (not seen)."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("epoch"),
        F.col("user_id").alias("sample_id"),
        F.col("event_type").alias("worker"),
        F.when(F.col("event_id") % 4 == 0, 0.0).otherwise((cents % 100) / F.lit(100.0)).alias("prob"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return merge_ranks(worker_history(spark, sf))


HISTORY_SQL = """
report AS (SELECT CAST(day(ts) AS INTEGER) AS epoch, user_id AS sample_id, event_type AS worker,
    CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE
      ELSE (CAST(round(value * 100) AS BIGINT) % 100) / 100.0::DOUBLE END AS prob
  FROM events),
hist AS (SELECT epoch, sample_id, max(prob) AS prob FROM report GROUP BY ALL)"""

# The buffer of every sample after every epoch of the training, seen or not.
GRID_SQL = """
pos AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS p FROM (SELECT DISTINCT epoch FROM hist)),
grid AS (SELECT s.sample_id, pos.epoch, pos.p, coalesce(hist.prob, 0.0) AS prob
  FROM (SELECT DISTINCT sample_id FROM hist) s CROSS JOIN pos
  LEFT JOIN hist ON hist.sample_id = s.sample_id AND hist.epoch = pos.epoch),
buf AS (SELECT sample_id, epoch, p, prob,
    list_concat(list_transform(range({window}), lambda z: 0.0::DOUBLE),
      coalesce(list(prob) FILTER (prob <> 0) OVER (PARTITION BY sample_id ORDER BY epoch), []))
      [-{window}:] AS b
  FROM grid),
unc AS (SELECT *, 10 * list_stddev_samp(b) AS uncertainty FROM buf)"""


# --- samples --------------------------------------------------------------------------------


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(key, shard, position, sample_key, files): documents as image-text samples. Keys have gaps;
    the image suffix varies, some samples lack one part, every tenth key comes twice."""
    d = F.col("doc_id")
    key = d * 37
    image = (
        F.when(d % 7 == 0, "png").when(d % 7 == 1, "jpeg").when(d % 7 == 2, "webp").when(d % 7 == 3, "gif")
        .otherwise("jpg")
    )
    text = F.encode("text", "utf-8")
    picture = F.encode(F.concat(F.lit("image of "), F.col("lang"), d.cast("string")), "utf-8")
    files = F.when(d % 11 == 0, F.create_map(image, picture)).otherwise(
        F.create_map(image, picture, F.lit("txt"), text)
    )
    rows = table(spark, sf, "documents").select(
        key.alias("key"),
        F.format_string("%06d", F.expr("(doc_id * 37) div 10000")).alias("shard"),
        F.explode(F.when(d % 10 == 0, F.array(d * 2, d * 2 + 1)).otherwise(F.array(d * 2))).alias("position"),
        F.format_string("%010d", key).alias("sample_key"),
        files.alias("files"),
    )
    return rows


SAMPLES_SQL = """
sample AS (SELECT doc_id * 37 AS key, lpad(CAST((doc_id * 37) // 10000 AS VARCHAR), 6, '0') AS shard,
    unnest(CASE WHEN doc_id % 10 = 0 THEN [doc_id * 2, doc_id * 2 + 1] ELSE [doc_id * 2] END) AS position,
    lpad(CAST(doc_id * 37 AS VARCHAR), 10, '0') AS sample_key,
    CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif'
      ELSE 'jpg' END AS suffix,
    'image of ' || lang || doc_id AS picture,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS caption
  FROM documents)"""

# A seeded hash order, as in gleaner.functions.keys.
HASH_SQL = "CAST(('0x' || substr(md5('{seed}/' || CAST({id} AS VARCHAR)), 1, 13)) AS BIGINT)"


def hash_sql(identity: str, *seed: int) -> str:
    return HASH_SQL.replace("{seed}", "/".join(map(str, seed))).replace("{id}", identity)
