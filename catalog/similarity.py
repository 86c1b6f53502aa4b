"""Scalar vector functions, clustering, duplicate scores, groups and picks."""

from pyspark.sql import functions as F

from catalog.inputs import (
    BASE_SQL,
    DOCUMENTS_SQL,
    GROUPS_SQL,
    SCORES_SQL,
    centroids,
    document_vectors,
    hash_sql,
    measured,
    pair_scores,
    r5,
    scored,
    texts,
    vectors,
    with_sql,
)
from gleaner.functions import vectors as fv
from gleaner.operators import clustering, components, dedup, evaluation, joins, sampling
from gleaner.plans import coresets, resumable
from gleaner.sources import sinks
from gleaner.sources.vectors import write_embeddings
from gleaner.storage import materialize, scratch_path

T = 0.35
LOW = 0.30
DOC_T = 0.945

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# --- scalar functions -----------------------------------------------------------------------


@query(
    "l2_normalize",
    with_sql(
        BASE_SQL,
        select="""SELECT id, round(u[1], 5) + 0.0 AS first_entry, round(u[64], 5) + 0.0 AS last_entry,
            round(list_sum(u), 5) + 0.0 AS total FROM geo""",
    ),
)
def l2_normalize(spark, sf):
    unit = vectors(spark, sf).select("id", fv.l2_normalize("embedding").alias("u"))
    return unit.select(
        "id",
        r5(F.get("u", F.lit(0))).alias("first_entry"),
        r5(F.get("u", F.lit(63))).alias("last_entry"),
        r5(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


@query(
    "dot_and_cosine",
    with_sql(
        BASE_SQL,
        select="""SELECT id, round(list_dot_product(v, t), 5) + 0.0 AS dot_product,
            round(list_dot_product(v, t) / sqrt(list_dot_product(v, v) * list_dot_product(t, t)), 5) + 0.0
              AS cosine FROM vec JOIN txt USING (id)""",
    ),
)
def dot_and_cosine(spark, sf):
    both = vectors(spark, sf).join(texts(spark, sf).withColumnRenamed("embedding", "t"), "id")
    return both.select(
        "id",
        r5(fv.dot("embedding", "t")).alias("dot_product"),
        r5(fv.cosine("embedding", "t")).alias("cosine"),
    )


@query(
    "l2_distance",
    with_sql(BASE_SQL, select="SELECT id, round(list_distance(v, t), 5) AS distance FROM vec JOIN txt USING (id)"),
)
def l2_distance(spark, sf):
    both = vectors(spark, sf).join(texts(spark, sf).withColumnRenamed("embedding", "t"), "id")
    return both.select("id", r5(fv.l2_distance("embedding", "t")).alias("distance"))


@query(
    "pair_score",
    with_sql(BASE_SQL, select="SELECT id, round(clip_score, 5) + 0.0 AS clip_score FROM geo"),
)
def pair_score(spark, sf):
    return pair_scores(spark, sf).select("id", r5("clip_score").alias("clip_score"))


@query(
    "cosine_to_centroid",
    with_sql(
        BASE_SQL,
        select="""SELECT id, cluster_id, round(centroid_dist, 5) AS centroid_dist,
            round(centroid_cosine, 5) + 0.0 AS centroid_cosine FROM geo""",
    ),
)
def cosine_to_centroid(spark, sf):
    return measured(spark, sf).select(
        "id",
        "cluster_id",
        r5("centroid_dist").alias("centroid_dist"),
        r5("centroid_cosine").alias("centroid_cosine"),
    )


@query(
    "zero_vectors",
    """SELECT doc_id AS id FROM documents
       WHERE len(list_filter([length(text) - length(replace(text, c, '')) FOR c IN ['z','q','x']],
                             lambda n: n > 0)) = 0""",
)
def zero_vectors(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [F.length("text") - F.length(F.replace("text", F.lit(c))) for c in "zqx"]
    rows = docs.select(F.col("doc_id").alias("id"), F.array(*counts).alias("embedding"))
    return clustering.zero_vectors(rows).select("id")


# --- clustering -----------------------------------------------------------------------------


@query(
    "assign_clusters",
    with_sql(
        BASE_SQL,
        select="""SELECT id, nearest AS cluster_id, round(d, 5) AS centroid_dist FROM (
            SELECT vec.id, cent.cluster_id AS nearest, list_distance(v, c) AS d,
              row_number() OVER (PARTITION BY vec.id ORDER BY list_distance(v, c), cent.cluster_id) AS r
            FROM vec CROSS JOIN cent) WHERE r = 1""",
    ),
)
def assign_clusters(spark, sf):
    rows = vectors(spark, sf).select("id", "embedding")
    return clustering.assign_clusters(rows, centroids(spark, sf)).select(
        "id", "cluster_id", r5("centroid_dist").alias("centroid_dist")
    )


@query("assign_clusters_in_blocks", SQL["assign_clusters"])
def assign_clusters_in_blocks(spark, sf):
    """The same assignment with a broadcast bound that holds three centroids at a time."""
    rows = vectors(spark, sf).select("id", "embedding")
    return clustering.assign_clusters(rows, centroids(spark, sf), limit=3 * 64 * 8).select(
        "id", "cluster_id", r5("centroid_dist").alias("centroid_dist")
    )


_KMEANS_ROUND = """
near{n} AS (SELECT id, v, cluster_id FROM (
    SELECT vec.id, vec.v, k.cluster_id,
      row_number() OVER (PARTITION BY vec.id ORDER BY list_distance(vec.v, k.c), k.cluster_id) AS r
    FROM vec CROSS JOIN cent{p} k) WHERE r = 1),
mean{n} AS (SELECT cluster_id, list(m ORDER BY d) AS c FROM (
    SELECT cluster_id, d, avg(x) AS m FROM (
      SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{n})
    GROUP BY cluster_id, d) GROUP BY cluster_id),
cent{n} AS (SELECT cent{p}.cluster_id, coalesce(mean{n}.c, cent{p}.c) AS c
  FROM cent{p} LEFT JOIN mean{n} USING (cluster_id))"""


def _kmeans_sql(k, rounds):
    start = f"""
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
cent0 AS (SELECT CAST(row_number() OVER (ORDER BY {hash_sql('id', 7)}, id) - 1 AS INTEGER) AS cluster_id, v AS c
  FROM vec QUALIFY cluster_id < {k})"""
    steps = [_KMEANS_ROUND.format(n=i + 1, p=i) for i in range(rounds)]
    return f"""WITH {','.join([start, *steps])}
SELECT cluster_id, round(c[1], 5) + 0.0 AS first_entry, round(c[2], 5) + 0.0 AS second_entry,
  round(list_sum(c), 4) + 0.0 AS total FROM cent{rounds}"""


@query("train_kmeans", _kmeans_sql(4, 3))
def train_kmeans(spark, sf):
    trained = clustering.train_kmeans(vectors(spark, sf).select("id", "embedding"), 4, 1, 3, "id", seed=7)
    return trained.select(
        "cluster_id",
        r5(F.get("centroid", F.lit(0))).alias("first_entry"),
        r5(F.get("centroid", F.lit(1))).alias("second_entry"),
        F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
    )


def _kmeans_on_files_sql(k, per_file, count, epochs):
    """Every epoch has its own ``vec``; the centroids of one epoch begin the next."""
    parts = [
        f"""every AS (SELECT f, file, '/' || r AS r, v, row_number() OVER () AS id FROM (
    SELECT *, '000000_' || lpad(f::VARCHAR, 4, '0') || '.npy' AS file FROM (
      SELECT n // {per_file} AS f, n % {per_file} AS r, v FROM (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, embedding::DOUBLE[] AS v FROM embeddings))))"""
    ]
    for e in range(epochs):
        parts.append(
            f"""vec{e} AS (SELECT file || r AS id, v FROM every SEMI JOIN (
      SELECT file FROM (SELECT DISTINCT file FROM every) ORDER BY {hash_sql('file', 5, e)}, file LIMIT {count}) USING (file))"""
        )
        if e == 0:
            parts.append(
                f"""cent0 AS (SELECT CAST(row_number() OVER (ORDER BY {hash_sql('id', 5)}, id) - 1 AS INTEGER) AS cluster_id, v AS c
      FROM vec0 QUALIFY cluster_id < {k})"""
            )
        parts.append(_KMEANS_ROUND.format(n=e + 1, p=e).replace("vec.", f"vec{e}.").replace("FROM vec ", f"FROM vec{e} "))
    return f"""WITH {','.join(parts)}
SELECT cluster_id, list_transform(c, lambda x: round(x, 5) + 0.0) AS centroid FROM cent{epochs}"""


@query("train_kmeans_on_files", _kmeans_on_files_sql(4, 90, 2, 2))
def train_kmeans_on_files(spark, sf):
    """Two epochs over two files each, drawn from the listing."""
    path = scratch_path(spark, "npy")
    write_embeddings(vectors(spark, sf).coalesce(1).sortWithinPartitions("id"), path, rows_per_file=90)
    trained = clustering.train_kmeans_on_files(spark, path, 4, 2, 1, 2, seed=5)
    return trained.select("cluster_id", F.transform("centroid", lambda x: F.round(x, 5) + 0.0).alias("centroid"))


@query(
    "sample_files",
    f"""SELECT epoch, source FROM (
        SELECT 0 AS epoch, source, row_number() OVER (ORDER BY {hash_sql('source', 3, 0)}, source) AS r
          FROM (SELECT DISTINCT source FROM documents)
        UNION ALL
        SELECT 1, source, row_number() OVER (ORDER BY {hash_sql('source', 3, 1)}, source)
          FROM (SELECT DISTINCT source FROM documents)) WHERE r <= 3""",
)
def sample_files(spark, sf):
    files = spark.read.parquet(f"{sf}/documents.parquet").select("source")
    epochs = [
        sampling.sample_files(files, "source", 3, 3, epoch).select(F.lit(epoch).alias("epoch"), "source")
        for epoch in (0, 1)
    ]
    return epochs[0].union(epochs[1])


@query(
    "attach_metadata",
    with_sql(
        BASE_SQL,
        select="""SELECT id AS key, cluster_id, CAST(id // 100 AS INTEGER) AS file_id, id % 100 AS row_id,
            round(clip_score, 5) + 0.0 AS clip_score FROM geo""",
    ),
)
def attach_metadata(spark, sf):
    rows = vectors(spark, sf).select(F.col("id").alias("key"), "cluster_id")
    places = rows.select("key", F.expr("cast(key div 100 as int)").alias("file_id"), (F.col("key") % 100).alias("row_id"))
    scores = pair_scores(spark, sf).withColumnRenamed("id", "key")
    return joins.attach_metadata(rows, places, scores).select(
        "key", "cluster_id", "file_id", "row_id", r5("clip_score").alias("clip_score")
    )


@query(
    "attach_embeddings",
    with_sql(
        BASE_SQL,
        select="""SELECT cluster_id, count(*) AS n_rows, round(sum(v[1]), 5) + 0.0 AS first_sum,
            round(sum(v[64]), 5) + 0.0 AS last_sum FROM geo GROUP BY cluster_id""",
    ),
)
def attach_embeddings(spark, sf):
    rows = vectors(spark, sf)
    members = joins.attach_embeddings(rows.select("id", "cluster_id"), rows.select("id", "embedding"), "id")
    entry = F.col("embedding").cast("array<double>")
    return members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r5(F.sum(F.get(entry, F.lit(0)))).alias("first_sum"),
        r5(F.sum(F.get(entry, F.lit(63)))).alias("last_sum"),
    )


# --- pairs and scores -----------------------------------------------------------------------


@query(
    "pairwise_in_cluster",
    with_sql(
        BASE_SQL,
        select="""SELECT a.cluster_id, count(*) AS n_pairs,
            CAST(count(*) FILTER (round(list_dot_product(a.u, b.u), 9) > {t}) AS BIGINT) AS n_above,
            round(max(list_dot_product(a.u, b.u)), 5) AS max_sim
          FROM geo a JOIN geo b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY 1""",
        t=T,
    ),
)
def pairwise_in_cluster(spark, sf):
    return dedup.pairwise_in_cluster(vectors(spark, sf), T).withColumn("max_sim", r5("max_sim"))


_EDGES_SQL = with_sql(
    BASE_SQL,
    select="""SELECT a.cluster_id, a.id AS src, b.id AS dst, round(list_dot_product(a.u, b.u), 5) AS sim
      FROM geo a JOIN geo b ON a.cluster_id = b.cluster_id AND a.id < b.id
      WHERE round(list_dot_product(a.u, b.u), 9) > {t}""",
    t=T,
)


@query("similarity_edges", _EDGES_SQL)
def similarity_edges(spark, sf):
    return dedup.similarity_edges(vectors(spark, sf), T).withColumn("sim", r5("sim"))


@query("similarity_edges_in_blocks", _EDGES_SQL)
def similarity_edges_in_blocks(spark, sf):
    """The same edges with a cluster cut into blocks of about 20 rows."""
    return dedup.similarity_edges(vectors(spark, sf), T, block_rows=20).withColumn("sim", r5("sim"))


_SCORE_COLUMNS = """SELECT id, cluster_id, round(semdedup_score, 5) AS semdedup_score, dis_rank FROM scores"""


def _score_query(name, order, sql_order, seed=0):
    sql = with_sql(BASE_SQL, SCORES_SQL, select=_SCORE_COLUMNS, order=sql_order)

    @query(name, sql)
    def run(spark, sf):
        rows = materialize(scored(spark, sf), "scored")
        return dedup.score_table(rows, order, seed=seed).select(
            "id", "cluster_id", r5("semdedup_score").alias("semdedup_score"), "dis_rank"
        )

    return run


_score_query("semdedup_score_far", "far", "-centroid_dist")
_score_query("semdedup_score_near", "near", "centroid_dist")
_score_query("semdedup_score_random", "random", hash_sql("id", 5), seed=5)
_score_query("semdedup_score_by_pair_score", "score_desc", "-clip_score")

_FAR = with_sql(BASE_SQL, SCORES_SQL, select="{select}", order="-centroid_dist")


def _far_sql(select):
    return _FAR.replace("{select}", select)


def _far_scores(spark, sf):
    rows = scored(spark, sf)
    return rows.drop("embedding").join(dedup.semdedup_score(rows, "far"), "id")


@query("threshold_filter", _far_sql(f"SELECT id, cluster_id FROM scores WHERE semdedup_score <= {T}"))
def threshold_filter(spark, sf):
    return dedup.threshold_filter(_far_scores(spark, sf), T).select("id", "cluster_id")


@query("exclude_clusters", with_sql(BASE_SQL, select="SELECT id, cluster_id FROM vec WHERE cluster_id NOT IN (3, 7)"))
def exclude_clusters(spark, sf):
    return dedup.exclude_clusters(vectors(spark, sf), [3, 7]).select("id", "cluster_id")


@query(
    "exclude_oversize_clusters",
    with_sql(
        BASE_SQL,
        select="""SELECT id, cluster_id FROM vec WHERE cluster_id NOT IN
            (SELECT cluster_id FROM vec GROUP BY 1 HAVING count(*) > (SELECT count(*) // 10 FROM vec))""",
    ),
)
def exclude_oversize_clusters(spark, sf):
    rows = vectors(spark, sf).select("id", "cluster_id")
    return dedup.exclude_clusters(rows, dedup.oversize_clusters(rows, rows.count() // 10))


@query("cluster_sizes", "SELECT label AS cluster_id, count(*) AS n_rows FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf):
    return dedup.cluster_sizes(vectors(spark, sf))


@query(
    "oversize_clusters",
    """SELECT label AS cluster_id, count(*) AS n_rows, count(*) * (count(*) - 1) // 2 AS n_pairs
       FROM embeddings GROUP BY 1 HAVING count(*) > 50""",
)
def oversize_clusters(spark, sf):
    return dedup.oversize_clusters(vectors(spark, sf), 50)


@query(
    "keep_ratio",
    _far_sql(
        f"""SELECT cluster_id, count(*) AS n_rows, count(*) FILTER (semdedup_score <= {T}) AS n_kept,
        round(count(*) FILTER (semdedup_score <= {T}) * 100.0::DOUBLE / count(*), 5) AS kept_percent
        FROM scores GROUP BY ROLLUP (cluster_id)"""
    ),
)
def keep_ratio(spark, sf):
    scores = materialize(_far_scores(spark, sf), "scores")
    kept = dedup.threshold_filter(scores, T)
    return dedup.keep_ratio(scores, kept).withColumn("kept_percent", r5("kept_percent"))


@query(
    "running_keep_ratio",
    _far_sql(
        f"""SELECT cluster_id, n_rows, n_kept, CAST(sum(n_rows) OVER w AS BIGINT) AS total_rows,
          CAST(sum(n_kept) OVER w AS BIGINT) AS total_kept,
          round(sum(n_kept) OVER w * 100.0::DOUBLE / sum(n_rows) OVER w, 5) AS running_percent
        FROM (SELECT cluster_id, count(*) AS n_rows, count(*) FILTER (semdedup_score <= {T}) AS n_kept
          FROM scores GROUP BY 1) WINDOW w AS (ORDER BY cluster_id)"""
    ),
)
def running_keep_ratio(spark, sf):
    scores = materialize(_far_scores(spark, sf), "scores")
    ratios = dedup.keep_ratio(scores, dedup.threshold_filter(scores, T))
    return dedup.running_keep_ratio(ratios).withColumn("running_percent", r5("running_percent"))


_THRESHOLDS = [0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.945]


@query(
    "threshold_sweep",
    _far_sql(
        f"""SELECT threshold, count(*) FILTER (semdedup_score <= threshold) AS n_kept,
        round(count(*) FILTER (semdedup_score <= threshold) * 100.0::DOUBLE / count(*), 5) AS kept_percent
        FROM scores CROSS JOIN (SELECT unnest({_THRESHOLDS}::DOUBLE[]) AS threshold) GROUP BY 1"""
    ),
)
def threshold_sweep(spark, sf):
    swept = dedup.threshold_sweep(_far_scores(spark, sf), _THRESHOLDS)
    return swept.withColumn("kept_percent", r5("kept_percent"))


@query(
    "threshold_for_fraction",
    _far_sql(
        """SELECT fraction, round(min(semdedup_score), 5) AS threshold FROM (
          SELECT semdedup_score, row_number() OVER (ORDER BY semdedup_score) AS r, count(*) OVER () AS n FROM scores)
          CROSS JOIN (SELECT unnest([0.25, 0.5, 0.9]::DOUBLE[]) AS fraction) WHERE r >= ceil(fraction * n) GROUP BY 1"""
    ),
)
def threshold_for_fraction(spark, sf):
    scores = materialize(_far_scores(spark, sf).select("id", "semdedup_score"), "scores")
    found = [(f, dedup.threshold_for_fraction(scores, f)) for f in (0.25, 0.5, 0.9)]
    chosen = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(t).alias("threshold")) for f, t in found])
    return scores.limit(1).select(F.inline(chosen)).withColumn("threshold", r5("threshold"))


@query(
    "score_histogram",
    _far_sql(
        """SELECT CASE WHEN semdedup_score < 0.1 THEN 0 WHEN semdedup_score >= 0.5 THEN 9
          ELSE CAST(floor((semdedup_score - 0.1) / (0.5 - 0.1) * 8) AS BIGINT) + 1 END AS bin,
          count(*) AS n_rows FROM scores GROUP BY 1"""
    ),
)
def score_histogram(spark, sf):
    return dedup.score_histogram(_far_scores(spark, sf), 0.1, 0.5, 8)


# --- groups ---------------------------------------------------------------------------------


def _groups(spark, sf):
    rows = materialize(scored(spark, sf), "scored")
    links = dedup.linking_edges(rows, LOW)
    return rows, materialize(components.connected_components(rows, links), "components")


@query("connected_components", with_sql(BASE_SQL, GROUPS_SQL, select="SELECT id, component FROM grp", threshold=LOW))
def connected_components(spark, sf):
    return _groups(spark, sf)[1]


@query(
    "connected_components_in_blocks",
    SQL["connected_components"],
)
def connected_components_in_blocks(spark, sf):
    """The same groups from spanning forests of many small tiles."""
    rows = vectors(spark, sf)
    return components.connected_components(rows, dedup.linking_edges(rows, LOW, block_rows=10))


_INNER_SQL = """
gdim AS (SELECT component, id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM geo JOIN grp USING (id)),
gmean AS (SELECT component, list(m ORDER BY d) AS mean FROM (
    SELECT component, d, avg(x) AS m FROM gdim GROUP BY component, d) GROUP BY component),
inner_geo AS (SELECT id, component, round(list_distance(v, mean), 9) AS inner_dist
  FROM geo JOIN grp USING (id) JOIN gmean USING (component))"""

_MEDIAN_SQL = """SELECT component, id FROM (SELECT component, id,
    row_number() OVER (PARTITION BY component ORDER BY {dist}, id) AS r,
    count(*) OVER (PARTITION BY component) AS n FROM {source}) WHERE r = n // 2 + 1"""


def _pick_query(name, pick, sql):
    """``pick`` is a rule's name or a function that gives sort Columns."""

    @query(name, sql)
    def run(spark, sf):
        rows, groups = _groups(spark, sf)
        rule = pick if isinstance(pick, str) else pick()
        return components.pick_per_component(rows, groups, rule)

    return run


_pick_query(
    "pick_middle",
    "middle",
    with_sql(BASE_SQL, GROUPS_SQL, select=_MEDIAN_SQL, threshold=LOW, dist="centroid_dist", source="geo JOIN grp USING (id)"),
)
_pick_query(
    "pick_far",
    "far",
    with_sql(
        BASE_SQL,
        GROUPS_SQL,
        select="""SELECT component, id FROM geo JOIN grp USING (id)
          QUALIFY row_number() OVER (PARTITION BY component ORDER BY centroid_dist DESC, id DESC) = 1""",
        threshold=LOW,
    ),
)
_pick_query(
    "pick_inner_middle",
    "inner-middle",
    with_sql(BASE_SQL, GROUPS_SQL, _INNER_SQL, select=_MEDIAN_SQL, threshold=LOW, dist="inner_dist", source="inner_geo"),
)
_pick_query(
    "pick_score_max",
    "score-max",
    with_sql(
        BASE_SQL,
        GROUPS_SQL,
        select="""SELECT component, id FROM geo JOIN grp USING (id)
          QUALIFY row_number() OVER (PARTITION BY component ORDER BY clip_score DESC, id) = 1""",
        threshold=LOW,
    ),
)
_pick_query(
    "pick_by_columns",
    lambda: [F.col("centroid_cosine")],
    with_sql(
        BASE_SQL,
        GROUPS_SQL,
        select="""SELECT component, id FROM geo JOIN grp USING (id)
          QUALIFY row_number() OVER (PARTITION BY component ORDER BY centroid_cosine, id) = 1""",
        threshold=LOW,
    ),
)


# --- end to end -----------------------------------------------------------------------------


_NEAREST_SQL = """
vec0 AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
txt AS (SELECT vec_id AS id,
    list_transform(embedding::DOUBLE[], lambda x, i: x * (((i * 7 + vec_id) % 5) - 1)) AS t FROM embeddings),
dims AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec0),
cent AS (SELECT label AS cluster_id, list(m ORDER BY d) AS c
  FROM (SELECT label, d, avg(x) AS m FROM dims GROUP BY label, d) GROUP BY label),
near AS (SELECT vec0.id, v, c, cent.cluster_id FROM vec0 CROSS JOIN cent
  QUALIFY row_number() OVER (PARTITION BY vec0.id ORDER BY list_distance(v, c), cent.cluster_id) = 1),
geo AS (SELECT near.id, near.cluster_id, v,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u,
    round(list_distance(v, c), 9) AS centroid_dist,
    round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 9) AS centroid_cosine,
    round(list_dot_product(v, t) / sqrt(list_dot_product(v, v) * list_dot_product(t, t)), 9) AS clip_score
  FROM near JOIN txt USING (id))"""


def _with_pair_scores(spark, sf):
    return vectors(spark, sf).select("id", "embedding").join(pair_scores(spark, sf), "id")


@query(
    "score_coreset",
    with_sql(
        _NEAREST_SQL,
        SCORES_SQL,
        select="""SELECT id, cluster_id, round(semdedup_score, 5) AS semdedup_score, dis_rank FROM (
          SELECT *, row_number() OVER (ORDER BY clip_score DESC, id DESC) AS r, count(*) OVER () AS n
          FROM scores WHERE semdedup_score <= {t}) WHERE r > floor(0.3 * n) AND r <= floor(0.7 * n)""",
        order="-centroid_dist",
        t=T,
    ),
)
def score_coreset(spark, sf):
    kept = coresets.score_coreset(
        _with_pair_scores(spark, sf), centroids(spark, sf), T, "far", band=(0.3, 0.7)
    )
    return kept.select("id", "cluster_id", r5("semdedup_score").alias("semdedup_score"), "dis_rank")


@query(
    "graph_coreset",
    with_sql(
        _NEAREST_SQL,
        GROUPS_SQL,
        f"""
mid AS ({_MEDIAN_SQL.replace("{dist}", "centroid_dist").replace("{source}", "geo JOIN grp USING (id)")}),
band1 AS (SELECT geo.* FROM geo JOIN mid USING (id)
  QUALIFY row_number() OVER (ORDER BY clip_score DESC, geo.id DESC) > floor(0.2 * count(*) OVER ())
    AND row_number() OVER (ORDER BY clip_score DESC, geo.id DESC) <= floor(0.8 * count(*) OVER ())),
band2 AS (SELECT * FROM band1
  QUALIFY row_number() OVER (ORDER BY centroid_cosine DESC, id DESC) > floor(0.15 * count(*) OVER ())
    AND row_number() OVER (ORDER BY centroid_cosine DESC, id DESC) <= floor(0.75 * count(*) OVER ()))""",
        select="""SELECT id, cluster_id, round(clip_score, 5) + 0.0 AS clip_score,
            round(centroid_cosine, 5) + 0.0 AS centroid_cosine FROM band2""",
        threshold=LOW,
    ),
)
def graph_coreset(spark, sf):
    kept = coresets.graph_coreset(
        _with_pair_scores(spark, sf),
        centroids(spark, sf),
        LOW,
        "middle",
        bands=[("clip_score", 0.2, 0.8), ("centroid_cosine", 0.15, 0.75)],
    )
    return kept.select(
        "id", "cluster_id", r5("clip_score").alias("clip_score"), r5("centroid_cosine").alias("centroid_cosine")
    )


@query(
    "resumed_score_coreset",
    with_sql(
        _NEAREST_SQL,
        SCORES_SQL,
        select="""SELECT id, cluster_id, round(semdedup_score, 5) AS semdedup_score, dis_rank
          FROM scores WHERE semdedup_score <= {t} AND cluster_id <> 3""",
        order="-centroid_dist",
        t=T,
    ),
)
def resumed_score_coreset(spark, sf):
    """A run that ended after half its batches, and the one that goes on. Cluster 3 is left out."""
    path = scratch_path(spark, "run")
    rows, centres = _with_pair_scores(spark, sf), materialize(centroids(spark, sf), "centroids")
    resumable.score_coreset(rows, centres, path, T, "far", exclude=[3], batches=4, most=2)
    kept = resumable.score_coreset(rows, centres, path, T, "far", exclude=[3], batches=4)
    return kept.select("id", "cluster_id", r5("semdedup_score").alias("semdedup_score"), "dis_rank")


@query(
    "resumed_graph_coreset",
    with_sql(
        _NEAREST_SQL,
        GROUPS_SQL,
        f"""
mid AS ({_MEDIAN_SQL.replace("{dist}", "centroid_dist").replace("{source}", "geo JOIN grp USING (id)")})""",
        select="SELECT id, cluster_id, round(clip_score, 5) + 0.0 AS clip_score FROM geo JOIN mid USING (id) WHERE cluster_id NOT IN (1, 5)",
        threshold=LOW,
    ),
)
def resumed_graph_coreset(spark, sf):
    path = scratch_path(spark, "run")
    rows, centres = _with_pair_scores(spark, sf), materialize(centroids(spark, sf), "centroids")
    out = spark.range(2).select((F.col("id") * 4 + 1).cast("int").alias("cluster_id"))
    resumable.graph_coreset(rows, centres, path, LOW, exclude=out, batches=3, most=1)
    kept = resumable.graph_coreset(rows, centres, path, LOW, exclude=out, batches=3)
    return kept.select("id", "cluster_id", r5("clip_score").alias("clip_score"))


@query(
    "document_duplicate_scores",
    with_sql(DOCUMENTS_SQL, SCORES_SQL, select=_SCORE_COLUMNS, order="-clip_score"),
)
def document_duplicate_scores(spark, sf):
    rows = materialize(document_vectors(spark, sf), "documents")
    return dedup.score_table(rows, "score_desc").select(
        "id", "cluster_id", r5("semdedup_score").alias("semdedup_score"), "dis_rank"
    )


@query(
    "document_groups",
    with_sql(DOCUMENTS_SQL, GROUPS_SQL, select="SELECT component, count(*) AS n_rows FROM grp GROUP BY 1", threshold=DOC_T),
)
def document_groups(spark, sf):
    rows = materialize(document_vectors(spark, sf), "documents")
    links = dedup.linking_edges(rows, DOC_T)
    return components.component_sizes(components.connected_components(rows, links))


@query(
    "write_cluster_map",
    with_sql(
        BASE_SQL,
        select="""SELECT CAST(cluster_id % 4 AS INTEGER) AS bucket, count(*) AS n_rows,
            CAST(count(DISTINCT cluster_id) AS BIGINT) AS n_clusters FROM vec GROUP BY 1""",
    ),
)
def write_cluster_map(spark, sf):
    path = scratch_path(spark, "cluster-map")
    sinks.write_cluster_map(vectors(spark, sf), path, buckets=4)
    return spark.read.parquet(path).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster_id").alias("n_clusters")
    )


@query(
    "pending_clusters",
    with_sql(BASE_SQL, select="SELECT id, cluster_id FROM vec WHERE cluster_id % 2 = 1"),
)
def pending_clusters(spark, sf):
    path = scratch_path(spark, "cluster-map")
    rows = vectors(spark, sf)
    sinks.write_cluster_map(rows.filter("cluster_id % 2 = 0"), path, buckets=4)
    return sinks.pending_clusters(rows.select("id", "cluster_id"), path)


# --- evaluation on vectors ------------------------------------------------------------------

_PROTO_SQL = """
pd AS (SELECT cluster_id, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM geo),
pm AS (SELECT cluster_id, list(m ORDER BY d) AS m FROM (
    SELECT cluster_id, d, avg(x) AS m FROM pd GROUP BY cluster_id, d) GROUP BY cluster_id),
proto AS (SELECT cluster_id AS label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS p FROM pm),
logit AS (SELECT id, cluster_id, label, round(100 * list_dot_product(u, p), 9) AS z,
    row_number() OVER (PARTITION BY id ORDER BY round(100 * list_dot_product(u, p), 9) DESC, label) AS r
  FROM geo CROSS JOIN proto)"""


def _prototypes(spark, sf):
    return evaluation.class_prototypes(vectors(spark, sf), "cluster_id").withColumnRenamed("cluster_id", "label")


def _logits(spark, sf):
    images = vectors(spark, sf).select("id", "embedding", F.col("cluster_id").alias("label"))
    return evaluation.zero_shot_logits(images, _prototypes(spark, sf))


@query(
    "class_prototypes",
    with_sql(
        BASE_SQL,
        _PROTO_SQL,
        select="SELECT label, round(p[1], 5) + 0.0 AS first_entry, round(list_sum(p), 5) + 0.0 AS total FROM proto",
    ),
)
def class_prototypes(spark, sf):
    return _prototypes(spark, sf).select(
        "label",
        r5(F.get("prototype", F.lit(0))).alias("first_entry"),
        r5(F.aggregate("prototype", F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


@query(
    "zero_shot_logits",
    with_sql(BASE_SQL, _PROTO_SQL, select="SELECT id, label, round(z, 5) + 0.0 AS logit FROM logit"),
)
def zero_shot_logits(spark, sf):
    return _logits(spark, sf).select("id", F.posexplode("logits").alias("label", "z")).select(
        "id", "label", r5("z").alias("logit")
    )


@query(
    "topk_accuracy",
    with_sql(
        BASE_SQL,
        _PROTO_SQL,
        select="""SELECT round(avg((r <= 1)::INTEGER), 5) AS top1, round(avg((r <= 5)::INTEGER), 5) AS top5
          FROM logit WHERE label = cluster_id""",
    ),
)
def topk_accuracy(spark, sf):
    found = evaluation.topk_accuracy(_logits(spark, sf))
    return found.select(r5("top1").alias("top1"), r5("top5").alias("top5"))


_RETRIEVAL_SQL = """
nt AS (SELECT id, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS w FROM txt),
pair AS (SELECT geo.id AS i, nt.id AS j, round(list_dot_product(u, w), 9) AS s FROM geo CROSS JOIN nt),
own AS (SELECT i, s FROM pair WHERE i = j),
ranks AS (
  SELECT 'image_to_text' AS direction, pair.i AS id, count(*) FILTER (pair.s > own.s) + 1 AS r
    FROM pair JOIN own ON own.i = pair.i GROUP BY ALL
  UNION ALL
  SELECT 'text_to_image', pair.j, count(*) FILTER (pair.s > own.s) + 1
    FROM pair JOIN own ON own.i = pair.j GROUP BY ALL)"""


@query(
    "retrieval_metrics",
    with_sql(
        BASE_SQL,
        _RETRIEVAL_SQL,
        select="""SELECT direction, round(avg(r), 5) AS mean_rank, floor(median(r - 1)) + 1 AS median_rank,
          round(avg((r <= 1)::INTEGER), 5) AS recall_1, round(avg((r <= 5)::INTEGER), 5) AS recall_5,
          round(avg((r <= 10)::INTEGER), 5) AS recall_10 FROM ranks GROUP BY 1""",
    ),
)
def retrieval_metrics(spark, sf):
    found = evaluation.retrieval_metrics(vectors(spark, sf), texts(spark, sf))
    return found.select(
        "direction", r5("mean_rank").alias("mean_rank"), "median_rank",
        *[r5(f"recall_{k}").alias(f"recall_{k}") for k in (1, 5, 10)],
    )
