"""Ranks, bands, samples, splits, joins on keys and training dynamics."""

from pyspark.sql import functions as F

from catalog.inputs import (
    GRID_SQL,
    HISTORY_SQL,
    hash_sql,
    history,
    r5,
    table,
    with_sql,
    worker_history,
)
from gleaner.functions import probabilities
from gleaner.functions.keys import shard_of
from gleaner.operators import dynamics, evaluation, joins, ranking, sampling
from gleaner.plans import coresets
from gleaner.sources import sinks, tables
from gleaner.storage import materialize, scratch_path

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


# --- rank bands -----------------------------------------------------------------------------


# Order and line number repeat in the test table; with part and supplier they do not.
LINE_ID_SQL = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"


def line_id():
    return F.expr(LINE_ID_SQL)


def lines(spark, sf):
    """(id, price, quantity, flag) of every line item."""
    return table(spark, sf, "lineitem").select(
        line_id().alias("id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
    )


LINES_SQL = f"""
line AS (SELECT {LINE_ID_SQL} AS id, l_extendedprice AS price, l_quantity AS quantity,
    l_returnflag AS flag FROM lineitem)"""


def _ranked(order, where):
    return with_sql(
        LINES_SQL,
        select=f"""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS r,
          count(*) OVER () AS n FROM line) WHERE {where}""",
    )


@query("rank_band", _ranked("price DESC, id DESC", "r > floor(0.3 * n) AND r <= floor(0.5 * n)"))
def rank_band(spark, sf):
    return ranking.rank_band(lines(spark, sf), "price", "id", 0.3, 0.5).select("id")


@query("rank_band_with_ties", _ranked("quantity DESC, id DESC", "r > floor(0.15 * n) AND r <= floor(0.55 * n)"))
def rank_band_with_ties(spark, sf):
    return ranking.rank_band(lines(spark, sf), "quantity", "id", 0.15, 0.55).select("id")


@query(
    "rank_band_reference_mode",
    _ranked("price DESC, id DESC", "r > floor(0.3 * n + 1) AND r <= floor(0.5 * n)"),
)
def rank_band_reference_mode(spark, sf):
    return ranking.rank_band(lines(spark, sf), "price", "id", 0.3, 0.5, mode="reference").select("id")


@query(
    "chained_bands",
    with_sql(
        LINES_SQL,
        """
first AS (SELECT * FROM line QUALIFY row_number() OVER (ORDER BY price DESC, id DESC) > floor(0.4 * count(*) OVER ())
  AND row_number() OVER (ORDER BY price DESC, id DESC) <= floor(0.6 * count(*) OVER ()))""",
        select="""SELECT id FROM first
          QUALIFY row_number() OVER (ORDER BY quantity DESC, id DESC) > floor(0.2 * count(*) OVER ())
            AND row_number() OVER (ORDER BY quantity DESC, id DESC) <= floor(0.4 * count(*) OVER ())""",
    ),
)
def chained_bands(spark, sf):
    bands = [("price", 0.4, 0.6), ("quantity", 0.2, 0.4)]
    return ranking.chained_bands(lines(spark, sf), "id", bands).select("id")


@query("top_fraction", _ranked("price DESC, id DESC", "r <= floor(0.2 * n)"))
def top_fraction(spark, sf):
    return ranking.top_fraction(lines(spark, sf), "price", "id", 0.2).select("id")


@query("random_fraction", _ranked(f"{hash_sql('id', 11)} DESC, id DESC", "r <= floor(0.2 * n)"))
def random_fraction(spark, sf):
    return ranking.random_fraction(lines(spark, sf), "id", 0.2, seed=11).select("id")


@query(
    "rank_in_group",
    with_sql(
        LINES_SQL,
        select="SELECT id, flag, row_number() OVER (PARTITION BY flag ORDER BY price DESC, id) AS rank FROM line",
    ),
)
def rank_in_group(spark, sf):
    rows = lines(spark, sf).select("id", "flag", "price")
    return ranking.rank_in_group(rows, [F.col("price").desc(), F.col("id")], ["flag"]).drop("price")


# --- samples --------------------------------------------------------------------------------


@query(
    "per_class_cap",
    with_sql(
        LINES_SQL,
        select=f"""SELECT id, flag FROM line
          QUALIFY row_number() OVER (PARTITION BY flag ORDER BY {hash_sql('id', 13)}, id) <= 50""",
    ),
)
def per_class_cap(spark, sf):
    return sampling.per_class_cap(lines(spark, sf).select("id", "flag"), "flag", "id", 50, seed=13)


@query(
    "per_class_cap_large",
    with_sql(
        LINES_SQL,
        select=f"""SELECT id, flag FROM line
          QUALIFY row_number() OVER (PARTITION BY flag ORDER BY {hash_sql('id', 13)}, id) <= 2000""",
    ),
)
def per_class_cap_large(spark, sf):
    return sampling.per_class_cap(lines(spark, sf).select("id", "flag"), "flag", "id", 2000, seed=13)


@query(
    "resample_weighted",
    f"""WITH w AS (SELECT 'shard-' || c_custkey AS url, c_custkey % 7 AS weight FROM customer),
    iv AS (SELECT url, sum(weight) OVER (ORDER BY url) - weight AS s, sum(weight) OVER (ORDER BY url) AS e
      FROM w WHERE weight > 0),
    pt AS (SELECT range AS draw, {hash_sql('range', 17, 2)} / 4503599627370496.0::DOUBLE
      * (SELECT sum(weight) FROM w) AS p FROM range((SELECT count(*) FROM orders)))
    SELECT url, count(*) AS n_draws FROM pt JOIN iv ON p >= s AND p < e GROUP BY 1""",
)
def resample_weighted(spark, sf):
    shards = table(spark, sf, "customer").select(
        F.concat(F.lit("shard-"), F.col("c_custkey").cast("string")).alias("url"),
        (F.col("c_custkey") % 7).alias("weight"),
    )
    draws = table(spark, sf, "orders").count()
    drawn = sampling.resample_weighted(shards, "url", draws, 17, 2, "weight")
    return drawn.groupBy("url").agg(F.count(F.lit(1)).alias("n_draws"))


@query(
    "shuffle_deterministic",
    with_sql(
        LINES_SQL,
        select=f"SELECT id, {hash_sql('id', 42)} AS shuffle_key FROM line",
    ),
)
def shuffle_deterministic(spark, sf):
    return sampling.shuffle_deterministic(lines(spark, sf).select("id"), "id", seed=40, epoch=2)


def _mixed(x, constants):
    factor, summand = constants
    return f"((({x}) % 2147483647) * (({x}) % 2147483647) % 2147483647 * {factor} + {summand}) % 2147483647"


def _permuted_sql(x, seed, epoch):
    """Columns l1, h1, l2, h2: two rounds on either part of ``x``; needs ``a`` and ``b``."""
    c = sampling.round_constants(seed, epoch)
    return f"""({x} % a + {_mixed(f'{x} // a', c[0])}) % a AS l1, ({x} // a + {_mixed('l1', c[1])}) % b AS h1,
      (l1 + {_mixed('h1', c[2])}) % a AS l2, (h1 + {_mixed('l2', c[3])}) % b AS h2"""


@query(
    "shuffle_rows",
    f"""WITH RECURSIVE k AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders),
    m AS (SELECT n, a, (n + a - 1) // a AS b FROM (
      SELECT n, CASE WHEN f * f < n THEN f + 1 ELSE f END AS a
      FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS f FROM orders))),
    walk AS (
      SELECT key, 0 AS step, l2 + a * h2 AS x FROM (SELECT key, a, {_permuted_sql('r', 40, 2)} FROM k, m)
      UNION ALL
      SELECT key, step + 1, l2 + a * h2 FROM (SELECT key, step, a, {_permuted_sql('x', 40, 2)} FROM walk, m WHERE x >= n))
    SELECT key, x AS position FROM walk, m WHERE x < n""",
)
def shuffle_rows(spark, sf):
    numbered = ranking.row_index(_keys(spark, sf), [F.col("key")], "row")
    return sampling.shuffle_rows(numbered, "row", numbered.count(), 40, 2).select("key", "position")


def _keys(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))


@query(
    "split_by_worker",
    "SELECT o_orderkey AS key, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS worker FROM orders",
)
def split_by_worker(spark, sf):
    return ranking.split_by_worker(_keys(spark, sf), [F.col("key")], 7)


@query(
    "contiguous_split",
    """SELECT o.key, max(b.i) AS part FROM (SELECT o_orderkey AS key,
          row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) o
        JOIN (SELECT i, i * (SELECT count(*) FROM orders) // 13 AS s FROM range(13) t(i)) b ON b.s <= o.r
        GROUP BY 1""",
)
def contiguous_split(spark, sf):
    return ranking.contiguous_split(_keys(spark, sf), [F.col("key")], 13)


@query(
    "contiguous_split_drop_tail",
    """SELECT key, r // (n // 13) AS part FROM (SELECT o_orderkey AS key,
          row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
        WHERE r < 13 * (n // 13)""",
)
def contiguous_split_drop_tail(spark, sf):
    return ranking.contiguous_split(_keys(spark, sf), [F.col("key")], 13, drop_tail=True)


@query(
    "even_splits",
    """SELECT o.key, max(b.i) AS part FROM (SELECT o_orderkey AS key,
          row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) o
        JOIN (SELECT i, round_even(i * (SELECT count(*) FROM orders) / 16.0::DOUBLE, 0) AS s FROM range(16) t(i)) b
          ON b.s <= o.r GROUP BY 1""",
)
def even_splits(spark, sf):
    return ranking.even_splits(_keys(spark, sf), [F.col("key")], 16)


# --- joins and keys -------------------------------------------------------------------------


@query("shard_of", "SELECT o_orderkey AS key, CAST(o_orderkey // 10000 AS INTEGER) AS shard FROM orders")
def shard_of_key(spark, sf):
    return _keys(spark, sf).withColumn("shard", shard_of("key"))


@query(
    "coreset_semi_join",
    """SELECT l_orderkey AS key, count(*) AS n_rows FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""",
)
def coreset_semi_join(spark, sf):
    samples = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    coreset = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return joins.coreset_semi_join(samples, coreset).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "first_by_key",
    """SELECT l_partkey AS key, l_orderkey AS shard, l_suppkey * 10 + l_linenumber AS position,
         l_extendedprice AS price FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey * 10 + l_linenumber) = 1""",
)
def first_by_key(spark, sf):
    samples = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("key"),
        F.col("l_orderkey").alias("shard"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.col("l_extendedprice").alias("price"),
    )
    return joins.first_by_key(samples, "key", ["shard", "position"])


@query(
    "class_map",
    """WITH t AS (SELECT p_brand AS class_name, row_number() OVER (ORDER BY p_brand) - 1 AS i
         FROM (SELECT DISTINCT p_brand FROM part)),
       v AS (SELECT class_name, row_number() OVER (ORDER BY class_name) - 1 AS j
         FROM (SELECT DISTINCT p_brand AS class_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)))
       SELECT class_name, CAST(j AS INTEGER) AS idx_validation, CAST(i AS INTEGER) AS idx_train
       FROM v JOIN t USING (class_name)""",
)
def class_map(spark, sf):
    """Classes of all parts, and of those that were ordered."""
    classes = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("class_name"))
    ordered = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"))
    return joins.class_map(classes, joins.coreset_semi_join(classes, ordered), "class_name")


def _predictions(spark, sf):
    """(id, ranked): five classes per document, and accepted labels, some lists empty."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    ranked = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("n_chars") + i * 3) % 11).cast("int"))
    found = F.filter(
        F.array(*[F.when(F.col("id") % (k + 2) == 0, F.lit(k)) for k in range(4)]), lambda x: x.isNotNull()
    )
    return docs.select("id", ranked.alias("ranked")), docs.select("id", found.alias("labels"))


PREDICTIONS_SQL = """
pred AS (SELECT doc_id AS id, [(n_chars + i * 3) % 11 FOR i IN range(5)] AS ranked,
    list_filter([CASE WHEN doc_id % (k + 2) = 0 THEN k END FOR k IN range(4)], lambda x: x IS NOT NULL) AS labels
  FROM documents),
hit AS (SELECT id, list_has_any(ranked[1:1], labels) AS hit_1, list_has_any(ranked[1:5], labels) AS hit_5
  FROM pred WHERE len(labels) > 0)"""


@query("membership", with_sql(PREDICTIONS_SQL, select="SELECT id, hit_1, hit_5 FROM hit"))
def membership(spark, sf):
    predictions, labels = _predictions(spark, sf)
    return joins.membership(predictions, "ranked", labels, "id", "labels", [1, 5])


@query(
    "real_accuracy",
    with_sql(
        PREDICTIONS_SQL,
        select="""SELECT round(avg(hit_1::INTEGER) * 100, 5) AS real_top1,
          round(avg(hit_5::INTEGER) * 100, 5) AS real_top5 FROM hit""",
    ),
)
def real_accuracy(spark, sf):
    predictions, labels = _predictions(spark, sf)
    found = evaluation.real_accuracy(predictions, labels, "id")
    return found.select(r5("real_top1").alias("real_top1"), r5("real_top5").alias("real_top5"))


# --- model outputs --------------------------------------------------------------------------


def _logits(spark, sf):
    """(id, logits, label): four columns of a line item stand for the logits of a sample."""
    return table(spark, sf, "lineitem").select(
        line_id().alias("id"),
        F.array(
            F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 40, F.col("l_linenumber").cast("double")
        ).alias("logits"),
        (F.col("l_linenumber") % 4).alias("label"),
    )


LOGITS_SQL = f"""
lg AS (SELECT {LINE_ID_SQL} AS id,
    [l_quantity / 10, l_discount * 50, l_tax * 40, l_linenumber::DOUBLE] AS z, l_linenumber % 4 AS label FROM lineitem)"""


@query(
    "target_probability",
    with_sql(
        LOGITS_SQL,
        select="""SELECT id, round(exp(z[label + 1] - list_max(z)) /
          list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 5) AS prob FROM lg""",
    ),
)
def target_probability(spark, sf):
    return _logits(spark, sf).select("id", r5(probabilities.target_probability("logits", "label")).alias("prob"))


@query(
    "select_classes",
    with_sql(
        LOGITS_SQL,
        select="""SELECT id, round(z[4], 5) AS first_class, round(z[2], 5) AS second_class FROM lg""",
    ),
)
def select_classes(spark, sf):
    chosen = _logits(spark, sf).select("id", probabilities.select_classes("logits", [3, 1]).alias("chosen"))
    return chosen.select(
        "id", r5(F.get("chosen", F.lit(0))).alias("first_class"), r5(F.get("chosen", F.lit(1))).alias("second_class")
    )


@query(
    "weighted_mean",
    """SELECT l_returnflag AS flag, round(sum(l_discount * l_quantity) / sum(l_quantity), 5) AS weighted_mean,
       round(sum(l_quantity), 5) AS weight FROM lineitem GROUP BY 1""",
)
def weighted_mean(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_discount", "l_quantity")
    return evaluation.weighted_mean(rows, "l_discount", "l_quantity", ["flag"]).select(
        "flag", r5("weighted_mean").alias("weighted_mean"), r5("weight").alias("weight")
    )


@query(
    "running_best",
    """WITH acc AS (SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 5) AS accuracy
         FROM events GROUP BY ALL)
       SELECT run, epoch, accuracy, max(accuracy) OVER (PARTITION BY run ORDER BY epoch) AS best FROM acc""",
)
def running_best(spark, sf):
    accuracy = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(r5(F.avg("value")).alias("accuracy"))
    )
    return evaluation.running_best(accuracy, "accuracy", ["run"])


# --- training dynamics ----------------------------------------------------------------------


@query("merge_ranks", with_sql(HISTORY_SQL, select="SELECT epoch, sample_id, prob FROM hist"))
def merge_ranks(spark, sf):
    return dynamics.merge_ranks(worker_history(spark, sf))


@query(
    "rolling_buffer",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        select="""SELECT sample_id, epoch, array_to_string(list_transform(b, lambda x: CAST(x AS VARCHAR)), ' ') AS buffer
          FROM buf JOIN hist USING (sample_id, epoch)""",
        window=WINDOW,
    ),
)
def rolling_buffer(spark, sf):
    buffers = dynamics.rolling_buffer(history(spark, sf), WINDOW)
    text = F.concat_ws(" ", F.transform("buffer", lambda x: x.cast("string")))
    return buffers.select("sample_id", "epoch", text.alias("buffer"))


@query(
    "buffer_uncertainty",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        select="SELECT sample_id, epoch, round(uncertainty, 5) AS uncertainty FROM unc JOIN hist USING (sample_id, epoch)",
        window=WINDOW,
    ),
)
def buffer_uncertainty(spark, sf):
    buffers = dynamics.rolling_buffer(history(spark, sf), WINDOW)
    return buffers.select(
        "sample_id", "epoch", r5(dynamics.buffer_uncertainty("buffer", WINDOW)).alias("uncertainty")
    )


@query(
    "window_uncertainty",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        select="SELECT sample_id, epoch, round(uncertainty, 5) AS uncertainty FROM unc WHERE prob <> 0",
        window=WINDOW,
    ),
)
def window_uncertainty(spark, sf):
    found = dynamics.window_uncertainty(history(spark, sf), WINDOW)
    return found.select("sample_id", "epoch", r5("uncertainty").alias("uncertainty"))


_DYNAMIC_SQL = """
dyn AS (SELECT sample_id, round(avg(uncertainty), 5) AS dynamic_uncertainty FROM unc
  WHERE p >= {window} - 1 AND p <= (SELECT count(*) FROM pos) - 2 GROUP BY 1)"""


@query(
    "dynamic_uncertainty",
    with_sql(
        HISTORY_SQL, GRID_SQL, _DYNAMIC_SQL, select="SELECT sample_id, dynamic_uncertainty FROM dyn", window=WINDOW
    ),
)
def dynamic_uncertainty(spark, sf):
    found = dynamics.dynamic_uncertainty(history(spark, sf), WINDOW)
    return found.select("sample_id", r5("dynamic_uncertainty").alias("dynamic_uncertainty"))


def _file_list(spark, sf):
    """Every customer is a sample; users of the events have a history."""
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") - 1).alias("sample_id"),
        F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("path"),
        F.col("c_nationkey").cast("int").alias("label"),
    )


@query(
    "prune_by_uncertainty",
    with_sql(
        HISTORY_SQL,
        GRID_SQL,
        """
fl AS (SELECT c_custkey - 1 AS sample_id, '/' || c_custkey AS path, CAST(c_nationkey AS INTEGER) AS label FROM customer),
dyn AS (SELECT fl.*, coalesce(u, 0) AS du FROM fl LEFT JOIN (SELECT sample_id, round(avg(uncertainty), 9) AS u FROM unc
  WHERE p >= {window} - 1 AND p <= (SELECT count(*) FROM pos) - 2 GROUP BY 1) USING (sample_id))""",
        select="""SELECT sample_id, path, label FROM dyn
          QUALIFY row_number() OVER (ORDER BY du DESC, sample_id DESC) <= floor(0.75 * count(*) OVER ())""",
        window=WINDOW,
    ),
)
def prune_by_uncertainty(spark, sf):
    kept = coresets.uncertainty_coreset(_file_list(spark, sf), history(spark, sf), WINDOW, 0.75)
    return kept.select("sample_id", "path", "label")


# --- keys, lists and sizes ------------------------------------------------------------------


@query(
    "write_coreset_by_shard",
    """WITH s AS (SELECT range::INTEGER AS shard FROM range((SELECT max(o_orderkey) // 10000 + 3 FROM orders))),
       k AS (SELECT CAST(o_orderkey // 10000 AS INTEGER) AS shard, o_orderkey AS key FROM (
         SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS r, count(*) OVER () AS n FROM orders)
         WHERE r > floor(0.2 * n) AND r <= floor(0.7 * n))
       SELECT s.shard, count(k.key) AS n_keys,
         sha256(coalesce(string_agg(k.key::VARCHAR, ',' ORDER BY k.key), '')) AS keys_sha256
       FROM s LEFT JOIN k ON k.shard = s.shard GROUP BY 1""",
)
def write_coreset_by_shard(spark, sf):
    """A band of the orders by price, as key lists per shard."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    kept = ranking.rank_band(orders, "o_totalprice", "key", 0.2, 0.7)
    shards = _keys(spark, sf).agg((F.expr("max(key) div 10000") + 3).alias("n")).first()["n"]
    path = scratch_path(spark, "coreset")
    sinks.write_coreset_by_shard(kept, path, shards)
    return spark.read.parquet(path).select(
        "shard",
        F.size("keys").cast("bigint").alias("n_keys"),
        F.sha2(F.concat_ws(",", F.col("keys").cast("array<string>")).cast("binary"), 256).alias("keys_sha256"),
    )


def _listed_files(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("class_name"), F.format_string("%06d.jpg", F.expr("(doc_id * 7919) % 1000003")).alias("file_name")
    )


FILES_SQL = """
f AS (SELECT source AS class_name, lpad(CAST((doc_id * 7919) % 1000003 AS VARCHAR), 6, '0') || '.jpg' AS file_name
  FROM documents),
list AS (SELECT row_number() OVER (ORDER BY class_name, file_name) - 1 AS sample_id,
    '/' || class_name || '/' || file_name AS path,
    CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INTEGER) AS label FROM f)"""


@query("make_file_list", with_sql(FILES_SQL, select="SELECT sample_id, path, label FROM list"))
def make_file_list(spark, sf):
    return tables.make_file_list(_listed_files(spark, sf))


@query("read_file_list", with_sql(FILES_SQL, select="SELECT sample_id, path, label FROM list"))
def read_file_list(spark, sf):
    """Written as text and read back: line numbers are the sample ids again."""
    path = scratch_path(spark, "file-list")
    sinks.write_file_list(tables.make_file_list(_listed_files(spark, sf)), path)
    return tables.read_file_list(spark, path)


@query(
    "write_file_list",
    with_sql(
        FILES_SQL,
        select="""SELECT row_number() OVER (ORDER BY sample_id) - 1 AS line_id, path || ' ' || label AS line
          FROM (SELECT *, row_number() OVER (ORDER BY """
        + hash_sql("sample_id", 9)
        + """ DESC, sample_id DESC) AS r, count(*) OVER () AS n FROM list) WHERE r <= floor(0.75 * n)""",
    ),
)
def write_file_list(spark, sf):
    """Three quarters of the list, chosen by a seeded hash."""
    path = scratch_path(spark, "file-list")
    listed = materialize(tables.make_file_list(_listed_files(spark, sf)), "list")
    sinks.write_file_list(ranking.random_fraction(listed, "sample_id", 0.75, 9), path)
    return tables.number_lines(spark, path).select("line_id", F.col("value").alias("line"))


@query(
    "read_prob_history",
    with_sql(
        HISTORY_SQL,
        select="""SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY sample_id) - 1 AS sample_id, prob
          FROM hist""",
    ),
)
def read_prob_history(spark, sf):
    """One folder of text per epoch; the line number is the sample."""
    path = scratch_path(spark, "history")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_epoch = history(spark, sf).repartition(n, "epoch").sortWithinPartitions("epoch", "sample_id")
    by_epoch.select("epoch", F.col("prob").cast("string").alias("value")).write.partitionBy("epoch").text(path)
    return tables.read_prob_history(spark, path, r"epoch=(\d+)")


@query(
    "row_offsets",
    """SELECT l_returnflag || l_linestatus AS file, count(*) AS rows,
       CAST(coalesce(sum(count(*)) OVER (ORDER BY l_returnflag || l_linestatus
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
       FROM lineitem GROUP BY 1""",
)
def row_offsets(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("file"))
    return joins.row_offsets(rows, "file")


@query(
    "global_to_local",
    """WITH o AS (SELECT l_returnflag || l_linestatus AS file, count(*) AS n FROM lineitem GROUP BY 1),
       b AS (SELECT file, n, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
         FROM o)
       SELECT o_orderkey AS id, file, CAST(o_orderkey - s AS BIGINT) AS row_id
       FROM orders JOIN b ON o_orderkey >= s AND o_orderkey < s + n""",
)
def global_to_local(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("file"))
    offsets = materialize(joins.row_offsets(rows, "file"), "offsets")
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return joins.global_to_local(ids, "id", offsets, "file")


@query(
    "source_size",
    """SELECT CAST(sum(n) AS BIGINT) AS total_size, count(*) AS num_shards FROM (
       SELECT CAST(o_orderkey // 1000 AS BIGINT) AS shard, count(*) AS n FROM orders GROUP BY 1)""",
)
def source_size(spark, sf):
    sizes = (
        table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 1000").alias("shard")).agg(F.count(F.lit(1)).alias("size"))
    )
    return tables.source_size(sizes.select("shard"), sizes)
