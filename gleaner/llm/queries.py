"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    chat,
    decontaminate,
    importance,
    lines,
    lm,
    mixing,
    neardup,
    neighbours,
    phrases,
    quality,
    secrets,
    sharding,
    substrings,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1 --------------------------------------------------------------------------------------

SHARDS = 40


@register
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of equal counts (law ``rows``) on a ring with bounded loads."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard_rows(narrow, SHARDS, "doc_id").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 3 --------------------------------------------------------------------------------------


@register
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    weights = quality.ratios(docs, quality.trusted_ids(table(spark, sf, "labels")))
    return quality.judge(docs, weights).drop("text")


# --- 4 --------------------------------------------------------------------------------------


@register
def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf, "documents")))


# --- 9 --------------------------------------------------------------------------------------


@register
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL["op9_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(md5(text), '') AS digest
  FROM documents),
u AS (
  SELECT *, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE + 0.5)
            / 4503599627370496.0 AS u
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, 1 + place % 3 AS weight FROM s),
levels AS (
  SELECT 0 AS round, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM w) AS level
  UNION ALL
  SELECT round + 1,
         (SELECT (sum(source_size) - sum(CASE WHEN weight * level > 3 * source_size THEN 3 * source_size ELSE 0 END))::DOUBLE
                 / sum(CASE WHEN weight * level > 3 * source_size THEN 0 ELSE weight END) FROM w)
  FROM levels WHERE round < 100),
t AS (
  SELECT w.*, least(weight * (SELECT level FROM levels ORDER BY round DESC LIMIT 1), (3 * source_size)::DOUBLE) AS target
  FROM w),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
q AS (
  SELECT u.doc_id, u.size, u.digest, r.place, r.rest, r.whole, r.source_size, r.target,
         u.u / (1 - u.u) / (rest / source_size / (1 - rest / source_size) * sqrt(source_size::DOUBLE / n / size)) AS rank
  FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source),
units AS (
  SELECT place, rank, doc_id, digest, sum(size) AS size, any_value(rest) AS rest
  FROM q WHERE size > 0 AND rest > 0 GROUP BY ALL),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY place ORDER BY rank, doc_id NULLS FIRST, digest) - size / 2.0 <= rest AS inside
  FROM units)
SELECT q.doc_id, q.size, q.source_size, q.target,
       (q.size * least(3, q.whole + CASE WHEN runs.inside THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN runs ON q.place = runs.place AND q.rank = runs.rank AND q.digest = runs.digest
     AND q.doc_id IS NOT DISTINCT FROM runs.doc_id
"""


# --- 10 -------------------------------------------------------------------------------------

_PROBE = r"\### Assistant: </turn> ok"


@register
def op10_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return chat.digests(chat.expand(turns.unionByName(probe)))


SQL["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(n)),
coded AS (
  SELECT *,
    length('### ') + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ': ', '\c')) + length(': ')
    + length(replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t'), ': ', '\c')) + length('</turn>') + 1 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM coded)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR pos = n THEN upto END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


# --- 6 --------------------------------------------------------------------------------------


@register
def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), width=2, percent=80)


# All pairs of texts that share a shingle, then the smallest id reachable.
SQL["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
e AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (
  SELECT doc_id AS start, doc_id AS seen FROM n
  UNION
  SELECT r.start, l.b FROM r JOIN l ON l.a = r.seen)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT start, min(seen) AS component_id FROM r GROUP BY start) c ON c.start = n.doc_id
"""


# --- 2 --------------------------------------------------------------------------------------


@register
def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold a benchmark item, with item, place and distance."""
    return decontaminate.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# --- 5 --------------------------------------------------------------------------------------


@register
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.cut(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL["op5_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
m AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id NULLS FIRST, i) > 1 AS later FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m WHERE later),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(w) AS n, coalesce(len(g.gone), 0) AS n_gone,
         CASE WHEN g.gone IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(g.gone, x)), lambda x: w[x]) END AS kept
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id)
SELECT doc_id, n::BIGINT AS n_words, n_gone::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256
FROM k
"""


# --- 8 --------------------------------------------------------------------------------------


@register
def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(table(spark, sf, "documents"))


# --- 7 --------------------------------------------------------------------------------------


@register
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.report(table(spark, sf, "documents")).withColumn(
        "removed_lines", F.array_join("removed_lines", ",")
    )


SQL["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
s AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM l),
t AS (SELECT * FROM s WHERE len(words) > 0),
c AS (SELECT words, len(words) AS n, min((doc_id, line_no)) AS first_at, row_number() OVER () AS id FROM t GROUP BY words),
u AS (SELECT id, n, unnest(words) AS word FROM c),
f AS (SELECT word, count(*) AS f FROM u GROUP BY word),
-- Similar sets share one of their rarest words.
p AS (SELECT id, word FROM u JOIN f USING (word)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, word) <= n - ceil(n * 0.8) + 1),
q AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.word = y.word AND x.id <> y.id),
k AS (
  SELECT q.a, q.b FROM q JOIN c a ON a.id = q.a JOIN c b ON b.id = q.b
  WHERE 180 * len(list_intersect(a.words, b.words)) >= 80 * (a.n + b.n)),
e AS (
  SELECT c.id, c.words, count(k.b) AS links, least(c.first_at, coalesce(min(o.first_at), c.first_at)) AS earliest
  FROM c LEFT JOIN k ON k.a = c.id LEFT JOIN c o ON o.id = k.b GROUP BY c.id, c.words, c.first_at),
m AS (SELECT t.doc_id, t.line_no, (t.doc_id, t.line_no) > e.earliest AS removed, e.links FROM t JOIN e ON t.words = e.words),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, sum(links) AS n_links,
         string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (removed) AS removed_lines
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_links, 0)::BIGINT AS n_links, coalesce(removed_lines, '') AS removed_lines
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON g.doc_id = d.doc_id
"""


# --- 11 -------------------------------------------------------------------------------------


@register
def op11_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


# --- 12 -------------------------------------------------------------------------------------


@register
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, table(spark, sf, "benchmark"), longest=1, buckets=10_000, percent=10)
    return drawn.drop("n_words")


# CRC-32 byte by byte, over the distinct words.
SQL["op12_importance_resampling"] = r"""
WITH steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS c
    FROM range(256) r(b))),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
v AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS word FROM w),
d AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM o UNION SELECT word FROM v)),
c AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                               lambda s, b: xor(s >> 8, steps.t[(xor(s, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM d, steps),
s AS (SELECT bucket, count(*) AS n FROM o JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM v JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
f AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_features,
         coalesce(floor(x.total / x.n::DOUBLE)::BIGINT, 0) AS weight
  FROM w LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM o JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id) x
    ON x.doc_id = w.doc_id),
p AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_features >= 20)
SELECT p.doc_id, p.n_features, p.weight, p.score,
       CASE WHEN r.rank <= (SELECT count(*) * 10 // 100 FROM r) THEN r.rank END AS rank
FROM p LEFT JOIN r ON r.doc_id = p.doc_id
"""


# --- 13 -------------------------------------------------------------------------------------


@register
def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"), longest=5, least=100, top=2000)


SQL["op13_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?
-
]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (
  SELECT lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase, m
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) r(m))),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
x AS (
  SELECT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS phrase, a AS larger
  FROM c WHERE m > 2),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.larger >= 100 * c.a)),
u AS (SELECT *, unnest(range(1, m)) AS cut FROM k),
s AS (
  SELECT u.lang, u.phrase, u.a, u.cut, l.a AS l, r.a AS r, n.n,
         (1000::HUGEINT * u.a * n.n::HUGEINT // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:u.cut], ' ')
         JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.cut + 1:u.m], ' ')
         JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
WHERE rank <= 2000
"""


# --- pipeline -------------------------------------------------------------------------------


@register
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
