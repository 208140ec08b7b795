"""Queries of the training-data operators over the test tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.functions.names import clean_name
from twintable.llm.components import connected_groups
from twintable.llm.knn import nearest
from twintable.llm.packing import bound_of, certified, pack, pieces_of
from twintable.llm.prose import odd_share, odd_texts
from twintable.llm.setjoin import similar_sets
from twintable.llm.survivorship import best_values, judged_values, recency_claims, surviving_records
from twintable.llm.tokens import encode_corpus, load, token_counts
from twintable.plans.problem_queries import clean_sql
from twintable.runtime import cut, table


def source_sets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per table and source, from both sides of the rows of common_ancestors."""
    t = table(spark, folder, "common_ancestors")
    sides = [t.select(clean_name(f"table_{x}").alias("name"), F.explode(f"sources_{x}").alias("s")) for x in "ab"]
    return sides[0].unionByName(sides[1]).select("name", clean_name("s").alias("source"))


def p1_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tables that share enough sources, with its true overlap ratio."""
    pairs = similar_sets(source_sets(spark, folder), "name", "source", share=0.8, least=3)
    return pairs.select(
        F.col("a").alias("table_a"), F.col("b").alias("table_b"), F.col("common").cast("bigint").alias("common_source_count"),
        F.round("ratio", 6).alias("source_overlap_ratio"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_ratios(spark, folder).select("table_a", "table_b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "similar_pairs")
    score = F.col("cosine_similarity")
    links = t.where(score.isNotNull() & ~F.isnan(score) & (score >= 0.8)).select(clean_name("table_a").alias("a"), clean_name("table_b").alias("b"))
    return connected_groups(links, "a", "b").select(F.col("member").alias("full_table_name"), "group_id")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other tables of each table, as far as their cosine reaches 0.8."""
    t = table(spark, folder, "embeddings_df").select(clean_name("full_table_name").alias("name"), "embedding")
    return nearest(t, "name", "embedding", dims=64, k=5, least=0.8)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_neighbours(spark, folder).select(F.least("name", "neighbour").alias("table_a"), F.greatest("name", "neighbour").alias("table_b")).distinct()


def recommendation_groups(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "recommendations")
    return connected_groups(t.select(clean_name("table_a").alias("a"), clean_name("table_b").alias("b")), "a", "b")


def usage_claims(spark: SparkSession, folder: str) -> DataFrame:
    """What the records of table_usage_stats state about each table's reads, last write and jobs."""
    t = table(spark, folder, "table_usage_stats").withColumn("table", clean_name("table_name"))
    write, seen = F.col("last_write"), F.col("snapshot_at")
    fields = {
        "read_count": (F.col("read_count"), F.col("read_count") >= 0),
        "last_write": (F.unix_micros(write.cast("timestamp")), write.isNotNull() & (F.year(write) != 1970) & (write <= seen)),
        "job_count": (F.col("job_count"), F.col("job_count") >= 0),
    }
    return recency_claims(t, "table", "snapshot_at", fields)


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """The source of truth of each group, its record filled field by field with the latest value judged true."""
    rank = ["read_count", "last_write", "job_count"]
    values = best_values(judged_values(cut(usage_claims(spark, folder))), rank)
    return surviving_records(recommendation_groups(spark, folder), values, "key", rank).withColumn("last_write", F.timestamp_micros("last_write"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """The records as text, '' for a field that no table of the group has."""
    text = {"read_count": F.col("read_count").cast("string"), "last_write": F.date_format("last_write", "yyyy-MM-dd HH:mm:ss"), "job_count": F.col("job_count").cast("string")}
    return p5_records(spark, folder).select("group_id", "survivor", *[F.coalesce(c, F.lit("")).alias(n) for n, c in text.items()])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_records(spark, folder).select("group_id", F.col("survivor").alias("sot_table"))


def p5_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Every value stated about a table's field, and whether the model judges it true."""
    judged = judged_values(cut(usage_claims(spark, folder)))
    return judged.select(F.col("key").alias("full_table_name"), "field", F.col("value").cast("string").alias("value"), (F.col("probability") >= 0.5).alias("judged_true"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", load()).select(F.col("id").alias("doc_id"), "ids")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each review, in tokens, in a container of 2,048; longer ones in pieces."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text", load())
    return pack(sizes, "id", "n", 2048).select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"), "container")


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews packed by their characters: items, their sum, containers that any packing needs, and whether ours are hardly more."""
    t = table(spark, folder, "documents")
    pieces = cut(pieces_of(t, "doc_id", "n_chars", 2048))
    bound = bound_of(pieces, 2048)
    rows, proof = certified(t, "doc_id", "n_chars", 2048)
    load = rows.where("size > 0").groupBy("container").agg(F.sum("size").alias("load"))
    used = load.agg(F.count("*").alias("used"), F.max("load").alias("fullest"))
    # No partition's bound may exceed what it used, nor all together fall short of the bound of all pieces.
    sound = proof.agg(F.coalesce(F.every(F.col("bound") <= F.col("containers")), F.lit(True)).alias("sound"))
    total = pieces.agg(F.count("*").alias("pieces"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"))
    fine = F.col("sound") & F.coalesce(F.col("fullest") <= 2048, F.lit(True)) & F.col("used").between(bound, 1.01 * bound + 1)
    return total.crossJoin(used).crossJoin(sound).select("pieces", "size", F.lit(bound).cast("bigint").alias("bound"), fine.alias("certified"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return odd_texts(table(spark, folder, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each text that is no running language, and its cost under the prose model."""
    scored = odd_share(table(spark, folder, "documents"), "doc_id", "text")
    return scored.select(F.col("id").alias("doc_id"), F.round("share", 6).alias("odd_share"), F.round("nats", 6).alias("nats_per_token"))


QUERIES = {
    "p1_found": p1_found,
    "p1_ratios": p1_ratios,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_records": p5_report,
    "p5_truth": p5_truth,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_bounds": p8_bounds,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_PAIRS = f"""
WITH raw AS (
  SELECT {clean_sql('table_a')} AS t, unnest(sources_a) AS s FROM common_ancestors
  UNION ALL SELECT {clean_sql('table_b')}, unnest(sources_b) FROM common_ancestors),
e AS (SELECT DISTINCT t, {clean_sql('s')} AS s FROM raw WHERE t IS NOT NULL AND {clean_sql('s')} IS NOT NULL),
n AS (SELECT t, count(*) AS n FROM e GROUP BY t),
c AS (SELECT x.t AS a, y.t AS b, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.t < y.t GROUP BY x.t, y.t),
p AS (SELECT a, b, k, k / least(na.n, nb.n) AS ratio FROM c JOIN n na ON na.t = a JOIN n nb ON nb.t = b
      WHERE k >= 3 AND k * 5 >= 4 * least(na.n, nb.n))"""

_GROUPS = """
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
label(n, g) USING KEY (n) AS (
  SELECT a, least(a, min(b)) FROM ends GROUP BY a
  UNION
  SELECT ends.a, min(l.g) FROM label l JOIN ends ON ends.b = l.n JOIN recurring.label k ON k.n = ends.a
  WHERE l.g < k.g GROUP BY ends.a)"""

_BEST = f"""
stats AS (SELECT *, {clean_sql('table_name')} AS t FROM table_usage_stats),
best AS (
  SELECT t,
    arg_max(read_count, (snapshot_at, read_count)) FILTER (WHERE read_count >= 0) AS read_count,
    arg_max(last_write, (snapshot_at, last_write)) FILTER (WHERE year(last_write) <> 1970 AND last_write <= snapshot_at) AS last_write,
    arg_max(job_count, (snapshot_at, job_count)) FILTER (WHERE job_count >= 0) AS job_count
  FROM stats WHERE t IS NOT NULL GROUP BY t),
ranked AS (
  SELECT g AS group_id, n, read_count, last_write, job_count, row_number() OVER (
    PARTITION BY g ORDER BY read_count DESC NULLS LAST, last_write DESC NULLS LAST, job_count DESC NULLS LAST, n) AS r
  FROM label LEFT JOIN best ON t = n)"""

_REC_LINKS = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT a, b FROM (SELECT {clean_sql('table_a')} AS a, {clean_sql('table_b')} AS b FROM recommendations)
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"""

_ROUNDS = 30


def _truth_sql() -> str:
    """The model in SQL, for a fixed number of rounds."""
    parts = [f"""
said AS (
  SELECT DISTINCT t, f, v, snapshot_at AS o FROM (
    SELECT {clean_sql('table_name')} AS t, 'read_count' AS f, CASE WHEN read_count >= 0 THEN read_count END AS v, snapshot_at FROM table_usage_stats
    UNION ALL SELECT {clean_sql('table_name')}, 'last_write', CASE WHEN year(last_write) <> 1970 AND last_write <= snapshot_at THEN epoch_us(last_write) END, snapshot_at FROM table_usage_stats
    UNION ALL SELECT {clean_sql('table_name')}, 'job_count', CASE WHEN job_count >= 0 THEN job_count END, snapshot_at FROM table_usage_stats)
  WHERE t IS NOT NULL AND v IS NOT NULL AND snapshot_at IS NOT NULL),
latest AS (SELECT t, f, max(row(o, v)) AS m FROM said GROUP BY t, f),
claims AS MATERIALIZED (
  SELECT DISTINCT t, f, v, f || CASE WHEN row(o, v) = m THEN ' new' ELSE ' ' || CAST(floor(log2((epoch_us(m[1]) - epoch_us(o)) / 86400000000.0::DOUBLE + 1)) AS INTEGER) END AS s
  FROM said JOIN latest USING (t, f)),
speaks AS MATERIALIZED (SELECT DISTINCT t, f, s FROM claims),
q0 AS MATERIALIZED (SELECT DISTINCT s, CASE WHEN s LIKE '% new' THEN 0.95 ELSE 0.5 END::DOUBLE AS sens, CASE WHEN s LIKE '% new' THEN 0.05 ELSE 0.5 END::DOUBLE AS fpr FROM claims)"""]
    for i in range(_ROUNDS + 1):
        parts.append(f"""
p{i} AS MATERIALIZED (
  SELECT n.t, n.f, n.v, 1 / (1 + exp(-(base + more))) AS p
  FROM (SELECT t, f, v, sum(ln(sens / fpr) - ln((1 - sens) / (1 - fpr))) AS more FROM claims JOIN q{i} USING (s) GROUP BY t, f, v) n
  JOIN (SELECT t, f, sum(ln((1 - sens) / (1 - fpr))) AS base FROM speaks JOIN q{i} USING (s) GROUP BY t, f) d ON d.t = n.t AND d.f = n.f)""")
        if i < _ROUNDS:
            parts.append(f"""
q{i + 1} AS MATERIALIZED (
  SELECT s, (t1 + 20 * q0.sens) / (tt + 20) AS sens, (f1 + 20 * q0.fpr) / (ff + 20) AS fpr FROM q0
  JOIN (SELECT s, sum(p) AS t1, sum(1 - p) AS f1 FROM claims JOIN p{i} USING (t, f, v) GROUP BY s) x USING (s)
  JOIN (SELECT s, sum(tt) AS tt, sum(ff) AS ff FROM speaks JOIN (SELECT t, f, sum(p) AS tt, sum(1 - p) AS ff FROM p{i} GROUP BY t, f) USING (t, f) GROUP BY s) y USING (s))""")
    return f"WITH {','.join(parts)} SELECT t AS full_table_name, f AS field, CAST(v AS VARCHAR) AS value, p >= 0.5 AS judged_true FROM p{_ROUNDS}"


SQL = {
    "p8_bounds": """
WITH d AS (SELECT greatest(coalesce(n_chars, 0), 0) AS n FROM documents),
p AS (SELECT least(2048, n - 2048 * k) AS s FROM (SELECT n, unnest(range(greatest(CAST(ceil(n / 2048) AS BIGINT), 1))) AS k FROM d)),
c AS (SELECT s, count(*) AS m FROM p WHERE s > 0 GROUP BY s),
b AS (
  SELECT t, sum(m) FILTER (WHERE s > 2048 - t) AS huge, sum(m) FILTER (WHERE s > 1024 AND s <= 2048 - t) AS large,
    sum(m * s) FILTER (WHERE s > 1024 AND s <= 2048 - t) AS large_mass, sum(m * s) FILTER (WHERE s BETWEEN t AND 1024) AS middle
  FROM range(1025) r(t), c GROUP BY t)
SELECT (SELECT count(*) FROM p) AS pieces, CAST((SELECT sum(s) FROM p) AS BIGINT) AS size,
  CAST(max(coalesce(huge, 0) + coalesce(large, 0) + greatest(0, ceil((coalesce(middle, 0) - (2048 * coalesce(large, 0) - coalesce(large_mass, 0))) / 2048))) AS BIGINT) AS bound, TRUE AS certified
FROM b""",
    "p5_truth": _truth_sql(),
    "p1_found": f"{_PAIRS} SELECT a AS table_a, b AS table_b FROM p",
    "p1_ratios": f"{_PAIRS} SELECT a AS table_a, b AS table_b, k AS common_source_count, round(ratio, 6) AS source_overlap_ratio FROM p",
    "p3_found": f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT a, b FROM (
    SELECT {clean_sql('table_a')} AS a, {clean_sql('table_b')} AS b FROM similar_pairs
    WHERE cosine_similarity >= 0.8 AND NOT isnan(cosine_similarity))
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),{_GROUPS}
SELECT n AS full_table_name, g AS group_id FROM label""",
    "p4_found": f"""
WITH raw AS (SELECT {clean_sql('full_table_name')} AS n, embedding::DOUBLE[] AS v FROM embeddings_df),
ok AS (SELECT n, min(v) AS v FROM raw
  WHERE n IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY n),
c AS (SELECT x.n AS a, y.n AS b, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM ok x JOIN ok y ON x.n <> y.n),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM c WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS table_a, greatest(a, b) AS table_b FROM r WHERE k <= 5""",
    "p5_found": f"{_REC_LINKS},{_GROUPS},{_BEST} SELECT group_id, n AS sot_table FROM ranked WHERE r = 1",
    "p5_records": f"""{_REC_LINKS},{_GROUPS},{_BEST},
filled AS (
  SELECT group_id, min(n) FILTER (WHERE r = 1) AS survivor,
    arg_min(read_count, r) FILTER (WHERE read_count IS NOT NULL) AS read_count,
    arg_min(last_write, r) FILTER (WHERE last_write IS NOT NULL) AS last_write,
    arg_min(job_count, r) FILTER (WHERE job_count IS NOT NULL) AS job_count
  FROM ranked GROUP BY group_id)
SELECT group_id, survivor, coalesce(read_count::VARCHAR, '') AS read_count,
  coalesce(strftime(last_write, '%Y-%m-%d %H:%M:%S'), '') AS last_write, coalesce(job_count::VARCHAR, '') AS job_count FROM filled""",
}
