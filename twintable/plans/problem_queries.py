"""Queries of the general data-pipeline problems over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.functions.names import clean_name
from twintable.operators.hierarchy import hierarchy
from twintable.operators.sessions import sessionize, visits_report
from twintable.runtime import checkpoint_dir, table
from twintable.streaming.sessions import stream_sessions


def lineage_links(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "table_lineage")
    return t.select(clean_name("source_table_full_name").alias("parent"), clean_name("target_table_full_name").alias("child"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(lineage_links(spark, folder), "parent", "child").select(
        F.col("node").alias("full_table_name"), F.col("root").alias("root_table"), "depth", "on_cycle", "n_descendants"
    )


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each table's path from each of its roots, as text."""
    return hierarchy(lineage_links(spark, folder), "parent", "child", paths=True).select(
        F.col("node").alias("full_table_name"), F.col("root").alias("root_table"), "depth", F.array_join("path", " > ").alias("path")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return visits_report(sessionize(table(spark, folder, "user_events")))


def p6_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same visits from the rows as a stream, file by file, with late events merged into closed visits."""
    t = table(spark, folder, "user_events")
    # The pattern lets the stream read a single file as well as a folder of files.
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/user_events.parque[t]")
    work = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return visits_report(stream_sessions(stream, work).visits())


def clean_sql(name: str) -> str:
    return f"nullif(lower(trim(replace({name}, '`', ''), chr(32) || chr(9) || chr(10) || chr(13))), '')"


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p6_found": p6_found, "p6_stream": p6_stream}

SQL = {
    "p2_found": f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT s, t FROM (
    SELECT {clean_sql('source_table_full_name')} AS s, {clean_sql('target_table_full_name')} AS t FROM table_lineage)
  WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t),
nodes AS (SELECT s AS n FROM links UNION SELECT t FROM links),
reach(a, b) AS (
  SELECT s, t FROM links UNION SELECT r.a, l.t FROM reach r JOIN links l ON r.b = l.s),
roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT t FROM links)),
walk(root, n, depth) USING KEY (root, n) AS (
  SELECT n, n, 0 FROM roots
  UNION
  SELECT w.root, l.t, min(w.depth + 1) FROM walk w JOIN links l ON w.n = l.s
  LEFT JOIN recurring.walk k ON k.root = w.root AND k.n = l.t
  WHERE k.depth IS NULL OR k.depth > w.depth + 1 GROUP BY w.root, l.t),
best AS (SELECT root, n, depth FROM walk),
info AS (
  SELECT n, max(CASE WHEN a = b THEN 1 ELSE 0 END) AS on_cycle, count(CASE WHEN a <> b THEN 1 END) AS k
  FROM nodes LEFT JOIN reach ON a = n GROUP BY n)
SELECT i.n AS full_table_name, coalesce(b.root, '') AS root_table, CAST(coalesce(b.depth, -1) AS BIGINT) AS depth,
       CAST(i.on_cycle AS BIGINT) AS on_cycle, CAST(i.k AS BIGINT) AS n_descendants
FROM info i LEFT JOIN best b ON b.n = i.n""",
    "p2_paths": f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT s, t FROM (
    SELECT {clean_sql('source_table_full_name')} AS s, {clean_sql('target_table_full_name')} AS t FROM table_lineage)
  WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t),
nodes AS (SELECT s AS n FROM links UNION SELECT t FROM links),
roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT t FROM links)),
walk(root, n, w) USING KEY (root, n) AS (
  SELECT n, n, row(0, [n]) FROM roots
  UNION
  SELECT w.root, l.t, min(row(w.w[1] + 1, list_append(w.w[2], l.t))) FROM walk w JOIN links l ON w.n = l.s
  LEFT JOIN recurring.walk k ON k.root = w.root AND k.n = l.t
  WHERE k.w IS NULL OR k.w > row(w.w[1] + 1, list_append(w.w[2], l.t)) GROUP BY w.root, l.t)
SELECT nodes.n AS full_table_name, coalesce(walk.root, '') AS root_table, CAST(coalesce(walk.w[1], -1) AS BIGINT) AS depth,
       coalesce(array_to_string(walk.w[2], ' > '), '') AS path
FROM nodes LEFT JOIN walk ON walk.n = nodes.n""",
    "p6_found": """
WITH e AS (
  SELECT DISTINCT event_id, user_id, event_timestamp AS t FROM user_events
  WHERE user_id IS NOT NULL AND user_id <> '' AND event_timestamp IS NOT NULL),
g AS (
  SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
v AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM g)
SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S.%g') AS session_start,
       strftime(max(t), '%Y-%m-%d %H:%M:%S.%g') AS session_end, count(*) AS event_count
FROM v GROUP BY user_id, visit""",
}
SQL["p6_stream"] = SQL["p6_found"]
