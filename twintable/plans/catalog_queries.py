"""Queries of the catalog operators over the test tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.functions.vectors import as_doubles, cosine, cosine_of_distance, l2_norm, normalize
from twintable.operators import candidates, embedding, lineage, recommend, schema_text, similarity
from twintable.plans.problem_queries import clean_sql
from twintable.runtime import cut, table
from twintable.sources import demo
from twintable.sources.metadata import names_frame

DAYS = 45
WEIGHT = 0.25


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)


def q01_lineage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    r = lineage.rollup(demo.catalog(spark, folder), DAYS)
    return r.select("source_table_full_name", "target_table_full_name", "entity_type", "entity_id", _text("first_seen"), _text("last_seen"), "event_count")


def q02_lineage_of_catalog(spark: SparkSession, folder: str) -> DataFrame:
    r = lineage.rollup(demo.catalog(spark, folder), DAYS, "lumora")
    return r.groupBy("source_table_full_name", "target_table_full_name").agg(F.sum("event_count").alias("event_count"))


def _rollup(spark: SparkSession, folder: str, days: int = 90) -> DataFrame:
    return lineage.rollup(demo.catalog(spark, folder), days)


def q03_parents(spark: SparkSession, folder: str) -> DataFrame:
    p = lineage.parents(_rollup(spark, folder))
    return p.select(F.col("target").alias("full_table_name"), F.array_join("source_tables", " ").alias("source_tables"), "source_count")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("table_a", "table_b", "common_source_count", F.round("source_overlap_ratio", 6).alias("source_overlap_ratio"))


def q04_common_ancestors_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with a common source in the shorter window, whatever its ratio."""
    return _pairs(lineage.common_ancestors(_rollup(spark, folder, DAYS)))


def q05_common_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(lineage.common_ancestors(_rollup(spark, folder), 0.5))
    return p.orderBy(F.desc("source_overlap_ratio"), F.desc("common_source_count"), "table_a", "table_b")


def q06_common_sources(spark: SparkSession, folder: str) -> DataFrame:
    p = lineage.common_ancestors(_rollup(spark, folder), 0.7, with_sources=True)
    lists = [F.array_join(c, " ").alias(c) for c in ("sources_a", "sources_b", "common_sources")]
    return p.select("table_a", "table_b", *lists, "common_source_count")


def q07_usage_score(spark: SparkSession, folder: str) -> DataFrame:
    return schema_text.usage_scores(demo.catalog(spark, folder), DAYS)


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return demo.schema_lines(spark, folder).select("full_table_name")


def q08_usage_stats(spark: SparkSession, folder: str) -> DataFrame:
    u = recommend.usage_stats(demo.catalog(spark, folder), _names(spark, folder), DAYS)
    return u.select("full_table_name", "read_count", "write_count", _text("last_read"), _text("last_write"), "total_job_count")


def q09_creation_info(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.creation_info(demo.catalog(spark, folder), _names(spark, folder)).select("table_name", _text("created_at"), "created_by")


def q10_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = similarity.cosine_pairs(demo.embeddings(spark, folder), threshold=0.8)
    return p.select("table_a", "table_b", F.round("cosine_similarity", 6).alias("cosine_similarity"))


def q11_distance_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every table's vector to the first table's, directly and from the distance of unit vectors."""
    e = demo.embeddings(spark, folder).select("full_table_name", normalize(as_doubles("embedding")).alias("v"))
    first = e.agg(F.min_by("v", "full_table_name").alias("w"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    both = e.join(F.broadcast(first))
    return both.select("full_table_name", F.round(cosine("v", "w"), 6).alias("direct"), F.round(cosine_of_distance(d), 6).alias("from_distance"))


def _neighbors(spark: SparkSession, folder: str, threshold: float | None) -> DataFrame:
    n = similarity.top_neighbors(demo.embeddings(spark, folder), k=5, threshold=threshold)
    return n.select("source_table", "target_table", F.round("similarity_score", 6).alias("similarity_score"))


def q12_top_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbors(spark, folder, 0.5)


def q13_top_neighbors_all(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbors(spark, folder, None)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return candidates.find_candidates(demo.embeddings(spark, folder), lineage.common_ancestors(_rollup(spark, folder)), 0.8, 0.5)


def q14_candidates(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder)
    rounded = [F.round(x, 6).alias(x) for x in ("cosine_similarity", "source_overlap_ratio", "combined_score")]
    return c.select("table_a", "table_b", *rounded, F.coalesce("common_source_count", F.lit(0)).alias("common_source_count"), "has_schema_similarity", "has_common_ancestors", "confidence_level")


def q15_candidates_enriched(spark: SparkSession, folder: str) -> DataFrame:
    t = demo.tables(spark, folder).withColumn("full_table_name", F.concat_ws(".", "table_catalog", "table_schema", "table_name"))
    c = candidates.enrich(_candidates(spark, folder), t)
    return c.select("table_a", "table_b", "owner_a", "owner_b", "comment_a", "comment_b", "same_owner")


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    s, c = demo.catalog(spark, folder), cut(_candidates(spark, folder))
    names = recommend.pair_names(c)
    return recommend.sot_decision(c, recommend.usage_stats(s, names), recommend.creation_info(s, names))


def q16_sot_decision(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("table_a", "table_b", "score_a", "score_b", "sot_table", "duplicate_table", "sot_confidence")


def q17_sot_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("table_a", "table_b", F.array_join("reasons", "; ").alias("reasons"))


def q18_savings(spark: SparkSession, folder: str) -> DataFrame:
    s, c = demo.catalog(spark, folder), cut(_candidates(spark, folder))
    names = recommend.pair_names(c)
    usage = recommend.usage_stats(s, names)
    d = recommend.savings(recommend.sot_decision(c, usage, recommend.creation_info(s, names)), usage, recommend.storage_gb(s), WEIGHT)
    return d.select("table_a", "table_b", "pipelines_to_remove", F.round("storage_savings_gb", 4).alias("storage_savings_gb"), F.round("monthly_dbu_savings_usd", 2).alias("monthly_dbu_savings_usd"), "savings_confidence", "savings_notes")


def _recommended(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommend_pair(cut(_candidates(spark, folder)), demo.catalog(spark, folder), cost_per_write=WEIGHT)


def q19_recommendation_text(spark: SparkSession, folder: str) -> DataFrame:
    return _recommended(spark, folder).select("table_a", "table_b", "recommendation")


def q20_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    r = _recommended(spark, folder)
    rounded = [F.round(x, 6).alias(x) for x in ("similarity_score", "combined_score", "monthly_dbu_savings_usd", "storage_savings_gb")]
    return r.select("table_a", "table_b", "sot_table", "duplicate_table", *rounded, "confidence_level", "pipelines_to_remove")


def q21_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = recommend.summary(_recommended(spark, folder))
    return s.select("total_recommendations", "total_pipelines_to_remove", *[F.round(x, 4).alias(x) for x in ("total_monthly_savings", "total_storage_savings_gb", "average_similarity")])


def q22_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.confidence_distribution(_recommended(spark, folder))


def q23_schema_text(spark: SparkSession, folder: str) -> DataFrame:
    return schema_text.schema_texts(demo.catalog(spark, folder))


def q24_column_text(spark: SparkSession, folder: str) -> DataFrame:
    return schema_text.column_texts(demo.catalog(spark, folder)).select("full_table_name", "column_name", "column_text")


def q25_signature(spark: SparkSession, folder: str) -> DataFrame:
    return schema_text.signatures(schema_text.enriched_metadata(demo.catalog(spark, folder), DAYS)).select("full_table_name", "usage_score", "signature")


def q26_column_overlap(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lineage.common_ancestors(_rollup(spark, folder), 0.8).select("table_a", "table_b")
    c = similarity.column_overlap(pairs, schema_text.named_columns(demo.catalog(spark, folder)))
    return c.select("table_a", "table_b", F.round("column_overlap", 6).alias("column_overlap"), F.array_join("common_columns", " ").alias("common_columns"), F.size("different_columns").cast("bigint").alias("different"))


def q27_table_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return schema_text.table_metadata(demo.catalog(spark, folder), "lumora", "gold")


def q40_candidate_names(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.pair_names(lineage.common_ancestors(_rollup(spark, folder), 0.5))


def q41_lsh_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.lsh_pairs(demo.embeddings(spark, folder), threshold=0.8)


def q41_lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Hashing against all exact pairs: how many there are, how many found ones are wrong, and whether 0.9 of them are found."""
    e = demo.embeddings(spark, folder)
    exact = cut(similarity.cosine_pairs(e, threshold=0.8).select("table_a", "table_b", F.lit(1).alias("exact")))
    found = similarity.lsh_pairs(e, threshold=0.8).select("table_a", "table_b", F.lit(1).alias("found"))
    both = exact.join(found, ["table_a", "table_b"], "full_outer")
    hits = F.count(F.when(F.col("exact").isNotNull() & F.col("found").isNotNull(), 1))
    return both.agg(F.count("exact").alias("pairs"), F.count(F.when(F.col("exact").isNull(), 1)).alias("wrong"), (hits >= 0.9 * F.count("exact")).alias("recall_reached"))


def q63_recent_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a short window with nearly equal sources: both limits leave rows out."""
    return _pairs(lineage.common_ancestors(_rollup(spark, folder, 12), 0.95))


def q42_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.clusters(demo.embeddings(spark, folder)).select("full_table_name", "cluster_id", "cluster_size")


def q43_map(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.projection(demo.embeddings(spark, folder))


def q44_seeded_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embed_schema_texts(demo.schema_lines(spark, folder), embedding.provider("simple")).select("full_table_name", "embedding")


def q45_hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embed_schema_texts(demo.schema_lines(spark, folder), embedding.provider("hashing")).select("full_table_name", "embedding")


def q46_column_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embed_columns(schema_text.column_texts(demo.catalog(spark, folder)), embedding.provider("hashing")).select("full_table_name", "column_name", "embedding")


def q47_column_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of one table: the alphabetically first that has any."""
    name = demo.columns(spark, folder).agg(F.min(F.concat_ws(".", "table_catalog", "table_schema", "table_name")).alias("n")).first()["n"]
    return schema_text.column_metadata(demo.catalog(spark, folder), name).select("column_name", "data_type", "comment", F.col("ordinal_position").cast("bigint").alias("ordinal_position"))


def q48_requested_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Schema texts of requested names, one of them unknown and one repeated."""
    wanted = [r["n"] for r in demo.columns(spark, folder).agg(F.min(F.concat_ws(".", "table_catalog", "table_schema", "table_name")).alias("n")).collect()]
    return schema_text.schema_texts(demo.catalog(spark, folder), names_frame(spark, [*wanted, *wanted, "no.such.table"]))


def q49_similar_events(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine pairs of the second set of vectors, at a threshold that suits it."""
    p = similarity.cosine_pairs(table(spark, folder, "embeddings"), "vec_id", threshold=0.3)
    return p.select("table_a", "table_b", F.round("cosine_similarity", 6).alias("cosine_similarity"))


def q64_model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of clusters, map and embeddings whatever their numbers are, as ``fact, value``."""
    one = lambda ok: F.coalesce(F.every(ok), F.lit(True)).cast("bigint")
    unit = lambda c: F.abs(l2_norm(c) - 1) < 1e-9
    c = cut(q42_clusters(spark, folder))
    real = c.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("cluster_size").alias("most"), F.min("cluster_size").alias("fewest"))
    xy = cut(q43_map(spark, folder))
    seeded, hashed = cut(q44_seeded_embeddings(spark, folder)), cut(q45_hashed_embeddings(spark, folder))
    parts = [
        ("a table is in one cluster at most", c, (F.count("*") == F.count_distinct("full_table_name")).cast("bigint")),
        ("cluster sizes agree", real, one((F.col("n") == F.col("most")) & (F.col("n") == F.col("fewest")) & (F.col("n") >= 2))),
        ("points on the map", xy, F.count("*")),
        ("the map's first axis is the wider", xy, (F.var_pop("vis_x") >= F.var_pop("vis_y")).cast("bigint")),
        ("seeded vectors", seeded, F.count_distinct("embedding")),
        ("seeded vectors are unit vectors", seeded, one(unit("embedding") & (F.size("embedding") == 128))),
        ("hashed vectors are unit vectors", hashed, one(unit("embedding") & (F.size("embedding") == 128))),
        ("columns embedded", q46_column_embeddings(spark, folder), F.count("embedding")),
    ]
    rows = [df.agg(value.alias("value")).select(F.lit(fact).alias("fact"), "value") for fact, df, value in parts]
    return reduce(DataFrame.unionByName, rows)


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

_LIN = f"""
lin AS (
  SELECT {clean_sql('source_table_full_name')} AS s, {clean_sql('target_table_full_name')} AS t, entity_type, entity_id, event_time FROM table_lineage),
ups AS (SELECT * FROM lin WHERE s IS NOT NULL AND t IS NOT NULL)"""


def _since(days: int) -> str:
    return f"event_time >= DATE '{demo.AS_OF}' - {days}"


_EDGES = f"{_LIN}, e AS (SELECT DISTINCT s, t FROM ups WHERE {_since(90)}), n AS (SELECT t, count(*) AS n FROM e GROUP BY t)"
_ANC = f"""{_EDGES},
anc AS (
  SELECT a, b, k, k / least(na.n, nb.n) AS ratio FROM (
    SELECT x.t AS a, y.t AS b, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.t < y.t GROUP BY x.t, y.t)
  JOIN n na ON na.t = a JOIN n nb ON nb.t = b)"""
_COL = f"""
txt AS (SELECT {clean_sql('full_table_name')} AS n, min(schema_text) AS x FROM embeddings_df WHERE schema_text IS NOT NULL AND {clean_sql('full_table_name')} IS NOT NULL GROUP BY 1),
lines AS (SELECT n, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS pos FROM txt),
col AS (
  SELECT n, regexp_extract(line, '^  - ([^ ]+) \\((.+)\\)$', 1) AS c, regexp_extract(line, '^  - ([^ ]+) \\((.+)\\)$', 2) AS ty, pos,
    CASE WHEN pos % 3 = 0 THEN 'no ' || pos END AS com
  FROM lines WHERE regexp_matches(line, '^  - ([^ ]+) \\((.+)\\)$'))"""
_TAB = f"""
tab AS (
  SELECT n, split_part(n, '.', 1) AS cat, split_part(n, '.', 2) AS sch, split_part(n, '.', 3) AS tn,
    CASE WHEN split_part(n, '.', 2) = 'mart' THEN 'VIEW' ELSE 'MANAGED' END AS ty,
    CASE WHEN length(n) % 5 <> 0 THEN 'team_' || (length(n) % 3) END AS own,
    CASE WHEN length(n) % 4 <> 0 THEN 'about ' || split_part(n, '.', 3) END AS com
  FROM (SELECT DISTINCT {clean_sql('table_name')} AS n FROM table_usage_stats) WHERE n IS NOT NULL)"""
_EMB = f"""
emb AS (
  SELECT {clean_sql('full_table_name')} AS n, min(embedding::DOUBLE[]) AS v FROM embeddings_df
  WHERE {clean_sql('full_table_name')} IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1)"""
_COS = f"""{_EMB},
cos AS (SELECT x.n AS a, y.n AS b, list_cosine_similarity(x.v, y.v) AS s FROM emb x JOIN emb y ON x.n < y.n)"""


def _usage(days: int, names: str) -> str:
    return f"""
rd AS (SELECT s AS n, count(*) AS k, max(event_time) AS m, count(DISTINCT entity_id) AS j FROM lin WHERE s IS NOT NULL AND {_since(days)} GROUP BY s),
wr AS (SELECT t AS n, count(*) AS k, max(event_time) AS m, count(DISTINCT entity_id) AS j FROM lin WHERE t IS NOT NULL AND {_since(days)} GROUP BY t),
us AS (
  SELECT w.n, coalesce(rd.k, 0) AS r, coalesce(wr.k, 0) AS w, rd.m AS lr, wr.m AS lw, coalesce(rd.j, 0) + coalesce(wr.j, 0) AS j
  FROM ({names}) w LEFT JOIN rd ON rd.n = w.n LEFT JOIN wr ON wr.n = w.n),
cr AS (SELECT t AS n, min(event_time) AS at, arg_min(entity_id, (event_time, entity_id IS NOT NULL, entity_id)) AS by FROM lin WHERE t IS NOT NULL AND entity_type = 'PIPELINE' GROUP BY t)"""


_CAND = f"""{_ANC},{_COS},
cand AS (
  SELECT coalesce(c.a, x.a) AS a, coalesce(c.b, x.b) AS b, c.s, x.k, x.ratio, c.a IS NOT NULL AS hs, x.a IS NOT NULL AS ha,
    0.6::DOUBLE * coalesce(c.s, 0) + 0.4::DOUBLE * coalesce(x.ratio, 0) AS score,
    CASE WHEN c.a IS NOT NULL AND x.a IS NOT NULL THEN 'HIGH' WHEN c.a IS NOT NULL OR x.ratio >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM (SELECT * FROM cos WHERE s >= 0.8) c FULL JOIN (SELECT * FROM anc WHERE ratio >= 0.5) x ON c.a = x.a AND c.b = x.b)"""
_SOT = f"""{_CAND},{_usage(90, 'SELECT a AS n FROM cand UNION SELECT b FROM cand')},
pts AS (
  SELECT cand.*, ua.r AS ra, ub.r AS rb, ua.lw > ub.lw AS late_a, ca.at < cb.at AS old_a,
    (ua.lw IS NOT NULL AND ub.lw IS NOT NULL) AS wrote, (ca.at IS NOT NULL AND cb.at IS NOT NULL) AS made
  FROM cand JOIN us ua ON ua.n = a JOIN us ub ON ub.n = b LEFT JOIN cr ca ON ca.n = a LEFT JOIN cr cb ON cb.n = b),
sco AS (
  SELECT *, CASE WHEN ra > rb THEN 2 ELSE 0 END + CASE WHEN wrote AND late_a THEN 1 ELSE 0 END + CASE WHEN made AND old_a THEN 1 ELSE 0 END AS pa,
    CASE WHEN rb > ra THEN 2 ELSE 0 END + CASE WHEN wrote AND NOT late_a THEN 1 ELSE 0 END + CASE WHEN made AND NOT old_a THEN 1 ELSE 0 END AS pb FROM pts),
sot AS (
  SELECT *, CASE WHEN pb > pa THEN b ELSE a END AS keep, CASE WHEN pb > pa THEN a ELSE b END AS dup,
    CASE WHEN abs(pa - pb) >= 2 THEN 'HIGH' WHEN pa <> pb THEN 'MEDIUM' ELSE 'LOW' END AS sc,
    list_filter([
      CASE WHEN ra > rb THEN a || ' has more reads (' || ra || ' vs ' || rb || ')' WHEN rb > ra THEN b || ' has more reads (' || rb || ' vs ' || ra || ')' END,
      CASE WHEN wrote THEN CASE WHEN late_a THEN a ELSE b END || ' was updated more recently' END,
      CASE WHEN made THEN CASE WHEN old_a THEN a ELSE b END || ' is older (established)' END,
      CASE WHEN pa = pb THEN 'Tie-breaker: alphabetical order' END], lambda x: x IS NOT NULL) AS why FROM sco)"""
_SAVE = f"""{_SOT},
sto AS (SELECT {clean_sql('table_name')} AS n, max(write_count) * 67108864 / 1073741824.0::DOUBLE AS gb FROM table_usage_stats WHERE write_count > 0 GROUP BY 1),
sav AS (
  SELECT sot.*, u.j AS jobs, coalesce(sto.gb, 0) AS gb, u.w * {WEIGHT}::DOUBLE AS money,
    (CASE WHEN u.j > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(sto.gb, 0) > 0 THEN 1 ELSE 0 END) AS act
  FROM sot JOIN us u ON u.n = dup LEFT JOIN sto ON sto.n = dup)"""
_TEXT = """'Tables ' || keep || ' and ' || dup || ' have ' || CAST(trunc(coalesce(s, score) * 100) AS INTEGER) || '% similar column structure.'
  || CASE WHEN len(why) > 0 THEN ' Decision rationale: ' || array_to_string(why[1:3], '; ') ELSE '' END
  || ' Recommendation: Remove ''' || dup || ''' and use ''' || keep || ''' as the Source of Truth (SoT).'
  || CASE WHEN money > 0 THEN ' Estimated monthly DBU savings: $' || printf('%.2f', money) || ', Pipelines to remove: ' || jobs ELSE '' END"""
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"

SQL = {
    "q01_lineage_rollup": f"""WITH {_LIN} SELECT s AS source_table_full_name, t AS target_table_full_name, entity_type, entity_id,
  {_TS.format('min(event_time)')} AS first_seen, {_TS.format('max(event_time)')} AS last_seen, count(*) AS event_count
FROM ups WHERE {_since(DAYS)} GROUP BY ALL""",
    "q02_lineage_of_catalog": f"""WITH {_LIN} SELECT s AS source_table_full_name, t AS target_table_full_name, count(*) AS event_count
FROM ups WHERE {_since(DAYS)} AND (split_part(s, '.', 1) = 'lumora' OR split_part(t, '.', 1) = 'lumora') GROUP BY s, t""",
    "q03_parents": f"WITH {_EDGES} SELECT t AS full_table_name, string_agg(s, ' ' ORDER BY s) AS source_tables, count(*) AS source_count FROM e GROUP BY t",
    "q04_common_ancestors_all": f"""WITH {_LIN}, p AS (SELECT t, list(DISTINCT s) AS l FROM ups WHERE {_since(DAYS)} GROUP BY t),
c AS (SELECT x.t AS a, y.t AS b, len(list_intersect(x.l, y.l)) AS k, least(len(x.l), len(y.l)) AS m FROM p x JOIN p y ON x.t < y.t)
SELECT a AS table_a, b AS table_b, k AS common_source_count, round(k / m, 6) AS source_overlap_ratio FROM c WHERE k > 0""",
    "q05_common_ancestors": f"WITH {_ANC} SELECT a AS table_a, b AS table_b, k AS common_source_count, round(ratio, 6) AS source_overlap_ratio FROM anc WHERE ratio >= 0.5",
    "q06_common_sources": f"""WITH {_ANC}, l AS (SELECT t, list_sort(list(s)) AS l FROM e GROUP BY t)
SELECT a AS table_a, b AS table_b, array_to_string(x.l, ' ') AS sources_a, array_to_string(y.l, ' ') AS sources_b,
  array_to_string(list_sort(list_intersect(x.l, y.l)), ' ') AS common_sources, k AS common_source_count
FROM anc JOIN l x ON x.t = a JOIN l y ON y.t = b WHERE ratio >= 0.7""",
    "q07_usage_score": f"WITH {_LIN} SELECT t AS full_table_name, count(*) AS usage_score FROM lin WHERE t IS NOT NULL AND entity_type IN ('JOB', 'NOTEBOOK', 'DASHBOARD_V3') AND {_since(DAYS)} GROUP BY t",
    "q08_usage_stats": f"""WITH {_LIN},{_COL},{_usage(DAYS, 'SELECT n FROM txt')}
SELECT n AS full_table_name, r AS read_count, w AS write_count, {_TS.format('lr')} AS last_read, {_TS.format('lw')} AS last_write, j AS total_job_count FROM us""",
    "q09_creation_info": f"""WITH {_LIN},{_COL},{_usage(DAYS, 'SELECT n FROM txt')}
SELECT cr.n AS table_name, {_TS.format('cr.at')} AS created_at, cr.by AS created_by FROM cr JOIN txt ON txt.n = cr.n""",
    "q10_cosine_pairs": f"WITH {_COS} SELECT a AS table_a, b AS table_b, round(s, 6) AS cosine_similarity FROM cos WHERE s >= 0.8",
    "q11_distance_cosine": f"""WITH {_EMB}, w AS (SELECT arg_min(v, n) AS w FROM emb), d AS (SELECT n, list_cosine_similarity(v, w) AS s FROM emb, w)
SELECT n AS full_table_name, round(s, 6) AS direct, round(s, 6) AS from_distance FROM d""",
    "q12_top_neighbors": f"""WITH {_EMB}, c AS (SELECT x.n AS a, y.n AS b, list_cosine_similarity(x.v, y.v) AS s FROM emb x JOIN emb y ON x.n <> y.n),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS k FROM c WHERE s >= 0.5)
SELECT a AS source_table, b AS target_table, round(s, 6) AS similarity_score FROM r WHERE k <= 5""",
    "q13_top_neighbors_all": f"""WITH {_EMB}, c AS (SELECT x.n AS a, y.n AS b, list_cosine_similarity(x.v, y.v) AS s FROM emb x JOIN emb y ON x.n <> y.n),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS k FROM c)
SELECT a AS source_table, b AS target_table, round(s, 6) AS similarity_score FROM r WHERE k <= 5""",
    "q14_candidates": f"""WITH {_CAND} SELECT a AS table_a, b AS table_b, round(s, 6) AS cosine_similarity, round(ratio, 6) AS source_overlap_ratio,
  round(score, 6) AS combined_score, coalesce(k, 0) AS common_source_count, hs AS has_schema_similarity, ha AS has_common_ancestors, level AS confidence_level FROM cand""",
    "q15_candidates_enriched": f"""WITH {_CAND},{_TAB} SELECT a AS table_a, b AS table_b, x.own AS owner_a, y.own AS owner_b, x.com AS comment_a, y.com AS comment_b,
  x.own = y.own AS same_owner FROM cand LEFT JOIN tab x ON x.n = a LEFT JOIN tab y ON y.n = b""",
    "q16_sot_decision": f"WITH {_SOT} SELECT a AS table_a, b AS table_b, pa AS score_a, pb AS score_b, keep AS sot_table, dup AS duplicate_table, sc AS sot_confidence FROM sot",
    "q17_sot_reasons": f"WITH {_SOT} SELECT a AS table_a, b AS table_b, array_to_string(why, '; ') AS reasons FROM sot",
    "q18_savings": f"""WITH {_SAVE} SELECT a AS table_a, b AS table_b, jobs AS pipelines_to_remove, round(gb, 4) AS storage_savings_gb, round(money, 2) AS monthly_dbu_savings_usd,
  CASE act WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS savings_confidence,
  CASE WHEN act = 2 THEN 'Estimation based on available data' ELSE concat_ws('; ', CASE WHEN jobs = 0 THEN 'No pipeline activity detected' END,
    CASE WHEN gb = 0 THEN 'Storage size could not be determined' END) END AS savings_notes FROM sav""",
    "q19_recommendation_text": f"WITH {_SAVE} SELECT a AS table_a, b AS table_b, {_TEXT} AS recommendation FROM sav",
    "q20_recommendations": f"""WITH {_SAVE} SELECT a AS table_a, b AS table_b, keep AS sot_table, dup AS duplicate_table, round(coalesce(s, 0), 6) AS similarity_score,
  round(score, 6) AS combined_score, round(money, 6) AS monthly_dbu_savings_usd, round(gb, 6) AS storage_savings_gb, level AS confidence_level, jobs AS pipelines_to_remove FROM sav""",
    "q21_summary": f"""WITH {_SAVE} SELECT count(*) AS total_recommendations, CAST(coalesce(sum(jobs), 0) AS BIGINT) AS total_pipelines_to_remove,
  round(coalesce(sum(money), 0), 4) AS total_monthly_savings, round(coalesce(sum(gb), 0), 4) AS total_storage_savings_gb, round(coalesce(avg(coalesce(s, 0)), 0), 4) AS average_similarity FROM sav""",
    "q22_confidence": f"WITH {_CAND} SELECT level AS confidence_level, count(*) AS n FROM cand GROUP BY level",
    "q23_schema_text": f"""WITH {_COL} SELECT n AS full_table_name, 'Table: ' || n || chr(10) || 'Columns:' || chr(10)
  || string_agg('  - ' || c || ' (' || ty || ')' || coalesce(': ' || com, ''), chr(10) ORDER BY pos) AS schema_text FROM col GROUP BY n""",
    "q24_column_text": f"WITH {_COL} SELECT n AS full_table_name, c AS column_name, 'Column: ' || c || ' | Type: ' || ty || coalesce(' | Description: ' || com, '') AS column_text FROM col",
    "q25_signature": f"""WITH {_LIN},{_COL},{_TAB},
c AS (SELECT n, string_agg(c, ', ' ORDER BY pos) AS l FROM col GROUP BY n),
u AS (SELECT t, string_agg(s, ' ' ORDER BY s) AS l FROM (SELECT DISTINCT s, t FROM ups WHERE {_since(DAYS)}) GROUP BY t),
k AS (SELECT t, count(*) AS k FROM lin WHERE t IS NOT NULL AND entity_type IN ('JOB', 'NOTEBOOK', 'DASHBOARD_V3') AND {_since(DAYS)} GROUP BY t)
SELECT tab.n AS full_table_name, coalesce(k.k, 0) AS usage_score, 'Table: ' || tab.n || ' Comment: ' || coalesce(com, '') || ' Columns: ' || coalesce(c.l, '')
  || ' Lineage Parents: ' || coalesce(u.l, '') AS signature
FROM tab LEFT JOIN c ON c.n = tab.n LEFT JOIN u ON u.t = tab.n LEFT JOIN k ON k.t = tab.n WHERE ty <> 'VIEW'""",
    "q26_column_overlap": f"""WITH {_ANC},{_COL}, l AS (SELECT n, list(DISTINCT lower(c)) AS l FROM col GROUP BY n),
p AS (SELECT a, b, x.l AS la, y.l AS lb, list_sort(list_intersect(x.l, y.l)) AS common FROM anc JOIN l x ON x.n = a JOIN l y ON y.n = b WHERE ratio >= 0.8)
SELECT a AS table_a, b AS table_b, round(len(common) / greatest(len(la), len(lb)), 6) AS column_overlap, array_to_string(common, ' ') AS common_columns,
  len(la) + len(lb) - 2 * len(common) AS different FROM p""",
    "q27_table_metadata": f"WITH {_TAB} SELECT n AS full_table_name, ty AS table_type, own AS table_owner, com AS comment, '/data/' || n AS storage_path FROM tab WHERE cat = 'lumora' AND sch = 'gold'",
    "q40_candidate_names": f"WITH {_ANC} SELECT a AS full_table_name FROM anc WHERE ratio >= 0.5 UNION SELECT b FROM anc WHERE ratio >= 0.5",
    "q41_lsh_recall": f"WITH {_COS} SELECT count(*) AS pairs, 0 AS wrong, TRUE AS recall_reached FROM cos WHERE s >= 0.8",
    "q64_model_facts": f"""WITH {_EMB},{_COL}
SELECT unnest(['a table is in one cluster at most', 'cluster sizes agree', 'points on the map', 'the map''s first axis is the wider', 'seeded vectors', 'seeded vectors are unit vectors',
  'hashed vectors are unit vectors', 'columns embedded']) AS fact,
  unnest([1, 1, (SELECT count(*) FROM emb), 1, (SELECT count(DISTINCT x) FROM txt), 1, 1, (SELECT count(*) FROM col)]) AS value""",
    "q63_recent_ancestors": f"""WITH {_LIN}, e AS (SELECT DISTINCT s, t FROM ups WHERE {_since(12)}), n AS (SELECT t, count(*) AS n FROM e GROUP BY t),
c AS (SELECT x.t AS a, y.t AS b, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.t < y.t GROUP BY x.t, y.t)
SELECT a AS table_a, b AS table_b, k AS common_source_count, round(k / least(na.n, nb.n), 6) AS source_overlap_ratio FROM c JOIN n na ON na.t = a JOIN n nb ON nb.t = b WHERE k / least(na.n, nb.n) >= 0.95""",
    "q47_column_metadata": f"WITH {_COL} SELECT c AS column_name, ty AS data_type, com AS comment, pos AS ordinal_position FROM col WHERE n = (SELECT min(n) FROM col)",
    "q48_requested_texts": f"""WITH {_COL} SELECT n AS full_table_name, 'Table: ' || n || chr(10) || 'Columns:' || chr(10)
  || string_agg('  - ' || c || ' (' || ty || ')' || coalesce(': ' || com, ''), chr(10) ORDER BY pos) AS schema_text FROM col WHERE n = (SELECT min(n) FROM col) GROUP BY n""",
    "q49_similar_events": """SELECT x.vec_id AS table_a, y.vec_id AS table_b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine_similarity
FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3""",
}
