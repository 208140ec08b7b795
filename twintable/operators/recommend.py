"""Usage, choice of the source of truth, and recommendations per pair, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.sources.metadata import MetadataSource, with_missing


def usage_stats(source: MetadataSource, names: DataFrame, days_back: int = 90) -> DataFrame:
    """A row for every requested name: read_count, write_count, last_read, last_write, total_job_count.

    One pass over lineage: an event is a read of its source and a write of its target. Jobs are distinct
    readers plus distinct writers, so a job doing both counts twice.
    """
    e = source.recent(source.get("lineage"), days_back)
    side = lambda name, read: F.struct(F.col(name).alias("full_table_name"), F.lit(read).alias("read"))
    acts = e.select("entity_id", "event_time", F.explode(F.array(side("source_table_full_name", True), side("target_table_full_name", False))).alias("x"))
    acts = acts.select("entity_id", "event_time", "x.*").where("full_table_name is not null")
    wanted = names.select("full_table_name").distinct()
    r, w = F.col("read"), ~F.col("read")
    stats = acts.join(wanted, "full_table_name", "left_semi").groupBy("full_table_name").agg(
        F.sum(r.cast("bigint")).alias("read_count"),
        F.sum(w.cast("bigint")).alias("write_count"),
        F.max(F.when(r, F.col("event_time"))).alias("last_read"),
        F.max(F.when(w, F.col("event_time"))).alias("last_write"),
        F.count_distinct(F.when(r, F.col("entity_id"))).alias("readers"),
        F.count_distinct(F.when(w, F.col("entity_id"))).alias("writers"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return wanted.join(stats, "full_table_name", "left").select(
        "full_table_name", zero("read_count").alias("read_count"), zero("write_count").alias("write_count"), "last_read", "last_write",
        (zero("readers") + zero("writers")).alias("total_job_count"),
    )


def creation_info(source: MetadataSource, names: DataFrame) -> DataFrame:
    """``table_name, created_at, created_by``: the first createTable event and its user."""
    made = source.get("audit").where("action_name = 'createTable'").select(
        F.col("request_params")["full_name_arg"].alias("full_table_name"), "event_time", F.col("user_identity")["email"].alias("email")
    )
    first = made.join(names.select("full_table_name").distinct(), "full_table_name", "left_semi").groupBy("full_table_name").agg(
        F.min(F.struct("event_time", "email")).alias("m")
    )
    return first.select(F.col("full_table_name").alias("table_name"), F.col("m.event_time").alias("created_at"), F.col("m.email").alias("created_by"))


def storage_gb(source: MetadataSource) -> DataFrame:
    s = source.get("storage")
    return s.groupBy("full_table_name").agg((F.max("size_bytes") / F.lit(1024.0**3)).alias("storage_gb"))


def _with_sides(pairs: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    for x in "ab":
        side = right.select(F.col(key).alias(f"table_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns])
        pairs = pairs.join(side, f"table_{x}", "left")
    return pairs


def sot_decision(pairs: DataFrame, usage: DataFrame, creation: DataFrame) -> DataFrame:
    """Adds score_a, score_b, sot_table, duplicate_table, reasons, sot_confidence to pairs ``table_a, table_b``.

    More reads: 2 points. Later last write: 1 point, a tie going to B. Older: 1 point, a tie going to B. A rule
    counts only where both sides are known. The higher score wins, then the smaller name. Confidence by
    difference: 2 or more HIGH, 1 MEDIUM, 0 LOW.
    """
    c = F.col
    p = _with_sides(pairs, usage, "full_table_name", ["read_count", "last_write"])
    p = _with_sides(p, creation, "table_name", ["created_at"])
    reads_a, reads_b = c("read_count_a") > c("read_count_b"), c("read_count_b") > c("read_count_a")
    wrote = c("last_write_a").isNotNull() & c("last_write_b").isNotNull()
    late_a = c("last_write_a") > c("last_write_b")
    made = c("created_at_a").isNotNull() & c("created_at_b").isNotNull()
    old_a = c("created_at_a") < c("created_at_b")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    a = points(reads_a, 2) + points(wrote & late_a, 1) + points(made & old_a, 1)
    b = points(reads_b, 2) + points(wrote & ~late_a, 1) + points(made & ~old_a, 1)
    p = p.withColumns({"score_a": a, "score_b": b})
    wins_a, tie = c("score_a") > c("score_b"), c("score_a") == c("score_b")
    lesser, greater = F.least("table_a", "table_b"), F.greatest("table_a", "table_b")
    more = lambda t, x, y: F.concat(c(t), F.lit(" has more reads ("), c(x).cast("string"), F.lit(" vs "), c(y).cast("string"), F.lit(")"))
    # The sentences of reasons.
    reasons = F.array(
        F.when(reads_a, more("table_a", "read_count_a", "read_count_b")).when(reads_b, more("table_b", "read_count_b", "read_count_a")),
        F.when(wrote, F.concat(F.when(late_a, c("table_a")).otherwise(c("table_b")), F.lit(" was updated more recently"))),
        F.when(made, F.concat(F.when(old_a, c("table_a")).otherwise(c("table_b")), F.lit(" is older (established)"))),
        F.when(tie, F.lit("Tie-breaker: alphabetical order")),
    )
    gap = F.abs(c("score_a") - c("score_b"))
    return p.withColumns(
        {
            "sot_table": F.when(tie, lesser).when(wins_a, c("table_a")).otherwise(c("table_b")),
            "duplicate_table": F.when(tie, greater).when(wins_a, c("table_b")).otherwise(c("table_a")),
            "reasons": F.filter(reasons, lambda x: x.isNotNull()),
            "sot_confidence": F.when(gap >= 2, "HIGH").when(gap == 1, "MEDIUM").otherwise("LOW"),
        }
    ).drop(*[f"{n}_{x}" for n in ("read_count", "last_write", "created_at") for x in "ab"])


def savings(decided: DataFrame, usage: DataFrame, storage: DataFrame, cost_per_write: float = 0.0) -> DataFrame:
    """Adds what removing ``duplicate_table`` saves: pipelines_to_remove, storage_savings_gb, monthly_dbu_savings_usd, and how sure that is.

    ``cost_per_write`` is the caller's monthly cost of a counted write; no price is built in.
    """
    c = F.col
    u = usage.select(c("full_table_name").alias("duplicate_table"), c("write_count").alias("w"), c("total_job_count").alias("jobs"))
    s = storage.select(c("full_table_name").alias("duplicate_table"), c("storage_gb").alias("gb"))
    d = decided.join(u, "duplicate_table", "left").join(s, "duplicate_table", "left")
    jobs, gb = F.coalesce("jobs", F.lit(0).cast("bigint")), F.coalesce("gb", F.lit(0.0))
    active = (jobs > 0).cast("int") + (gb > 0).cast("int")
    notes = F.concat_ws("; ", F.when(jobs == 0, "No pipeline activity detected"), F.when(gb == 0, "Storage size could not be determined"))
    return d.withColumns(
        {
            "pipelines_to_remove": jobs,
            "storage_savings_gb": gb,
            "monthly_dbu_savings_usd": F.coalesce("w", F.lit(0)) * F.lit(float(cost_per_write)),
            "savings_confidence": F.when(active == 2, "HIGH").when(active == 1, "MEDIUM").otherwise("LOW"),
            "savings_notes": F.when(active == 2, "Estimation based on available data").otherwise(notes),
        }
    ).drop("w", "jobs", "gb")


def comment_text(similarity: Column, sources: Column) -> Column:
    """Three to five sentences about a decided pair; three reasons and three common sources at most are named."""
    c = F.col
    few = F.array_join(F.slice(sources, 1, 3), ", ")
    # The sentences of a recommendation.
    return F.concat_ws(
        " ",
        F.concat(F.lit("Tables "), "sot_table", F.lit(" and "), "duplicate_table", F.lit(" have "), (similarity * 100).cast("int").cast("string"), F.lit("% similar column structure.")),
        F.when(F.size(sources) > 0, F.concat(F.lit("Both tables are derived from the same source ("), few, F.when(F.size(sources) > 3, "...").otherwise(""), F.lit(")."))),
        F.when(F.size("reasons") > 0, F.concat(F.lit("Decision rationale: "), F.array_join(F.slice("reasons", 1, 3), "; "))),
        F.concat(F.lit("Recommendation: Remove '"), "duplicate_table", F.lit("' and use '"), "sot_table", F.lit("' as the Source of Truth (SoT).")),
        F.when(c("monthly_dbu_savings_usd") > 0, F.concat(F.lit("Estimated monthly DBU savings: $"), F.format_string("%.2f", c("monthly_dbu_savings_usd")), F.lit(", Pipelines to remove: "), c("pipelines_to_remove").cast("string"))),
    )


def recommendations(candidates: DataFrame, usage: DataFrame, creation: DataFrame, storage: DataFrame, cost_per_write: float = 0.0) -> DataFrame:
    """One recommendation per candidate pair. Candidates may lack combined_score, confidence_level and common_sources.

    The text's percentage is the cosine, else the combined score; ``similarity_score`` is the cosine or 0.
    """
    c = F.col
    full = with_missing(candidates, {"cosine_similarity": "double", "combined_score": "double", "confidence_level": "string", "common_sources": "array<string>"})
    d = savings(sot_decision(full, usage, creation), usage, storage, cost_per_write)
    score = F.coalesce("cosine_similarity", "combined_score", F.lit(0.0))
    return d.select(
        "table_a", "table_b", "sot_table", "duplicate_table",
        F.coalesce("cosine_similarity", F.lit(0.0)).alias("similarity_score"),
        F.coalesce("combined_score", F.lit(0.0)).alias("combined_score"),
        F.coalesce("confidence_level", "sot_confidence").alias("confidence_level"),
        comment_text(score, F.coalesce("common_sources", F.array().cast("array<string>"))).alias("recommendation"),
        "monthly_dbu_savings_usd", "storage_savings_gb", c("pipelines_to_remove").cast("bigint").alias("pipelines_to_remove"),
    )


def recommend_pair(pair: DataFrame, source: MetadataSource, days_back: int = 90, cost_per_write: float = 0.0) -> DataFrame:
    """Recommendation for one or few pairs straight from a source."""
    names = pair_names(pair)
    return recommendations(pair, usage_stats(source, names, days_back), creation_info(source, names), storage_gb(source), cost_per_write)


def pair_names(pairs: DataFrame) -> DataFrame:
    """Every table of the pairs, once."""
    a, b = pairs.select(F.col("table_a").alias("full_table_name")), pairs.select(F.col("table_b").alias("full_table_name"))
    return a.union(b).where("full_table_name is not null").distinct()


def summary(recs: DataFrame) -> DataFrame:
    """One row of totals; sums over nothing are 0."""
    zero = F.lit(0.0)
    return recs.agg(
        F.count("*").alias("total_recommendations"),
        F.coalesce(F.sum("monthly_dbu_savings_usd"), zero).alias("total_monthly_savings"),
        F.coalesce(F.sum("storage_savings_gb"), zero).alias("total_storage_savings_gb"),
        F.coalesce(F.sum("pipelines_to_remove"), F.lit(0).cast("bigint")).alias("total_pipelines_to_remove"),
        F.coalesce(F.avg("similarity_score"), zero).alias("average_similarity"),
    )


def confidence_distribution(recs: DataFrame) -> DataFrame:
    return recs.groupBy("confidence_level").agg(F.count("*").alias("n"))


def summary_dict(recs: DataFrame) -> dict:
    """The summary on the driver: totals and the distribution of confidence levels (a handful of rows)."""
    out = summary(recs).first().asDict()
    return out | {"by_confidence": {r["confidence_level"]: r["n"] for r in confidence_distribution(recs).collect()}}
