"""Lineage roll-up, parents, and pairs of tables with common parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.runtime import cut
from twintable.sources.metadata import MetadataSource

#: Targets of a source that one task pairs with others.
SLICE_ROWS = 10_000

KEYS = [
    "source_table_full_name", "source_table_catalog", "source_table_schema", "source_table_name",
    "target_table_full_name", "entity_type", "entity_id",
]


def rollup(source: MetadataSource, days_back: int = 30, catalog: str | None = None) -> DataFrame:
    """Events per edge and entity: the keys, first_seen, last_seen, event_count.

    Only events with both ends count. ``catalog`` keeps edges whose source or target is in this catalog; the
    filter is on grouping keys, so it runs before the aggregation.
    """
    e = source.recent(source.get("lineage"), days_back).where("source_table_full_name is not null and target_table_full_name is not null")
    out = e.groupBy(*KEYS).agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("event_count"))
    if catalog is not None:
        out = out.where((F.col("source_table_catalog") == catalog) | (F.split("target_table_full_name", r"\.")[0] == catalog))
    return out


def edges(lineage: DataFrame) -> DataFrame:
    """``target, source``, each pair once."""
    return lineage.select(F.col("target_table_full_name").alias("target"), F.col("source_table_full_name").alias("source")).distinct()


def parents(lineage: DataFrame) -> DataFrame:
    """``target, source_tables`` (sorted), ``source_count``."""
    return edges(lineage).groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("source_tables"), F.count("*").alias("source_count"))


def common_ancestors(lineage: DataFrame, threshold: float = 0.0, with_sources: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pairs of targets that share a source: ``table_a, table_b, common_source_count, source_overlap_ratio``.

    The ratio is common sources / size of the smaller set. A pair that reaches the threshold shares one of the
    rarest ``n - ceil(threshold n) + 1`` sources of the target with fewer (``n``; of equal ones the smaller name),
    so only these look for partners, and common sources meet rarely. Without a threshold every pair with a common
    source is a result. Edges of a source with more than ``slice_rows`` targets are cut into slices on one side
    and repeated on the other, so no task gets all pairs of a hot source. Common sources are then counted for the
    candidates, over the edges of the target with fewer. ``with_sources`` adds the three sorted lists, fetched for
    the surviving pairs only.
    """
    col = F.col
    e = edges(lineage)
    used = e.groupBy("source").agg(F.count("*").alias("f"))
    sized = cut(e.join(e.groupBy("target").agg(F.count("*").alias("n")), "target").join(used, "source"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("f", "source"))
    need = F.greatest(F.ceil(F.lit(threshold) * col("n") - F.lit(1e-9)), F.lit(1))
    slices = F.ceil(col("f") / slice_rows).cast("int")
    few = sized.withColumn("r", rank).where(col("r") <= col("n") - need + 1).where("f > 1")
    few = few.select("source", col("target").alias("small"), col("n").alias("ns"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    many = sized.where("f > 1").select("source", col("target").alias("large"), col("n").alias("nl"), F.pmod(F.xxhash64("target"), slices).cast("int").alias("slice"))
    first = (col("ns") < col("nl")) | ((col("ns") == col("nl")) & (col("small") < col("large")))
    found = few.join(many, ["source", "slice"]).where(first)
    if threshold > 0:
        found = found.select("small", "large", "ns").distinct()
        shared = found.join(e.select(col("target").alias("small"), "source"), "small").join(e.select(col("target").alias("large"), "source"), ["large", "source"], "left_semi")
    else:
        shared = found
    counted = shared.groupBy("small", "large", "ns").agg(F.count("*").alias("common_source_count"))
    pairs = counted.select(
        F.least("small", "large").alias("table_a"), F.greatest("small", "large").alias("table_b"), "common_source_count", (col("common_source_count") / col("ns")).alias("source_overlap_ratio")
    ).where(col("source_overlap_ratio") >= threshold)
    return with_lists(pairs, lineage) if with_sources else pairs


def with_lists(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """``pairs`` of targets with the sorted lists of their sources and of the common ones."""
    col = F.col
    lists = parents(lineage).select("target", "source_tables")
    return (
        pairs.join(lists.select(col("target").alias("table_a"), col("source_tables").alias("sources_a")), "table_a")
        .join(lists.select(col("target").alias("table_b"), col("source_tables").alias("sources_b")), "table_b")
        .withColumn("common_sources", F.array_sort(F.array_intersect("sources_a", "sources_b")))
        .select("table_a", "table_b", "sources_a", "sources_b", "common_sources", "common_source_count", "source_overlap_ratio")
    )
