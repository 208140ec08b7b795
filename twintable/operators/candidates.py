"""Consolidation candidates: schema similarity and common ancestors together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.operators.similarity import cosine_pairs, lsh_pairs


def fuse(similar: DataFrame, ancestors: DataFrame, with_sources: bool = False) -> DataFrame:
    """Full outer join of both signals with flags, ``combined_score`` and ``confidence_level``.

    combined_score = 0.6 cosine + 0.4 overlap, a missing signal being 0. HIGH: both signals; MEDIUM: similar
    schema only, or an overlap of 0.8 or more; LOW: the rest. ``with_sources`` keeps ``common_sources``.
    """
    col = F.col
    extra = ["common_sources"] if with_sources else []
    a = ancestors.select("table_a", "table_b", "common_source_count", "source_overlap_ratio", *extra)
    both = similar.select("table_a", "table_b", "cosine_similarity").join(a, ["table_a", "table_b"], "full_outer")
    schema, lineage = col("cosine_similarity").isNotNull(), col("source_overlap_ratio").isNotNull()
    # Weights 0.6 and 0.4, and 0.8 as the limit of an overlap that is MEDIUM by itself.
    level = F.when(schema & lineage, "HIGH").when(schema | (col("source_overlap_ratio") >= 0.8), "MEDIUM").otherwise("LOW")
    score = 0.6 * F.coalesce("cosine_similarity", F.lit(0.0)) + 0.4 * F.coalesce("source_overlap_ratio", F.lit(0.0))
    return both.withColumns({"has_schema_similarity": schema, "has_common_ancestors": lineage, "combined_score": score, "confidence_level": level})


def find_candidates(
    embeddings: DataFrame, ancestors: DataFrame, similarity_threshold: float = 0.8, overlap_threshold: float = 0.5,
    use_lsh: bool = False, with_sources: bool = False,
) -> DataFrame:
    """Candidates from embeddings and ``common_ancestors``, the best first; ``use_lsh`` looks for similar schemas approximately."""
    similar = (lsh_pairs if use_lsh else cosine_pairs)(embeddings, threshold=similarity_threshold)
    found = fuse(similar, ancestors.where(F.col("source_overlap_ratio") >= overlap_threshold), with_sources)
    return found.orderBy(F.desc("combined_score"), "table_a", "table_b")


def enrich(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds owner and comment of both tables (``full_table_name, table_owner, comment``) and ``same_owner``, null if an owner is unknown."""
    out = candidates
    for x in "ab":
        t = tables.groupBy("full_table_name").agg(F.max("table_owner").alias(f"owner_{x}"), F.max("comment").alias(f"comment_{x}"))
        out = out.join(t.withColumnRenamed("full_table_name", f"table_{x}"), f"table_{x}", "left")
    return out.withColumn("same_owner", F.col("owner_a") == F.col("owner_b"))
