"""The whole analysis: lazy steps that build on each other, results as DataFrames, saved as tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.operators import candidates, embedding, lineage, recommend, schema_text, similarity
from twintable.runtime import cut
from twintable.sources.metadata import MetadataSource, save_table


@dataclass
class Config:
    catalog: str | None = None
    days_back: int = 30
    usage_days_back: int = 90
    provider: str = "hashing"
    provider_options: dict = field(default_factory=dict)
    similarity_threshold: float = 0.8
    overlap_threshold: float = 0.5
    use_lsh: bool = False
    with_sources: bool = False
    top_k: int = 5
    score_threshold: float = 0.0
    cost_per_write: float = 0.0


class ConsolidationAnalysis:
    """Each step is computed once, when it or a later step is first asked for.

    The three relations that several later steps read (candidate ancestors, embeddings, candidates) are
    materialised in the shared checkpoint folder; everything else stays a plan.
    """

    def __init__(self, source: MetadataSource, config: Config | None = None):
        self.source, self.config = source, config or Config()
        self.embedder = embedding.provider(self.config.provider, **self.config.provider_options)

    @cached_property
    def lineage(self) -> DataFrame:
        return lineage.rollup(self.source, self.config.days_back, self.config.catalog)

    @cached_property
    def ancestor_pairs(self) -> DataFrame:
        """All pairs with a common source, as counts only."""
        return cut(lineage.common_ancestors(self.lineage))

    @cached_property
    def common_ancestors(self) -> DataFrame:
        """The pairs that overlap enough, with the lists of their sources."""
        return cut(lineage.with_lists(self.ancestor_pairs.where(F.col("source_overlap_ratio") >= self.config.overlap_threshold), self.lineage))

    @cached_property
    def schema_texts(self) -> DataFrame:
        return schema_text.schema_texts(self.source, recommend.pair_names(self.ancestor_pairs))

    @cached_property
    def embeddings(self) -> DataFrame:
        return cut(embedding.embed_schema_texts(self.schema_texts, self.embedder))

    @cached_property
    def candidates(self) -> DataFrame:
        c = self.config
        return cut(candidates.find_candidates(self.embeddings, self.common_ancestors, c.similarity_threshold, c.overlap_threshold, c.use_lsh, c.with_sources))

    @cached_property
    def recommendations(self) -> DataFrame:
        names = recommend.pair_names(self.candidates)
        usage = recommend.usage_stats(self.source, names, self.config.usage_days_back)
        return recommend.recommendations(self.candidates, usage, recommend.creation_info(self.source, names), recommend.storage_gb(self.source), self.config.cost_per_write)

    @cached_property
    def summary(self) -> DataFrame:
        return recommend.summary(self.recommendations)

    @cached_property
    def viz_map(self) -> DataFrame:
        """2-D map of the embedded tables with their usage."""
        usage = schema_text.usage_scores(self.source, self.config.days_back)
        points = similarity.projection(self.embeddings).join(self.schema_texts, "full_table_name", "left").join(usage, "full_table_name", "left")
        return points.na.fill(0, ["usage_score"]).select("full_table_name", "vis_x", "vis_y", "schema_text", "usage_score")

    @cached_property
    def enriched(self) -> DataFrame:
        """All tables with signature text and its vector (the catalog-wide path, without lineage pairs)."""
        meta = schema_text.signatures(schema_text.enriched_metadata(self.source, self.config.days_back, self.config.catalog))
        return cut(embedding.embed_texts(meta, "signature", self.embedder))

    @cached_property
    def table_map(self) -> DataFrame:
        points = similarity.projection(self.enriched)
        return points.join(self.enriched.select("full_table_name", "usage_score", "tbl_comment"), "full_table_name")

    @cached_property
    def table_similarity(self) -> DataFrame:
        return similarity.top_neighbors(self.enriched, k=self.config.top_k, threshold=self.config.score_threshold)

    def run_full(self) -> dict[str, DataFrame]:
        names = ("common_ancestors", "schema_texts", "embeddings", "candidates", "recommendations", "summary", "viz_map")
        return {n: getattr(self, n) for n in names}

    def run_similarity(self) -> dict[str, DataFrame]:
        return {"table_viz_map": self.table_map, "table_similarity": self.table_similarity}

    def save(self, prefix: str, mode: str = "overwrite") -> list[str]:
        """Saves the results computed so far as ``prefix`` + table name; returns the names written."""
        tables = {
            "common_ancestors": "common_ancestors", "candidates": "consolidation_candidates", "recommendations": "consolidation_recommendations",
            "viz_map": "table_viz_map", "table_map": "table_viz_map_fast", "table_similarity": "table_similarity",
        }
        done = []
        for step, name in tables.items():
            if step in self.__dict__:
                save_table(getattr(self, step), prefix + name, mode)
                done.append(prefix + name)
        return done


def detect_duplicates(source: MetadataSource, **options) -> dict[str, DataFrame]:
    """The lineage-based analysis in one call."""
    return ConsolidationAnalysis(source, Config(**options)).run_full()


def table_similarity(source: MetadataSource, **options) -> dict[str, DataFrame]:
    """The catalog-wide similarity analysis in one call."""
    return ConsolidationAnalysis(source, Config(**options)).run_similarity()


def report(analysis: ConsolidationAnalysis) -> DataFrame:
    """Row counts of the steps and the distribution of confidence levels, as ``item, n``."""
    count = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")
    out = count(analysis.ancestor_pairs, "pairs with common ancestors").unionByName(count(analysis.candidates, "candidates"))
    levels = recommend.confidence_distribution(analysis.recommendations)
    return out.unionByName(levels.select(F.concat(F.lit("confidence "), "confidence_level").alias("item"), "n"))
