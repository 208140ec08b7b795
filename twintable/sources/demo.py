"""The test tables as a catalog: how they stand in for lineage, audit, table and column catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.functions.names import clean_name
from twintable.functions.vectors import is_usable
from twintable.runtime import table
from twintable.sources.metadata import MetadataSource

#: End of the lineage window of the test data.
AS_OF = "2026-05-31"


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """table_lineage with clean names, their parts taken from the clean name."""
    t = table(spark, folder, "table_lineage").withColumn("s", clean_name("source_table_full_name"))
    part = lambda k: F.nullif(F.split_part("s", F.lit("."), F.lit(k)), F.lit(""))
    return t.select(
        F.col("s").alias("source_table_full_name"), part(1).alias("source_table_catalog"), part(2).alias("source_table_schema"), part(3).alias("source_table_name"),
        clean_name("target_table_full_name").alias("target_table_full_name"), "entity_type", "entity_id", F.col("event_time").cast("timestamp").alias("event_time"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage events as audit events on their target."""
    action = F.create_map(*[F.lit(x) for x in ("JOB", "writeTable", "NOTEBOOK", "readTable", "PIPELINE", "createTable", "DASHBOARD_V3", "getTable")])
    return lineage(spark, folder).select(
        "event_time", action[F.col("entity_type")].alias("action_name"),
        F.when(F.col("target_table_full_name").isNotNull(), F.create_map(F.lit("full_name_arg"), "target_table_full_name")).alias("request_params"),
        F.struct(F.col("entity_id").alias("email")).alias("user_identity"),
    )


def schema_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``full_table_name, schema_text``: one known text per table of embeddings_df."""
    t = table(spark, folder, "embeddings_df").select(clean_name("full_table_name").alias("full_table_name"), "schema_text")
    return t.where("full_table_name is not null and schema_text is not null").groupBy("full_table_name").agg(F.min("schema_text").alias("schema_text"))


def columns(spark: SparkSession, folder: str) -> DataFrame:
    """The column catalog that these texts list."""
    lines = schema_lines(spark, folder).select("full_table_name", F.posexplode(F.split("schema_text", "\n")).alias("ordinal_position", "line"))
    pattern = r"^  - ([^ ]+) \((.+)\)$"
    name = lambda k: F.split_part("full_table_name", F.lit("."), F.lit(k))
    return lines.where(F.col("line").rlike(pattern)).select(
        name(1).alias("table_catalog"), name(2).alias("table_schema"), name(3).alias("table_name"),
        F.regexp_extract("line", pattern, 1).alias("column_name"), F.regexp_extract("line", pattern, 2).alias("data_type"),
        F.when(F.col("ordinal_position") % 3 == 0, F.concat(F.lit("no "), F.col("ordinal_position").cast("string"))).alias("comment"), "ordinal_position",
    )


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """The table catalog: the tables of table_usage_stats, those of schema mart as views."""
    n = table(spark, folder, "table_usage_stats").select(clean_name("table_name").alias("n")).where("n is not null").distinct()
    part = lambda k: F.split_part("n", F.lit("."), F.lit(k))
    size = F.length("n")
    return n.select(
        part(1).alias("table_catalog"), part(2).alias("table_schema"), part(3).alias("table_name"),
        F.when(part(2) == "mart", "VIEW").otherwise("MANAGED").alias("table_type"),
        F.when(size % 5 != 0, F.concat(F.lit("team_"), (size % 3).cast("string"))).alias("table_owner"),
        F.concat(F.lit("/data/"), "n").alias("storage_path"),
        F.when(size % 4 != 0, F.concat(F.lit("about "), part(3))).alias("comment"),
    )


def storage(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "table_usage_stats").select(clean_name("table_name").alias("full_table_name"), "write_count")
    return t.where("full_table_name is not null and write_count > 0").groupBy("full_table_name").agg((F.max("write_count") * (1 << 26)).alias("size_bytes"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "embeddings_df").select(clean_name("full_table_name").alias("full_table_name"), "embedding")
    return t.where(F.col("full_table_name").isNotNull() & is_usable("embedding", 64)).groupBy("full_table_name").agg(F.min("embedding").alias("embedding"))


def catalog(spark: SparkSession, folder: str) -> MetadataSource:
    makers = {"lineage": lineage, "audit": audit, "columns": columns, "tables": tables, "storage": storage}
    return MetadataSource(spark, {k: f(spark, folder) for k, f in makers.items()}, AS_OF)
