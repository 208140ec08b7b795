"""Text forms of tables and columns, and joined table metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.sources.metadata import MetadataSource, full_name, split_name

READ_ACTIONS = ("getTable", "readTable", "writeTable")


def column_description() -> Column:
    """'  - NAME (TYPE)', with ': COMMENT' if the comment is not null."""
    return F.concat(F.lit("  - "), "column_name", F.lit(" ("), "data_type", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "comment"), F.lit("")))


def column_text() -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Column: "), "column_name"), F.concat(F.lit("Type: "), "data_type"), F.concat(F.lit("Description: "), "comment"))


def joined(parts: Column, order: Column, separator: str) -> Column:
    """Aggregate: texts of a group joined in a defined order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("p")))), lambda x: x["p"]), separator)


def named_columns(source: MetadataSource, names: DataFrame | None = None) -> DataFrame:
    """The column catalog with ``full_table_name``, for requested names only if given."""
    c = source.get("columns").withColumn("full_table_name", full_name())
    return c if names is None else c.join(names.select("full_table_name").distinct(), "full_table_name", "left_semi")


def schema_texts(source: MetadataSource, names: DataFrame | None = None) -> DataFrame:
    """``full_table_name, schema_text``: the table's name and its columns in ordinal order."""
    lines = joined(column_description(), F.col("ordinal_position"), "\n")
    text = F.concat(F.lit("Table: "), "full_table_name", F.lit("\nColumns:\n"), "lines")
    return named_columns(source, names).groupBy("full_table_name").agg(lines.alias("lines")).select("full_table_name", text.alias("schema_text"))


def column_texts(source: MetadataSource, names: DataFrame | None = None) -> DataFrame:
    return named_columns(source, names).select("full_table_name", "column_name", "data_type", "comment", column_text().alias("column_text"))


def table_metadata(source: MetadataSource, catalog: str, schema: str | None = None) -> DataFrame:
    t = source.get("tables").where(F.col("table_catalog") == catalog)
    if schema is not None:
        t = t.where(F.col("table_schema") == schema)
    return t.select(full_name().alias("full_table_name"), "table_type", "table_owner", "comment", "storage_path")


def column_metadata(source: MetadataSource, name: str) -> DataFrame:
    """Columns of one table, in order; the name must have three parts."""
    c, s, t = split_name(name)
    rows = source.get("columns").where((F.col("table_catalog") == c) & (F.col("table_schema") == s) & (F.col("table_name") == t))
    return rows.select("column_name", "data_type", "is_nullable", "column_default", "comment", "ordinal_position").orderBy("ordinal_position")


def usage_scores(source: MetadataSource, days_back: int = 30) -> DataFrame:
    """``full_table_name, usage_score``: audit events that read or write a table."""
    a = source.recent(source.get("audit"), days_back).where(F.col("action_name").isin(*READ_ACTIONS))
    name = F.col("request_params")["full_name_arg"]
    return a.select(name.alias("full_table_name")).where("full_table_name is not null").groupBy("full_table_name").agg(F.count("*").alias("usage_score"))


def enriched_metadata(source: MetadataSource, days_back: int = 30, catalog: str | None = None) -> DataFrame:
    """Tables (no views) with columns, parents and usage; missing parts are '' and 0."""
    t, c = source.get("tables").where("table_type <> 'VIEW'"), source.get("columns")
    if catalog is not None:
        t, c = t.where(F.col("table_catalog") == catalog), c.where(F.col("table_catalog") == catalog)
    t = t.select(full_name().alias("full_table_name"), F.col("comment").alias("tbl_comment"))
    c = c.groupBy(full_name().alias("full_table_name")).agg(
        joined(F.col("column_name"), F.col("ordinal_position"), ", ").alias("col_list"),
        joined(F.coalesce("comment", F.lit("")), F.col("ordinal_position"), " ").alias("col_comments"),
    )
    events = source.recent(source.get("lineage"), days_back).where("source_table_full_name is not null and target_table_full_name is not null")
    up = events.groupBy(F.col("target_table_full_name").alias("full_table_name")).agg(
        F.array_join(F.array_sort(F.collect_set("source_table_full_name")), " ").alias("lineage_context")
    )
    out = t.join(c, "full_table_name", "left").join(up, "full_table_name", "left").join(usage_scores(source, days_back), "full_table_name", "left")
    texts = ["tbl_comment", "col_list", "col_comments", "lineage_context"]
    return out.na.fill("", texts).na.fill(0, ["usage_score"]).select("full_table_name", *texts, "usage_score")


def signatures(enriched: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Table: "), "full_table_name", F.lit(" Comment: "), "tbl_comment", F.lit(" Columns: "), "col_list",
        F.lit(" Lineage Parents: "), "lineage_context",
    )
    return enriched.withColumn("signature", text)
