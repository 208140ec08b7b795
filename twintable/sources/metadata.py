"""Catalog metadata as injected DataFrames, and the result sink."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of each relation. A missing relation is an empty one of this schema.
SCHEMAS = {
    "lineage": "source_table_full_name string, source_table_catalog string, source_table_schema string, source_table_name string, target_table_full_name string, entity_type string, entity_id string, event_time timestamp",
    "tables": "table_catalog string, table_schema string, table_name string, table_type string, table_owner string, storage_path string, comment string",
    "columns": "table_catalog string, table_schema string, table_name string, column_name string, data_type string, is_nullable string, column_default string, comment string, ordinal_position int",
    "audit": "event_time timestamp, action_name string, request_params map<string,string>, user_identity struct<email:string>",
    "storage": "full_table_name string, size_bytes bigint",
}


def full_name(catalog: str = "table_catalog", schema: str = "table_schema", name: str = "table_name") -> Column:
    """Three-part name; null if a part is null."""
    return F.concat(F.col(catalog), F.lit("."), F.col(schema), F.lit("."), F.col(name))


def split_name(name: str) -> tuple[str, str, str]:
    parts = name.split(".")
    if len(parts) != 3:
        raise ValueError(f"not a three-part table name: {name}")
    return parts[0], parts[1], parts[2]


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with typed null columns for those it lacks."""
    lower = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in lower})


@dataclass
class MetadataSource:
    """Relations of a catalog: each a DataFrame, the name of a table, or None for an inaccessible one.

    ``as_of`` replaces the wall clock in all time windows; None means the session's current date.
    """

    spark: SparkSession
    relations: dict[str, DataFrame | str | None] = field(default_factory=dict)
    as_of: date | str | None = None

    def get(self, name: str) -> DataFrame:
        given = self.relations.get(name)
        if given is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.table(given) if isinstance(given, str) else given
        return with_missing(df, {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in _fields(SCHEMAS[name])})

    def today(self) -> Column:
        return F.current_date() if self.as_of is None else F.to_date(F.lit(str(self.as_of)))

    def recent(self, df: DataFrame, days_back: int, ts: str = "event_time") -> DataFrame:
        """Rows not older than ``days_back`` days before the as-of date; the bound reaches the scan."""
        return df.where(F.col(ts) >= F.date_sub(self.today(), days_back))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def names_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    """A relation of requested table names, each once."""
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "full_table_name string")


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Write a result table; ``mode`` is overwrite or append."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode: {mode}")
    df.write.mode(mode).saveAsTable(name)


def append_into(df: DataFrame, name: str) -> None:
    """Append to an existing typed table by column name; values are cast to its types under the store-assignment rules."""
    df.sparkSession.table(name)  # fails early if the table is missing
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def create_tables(spark: SparkSession, tables: dict[str, str], using: str = "parquet") -> None:
    """Creates tables, and the schemas they lie in, where they are missing: name -> columns as DDL, with comments."""
    for schema in sorted({name.rsplit(".", 1)[0] for name in tables if "." in name}):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}")


def session_relations(spark: SparkSession, databases: list[str] | None = None) -> dict[str, DataFrame]:
    """``tables`` and ``columns`` of the session catalog (metadata only, no table is read)."""
    tables, columns = [], []
    catalog = spark.catalog.currentCatalog()
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            if t.isTemporary:
                continue
            tables.append((catalog, db, t.name, t.tableType, None, None, t.description))
            for i, c in enumerate(spark.catalog.listColumns(f"{db}.{t.name}"), 1):
                columns.append((catalog, db, t.name, c.name, c.dataType.upper(), "YES" if c.nullable else "NO", None, c.description, i))
    return {"tables": spark.createDataFrame(tables, SCHEMAS["tables"]), "columns": spark.createDataFrame(columns, SCHEMAS["columns"])}
