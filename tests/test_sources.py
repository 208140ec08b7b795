from datetime import datetime

import pytest
from pyspark.sql import functions as F

from twintable.operators.lineage import rollup
from twintable.operators.schema_text import schema_texts
from twintable.sources.metadata import SCHEMAS, MetadataSource, append_into, save_table, session_relations
from twintable.streaming.lineage import stream_rollup

D = datetime


@pytest.fixture
def place(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shelf LOCATION '{tmp_path}/shelf'")
    yield "shelf"
    spark.sql("DROP DATABASE shelf CASCADE")


def test_sink_append_and_session_catalog(spark, place):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    save_table(df, "shelf.items")
    save_table(df, "shelf.items", "append")
    append_into(df.select("name", F.col("id").cast("int").alias("id"), F.lit(1).alias("more")), "shelf.items")
    assert spark.table("shelf.items").count() == 6
    save_table(df, "shelf.items")
    assert spark.table("shelf.items").count() == 2
    source = MetadataSource(spark, session_relations(spark, ["shelf"]))
    assert [r.schema_text for r in schema_texts(source).collect()] == ["Table: spark_catalog.shelf.items\nColumns:\n  - id (BIGINT)\n  - name (STRING)"]
    assert MetadataSource(spark, {"lineage": "shelf.items"}).get("lineage").where("event_time is not null").count() == 0


def test_stream_rolls_up_to_the_batch_result(spark, tmp_path):
    rows = [("c.s.a", "c", "s", "a", "c.s.x", "JOB", "j", D(2026, 5, d, h)) for d, h in ((1, 1), (1, 5), (2, 3), (9, 0))] + [(None, None, None, None, "c.s.x", "JOB", "j", D(2026, 5, 1))]
    df = spark.createDataFrame(rows, SCHEMAS["lineage"])
    df.write.parquet(str(tmp_path / "in"))
    days = stream_rollup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("days").agg(F.sum("event_count").alias("n"), F.min("first_seen").alias("a"), F.max("last_seen").alias("b")).first()
    want = rollup(MetadataSource(spark, {"lineage": df.where("event_time < '2026-05-09'")}, "2026-05-31"), 60).first()
    assert (got.n, got.a, got.b) == (want.event_count, want.first_seen, want.last_seen)
