"""Further statements of the layered workload, and loading all of it into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.plans import medallion
from twintable.plans.medallion import _money, _t
from twintable.sources.metadata import append_into, create_tables

#: The day on which the age of an order counts.
TODAY = "2001-08-01"


def stock_status(stats: DataFrame) -> DataFrame:
    """What is left of one count after another, with three levels; a null difference is the lowest."""
    left = F.col("read_count") - F.col("write_count")
    level = F.when(left > 100, "IN_STOCK").when(left > 0, "LOW_STOCK").otherwise("OUT_OF_STOCK")
    return stats.select("table_name", left.alias("available"), F.col("write_count").alias("reserved"), F.col("read_count").alias("total"), level.alias("status"), F.date_format("snapshot_at", "yyyy-MM-dd").alias("day"))


def shipments(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Two tables joined, a date with a fallback, days between, and a flag that is null where a date is missing."""
    first = events.where("entity_id is not null").groupBy(F.col("entity_id").alias("shipment")).agg(F.min("event_time").alias("sent"), F.max(F.when(F.col("entity_type") == "JOB", F.col("event_time"))).alias("arrived"), F.count("*").alias("k"))
    due = F.date_add(F.to_date("sent"), 30)
    there = F.coalesce(F.to_date("arrived"), due)
    kinds = events.where("entity_id is not null").groupBy(F.col("entity_id").alias("s")).agg(F.max("entity_type").alias("carrier"))
    return first.join(kinds, F.col("shipment") == F.col("s")).select(
        "shipment", "carrier", F.date_format(there, "yyyy-MM-dd").alias("delivery_date"), F.datediff(there, F.to_date("sent")).cast("bigint").alias("days"), (F.to_date("arrived") <= due).alias("in_time")
    )


def recorded_sessions(events: DataFrame) -> DataFrame:
    """Sessions as their events record them: one row per id, user and device, with start and end."""
    e = events.where("session_id is not null and user_id is not null and event_timestamp is not null")
    return e.groupBy("session_id", "user_id", F.lower("device_type").alias("device")).agg(F.min("event_timestamp").alias("start"), F.max("event_timestamp").alias("end"))


def _seconds(c):
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)


def session_analysis(events: DataFrame) -> DataFrame:
    """Sessions left-joined to their events of one browser and grouped by six columns; a session of at most one such event is a bounce."""
    s = recorded_sessions(events).withColumn("hour", F.hour("start"))
    e = events.where("browser = 'Chrome'").select(F.col("session_id").alias("sid"), "page_url", "event_id")
    d = s.join(e, F.col("session_id") == F.col("sid"), "left").groupBy("session_id", "user_id", "start", "end", "device", "hour")
    return d.agg(F.count_distinct("page_url").alias("pages"), F.count("event_id").alias("events")).select(
        "session_id", "user_id", F.coalesce("device", F.lit("")).alias("device"), F.date_format("start", "yyyy-MM-dd").alias("day"), (_seconds(F.col("end")) - _seconds(F.col("start"))).alias("seconds"), "pages", "events", (F.col("events") <= 1).alias("is_bounce")
    )


def product_fan_out(products: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Products left-joined to reviews and to page views: every review meets every view, so sums and counts are inflated, as the statement says.

    The inflated figures follow from each side's own, so the rows of the fan-out are never made: with r reviews
    and v views a product has max(r, 1) x max(v, 1) rows, a sum over reviews counts max(v, 1) times, an average
    not at all. A hot product is no hot task.
    """
    views = events.where(F.col("page_url").like("%/product/%")).groupBy(F.regexp_extract("page_url", "/product/([^/?]+)", 1).alias("viewed")).agg(F.count("*").alias("v"))
    r = reviews.groupBy("product_id").agg(F.count("*").alias("r"), F.sum("helpful_votes").alias("votes"), F.avg("rating").alias("rating"))
    d = products.join(r, "product_id", "left").join(views, F.col("product_id") == F.col("viewed"), "left")
    many = F.greatest(F.coalesce("v", F.lit(0)), F.lit(1))
    return d.select(
        "product_id", "product_name", (F.coalesce("votes", F.lit(0)) * many).alias("total_votes"), F.round("rating", 6).alias("avg_rating"), F.coalesce("r", F.lit(0)).alias("review_count"),
        (F.greatest(F.coalesce("r", F.lit(0)), F.lit(1)) * many).alias("joined_rows"), F.lit(0.05).alias("return_rate"),
    )


def monthly_kpi(orders: DataFrame, customers: DataFrame, events: DataFrame) -> DataFrame:
    """Per month: orders left-joined to customers and to recorded sessions, counts of distinct ones by CASE, a ratio safe from zero."""
    s = recorded_sessions(events).select(F.col("user_id").alias("visitor"), "session_id").distinct()
    d = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(s, F.concat(F.lit("user_"), F.col("c_custkey").cast("string")) == F.col("visitor"), "left")
    rich = F.col("c_acctbal") > 5000
    n, m = F.count_distinct("o_orderkey"), F.count_distinct("session_id")
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        _money(F.sum("o_totalprice")).alias("revenue"), F.count_distinct(F.when(rich, F.col("c_custkey"))).alias("rich"), F.count_distinct(F.when(~rich, F.col("c_custkey"))).alias("others"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(n * 1.0 / F.nullif(m, F.lit(0)), 6).cast("double").alias("conversion"),
    )


def payment_buckets(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per day: a flag from a left join that may be null counts in neither bucket."""
    p = lines.where("l_linenumber = 3").select("l_orderkey", (F.col("l_returnflag") != "R").alias("ok"))
    d = orders.join(p, orders.o_orderkey == p.l_orderkey, "left")
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(
        F.count("o_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("successful"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("failed"),
    )


def channel_fan_out(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions left-joined to orders by user alone: a session counts once per order of its user (COUNT, not distinct).

    As in ``product_fan_out`` the inflated counts come from the counts of both sides.
    """
    s = recorded_sessions(events).withColumn("day", F.date_format("start", "yyyy-MM-dd"))
    o = orders.groupBy(F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("buyer")).agg(F.count("*").alias("o"), F.sum("o_totalprice").alias("spent"))
    d = s.groupBy("device", "day", "user_id").agg(F.count("*").alias("k")).join(o, F.col("user_id") == F.col("buyer"), "left")
    many = F.greatest(F.coalesce("o", F.lit(0)), F.lit(1))
    count, buys = F.sum(F.col("k") * many), F.coalesce(F.sum("o"), F.lit(0))
    return d.groupBy(F.coalesce("device", F.lit("")).alias("channel"), "day").agg(
        count.alias("session_count"), F.count("*").alias("visitors"), buys.alias("orders"), _money(F.coalesce(F.sum(F.col("k") * F.col("spent")), F.lit(0.0))).alias("revenue"), F.round(buys * 100.0 / F.nullif(count, F.lit(0)), 6).cast("double").alias("cvr_pct"),
    )


def value_tiers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with a tier by volume and a risk by the last order's age; no order is the lowest of both."""
    o = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    d = customers.join(o, customers.c_custkey == o.o_custkey, "left")
    tier = F.when(F.col("s") > 4e6, "Platinum").when(F.col("s") > 2e6, "Gold").when(F.col("s") > 5e5, "Silver").otherwise("Bronze")
    day = lambda n: F.date_sub(F.to_date(F.lit(TODAY)), n)
    risk = F.when(F.to_date("last") < day(90), "HIGH").when(F.to_date("last") < day(30), "MEDIUM").otherwise("LOW")
    return d.select("c_custkey", tier.alias("value_tier"), F.coalesce("n", F.lit(0)).alias("orders"), _money(F.coalesce("s", F.lit(0.0))).alias("total"), F.round(F.col("s") / F.col("n"), 1).alias("basket"), risk.alias("churn_risk"))


def activity_log(events: DataFrame) -> DataFrame:
    """All events under older names, nothing filtered."""
    url = F.col("page_url")
    kind = F.when(url.like("%/product%"), "P").when(url.like("%/cart%"), "C").otherwise("O")
    return events.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("member"), F.col("event_type").alias("action"), kind.alias("page_kind"), F.date_format("event_timestamp", "yyyy-MM-dd").alias("log_date"))


def transaction_history(orders: DataFrame) -> DataFrame:
    c = medallion.clean_orders(orders)
    return c.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("buyer_id"), F.col("amount").alias("converted_amount"), (F.col("order_year") * 100 + F.col("order_month")).alias("period"))


def customer_master(reviews: DataFrame) -> DataFrame:
    """Three classes of age in days, from a date that may be missing."""
    days = F.datediff(F.to_date(F.lit(medallion.TODAY)), "review_date")
    return reviews.select("doc_id", F.concat_ws(" ", "lang", "source").alias("label"), F.when(days < 200, "young").when(days < 500, "middle").otherwise("senior").alias("age_class"))


def item_sales(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products left-joined and grouped, next to constants."""
    d = products.join(reviews.select("product_id", "helpful_votes"), "product_id", "left")
    return d.groupBy("product_id", "brand").agg(F.coalesce(F.sum("helpful_votes"), F.lit(0)).alias("sold"), F.lit(0).alias("returned"), F.lit("units").alias("measure"))


def sales_dashboard(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Daily orders left-joined to several lines each: counts and sums over the joined rows."""
    d = orders.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("k")), orders.o_orderkey == F.col("l_orderkey"), "left").withColumn("k", F.coalesce("k", F.lit(1)))
    done = F.col("o_orderstatus") == "F"
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_key")).agg(
        F.sum("k").alias("num_orders"), _money(F.sum(F.col("o_totalprice") * F.col("k"))).alias("total_sales"), F.count_distinct("o_custkey").alias("distinct_customers"),
        F.sum(F.when(done, F.col("k")).otherwise(0)).alias("completed"), F.sum(F.when(~done, F.col("k")).otherwise(0)).alias("open"),
    )


QUERIES = {
    "q50_stock_status": _t("table_usage_stats")(stock_status),
    "q51_shipments": _t("table_lineage", "table_usage_stats")(shipments),
    "q52_session_analysis": _t("user_events")(session_analysis),
    "q53_product_fan_out": _t("products_master", "documents", "user_events")(product_fan_out),
    "q54_monthly_kpi": _t("orders", "customer", "user_events")(monthly_kpi),
    "q55_payment_buckets": _t("orders", "lineitem")(payment_buckets),
    "q56_channel_fan_out": _t("user_events", "orders")(channel_fan_out),
    "q57_value_tiers": _t("customer", "orders")(value_tiers),
    "q58_activity_log": _t("user_events")(activity_log),
    "q59_transaction_history": _t("orders")(transaction_history),
    "q60_customer_master": _t("documents")(customer_master),
    "q61_item_sales": _t("products_master", "documents")(item_sales),
    "q62_sales_dashboard": _t("orders", "lineitem")(sales_dashboard),
}

_SESSIONS = """s AS (
  SELECT session_id, user_id, lower(device_type) AS device, min(event_timestamp) AS a, max(event_timestamp) AS b FROM user_events
  WHERE session_id IS NOT NULL AND user_id IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY 1, 2, 3)"""

SQL = {
    "q50_stock_status": """SELECT table_name, read_count - write_count AS available, write_count AS reserved, read_count AS total,
  CASE WHEN read_count - write_count > 100 THEN 'IN_STOCK' WHEN read_count - write_count > 0 THEN 'LOW_STOCK' ELSE 'OUT_OF_STOCK' END AS status, strftime(snapshot_at, '%Y-%m-%d') AS day FROM table_usage_stats""",
    "q51_shipments": """WITH f AS (SELECT entity_id AS x, min(event_time) AS sent, max(CASE WHEN entity_type = 'JOB' THEN event_time END) AS arrived FROM table_lineage WHERE entity_id IS NOT NULL GROUP BY 1),
k AS (SELECT entity_id AS y, max(entity_type) AS carrier FROM table_lineage WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT x AS shipment, carrier, strftime(coalesce(arrived::DATE, sent::DATE + 30), '%Y-%m-%d') AS delivery_date, date_diff('day', sent::DATE, coalesce(arrived::DATE, sent::DATE + 30)) AS days,
  arrived::DATE <= sent::DATE + 30 AS in_time FROM f JOIN k ON x = y""",
    "q52_session_analysis": f"""WITH {_SESSIONS}
SELECT s.session_id, s.user_id, coalesce(device, '') AS device, strftime(a, '%Y-%m-%d') AS day, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS seconds,
  count(DISTINCT e.page_url) AS pages, count(e.event_id) AS events, count(e.event_id) <= 1 AS is_bounce
FROM s LEFT JOIN (SELECT * FROM user_events WHERE browser = 'Chrome') e ON s.session_id = e.session_id GROUP BY s.session_id, s.user_id, a, b, device, hour(a)""",
    "q53_product_fan_out": """WITH v AS (SELECT regexp_extract(page_url, '/product/([^/?]+)', 1) AS p FROM user_events WHERE page_url LIKE '%/product/%')
SELECT m.product_id, m.product_name, CAST(coalesce(sum(helpful_votes), 0) AS BIGINT) AS total_votes, round(avg(rating), 6) AS avg_rating, count(DISTINCT doc_id) AS review_count, count(*) AS joined_rows, 0.05::DOUBLE AS return_rate
FROM products_master m LEFT JOIN documents d ON d.product_id = m.product_id LEFT JOIN v ON v.p = m.product_id GROUP BY m.product_id, m.product_name""",
    "q54_monthly_kpi": f"""WITH {_SESSIONS}, u AS (SELECT DISTINCT user_id, session_id FROM s)
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT CASE WHEN c_acctbal > 5000 THEN c_custkey END) AS rich, count(DISTINCT CASE WHEN NOT c_acctbal > 5000 THEN c_custkey END) AS others,
  round(avg(o_totalprice), 4) AS mean, round(count(DISTINCT o_orderkey)::DOUBLE / nullif(count(DISTINCT session_id), 0), 6) AS conversion
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN u ON user_id = 'user_' || c_custkey GROUP BY 1""",
    "q55_payment_buckets": """WITH p AS (SELECT l_orderkey, l_returnflag <> 'R' AS ok FROM lineitem WHERE l_linenumber = 3)
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successful,
  CAST(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM orders LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY 1""",
    "q56_channel_fan_out": f"""WITH {_SESSIONS}
SELECT coalesce(device, '') AS channel, strftime(a, '%Y-%m-%d') AS day, count(session_id) AS session_count, count(DISTINCT user_id) AS visitors, count(DISTINCT o_orderkey) AS orders,
  round(coalesce(sum(o_totalprice), 0), 2) AS revenue, round(count(DISTINCT o_orderkey) * 100.0::DOUBLE / nullif(count(session_id), 0), 6) AS cvr_pct
FROM s LEFT JOIN orders ON user_id = 'user_' || o_custkey GROUP BY 1, 2""",
    "q57_value_tiers": f"""SELECT c_custkey, CASE WHEN sum(o_totalprice) > 4e6 THEN 'Platinum' WHEN sum(o_totalprice) > 2e6 THEN 'Gold' WHEN sum(o_totalprice) > 5e5 THEN 'Silver' ELSE 'Bronze' END AS value_tier,
  count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, round(avg(o_totalprice), 1) AS basket,
  CASE WHEN max(o_orderdate)::DATE < DATE '{TODAY}' - 90 THEN 'HIGH' WHEN max(o_orderdate)::DATE < DATE '{TODAY}' - 30 THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "q58_activity_log": """SELECT event_id AS log_id, user_id AS member, event_type AS action, CASE WHEN page_url LIKE '%/product%' THEN 'P' WHEN page_url LIKE '%/cart%' THEN 'C' ELSE 'O' END AS page_kind,
  strftime(event_timestamp, '%Y-%m-%d') AS log_date FROM user_events""",
    "q59_transaction_history": """SELECT o_orderkey AS transaction_id, o_custkey AS buyer_id, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN 2.0 ELSE 1.0 END::DOUBLE, 2) AS converted_amount,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period FROM orders""",
    "q60_customer_master": f"""SELECT doc_id, concat_ws(' ', lang, source) AS label, CASE WHEN date_diff('day', review_date, DATE '{medallion.TODAY}') < 200 THEN 'young' WHEN date_diff('day', review_date, DATE '{medallion.TODAY}') < 500 THEN 'middle' ELSE 'senior' END AS age_class FROM documents""",
    "q61_item_sales": """SELECT m.product_id, brand, CAST(coalesce(sum(helpful_votes), 0) AS BIGINT) AS sold, 0 AS returned, 'units' AS measure
FROM products_master m LEFT JOIN documents d ON d.product_id = m.product_id GROUP BY 1, 2""",
    "q62_sales_dashboard": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_key, count(o_orderkey) AS num_orders, round(sum(o_totalprice), 2) AS total_sales, count(DISTINCT o_custkey) AS distinct_customers,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN NOT o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS open
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
}

#: Typed tables that the workload fills: layer, table, columns. Amounts are decimals and counts integers, so inserting casts.
TABLES = {
    "silver.user_events_cleaned": ("q28_clean_events", "event_id STRING, user_id STRING, event_type STRING, event_date STRING, section STRING COMMENT 'part of the shop', is_mobile BOOLEAN, session_id STRING"),
    "silver.orders_cleaned": ("q29_clean_orders", "o_orderkey BIGINT, o_custkey BIGINT, order_year INT, order_month INT, amount DECIMAL(18,2) COMMENT 'converted', is_final BOOLEAN"),
    "silver.products_enriched": ("q30_enrich_products", "product_id STRING, product_name STRING, subcategory_id STRING, brand STRING, margin DECIMAL(10,2), is_active BOOLEAN"),
    "silver.inventory_status": ("q50_stock_status", "table_name STRING, available INT, reserved INT, total INT, status STRING, day STRING"),
    "silver.session_analysis": ("q52_session_analysis", "session_id STRING, user_id STRING, device STRING, day STRING, seconds INT, pages INT, events INT, is_bounce BOOLEAN"),
    "gold.customer_segments": ("q36_customer_segments", "c_custkey BIGINT, c_mktsegment STRING, orders INT, total DECIMAL(18,2), level STRING, code STRING"),
    "gold.product_performance": ("q53_product_fan_out", "product_id STRING, product_name STRING, total_votes BIGINT, avg_rating DECIMAL(4,2), review_count INT, joined_rows BIGINT, return_rate DECIMAL(5,2)"),
    "gold.monthly_kpi": ("q54_monthly_kpi", "month STRING, revenue DECIMAL(20,2), rich INT, others INT, mean DECIMAL(18,4), conversion DECIMAL(18,6)"),
    "legacy.daily_revenue_report": ("q55_payment_buckets", "day STRING, orders INT, customers INT, successful INT, failed INT"),
    "mart.customer_value_tiers": ("q57_value_tiers", "c_custkey BIGINT, value_tier STRING, orders INT, total DECIMAL(18,2), basket DECIMAL(18,4), churn_risk STRING"),
}


def load_workload(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Creates the layers' schemas and typed tables where they are missing and appends each statement's rows.

    ``prefix`` goes before the layer's name. Values are cast by the store-assignment rules: whole numbers to
    narrower ones, doubles to decimals; what doesn't fit is an error, nothing is cut off.
    """
    every = medallion.QUERIES | QUERIES
    tables = {prefix + name: columns for name, (_, columns) in TABLES.items()}
    create_tables(spark, tables)
    for name, (query, _) in TABLES.items():
        append_into(every[query](spark, folder), prefix + name)
    return list(tables)
