"""A layered table workload: the relational shapes of cleaning, enriching and summarising layers, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.runtime import table

#: The day on which ages are counted.
TODAY = "2026-06-01"


def _money(c: Column | str) -> Column:
    return F.round(c, 2)


def clean_events(events: DataFrame) -> DataFrame:
    """Valid events with their day, page section and flags."""
    url = F.col("page_url")
    section = F.when(url.like("%/product%"), "product").when(url.like("%/cart%"), "cart").when(url.like("%/search%"), "search").otherwise("other")
    return events.where("event_id is not null and user_id is not null and event_timestamp is not null").select(
        "event_id", "user_id", "event_type", F.date_format("event_timestamp", "yyyy-MM-dd").alias("event_date"), section.alias("section"),
        F.lower("device_type").isin("mobile", "tablet").alias("is_mobile"), "session_id",
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    """Orders with calendar fields and an amount converted by a simple CASE."""
    rate = F.when(F.col("o_orderstatus") == "F", 3.0).when(F.col("o_orderstatus") == "O", 2.0).otherwise(1.0)
    return orders.select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"),
        _money(F.col("o_totalprice") * rate).alias("amount"), (F.col("o_orderstatus") == "F").alias("is_final"),
    )


def enrich_products(products: DataFrame) -> DataFrame:
    """Products with defaults for missing fields and a margin; no margin without cost or price."""
    price, cost = F.col("price").cast("double"), F.col("cost").cast("double")
    return products.select(
        "product_id", "product_name", F.coalesce("subcategory_id", F.lit("unknown")).alias("subcategory_id"), F.lower(F.coalesce("brand", F.lit("none"))).alias("brand"),
        F.round(F.try_divide(price - cost, F.nullif(price, F.lit(0.0))) * 100, 2).alias("margin"), (F.col("status") == "active").alias("is_active"),
    )


def age_groups(reviews: DataFrame) -> DataFrame:
    """Reviews with their age in years and a bucket of it."""
    years = F.floor(F.datediff(F.to_date(F.lit(TODAY)), "review_date") / 365)
    bucket = F.when(years < 1, "new").when(years < 2, "recent").when(years < 3, "old").otherwise("ancient")
    return reviews.select("doc_id", F.concat("source", F.lit("/"), "product_id").alias("origin"), F.coalesce(years.cast("bigint"), F.lit(-1)).alias("age_years"), bucket.alias("age_group"))


def review_scores(reviews: DataFrame) -> DataFrame:
    text = F.col("text")
    mood = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") == 3, "neutral").when(F.col("rating") >= 1, "negative").otherwise("unrated")
    return reviews.select(
        "doc_id", mood.alias("mood"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("text_length"),
        F.round(F.col("rating") / 5.0 * F.when(F.col("verified_purchase"), 1.0).otherwise(0.5), 3).cast("double").alias("weight"),
    )


def line_details(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines joined to their orders, with delay in days and a flag that may be null."""
    d = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    mode = F.when(F.col("l_returnflag").isin("A", "R"), "back").otherwise("kept")
    days = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return d.select("l_orderkey", "l_linenumber", mode.alias("mode"), days.alias("days"), (F.to_date("l_shipdate") <= F.date_add(F.to_date("o_orderdate"), 30)).alias("in_time"))


def session_summary(events: DataFrame) -> DataFrame:
    """Per recorded session: events, distinct pages, length in seconds; sessions without id are left out."""
    e = events.where("session_id is not null and event_timestamp is not null")
    sec = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    return e.groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_distinct("page_url").alias("pages"),
        F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("purchases"),
        (sec(F.max("event_timestamp")) - sec(F.min("event_timestamp"))).alias("seconds"),
    )


def daily_sales(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per day: orders, customers, amounts by return flag. Lines are added up per order first, so amounts are not multiplied."""
    back = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)
    l = lines.groupBy("l_orderkey").agg(F.sum(back).alias("back"), F.sum("l_quantity").alias("quantity"))
    d = orders.join(l, orders.o_orderkey == l.l_orderkey, "left")
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"), _money(F.sum("o_totalprice")).alias("total"),
        _money(F.coalesce(F.sum("back"), F.lit(0.0))).alias("returned"), F.round(F.avg("quantity"), 4).alias("quantity"),
    )


def customer_segments(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with order count, volume, a class from both and a code of the three parts."""
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last"))
    d = customers.join(o, customers.c_custkey == o.o_custkey, "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "s": F.coalesce("s", F.lit(0.0))})
    level = F.when(F.col("n") >= 15, "frequent").when(F.col("n") >= 5, "regular").when(F.col("n") > 0, "rare").otherwise("none")
    grade = lambda c, a, b: F.when(c >= b, "3").when(c >= a, "2").otherwise("1")
    code = F.concat(grade(F.coalesce(F.year("last"), F.lit(0)), 1996, 1998), grade(F.col("n"), 5, 15), grade(F.col("s"), 5e5, 2e6))
    return d.select("c_custkey", "c_mktsegment", F.col("n").alias("orders"), _money("s").alias("total"), level.alias("level"), code.alias("code"))


def product_performance(products: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Two left joins on one key, each side counted once; ``workload.product_fan_out`` has the inflated sums of the plain statement."""
    views = events.where(F.col("page_url").like("%/product/%")).select(F.regexp_extract("page_url", "/product/([^/?]+)", 1).alias("viewed"), "event_id")
    r = reviews.groupBy("product_id").agg(F.count("*").alias("reviews"), F.sum("helpful_votes").alias("votes"))
    v = views.groupBy("viewed").agg(F.count("*").alias("views"))
    d = products.join(r, "product_id", "left").join(v, F.col("product_id") == F.col("viewed"), "left")
    return d.select("product_id", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("views", F.lit(0)).alias("views"), (F.coalesce("reviews", F.lit(0)) * F.coalesce("views", F.lit(1))).alias("fan_out"))


def monthly_figures(orders: DataFrame, customers: DataFrame) -> DataFrame:
    d = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    big = F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct(big).alias("big_customers"), F.count_distinct("c_nationkey").alias("nations"),
        F.round(F.count_distinct(big) * 1.0 / F.nullif(F.count_distinct("o_custkey"), F.lit(0)), 6).cast("double").alias("big_share"),
    )


def channel_performance(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Left join of pre-aggregated sides on two keys."""
    e = events.where("device_type is not null and event_timestamp is not null").groupBy(F.lower("device_type").alias("channel"), F.date_format("event_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    r = reviews.where("review_date is not null").groupBy(F.when(F.col("source") == "mobile_app", "mobile").otherwise("desktop").alias("channel"), F.date_format("review_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("reviews"))
    return e.join(r, ["channel", "day"], "left").select("channel", "day", "events", "users", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def pairs_of_small(regions: DataFrame, nations: DataFrame, rows: int = 40) -> DataFrame:
    """Cross product of two tables of fixed size, the first ``rows`` in a defined order."""
    d = regions.crossJoin(nations).where("r_regionkey <> n_regionkey")
    return d.select("r_name", "n_name").orderBy("r_name", "n_name").limit(rows)


def _t(*names: str):
    def bind(make):
        return lambda spark, folder: make(*[table(spark, folder, n) for n in names])

    return bind


QUERIES = {
    "q28_clean_events": _t("user_events")(clean_events),
    "q29_clean_orders": _t("orders")(clean_orders),
    "q30_enrich_products": _t("products_master")(enrich_products),
    "q31_age_groups": _t("documents")(age_groups),
    "q32_review_scores": _t("documents")(review_scores),
    "q33_line_details": _t("lineitem", "orders")(line_details),
    "q34_session_summary": _t("user_events")(session_summary),
    "q35_daily_sales": _t("orders", "lineitem")(daily_sales),
    "q36_customer_segments": _t("customer", "orders")(customer_segments),
    "q37_product_performance": _t("products_master", "documents", "user_events")(product_performance),
    "q38_monthly_figures": _t("orders", "customer")(monthly_figures),
    "q39_channel_performance": _t("user_events", "documents")(channel_performance),
    "q39_pairs_of_small": _t("region", "nation")(pairs_of_small),
}

SQL = {
    "q28_clean_events": """SELECT event_id, user_id, event_type, strftime(event_timestamp, '%Y-%m-%d') AS event_date,
  CASE WHEN page_url LIKE '%/product%' THEN 'product' WHEN page_url LIKE '%/cart%' THEN 'cart' WHEN page_url LIKE '%/search%' THEN 'search' ELSE 'other' END AS section,
  lower(device_type) IN ('mobile', 'tablet') AS is_mobile, session_id
FROM user_events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_timestamp IS NOT NULL""",
    "q29_clean_orders": """SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month,
  round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN 2.0 ELSE 1.0 END::DOUBLE, 2) AS amount, o_orderstatus = 'F' AS is_final FROM orders""",
    "q30_enrich_products": """SELECT product_id, product_name, coalesce(subcategory_id, 'unknown') AS subcategory_id, lower(coalesce(brand, 'none')) AS brand,
  round((price::DOUBLE - cost::DOUBLE) / nullif(price::DOUBLE, 0) * 100, 2) AS margin, status = 'active' AS is_active FROM products_master""",
    "q31_age_groups": f"""WITH a AS (SELECT doc_id, source || '/' || product_id AS origin, floor(date_diff('day', review_date, DATE '{TODAY}') / 365) AS y FROM documents)
SELECT doc_id, origin, coalesce(CAST(y AS BIGINT), -1) AS age_years, CASE WHEN y < 1 THEN 'new' WHEN y < 2 THEN 'recent' WHEN y < 3 THEN 'old' ELSE 'ancient' END AS age_group FROM a""",
    "q32_review_scores": """SELECT doc_id, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' WHEN rating >= 1 THEN 'negative' ELSE 'unrated' END AS mood,
  coalesce(length(text), 0) AS text_length, round(rating / 5.0::DOUBLE * CASE WHEN verified_purchase THEN 1.0 ELSE 0.5 END::DOUBLE, 3) AS weight FROM documents""",
    "q33_line_details": """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 'back' ELSE 'kept' END AS mode,
  date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + 30 AS in_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "q34_session_summary": """SELECT session_id, count(*) AS events, count(DISTINCT page_url) AS pages, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS purchases,
  CAST(floor(epoch(max(event_timestamp))) - floor(epoch(min(event_timestamp))) AS BIGINT) AS seconds
FROM user_events WHERE session_id IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY session_id""",
    "q35_daily_sales": """WITH l AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS back, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total,
  round(coalesce(sum(back), 0), 2) AS returned, round(avg(q), 4) AS quantity FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""",
    "q36_customer_segments": """WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, max(o_orderdate) AS last FROM orders GROUP BY o_custkey),
d AS (SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(year(last), 0) AS y FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, c_mktsegment, n AS orders, round(s, 2) AS total, CASE WHEN n >= 15 THEN 'frequent' WHEN n >= 5 THEN 'regular' WHEN n > 0 THEN 'rare' ELSE 'none' END AS level,
  CASE WHEN y >= 1998 THEN '3' WHEN y >= 1996 THEN '2' ELSE '1' END || CASE WHEN n >= 15 THEN '3' WHEN n >= 5 THEN '2' ELSE '1' END
  || CASE WHEN s >= 2e6 THEN '3' WHEN s >= 5e5 THEN '2' ELSE '1' END AS code FROM d""",
    "q37_product_performance": """WITH r AS (SELECT product_id, count(*) AS reviews, sum(helpful_votes) AS votes FROM documents GROUP BY product_id),
v AS (SELECT regexp_extract(page_url, '/product/([^/?]+)', 1) AS p, count(*) AS views FROM user_events WHERE page_url LIKE '%/product/%' GROUP BY 1)
SELECT m.product_id, coalesce(reviews, 0) AS reviews, CAST(coalesce(votes, 0) AS BIGINT) AS votes, coalesce(views, 0) AS views, coalesce(reviews, 0) * coalesce(views, 1) AS fan_out
FROM products_master m LEFT JOIN r ON r.product_id = m.product_id LEFT JOIN v ON v.p = m.product_id""",
    "q38_monthly_figures": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS big_customers,
  count(DISTINCT c_nationkey) AS nations, round(count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END)::DOUBLE / nullif(count(DISTINCT o_custkey), 0), 6) AS big_share
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "q39_channel_performance": """WITH e AS (SELECT lower(device_type) AS channel, strftime(event_timestamp, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users
  FROM user_events WHERE device_type IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY 1, 2),
r AS (SELECT CASE WHEN source = 'mobile_app' THEN 'mobile' ELSE 'desktop' END AS channel, strftime(review_date, '%Y-%m-%d') AS day, count(*) AS reviews FROM documents WHERE review_date IS NOT NULL GROUP BY 1, 2)
SELECT e.channel, e.day, events, users, coalesce(reviews, 0) AS reviews FROM e LEFT JOIN r ON r.channel = e.channel AND r.day = e.day""",
    "q39_pairs_of_small": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey ORDER BY 1, 2 LIMIT 40",
}
