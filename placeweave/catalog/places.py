"""Filters, parsing, categories, ranking, joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave.catalog.base import query, sql_rules, table
from placeweave.functions.cleaning import classify, make_slug, to_int, to_number, to_price
from placeweave.functions.display import comma, dollars, plain_number, post_flag, truncate
from placeweave.operators.joins import complete_spine, fallback_rows, keep_keys, union_layers
from placeweave.operators.ranking import (
    cap_per_source, earliest_per_key, global_top, global_top_ties, latest_per_key, ordered_join, priority_dedup,
    top_n)
from placeweave.operators.stats import (
    category_counts, diversity, engagement, mean_and_sd, share_in_group, with_median)

PART_RULES = [("Warm", "hot|red"), ("Round", "ring|rod|gear|hot"), ("Flat", "plate|anvil"), ("Little", "small")]


@query("""
SELECT o_orderkey AS id, o_custkey AS holder, o_orderstatus AS status, o_totalprice AS amount,
       CAST(o_orderdate AS DATE) AS start_date
FROM orders WHERE o_orderstatus = 'F'
""")
def active_filter_project(spark, sf):
    return table(spark, sf, "orders").filter(col("o_orderstatus") == "F").select(
        col("o_orderkey").alias("id"), col("o_custkey").alias("holder"), col("o_orderstatus").alias("status"),
        col("o_totalprice").alias("amount"), col("o_orderdate").cast("date").alias("start_date"))


@query("""
WITH raw AS (
  SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'n/a' WHEN 'SMALL' THEN ' 0' || p_size || ' '
                    WHEN 'LARGE' THEN '' ELSE CAST(p_size AS VARCHAR) END AS area,
         CASE WHEN r >= 1000 THEN '$' || CAST(r // 1000 AS VARCHAR) || ',' || lpad(CAST(r % 1000 AS VARCHAR), 3, '0')
              ELSE '$' || CAST(r AS VARCHAR) END || '.50' AS price,
         CASE p_type WHEN 'MEDIUM' THEN '12.5x' WHEN 'PROMO' THEN NULL ELSE p_size || '.25' END AS lat
  FROM (SELECT *, CAST(floor(p_retailprice) AS INTEGER) AS r FROM part)),
num AS (SELECT p_partkey, CAST(trunc(TRY_CAST(trim(area) AS DOUBLE)) AS INTEGER) AS area_number,
               TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price_num,
               TRY_CAST(lat AS DOUBLE) AS latitude FROM raw)
SELECT * FROM num WHERE area_number BETWEEN 1 AND 40
UNION ALL SELECT * FROM num WHERE area_number IS NULL
""")
def lenient_cast_normalise(spark, sf):
    size, kind, whole = col("p_size").cast("string"), col("p_type"), F.floor("p_retailprice").cast("int")
    thousands = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    raw = table(spark, sf, "part").select(
        "p_partkey",
        F.when(kind == "PROMO", "n/a").when(kind == "SMALL", F.concat(F.lit(" 0"), size, F.lit(" ")))
        .when(kind == "LARGE", "").otherwise(size).alias("area"),
        F.concat(F.lit("$"), F.when(whole >= 1000, thousands).otherwise(whole.cast("string")), F.lit(".50")).alias("price"),
        F.when(kind == "MEDIUM", "12.5x").when(kind != "PROMO", F.concat(size, F.lit(".25"))).alias("lat"))
    parsed = raw.select("p_partkey", to_int("area").alias("area_number"), to_price("price").alias("price_num"),
                        to_number("lat").alias("latitude"))
    return parsed.filter(col("area_number").between(1, 40) | col("area_number").isNull())


@query(f"""
SELECT {sql_rules('p_name', PART_RULES, 'Other')} AS category, count(*) AS n FROM part GROUP BY 1
""")
def classify_rules(spark, sf):
    parts = table(spark, sf, "part").select(classify("p_name", PART_RULES).alias("category"))
    return category_counts(parts, [], "category")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
     p AS (SELECT p_brand, n, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM c)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS total, round(-sum(share * ln(share)), 8) AS diversity FROM p GROUP BY 1
""")
def category_diversity(spark, sf):
    counts = category_counts(table(spark, sf, "part"), ["p_brand"], "p_type")
    return diversity(counts, ["p_brand"]).withColumn("diversity", F.round("diversity", 8))


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rk FROM c)
SELECT p_brand, string_agg(p_type, ' | ' ORDER BY rk) AS top_3_types FROM r WHERE rk <= 3 GROUP BY 1
""")
def top3_categories(spark, sf):
    counts = category_counts(table(spark, sf, "part"), ["p_brand"], "p_type")
    best = top_n(counts, ["p_brand"], [F.desc("n"), "p_type"], 3, rank="rank")
    return ordered_join(best, ["p_brand"], "p_type", "rank", "top_3_types", " | ")


@query("""
SELECT n_nationkey, n_name, coalesce(n, 0) AS suppliers, coalesce(round(best, 2), 0.0) AS best_balance,
       coalesce(names, 'No data') AS names
FROM nation LEFT JOIN (
  SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS best,
         string_agg(CASE WHEN rk <= 2 THEN s_name END, ', ' ORDER BY rk) AS names
  FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS rk
        FROM supplier WHERE s_acctbal > 8500) GROUP BY 1) ON n_nationkey = s_nationkey
""")
def spine_complete(spark, sf):
    rich = table(spark, sf, "supplier").filter(col("s_acctbal") > 8500)
    stats = rich.groupBy(col("s_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("suppliers"), F.round(F.max("s_acctbal"), 2).alias("best_balance"))
    first = top_n(rich.withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"],
                  [F.desc("s_acctbal"), "s_name"], 2, rank="rank")
    names = ordered_join(first, ["n_nationkey"], "s_name", "rank", "names", ", ")
    return complete_spine(table(spark, sf, "nation").select("n_nationkey", "n_name"),
                          stats.join(names, "n_nationkey"), "n_nationkey",
                          {"suppliers": 0, "best_balance": 0.0, "names": "No data"})


@query("""
SELECT user_id, event_id, CAST(ts AS VARCHAR)[1:19] AS at, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""", name="latest_per_key")
def latest_per_key_events(spark, sf):
    kept = latest_per_key(table(spark, sf, "events").drop("props", "value"), ["user_id"], "ts", [F.desc("event_id")])
    return kept.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type")


@query("""
SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1
""")
def first_per_composite_key(spark, sf):
    days = table(spark, sf, "events").withColumn("day", col("ts").cast("date"))
    return earliest_per_key(days, ["user_id", "event_type", "day"], "ts", ["event_id"]).select(
        "user_id", "event_type", "day", "event_id", "value")


_PRIORITY = ["purchase", "signup", "click", "view", "error"]


@query("""
WITH e AS (SELECT *, list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type) AS source_rank,
             CAST(ts AS DATE) AS day FROM events),
 c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 12)
SELECT user_id, day, event_id, event_type FROM c
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY source_rank, event_id) = 1
""")
def source_priority_dedup(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", col("ts").cast("date").alias("day"))
    capped = cap_per_source(events, ["user_id", "event_type"], "event_id", 12)
    rank = F.array_position(F.lit(_PRIORITY), col("event_type"))
    return priority_dedup(capped, ["user_id"], "day", [rank, "event_id"]).select(
        "user_id", "day", "event_id", "event_type")


@query("""
WITH p AS (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 13)
SELECT event_id, user_id, event_type FROM events
WHERE event_type <> 'view' OR user_id NOT IN (SELECT user_id FROM p)
""")
def fallback_source(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return fallback_rows(events, ["user_id"], col("event_type") == "purchase", col("event_type") == "view", 13)


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 4) AS median_price,
       round(avg(l_discount), 8) AS avg_discount, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY 1, 2
""")
def group_stats(spark, sf):
    keys = ["l_returnflag", "l_linestatus"]
    stats = with_median(table(spark, sf, "lineitem"), keys, "l_extendedprice", "median_price", [
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("avg_discount"),
        F.round(F.sum("l_quantity"), 2).alias("quantity")])
    return stats.withColumn("median_price", F.round("median_price", 4))


@query("""
SELECT l_partkey, count(*) AS n, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1
""")
def median_per_part(spark, sf):
    stats = with_median(table(spark, sf, "lineitem"), ["l_partkey"], "l_extendedprice", "median_price",
                        [F.count("*").alias("n")])
    return stats.withColumn("median_price", F.round("median_price", 4))


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value
FROM events GROUP BY 1
""")
def mean_sd(spark, sf):
    events = table(spark, sf, "events")
    stats = mean_and_sd(events, ["event_type"], "value", "mean_value", "sd_value", [F.count("*").alias("n")])
    return stats.select(
        "event_type", "n", F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 6).alias("sd_value"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '(^_|_$)', '', 'g') AS slug
FROM (SELECT p_partkey, '(' || p_name || ') & ' || p_brand || ' / ' || p_type || '!' AS t FROM part)
""", name="make_slug")
def make_slugs(spark, sf):
    text = F.concat(F.lit("("), "p_name", F.lit(") & "), "p_brand", F.lit(" / "), "p_type", F.lit("!"))
    return table(spark, sf, "part").select("p_partkey", make_slug(text).alias("slug"))


@query("""
SELECT user_id, count(*) AS post_count, CAST(sum(CAST(value * 100 AS BIGINT) + event_id) AS BIGINT) AS total_engagement,
       CASE WHEN count(*) < 66 THEN 'low_reddit' ELSE 'full' END AS data_quality_flag
FROM events GROUP BY 1
""", name="engagement")
def engagement_flags(spark, sf):
    events = table(spark, sf, "events").withColumn("score", F.round(col("value") * 100).cast("long"))
    stats = engagement(events, ["user_id"], ["score", "event_id"])
    return stats.withColumn("data_quality_flag", post_flag("post_count", 66))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag,
       round(1e6 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS share
FROM lineitem
""", name="share_in_group")
def share_in_group_lines(spark, sf):
    shares = share_in_group(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "share")
    return shares.select("l_orderkey", "l_linenumber", "l_returnflag", F.round(col("share") * 1e6, 6).alias("share"))


@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS revenue
           FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(revenue, 2) AS revenue,
       round(revenue / sum(revenue) OVER (PARTITION BY l_returnflag), 8) AS share FROM r
""")
def revenue_share(spark, sf):
    revenue = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(col("l_extendedprice") * (1 - col("l_discount"))).alias("revenue"))
    return share_in_group(revenue, ["l_returnflag"], "revenue", "share").select(
        "l_returnflag", "l_linestatus", F.round("revenue", 2).alias("revenue"), F.round("share", 8).alias("share"))


@query("""
SELECT s_suppkey, s_name, CAST(round(s_acctbal / 500) AS BIGINT) AS level FROM supplier
QUALIFY rank() OVER (ORDER BY round(s_acctbal / 500) DESC) <= 10
""")
def top_n_ties(spark, sf):
    level = F.round(col("s_acctbal") / 500).cast("long").alias("level")
    return global_top_ties(table(spark, sf, "supplier").select("s_suppkey", "s_name", level), "level", 10)


@query("""
SELECT s_suppkey, s_name, CAST(round(s_acctbal / 500) AS BIGINT) AS level FROM supplier
ORDER BY level DESC, s_suppkey LIMIT 10
""")
def top_n_no_ties(spark, sf):
    level = F.round(col("s_acctbal") / 500).cast("long").alias("level")
    return global_top(table(spark, sf, "supplier").select("s_suppkey", "s_name", level), "level", 10, ["s_suppkey"])


@query("""
SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders)
WHERE rk <= 3
""")
def top_orders_per_customer(spark, sf):
    return top_n(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rk").select(
        "o_custkey", "o_orderkey", "rk")


@query("""
SELECT o_orderkey, 'kept' AS part FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL
SELECT o_orderkey, 'listed' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT o_orderkey, 'other' FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE'))
""")
def key_subset(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    people = table(spark, sf, "customer")
    kept = keep_keys(orders, people.filter(col("c_mktsegment") == "BUILDING"), "c_custkey")
    listed = keep_keys(orders, ["1-URGENT", "2-HIGH"], "o_orderpriority")
    other = keep_keys(orders, keep_keys(people, ["BUILDING", "FURNITURE"], "c_mktsegment"), "c_custkey", negate=True)
    return union_layers({"kept": kept.select("o_orderkey"), "listed": listed.select("o_orderkey"),
                         "other": other.select("o_orderkey")}, "part")


@query("""
SELECT o_orderpriority, p_brand, n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
GROUP BY ALL
""")
def join_variants(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    parts = table(spark, sf, "part").select(col("p_partkey").alias("l_partkey"), "p_brand")
    nations = table(spark, sf, "nation").select(col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = (table(spark, sf, "supplier").join(nations, "s_nationkey", "left")
                 .select(col("s_suppkey").alias("l_suppkey"), "n_name"))
    joined = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
              .join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left"))
    return joined.groupBy("o_orderpriority", "p_brand", "n_name").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH s AS (SELECT s_suppkey * 40 AS k FROM supplier), c AS (SELECT c_custkey AS k FROM customer),
 u AS (SELECT k, 'supplier' AS origin FROM s UNION ALL SELECT k, 'customer' FROM c)
SELECT 'all' AS part, k, origin FROM u
UNION ALL SELECT 'distinct', k, NULL FROM (SELECT DISTINCT k FROM u)
UNION ALL SELECT 'difference', k, NULL FROM (SELECT DISTINCT k FROM s WHERE k NOT IN (SELECT k FROM c))
""", name="union_layers")
def union_layers_keys(spark, sf):
    sold = table(spark, sf, "supplier").select((col("s_suppkey") * 40).alias("k"))
    bought = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    stacked = union_layers({"supplier": sold, "customer": bought}, "origin")
    difference = keep_keys(sold.distinct(), bought, "k", negate=True)
    return union_layers({"all": stacked, "distinct": stacked.select("k").distinct(), "difference": difference}, "part")


@query("""
SELECT s_suppkey,
       CASE WHEN abs(v) >= 1000 THEN CAST(CAST(trunc(v / 1000) AS BIGINT) AS VARCHAR) || ',' ||
            lpad(CAST(CAST(abs(v) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END
         AS with_comma,
       '$' || CAST(CAST(round_even(h, 0) AS BIGINT) AS VARCHAR) AS price,
       regexp_replace(CAST(round_even(q, 1) AS VARCHAR), '\\.0$', '') AS plain,
       CASE WHEN length(t) > 24 THEN substr(t, 1, 21) || '...' ELSE t END AS short
FROM (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS v, floor(s_acctbal) / 2 AS h,
             floor(s_acctbal) / 4 AS q,
             CASE WHEN s_nationkey < 12 THEN s_name || ' of nation' ELSE s_name END AS t FROM supplier)
""")
def display_format(spark, sf):
    whole = F.floor("s_acctbal")
    named = F.when(col("s_nationkey") < 12, F.concat("s_name", F.lit(" of nation"))).otherwise(col("s_name"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", comma(whole).alias("with_comma"), dollars(whole / 2, "N/A").alias("price"),
        plain_number(whole / 4, 1).alias("plain"), truncate(named, 24).alias("short"))
