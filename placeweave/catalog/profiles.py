"""The three feeds, the master table, its checks and the report feeds, on mapped tables.

Nations are the areas (number, name, slug), orders the licences, documents the posts,
parts the listings and conversations the reviews.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave import fixed
from placeweave.catalog.base import heavy, query, sql_rules, sql_values, sql_words, table
from placeweave.catalog.spatial import literal_edges
from placeweave.catalog.text import (
    _SQL_CLEAN, POLAR, SQL_KEPT, SQL_SCORED, STOPWORDS, VALUED, _polar, _stop, _valued, sql_phrases, sql_tokens)
from placeweave.operators.checks import run_checks
from placeweave.operators.joins import merged_words, union_layers
from placeweave.operators.text import stopword_table
from placeweave.plans import business, feeds, forum, listings, master

# area number -> rectangle of part size (x) and price remainder (y)
AREAS = {n: [[(10 * i, 900), (10 * i + 10, 900), (10 * i + 10, 1400), (10 * i, 1400), (10 * i, 900)]]
         for i, n in enumerate([1, 2, 3, 4])}
AREAS[5] = [[(5, 1000), (15, 1000), (15, 1800), (5, 1800), (5, 1000)]]


def _lookup(spark, sf):
    n = col("n_nationkey")
    return table(spark, sf, "nation").select(
        (n + 1).alias("community_area_number"), col("n_name").alias("name"),
        F.concat(F.lit("src"), n.cast("string")).alias("slug"))


_SQL_LOOKUP = "SELECT n_nationkey + 1 AS community_area_number, n_name AS name, 'src' || n_nationkey AS slug FROM nation"


def _raw_licences(spark, sf):
    people = table(spark, sf, "customer").select(col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_name")
    joined = table(spark, sf, "orders").join(people, "o_custkey")
    area = (col("c_nationkey") + 1).cast("string")
    none = F.lit(None).cast("string")
    columns = {
        "ID": col("o_orderkey").cast("string"), "LICENSE ID": col("o_orderkey").cast("string"),
        "LEGAL NAME": col("c_name"), "DOING BUSINESS AS NAME": none, "ADDRESS": none,
        "COMMUNITY AREA": F.when(col("c_nationkey") == 24, "99").when(
            col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" 0"), area, F.lit(" "))).when(
            col("o_orderpriority") == "5-LOW", "unknown").otherwise(area),
        "COMMUNITY AREA NAME": none, "LICENSE CODE": none,
        "LICENSE DESCRIPTION": F.when(col("o_orderpriority") != "2-HIGH", F.concat("c_mktsegment", F.lit(" licence"))),
        "BUSINESS ACTIVITY ID": none,
        "BUSINESS ACTIVITY": F.when(col("c_mktsegment") == "BUILDING", "Barber shop").when(
            col("c_mktsegment") != "FURNITURE", "Child care"),
        "LICENSE STATUS": F.when(col("o_orderstatus") == "F", "AAC").when(col("o_orderstatus") == "O", "REV"),
        "LICENSE TERM START DATE": none, "LICENSE TERM EXPIRATION DATE": none,
        "LATITUDE": col("o_totalprice").cast("string"), "LONGITUDE": F.lit("x")}
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def _business(spark, sf):
    return business.business_profile(business.active_licences(_raw_licences(spark, sf)), _lookup(spark, sf))


_SQL_LICENCES = f"""
licences AS (
  SELECT c_nationkey + 1 AS area, coalesce(
    CASE WHEN o_orderpriority <> '2-HIGH' THEN c_mktsegment || ' licence' END,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Barber shop' WHEN 'FURNITURE' THEN NULL ELSE 'Child care' END,
    'Unknown') AS d
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND c_nationkey <> 24),
cats AS (SELECT area, {sql_rules('d', fixed.CATEGORY_PATTERNS, 'Other')} AS category, count(*) AS n FROM licences GROUP BY 1, 2),
cat_rank AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, category) AS k FROM cats),
cat_share AS (SELECT *, n / sum(n) OVER (PARTITION BY area) AS p FROM cat_rank),
biz AS (SELECT area, CAST(sum(n) AS BIGINT) AS total, -sum(p * ln(p)) AS h,
          string_agg(category, ' | ' ORDER BY k) FILTER (k <= 3) AS top FROM cat_share GROUP BY 1),
business AS (SELECT l.*, coalesce(total, 0) AS total_active_businesses, coalesce(h, 0.0) AS business_diversity_index,
               coalesce(top, 'No data') AS top_3_categories
             FROM ({_SQL_LOOKUP}) l LEFT JOIN biz ON area = community_area_number)"""


@query(f"""
WITH {_SQL_LICENCES}
SELECT * REPLACE (round(business_diversity_index, 8) AS business_diversity_index) FROM business
""")
def business_profile(spark, sf):
    return _business(spark, sf)["summary"].withColumn(
        "business_diversity_index", F.round("business_diversity_index", 8))


@query(f"""
WITH {_SQL_LICENCES}
SELECT slug, category, n, CAST(k AS INTEGER) AS bar, format('{{:,}}', n) AS label
FROM cat_rank JOIN ({_SQL_LOOKUP}) ON area = community_area_number
""")
def category_bar_feed(spark, sf):
    return feeds.category_bars(_business(spark, sf)["by_category"]).select("slug", "category", "n", "bar", "label")


def _posts(spark, sf):
    return heavy(spark, sf, "documents", "doc_id").select(
        col("source").alias("slug"), col("doc_id").cast("string").alias("post_id"), col("lang").alias("title"),
        col("text").alias("selftext"), F.length("text").alias("score"), F.lit(1).alias("num_comments"))


def _forum(spark, sf):
    clean = forum.clean_posts(_posts(spark, sf)).select(*forum.POST)
    return forum.forum_profile(clean, _lookup(spark, sf), _valued(spark), _polar(spark), _stop(spark))


_SQL_FORUM = f"""
clean AS (SELECT source AS slug, doc_id, lang || ' ' || {_SQL_CLEAN.format('text')} AS full_text, length(text) + 1 AS points
          FROM documents),
clean_ok AS (SELECT * FROM clean WHERE length(trim(full_text)) > 5),
{sql_phrases('clean_ok', 'slug', 'full_text')}, {SQL_SCORED}, {SQL_KEPT},
top AS (SELECT g AS slug, string_agg(word, ', ' ORDER BY k) AS top_words FROM kept WHERE k <= 10 GROUP BY 1),
words AS (SELECT slug, doc_id, word FROM (SELECT slug, doc_id, unnest({sql_tokens('full_text')}) AS word FROM clean_ok)
          WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN {sql_words(STOPWORDS)}),
scored_posts AS (SELECT slug, doc_id, sum(value) / count(*) AS v
                 FROM words JOIN (VALUES {sql_values(VALUED)}) lex(word, value) USING (word) GROUP BY 1, 2),
means AS (SELECT slug, avg(v) AS m, stddev_samp(v) AS s FROM scored_posts GROUP BY 1),
polar AS (SELECT slug, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'negative') AS neg
          FROM words JOIN (VALUES {sql_values(POLAR)}) lex(word, sentiment) USING (word) GROUP BY 1),
sizes AS (SELECT slug, count(*) AS c, CAST(sum(points) AS BIGINT) AS e FROM clean_ok GROUP BY 1),
forum AS (SELECT l.*, coalesce(m, 0.0) AS mean_sentiment_score, s AS sd_sentiment_score,
    pos / (pos + neg + 1) AS bing_pos_ratio, pos AS bing_positive, neg AS bing_negative,
    coalesce(c, 0) AS post_count, e AS total_engagement, top_words,
    CASE WHEN c IS NULL THEN 'Neutral' WHEN m > .05 THEN 'Positive' WHEN m < -.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
    CASE WHEN c IS NULL THEN 'business_only' WHEN c < 10 THEN 'low_reddit' ELSE 'full' END AS data_quality_flag
  FROM ({_SQL_LOOKUP}) l LEFT JOIN means USING (slug) LEFT JOIN polar USING (slug) LEFT JOIN sizes USING (slug)
  LEFT JOIN top USING (slug))"""
_FORUM_ROUND = ["mean_sentiment_score", "sd_sentiment_score", "bing_pos_ratio"]


def _rounded(df, columns, digits=8):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _sql_round(columns):
    return "* REPLACE (" + ", ".join(f"round({c}, 8) AS {c}" for c in columns) + ")"


@query(f"WITH {_SQL_FORUM} SELECT {_sql_round(_FORUM_ROUND)} FROM forum")
def forum_profile(spark, sf):
    return _rounded(_forum(spark, sf)["scores"], _FORUM_ROUND)


def _listings(spark, sf):
    """Two snapshots: the later one lacks promotions and costs a dollar more."""
    parts = table(spark, sf, "part")
    base = parts.select(
        col("p_partkey").alias("id"), col("p_retailprice").alias("latitude"), col("p_size").cast("double").alias("longitude"),
        col("p_type").alias("room_type"),
        F.when(col("p_brand") != "Brand#7", col("p_size") / 10).alias("reviews_per_month"))

    def priced(more, date):
        text = F.concat(F.lit("$"), F.format_number(F.floor(col("latitude")) + more, 2))
        return base.withColumn("price", text).withColumn("snapshot_date", F.lit(date))

    return priced(0, "2025-06-17").unionByName(priced(1, "2025-09-22").filter(col("room_type") != "PROMO"))


def _reviews(spark, sf):
    """Every turn as a review of the part with the number of its conversation; the later
    snapshot repeats each with other words."""
    turns = heavy(spark, sf, "conversations", "conv_id").select(
        col("conv_id").alias("listing_id"), F.lit("2025-01-01").cast("date").alias("date"),
        col("turn").alias("reviewer_id"), col("text").alias("comments"))
    return turns.withColumn("snapshot_date", F.lit("2025-06-17")).unionByName(
        turns.withColumn("comments", F.lit("best best best best")).withColumn("snapshot_date", F.lit("2025-09-22")))


def _areas(spark):
    return literal_edges(spark, AREAS, "community_area_number").withColumn(
        "community_area_number", col("community_area_number").cast("int"))


def _placed(spark, sf):
    return listings.place_listings(listings.latest_listings(_listings(spark, sf)), _areas(spark), _lookup(spark, sf), 50.0)


def _visitor_stop(spark):
    return merged_words(_stop(spark), stopword_table(spark, fixed.HOSPITALITY_STOPWORDS, fixed.HOSPITALITY_LEXICON))


def _stays(spark, sf):
    return listings.listing_profile(_listings(spark, sf), _reviews(spark, sf), _areas(spark), _lookup(spark, sf),
                                    _valued(spark), _stop(spark), _visitor_stop(spark), cell=50.0)


_SQL_PLACED = f"""
rects(area, x0, x1, y0, y1) AS (VALUES (1, 0, 10, 900, 1400), (2, 10, 20, 900, 1400), (3, 20, 30, 900, 1400),
                                       (4, 30, 40, 900, 1400), (5, 5, 15, 1000, 1800)),
placed AS (SELECT p_partkey AS id, area, 'src' || (area - 1) AS slug, p_type AS room_type,
    floor(p_retailprice) + CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END AS price,
    CASE WHEN p_brand <> 'Brand#7' THEN p_size / 10 END AS rpm
  FROM part JOIN rects ON p_size > x0 AND p_size < x1 AND p_retailprice > y0 AND p_retailprice < y1)"""
_SQL_STAYS = f"""
{_SQL_PLACED},
stats AS (SELECT area, slug, count(*) AS n, CAST(median(price) AS DOUBLE) AS med, avg(rpm) AS rpm FROM placed GROUP BY 1, 2),
reviewed AS (SELECT slug, conv_id, turn, {_SQL_CLEAN.format('text')} AS t
             FROM conversations JOIN placed ON conv_id = id WHERE length(trim(text)) > 10),
review_words AS (SELECT slug, conv_id, turn, word FROM (
            SELECT slug, conv_id, turn, unnest({sql_tokens('t')}) AS word FROM reviewed WHERE length(t) > 5)
          WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN {sql_words(STOPWORDS)}),
review_scores AS (SELECT slug, conv_id, turn, sum(value) / count(*) AS v FROM review_words
          JOIN (VALUES {sql_values(VALUED)}) lex(word, value) USING (word) GROUP BY ALL),
review_means AS (SELECT slug, avg(v) AS m FROM review_scores GROUP BY 1),
stays AS (SELECT community_area_number, slug, l.name, coalesce(n, 0) AS airbnb_listing_count, med AS airbnb_median_price,
    rpm AS airbnb_avg_rating, CASE WHEN n IS NULL THEN 'no_airbnb' ELSE 'full' END AS airbnb_data_flag,
    m AS airbnb_mean_sentiment,
    CASE WHEN m > .05 THEN 'Positive' WHEN m < -.05 THEN 'Negative' ELSE 'Neutral' END AS airbnb_sentiment_label
  FROM ({_SQL_LOOKUP}) l LEFT JOIN stats USING (slug) LEFT JOIN review_means USING (slug))"""
_STAY_ROUND = ["airbnb_median_price", "airbnb_avg_rating", "airbnb_mean_sentiment"]


@query(f"WITH {_SQL_STAYS} SELECT {_sql_round(_STAY_ROUND)} FROM stays")
def listing_profile(spark, sf):
    return _rounded(_stays(spark, sf)["summary"], _STAY_ROUND).drop(
        "airbnb_avg_reviews_per_month", "airbnb_top_words")


_SQL_VISITOR = f"""
{_SQL_PLACED},
reviewed AS (SELECT slug, {_SQL_CLEAN.format('text')} AS t
             FROM conversations JOIN placed ON conv_id = id WHERE length(trim(text)) > 10),
reviewed_ok AS (SELECT * FROM reviewed WHERE length(t) > 5),
{sql_phrases('reviewed_ok', 'slug', 't')}, {SQL_SCORED}, {SQL_KEPT}"""


@query(f"""
WITH {_SQL_VISITOR}
SELECT g AS slug, CAST(k AS INTEGER) AS rank, word, n, round(1e6 * tf * idf, 6) AS score FROM kept WHERE k <= 10
""")
def visitor_phrases(spark, sf):
    reviews = listings.placed_reviews(_reviews(spark, sf), _placed(spark, sf))
    return listings.visitor_phrases(reviews, _visitor_stop(spark)).select(
        "slug", "rank", "word", "n", F.round(col("tf_idf") * 1e6, 6).alias("score"))


@query(f"""
WITH {_SQL_PLACED}
SELECT slug, 'NATION_' || (area - 1) AS neighborhood_name, room_type, count(*) AS n_listings FROM placed GROUP BY ALL
""")
def room_types(spark, sf):
    return listings.room_types(_placed(spark, sf))


def _summaries(spark, sf):
    """Texts exist for the areas of the first three regions."""
    return table(spark, sf, "nation").filter(col("n_regionkey") < 3).select(
        F.concat(F.lit("src"), col("n_nationkey").cast("string")).alias("slug"),
        F.concat(F.lit("Profile of "), "n_name").alias("ai_summary"))


_SQL_SUMMARIES = ("SELECT 'src' || n_nationkey AS slug, 'Profile of ' || n_name AS ai_summary FROM nation "
                  "WHERE n_regionkey < 3")


def _master(spark, sf):
    return master.master_profile(_lookup(spark, sf), _business(spark, sf)["summary"], _forum(spark, sf)["scores"],
                                 _summaries(spark, sf), _stays(spark, sf)["summary"])


_SQL_MASTER = f"""
{_SQL_LICENCES}, {_SQL_FORUM}, {_SQL_STAYS},
master AS (SELECT business.*, mean_sentiment_score, sd_sentiment_score, sentiment_label, data_quality_flag, post_count,
    total_engagement, bing_pos_ratio, bing_positive, bing_negative, top_words, ai_summary, airbnb_listing_count,
    airbnb_median_price, airbnb_avg_rating, airbnb_data_flag, airbnb_sentiment_label
  FROM business JOIN forum USING (slug) JOIN stays USING (slug) LEFT JOIN ({_SQL_SUMMARIES}) USING (slug))"""
_MASTER_ROUND = ["business_diversity_index", *_FORUM_ROUND, "airbnb_median_price", "airbnb_avg_rating"]


@query(f"WITH {_SQL_MASTER} SELECT {_sql_round(_MASTER_ROUND)} FROM master")
def master_profile(spark, sf):
    return _rounded(_master(spark, sf), _MASTER_ROUND)


@query(f"""
WITH {_SQL_MASTER},
c AS (SELECT count(*) AS n, count(*) FILTER (ai_summary IS NULL) AS missing FROM master)
SELECT 'row_count' AS "check", 'fail' AS severity, CAST(25 AS BIGINT) AS expected, n AS observed, n = 25 AS passed FROM c
UNION ALL SELECT 'no_null_' || name, 'fail', 0, nulls, nulls = 0 FROM (
  SELECT unnest(['community_area_number', 'slug', 'name', 'total_active_businesses', 'data_quality_flag', 'airbnb_listing_count']) AS name,
         unnest([count(*) - count(community_area_number), count(*) - count(slug), count(*) - count(name),
                 count(*) - count(total_active_businesses), count(*) - count(data_quality_flag),
                 count(*) - count(airbnb_listing_count)]) AS nulls FROM master)
UNION ALL SELECT 'no_null_ai_summary', 'warn', 0, missing, missing = 0 FROM c
""")
def quality_report(spark, sf):
    profile = _master(spark, sf)
    return run_checks(profile, master.master_checks(profile, rows=25))


@query(f"""
WITH {_SQL_LICENCES}, {_SQL_FORUM}
SELECT f.community_area_number AS region, round(mean_sentiment_score, 8) AS mean_sentiment_score, name,
  name || ' (' || regexp_replace(CAST(round_even(mean_sentiment_score, 2) AS VARCHAR), '\\.0$', '') || ')' AS label
FROM forum f WHERE community_area_number <> 3
UNION ALL SELECT 3, NULL, NULL, 'NA (NA)' FROM nation WHERE n_nationkey = 2
""")
def map_feed(spark, sf):
    """Every nation as a region; one has no measure and stays."""
    scores = _forum(spark, sf)["scores"].filter(col("community_area_number") != 3)
    regions = _lookup(spark, sf).select("community_area_number")
    return feeds.map_feed(regions, scores).select(
        col("community_area_number").alias("region"), F.round("mean_sentiment_score", 8).alias("mean_sentiment_score"),
        "name", "label")


@query(f"""
WITH {_SQL_MASTER}
SELECT slug, name, coalesce(ai_summary, '{fixed.MISSING_SUMMARY}') AS summary,
  format('{{:,}}', total_active_businesses) AS businesses,
  regexp_replace(CAST(round_even(business_diversity_index, 2) AS VARCHAR), '\\.0$', '') AS diversity,
  format('{{:,}}', airbnb_listing_count) AS listings,
  coalesce('$' || CAST(round_even(airbnb_median_price, 0) AS BIGINT), '—') AS price,
  sentiment_label AS badge, lower(sentiment_label) AS badge_class,
  concat_ws('; ', CASE data_quality_flag WHEN 'low_reddit' THEN '{fixed.NOTICE_FEW_POSTS}'
                  WHEN 'business_only' THEN '{fixed.NOTICE_NO_POSTS}' END,
            CASE airbnb_data_flag WHEN 'no_airbnb' THEN '{fixed.NOTICE_NO_LISTINGS}' END) AS notices,
  data_quality_flag <> 'business_only' AS show_resident_phrases, airbnb_data_flag <> 'no_airbnb' AS show_visitor_phrases
FROM master
""")
def card_feed(spark, sf):
    return feeds.card_feed(_master(spark, sf))


@query(f"""
WITH {_SQL_LICENCES}, {_SQL_FORUM},
m AS (SELECT business.*, sentiment_label FROM business JOIN forum USING (slug))
SELECT 'label' AS part, sentiment_label AS key, count(*) AS n, CAST(NULL AS VARCHAR) AS label FROM m GROUP BY 2
UNION ALL SELECT 'places', NULL, count(*), NULL FROM m
UNION ALL SELECT 'businesses', NULL, CAST(sum(total_active_businesses) AS BIGINT),
                 format('{{:,}}', CAST(sum(total_active_businesses) AS BIGINT)) FROM m
UNION ALL SELECT 'top', slug, total_active_businesses, format('{{:,}}', total_active_businesses) FROM m
QUALIFY rank() OVER (ORDER BY total_active_businesses DESC) <= 10
""")
def overview_feed(spark, sf):
    profile = _business(spark, sf)["summary"].join(
        _forum(spark, sf)["scores"].select("slug", "sentiment_label"), "slug")
    none = F.lit(None).cast("string")
    total = feeds.totals(profile)
    labels = feeds.label_counts(profile).select(
        F.lit("label").alias("part"), col("sentiment_label").alias("key"), "n", none.alias("label"))
    places = total.select(F.lit("places").alias("part"), none.alias("key"), col("places").alias("n"), none.alias("label"))
    counts = total.select(F.lit("businesses").alias("part"), none.alias("key"), col("businesses").alias("n"),
                          col("businesses_text").alias("label"))
    top = feeds.overview_top(profile).select(
        F.lit("top").alias("part"), col("slug").alias("key"), col("total_active_businesses").alias("n"), "label")
    return labels.unionByName(places).unionByName(counts).unionByName(top)


_SQL_PROMPT_FIELDS = {
    "name": "name", "total": "total_active_businesses", "categories": "top_3_categories", "label": "sentiment_label",
    "diversity": "regexp_replace(CAST(round_even(business_diversity_index, 2) AS VARCHAR), '\\.0$', '')",
    "phrases": "coalesce(top_words, '')", "listings": "airbnb_listing_count",
    "price": f"coalesce('$' || CAST(round_even(airbnb_median_price, 0) AS BIGINT), '{fixed.MISSING_PRICE_PROMPT}')",
    "visitor_phrases": "coalesce(v.words, '')"}


def _sql_lines(lines):
    quoted = ", ".join("'" + line.replace("'", "''") + "'" for line in lines)
    for field, expression in _SQL_PROMPT_FIELDS.items():
        quoted = quoted.replace("{" + field + "}", f"' || {expression} || '")
    return quoted


@query(f"""
WITH {_SQL_MASTER}
SELECT community_area_number, slug, name, concat_ws(chr(10),
  {_sql_lines(fixed.PROMPT_HEAD + fixed.PROMPT_BUSINESS)},
  CASE WHEN data_quality_flag = '{fixed.FLAG_NO_POSTS}' THEN '{fixed.PROMPT_NO_POSTS}'
       ELSE concat_ws(chr(10), {_sql_lines(fixed.PROMPT_POSTS)}) END,
  '{fixed.PROMPT_LISTINGS_TITLE}',
  CASE WHEN airbnb_data_flag = '{fixed.FLAG_NO_LISTINGS}' THEN '{fixed.PROMPT_NO_LISTINGS}'
       ELSE concat_ws(chr(10), {_sql_lines(fixed.PROMPT_LISTINGS)}) END,
  {_sql_lines(fixed.PROMPT_TAIL)}) AS prompt
FROM master LEFT JOIN (WITH {_SQL_VISITOR}
  SELECT g, string_agg(word, ', ' ORDER BY k) AS words FROM kept WHERE k <= 10 GROUP BY 1) v ON v.g = slug
WHERE ai_summary IS NULL
""")
def prompt_table(spark, sf):
    """Prompts of the areas that have no text yet."""
    return master.prompt_table(_business(spark, sf)["summary"], _forum(spark, sf)["scores"],
                               _stays(spark, sf)["summary"], _summaries(spark, sf))


@query("""
SELECT 'raw' AS stage, count(*) AS n FROM lineitem
UNION ALL SELECT 'valid', count(*) FILTER (l_discount > 0) FROM lineitem
UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0)
UNION ALL SELECT 'dropped', count(*) FILTER (NOT l_discount > 0) FROM lineitem
""")
def stage_totals(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    first = lines.agg(F.count("*").alias("raw"), F.count_if(col("l_discount") > 0).alias("valid"),
                      F.count_if(~(col("l_discount") > 0)).alias("dropped"))
    unique = (lines.filter(col("l_discount") > 0).select("l_orderkey", "l_partkey").distinct()
              .agg(F.count("*").alias("distinct")))

    def rows(df, *names):
        return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), col(n).alias("n")) for n in names])))

    return rows(first, "raw", "valid", "dropped").unionByName(rows(unique, "distinct"))


@query(f"""
SELECT 'subset' AS part, * FROM (SELECT * FROM ({_SQL_LOOKUP}) ORDER BY community_area_number LIMIT 10)
UNION ALL SELECT 'all', * FROM ({_SQL_LOOKUP})
""")
def first_places(spark, sf):
    """The report on the first ten places, and on all of them when the number is no true subset."""
    lookup = _lookup(spark, sf)
    return union_layers({"subset": feeds.subset(lookup, 10, rows=25), "all": feeds.subset(lookup, 0, rows=25)}, "part")
