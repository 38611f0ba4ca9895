"""Tables ready for a map, cards, bars and an overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import fixed
from placeweave.functions.display import comma, dollars, plain_number
from placeweave.operators.ranking import global_top_ties, top_n


def map_feed(regions: DataFrame, profile: DataFrame, key: str = "community_area_number",
             measure: str = "mean_sentiment_score") -> DataFrame:
    """Every region with its measure and the label ``name (0.12)``; a region without one is kept."""
    label = F.concat(F.coalesce("name", F.lit("NA")), F.lit(" ("),
                     F.coalesce(plain_number(measure), F.lit("NA")), F.lit(")"))
    return regions.join(profile.select(key, measure, "name"), key, "left").withColumn("label", label)


def card_feed(profile: DataFrame) -> DataFrame:
    """Formatted figures, badge class and notices of each place."""
    has = "airbnb_listing_count" in profile.columns
    flag = F.col("airbnb_data_flag") if has else F.lit(fixed.FLAG_NO_LISTINGS)
    dash = F.lit(fixed.MISSING_PRICE_CARD)
    summary = F.col("ai_summary") if "ai_summary" in profile.columns else F.lit(None).cast("string")
    notices = F.concat_ws(
        "; ", F.when(F.col("data_quality_flag") == fixed.FLAG_FEW_POSTS, fixed.NOTICE_FEW_POSTS),
        F.when(F.col("data_quality_flag") == fixed.FLAG_NO_POSTS, fixed.NOTICE_NO_POSTS),
        F.when((flag == fixed.FLAG_NO_LISTINGS) & F.lit(has), fixed.NOTICE_NO_LISTINGS))
    return profile.select(
        "slug", "name", F.coalesce(summary, F.lit(fixed.MISSING_SUMMARY)).alias("summary"),
        comma("total_active_businesses").alias("businesses"),
        plain_number("business_diversity_index").alias("diversity"),
        (comma("airbnb_listing_count") if has else dash).alias("listings"),
        (dollars("airbnb_median_price", fixed.MISSING_PRICE_CARD) if has else dash).alias("price"),
        F.col("sentiment_label").alias("badge"), F.lower("sentiment_label").alias("badge_class"),
        notices.alias("notices"),
        (F.col("data_quality_flag") != fixed.FLAG_NO_POSTS).alias("show_resident_phrases"),
        (flag != fixed.FLAG_NO_LISTINGS).alias("show_visitor_phrases"))


def label_counts(profile: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return profile.groupBy(label).agg(F.count("*").alias("n"))


def totals(profile: DataFrame) -> DataFrame:
    """Number of places and of active businesses, plain and with commas."""
    out = profile.agg(F.count("*").alias("places"), F.sum("total_active_businesses").alias("businesses"))
    return out.withColumn("businesses_text", comma("businesses"))


def overview_top(profile: DataFrame, n: int = fixed.OVERVIEW_ROWS) -> DataFrame:
    """The n places with most businesses, ties kept, with label text."""
    best = global_top_ties(profile, "total_active_businesses", n)
    return best.select("slug", "name", "total_active_businesses", "sentiment_label",
                       comma("total_active_businesses").alias("label"))


def category_bars(counts: DataFrame, key: str = "slug") -> DataFrame:
    """Categories of each key by size, with their order and label."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), "category")
    return counts.withColumn("bar", F.row_number().over(order)).withColumn("label", comma("n"))


def phrase_bars(phrases: DataFrame, profile: DataFrame, key: str = "slug", flag: str = "data_quality_flag",
                hidden: str = fixed.FLAG_NO_POSTS, n: int = fixed.KEPT_PHRASES) -> DataFrame:
    """Top phrases of each key whose feed is shown at all."""
    shown = profile.filter(F.col(flag) != hidden).select(key)
    bars = top_n(phrases.drop("rank"), [key], [F.desc("tf_idf"), "word"], n, rank="bar")
    return bars.join(shown, key, "left_semi").select(key, "bar", "word", "tf_idf")


def subset(profile: DataFrame, n: int, order: str = "community_area_number",
           rows: int = fixed.SPINE_ROWS) -> DataFrame:
    """The first n places, only when n is a true subset."""
    return profile.orderBy(order).limit(n) if 0 < n < rows else profile


def one_place(table: DataFrame, slug: str) -> DataFrame:
    return table.filter(F.col("slug") == slug)
