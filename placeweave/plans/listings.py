"""Listings and reviews: areas, prices, visitor sentiment and visitor phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from placeweave import fixed
from placeweave.functions.cleaning import clean_text, strip_edges, to_price
from placeweave.functions.display import listing_flag, sentiment_label
from placeweave.operators.compute import computed_once
from placeweave.operators.joins import chain_left, complete_spine
from placeweave.operators.ranking import earliest_per_key, latest_per_key
from placeweave.operators.spatial import points_in_areas
from placeweave.operators.stats import with_median
from placeweave.operators.text import lexicon_hits, phrase_string, post_sentiment, top_phrases
from placeweave.session import cut_lineage

AREA = "community_area_number"
CELL = 0.005
REVIEW = ["listing_id", "date", "reviewer_id"]


def latest_listings(snapshots: DataFrame) -> DataFrame:
    """One row per listing, from the newest snapshot, with its price as a number. The order ends in a
    hash of the row, so that the survivor of equal ones is fixed."""
    priced = snapshots.withColumn("price_num", to_price("price"))
    named = ["latitude", "longitude", "price", "room_type", "reviews_per_month"]
    every = F.xxhash64(*[f.name for f in priced.schema if not isinstance(f.dataType, MapType)])
    return latest_per_key(priced, ["id"], "snapshot_date", [*[c for c in named if c in priced.columns], every])


def place_listings(listings: DataFrame, edges: DataFrame, lookup: DataFrame, cell: float = CELL) -> DataFrame:
    """Listings inside an area, with its slug and name."""
    placed = points_in_areas(listings, edges, "longitude", "latitude", AREA, cell)
    return placed.join(lookup.select(AREA, "slug", F.col("name").alias("neighborhood_name")), AREA, "left")


def listing_stats(placed: DataFrame) -> DataFrame:
    """Count, exact median price and mean of reviews per month. The mean's name is historic;
    ``airbnb_avg_reviews_per_month`` carries the same number under a fitting one."""
    stats = with_median(placed, [AREA, "slug", "neighborhood_name"], "price_num", "airbnb_median_price", [
        F.count("*").alias("airbnb_listing_count"), F.avg("reviews_per_month").alias("airbnb_avg_rating")])
    return stats.withColumn("airbnb_avg_reviews_per_month", F.col("airbnb_avg_rating"))


def placed_reviews(snapshots: DataFrame, placed: DataFrame) -> DataFrame:
    """Each review once, from the oldest snapshot, with the slug of its listing; cleaned. Reviews of
    listings that were not placed go first, before any text is ranked."""
    areas = placed.select(F.col("id").alias("listing_id"), AREA, "slug").distinct()
    ours = snapshots.select(*REVIEW, "snapshot_date", "comments").join(areas.select("listing_id"), "listing_id", "left_semi")
    unique = earliest_per_key(ours, REVIEW, "snapshot_date", [F.asc_nulls_last("comments")])
    long_enough = F.length(strip_edges("comments")) > fixed.MIN_REVIEW_CHARS
    joined = unique.filter(long_enough).join(areas, "listing_id")
    cleaned = computed_once(joined, text_clean=clean_text("comments"))
    return cleaned.filter(F.length("text_clean") > fixed.MIN_CLEAN_CHARS).select(*REVIEW, AREA, "slug", "text_clean")


def review_sentiment(reviews: DataFrame, valued: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    hits = lexicon_hits(reviews, ["slug", *REVIEW], "text_clean", valued, stopwords)
    mean = (post_sentiment(hits, ["slug"], REVIEW).groupBy("slug")
            .agg(F.avg("post_norm").alias("airbnb_mean_sentiment")))
    return mean.withColumn("airbnb_sentiment_label", sentiment_label("airbnb_mean_sentiment"))


def room_types(placed: DataFrame) -> DataFrame:
    return placed.groupBy("slug", "neighborhood_name", "room_type").agg(F.count("*").alias("n_listings"))


def visitor_phrases(reviews: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    return top_phrases(reviews, "slug", "text_clean", stopwords)


def listing_summary(placed: DataFrame, lookup: DataFrame, sentiment: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row per lookup area, with flag and labels filled in."""
    base = complete_spine(lookup.select(AREA, "slug", "name"), listing_stats(placed).drop("neighborhood_name"),
                          [AREA, "slug"], {"airbnb_listing_count": 0})
    base = base.withColumn("airbnb_data_flag", listing_flag("airbnb_listing_count"))
    summary = chain_left(base, [sentiment, phrase_string(phrases, "slug", "airbnb_top_words")], "slug")
    return summary.withColumn("airbnb_sentiment_label", F.coalesce("airbnb_sentiment_label", F.lit(fixed.NEUTRAL)))


def listing_profile(listings: DataFrame, reviews: DataFrame, edges: DataFrame, lookup: DataFrame,
                    valued: DataFrame, stopwords: DataFrame | None, phrase_stopwords: DataFrame | None,
                    cell: float = CELL, count: Callable[[DataFrame, str], DataFrame] = lambda df, step: df) -> dict[str, DataFrame]:
    """``summary``: one row per lookup area; ``by_room_type``; ``phrases``. The hospitality words
    belong in ``phrase_stopwords`` only. Placed listings and cleaned reviews are each used
    several times, so they are written once. ``count`` is told the rows of each step, as an ``Accounting`` takes them."""
    unique = count(latest_listings(count(listings, "listings raw")), "listings unique")
    placed = cut_lineage(count(place_listings(unique, edges, lookup, cell), "listings placed"), "placed")
    clean = cut_lineage(count(placed_reviews(count(reviews, "reviews raw"), placed), "reviews kept"), "reviews")
    phrases = cut_lineage(visitor_phrases(clean, phrase_stopwords), "phrases")
    summary = listing_summary(placed, lookup, review_sentiment(clean, valued, stopwords), phrases)
    return {"summary": summary, "by_room_type": room_types(placed), "phrases": phrases}
