"""One complete row per place, its checks and its prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions.display import dollars, plain_number
from placeweave.operators.checks import WARN, Check, no_nulls, row_count
from placeweave.operators.joins import chain_left

AREA = "community_area_number"
SCORE_COLUMNS = ["slug", "mean_sentiment_score", "sd_sentiment_score", "sentiment_label", "data_quality_flag",
                 "post_count", "total_engagement", "bing_pos_ratio", "bing_positive", "bing_negative", "top_words"]
LISTING_COLUMNS = ["slug", "airbnb_listing_count", "airbnb_median_price", "airbnb_avg_rating",
                   "airbnb_data_flag", "airbnb_sentiment_label"]


def master_profile(lookup: DataFrame, business: DataFrame, scores: DataFrame,
                   summaries: DataFrame | None = None, listings: DataFrame | None = None) -> DataFrame:
    """Lookup with everything known about each key; an absent table leaves its columns out."""
    joined = lookup.join(business.drop("name"), [AREA, "slug"], "left")
    parts = [scores.select(*SCORE_COLUMNS), summaries,
             listings.select(*LISTING_COLUMNS) if listings is not None else None]
    return chain_left(joined, parts, "slug")


def master_checks(df: DataFrame, rows: int = fixed.SPINE_ROWS) -> list[Check]:
    needed = [AREA, "slug", "name", "total_active_businesses", "data_quality_flag"]
    if "airbnb_listing_count" in df.columns:
        needed.append("airbnb_listing_count")
    checks = [row_count(rows), *[no_nulls(c) for c in needed]]
    if "ai_summary" in df.columns:
        checks.append(no_nulls("ai_summary", WARN))
    return checks


def business_checks(rows: int = fixed.SPINE_ROWS) -> list[Check]:
    return [row_count(rows), no_nulls(AREA), no_nulls("slug")]


def score_checks(rows: int = fixed.SPINE_ROWS) -> list[Check]:
    return [row_count(rows), no_nulls("sentiment_label"), no_nulls("data_quality_flag")]


def _fill(lines: list[str], values: dict[str, Column]) -> list[Column]:
    """Each template line as a column, ``{field}`` replaced by its value."""
    out = []
    for line in lines:
        parts, rest = [], line
        while "{" in rest:
            before, _, tail = rest.partition("{")
            field, _, rest = tail.partition("}")
            parts += [F.lit(before), values[field]]
        out.append(F.concat(*parts, F.lit(rest)))
    return out


def with_prompt(df: DataFrame, out: str = "prompt") -> DataFrame:
    """Adds the prompt text. Needs the joined business and score columns; the listing block
    needs the listing columns, else it reads as absent."""
    values = {
        "name": F.col("name"),
        "total": F.col("total_active_businesses").cast("string"),
        "categories": F.col("top_3_categories"),
        "diversity": plain_number("business_diversity_index"),
        "label": F.col("sentiment_label"),
        "phrases": F.coalesce("top_words", F.lit("")),
    }
    posts = F.when(F.col("data_quality_flag") == fixed.FLAG_NO_POSTS, F.lit(fixed.PROMPT_NO_POSTS)).otherwise(
        F.concat_ws("\n", *_fill(fixed.PROMPT_POSTS, values)))
    listings = F.lit(fixed.PROMPT_NO_LISTINGS)
    if "airbnb_data_flag" in df.columns:
        values |= {
            "listings": F.col("airbnb_listing_count").cast("string"),
            "price": dollars("airbnb_median_price", fixed.MISSING_PRICE_PROMPT),
            "visitor_phrases": F.coalesce("airbnb_top_words", F.lit("")),
        }
        listings = F.when(F.col("airbnb_data_flag") == fixed.FLAG_NO_LISTINGS, listings).otherwise(
            F.concat_ws("\n", *_fill(fixed.PROMPT_LISTINGS, values)))
    return df.withColumn(out, F.concat_ws(
        "\n", *_fill(fixed.PROMPT_HEAD, values), *_fill(fixed.PROMPT_BUSINESS, values), posts,
        F.lit(fixed.PROMPT_LISTINGS_TITLE), listings, *_fill(fixed.PROMPT_TAIL, values)))


def prompt_table(business: DataFrame, scores: DataFrame, listings: DataFrame | None = None,
                 done: DataFrame | None = None) -> DataFrame:
    """Prompts of the keys that have no text yet."""
    joined = business.join(scores, [AREA, "slug", "name"], "left")
    if listings is not None:
        joined = joined.join(listings.select("slug", "airbnb_listing_count", "airbnb_median_price",
                                             "airbnb_data_flag", "airbnb_top_words"), "slug", "left")
    if done is not None:
        joined = joined.join(done.select("slug"), "slug", "left_anti")
    return with_prompt(joined).select(AREA, "slug", "name", "prompt")
