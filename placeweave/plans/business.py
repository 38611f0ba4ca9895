"""Registrations: active ones, their categories, and a profile per area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions.cleaning import classify, not_blank, to_int, to_number
from placeweave.operators.compute import computed_once
from placeweave.operators.joins import complete_spine
from placeweave.operators.ranking import ordered_join, top_n
from placeweave.operators.stats import diversity
from placeweave.sources.schemas import LICENCE_COLUMNS

AREA = "community_area_number"


def active_licences(raw: DataFrame, status: str = fixed.ACTIVE_STATUS) -> DataFrame:
    """Rows with the active status, columns renamed, coordinates parsed leniently."""
    number = {"latitude", "longitude"}
    return raw.filter(F.col("LICENSE STATUS") == status).select(*[
        (to_number(f"`{old}`") if new in number else F.col(f"`{old}`")).alias(new)
        for old, new in LICENCE_COLUMNS])


def in_known_area(df: DataFrame, column: str = "community_area", out: str = AREA,
                  valid: tuple[int, int] | None = fixed.AREA_RANGE) -> DataFrame:
    """Rows whose area text is a number in range; spaces and leading zeros are fine. Without a
    range any number will do."""
    numbered = computed_once(df.filter(not_blank(column)), **{out: to_int(column)})
    return numbered.filter(F.col(out).isNotNull() if valid is None else F.col(out).between(*valid))


def licence_counts(licences: DataFrame, rules=None, valid: tuple[int, int] | None = fixed.AREA_RANGE) -> DataFrame:
    """Licences per known area and category. Equal texts of area and description (or its default) are counted first, in the
    map tasks already, so that numbers are read and patterns asked once per pair of texts and not once per licence."""
    described = F.coalesce("license_description", "business_activity", F.lit(fixed.DESCRIPTION_DEFAULT))
    texts = licences.groupBy("community_area", described.alias("license_description")).agg(F.count("*").alias("_n"))
    known = in_known_area(texts, valid=valid).withColumn("category", classify("license_description", rules))
    return known.groupBy(AREA, "category").agg(F.sum("_n").alias("n"))


def business_profile(licences: DataFrame, lookup: DataFrame, rules=None,
                     valid: tuple[int, int] | None = fixed.AREA_RANGE) -> dict[str, DataFrame]:
    """``summary``: one row per lookup area; ``by_category``: counts per area and category."""
    counts = licence_counts(licences, rules, valid)
    leaders = top_n(counts, [AREA], [F.desc("n"), "category"], fixed.TOP_CATEGORIES, rank="rank")
    leaders = ordered_join(leaders, [AREA], "category", "rank", "top_3_categories", fixed.CATEGORY_SEPARATOR)
    index = diversity(counts, [AREA], "n", "total_active_businesses", "business_diversity_index")
    summary = complete_spine(
        lookup.select(AREA, "name", "slug"), index.join(leaders, AREA, "left"), AREA,
        {"total_active_businesses": 0, "business_diversity_index": 0.0,
         "top_3_categories": fixed.NO_CATEGORIES})
    by_category = counts.join(lookup.select(AREA, "slug"), AREA, "left")
    return {"summary": summary, "by_category": by_category}
