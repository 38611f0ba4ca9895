"""Labels, flags and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions.cleaning import _col


def sentiment_label(score: Column | str, posts: Column | str | None = None,
                    band: float = fixed.SENTIMENT_BAND) -> Column:
    """Positive above the band, Negative below it, else Neutral; no posts is Neutral too."""
    score = _col(score)
    label = F.when(score > band, fixed.POSITIVE).when(score < -band, fixed.NEGATIVE)
    if posts is not None:
        label = (F.when(score.isNull() | (_col(posts) == 0), fixed.NEUTRAL)
                 .when(score > band, fixed.POSITIVE).when(score < -band, fixed.NEGATIVE))
    return label.otherwise(fixed.NEUTRAL)


def post_flag(posts: Column | str, full: int = fixed.FULL_POSTS) -> Column:
    posts = _col(posts)
    return (F.when(posts == 0, fixed.FLAG_NO_POSTS)
            .when(posts < full, fixed.FLAG_FEW_POSTS)
            .otherwise(fixed.FLAG_FULL))


def listing_flag(listings: Column | str) -> Column:
    return F.when(_col(listings) == 0, fixed.FLAG_NO_LISTINGS).otherwise(fixed.FLAG_FULL)


def plain_number(c: Column | str, digits: int = 2) -> Column:
    """Rounded half to even and printed without trailing zeros: 1.2, 0, 3."""
    text = F.bround(_col(c).cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"\.0+$|(\.\d*[1-9])0+$", "$1")


def comma(c: Column | str) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(_col(c), 0)


def dollars(c: Column | str, missing: str) -> Column:
    """``$`` and the price rounded half to even, or a stand-in."""
    value = F.bround(_col(c).cast("double"), 0).cast("long")
    return F.coalesce(F.concat(F.lit("$"), value.cast("string")), F.lit(missing))


def truncate(c: Column | str, width: int = fixed.TRUNCATE_WIDTH) -> Column:
    """At most ``width`` characters, the last three being dots when text was cut."""
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
