"""Lenient parsing and text cleaning, all from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double, NULL when it is no number (a Java ``7d`` / ``7f`` is no number either)."""
    text = F.trim(_col(c).cast("string"))
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def to_int(c: Column | str) -> Column:
    """Text to int, fractions truncated, NULL when it is no number."""
    return to_number(c).try_cast("int")


def to_price(c: Column | str) -> Column:
    """``"$1,150.00"`` to 1150.0."""
    return to_number(F.regexp_replace(_col(c).cast("string"), "[$,]", ""))


def _runs(one: str) -> str:
    """Runs of a class of characters, spaces among them, except a space that stands alone: it would be replaced by itself,
    and nearly all are such. One class is asked at each place, so that letters cost one test."""
    return rf"(?U){one}(?:(?<! ){one}*+|{one}++)"


def squish(c: Column | str) -> Column:
    """Every run of whitespace to one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), _runs(r"\s"), " "))


def strip_edges(c: Column | str) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """Drop URLs, unwrap links, drop markup marks, squish. The order matters: a link to a
    web address loses its address first and keeps its bracket.

    Texts without ``://`` hold no URL, and texts without ``](`` no link: a URL leaves a space, which joins none. A mark
    becomes a space and is squished, so marks and whitespace go in one pass."""
    raw = _col(c)
    c = F.when(raw.contains("://"), F.regexp_replace(raw, r"(?U)https?://\S+", " ")).otherwise(raw)
    c = F.when(raw.contains("]("), F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")).otherwise(c)
    return F.trim(F.regexp_replace(c, _runs(r"[*_~`>|#\s]"), " "))


def make_slug(c: Column | str) -> Column:
    """Name to key: lower case, other characters to one underscore, none at the edges."""
    c = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(c, "(^_|_$)", "")


def classify(c: Column | str, rules=None, default: str = fixed.CATEGORY_DEFAULT) -> Column:
    """Label of the first rule whose pattern occurs anywhere in the lower-cased text."""
    rules = fixed.CATEGORY_PATTERNS if rules is None else rules
    text = F.lower(_col(c))
    chain = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def not_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & (c != "")


def file_stem(c: Column | str, extension: str = "txt") -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(_col(c), r"([^/]*)$", 1), rf"\.{extension}$", "")
