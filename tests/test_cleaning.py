import random

import pytest
from pyspark.sql import functions as F

from placeweave.functions.cleaning import (
    classify, clean_text, file_stem, make_slug, not_blank, squish, to_int, to_number, to_price)
from placeweave.functions.display import (
    comma, dollars, listing_flag, plain_number, post_flag, sentiment_label, truncate)
from placeweave.functions.tokens import tokens


@pytest.mark.parametrize("text, label", [
    ("Barber Shop", "Food & Beverage"), ("PUBLIC PLACE", "Food & Beverage"), ("Child Care", "Automotive & Transportation"),
    ("Auto Parts", "Retail"), ("Dental", "Health & Personal Care"), ("Roofing", "Construction & Trades"),
    ("Legal", "Professional Services"), ("Tutoring", "Education, Arts & Recreation"), ("Hostel", "Lodging"),
    ("Cold Warehouse", "Wholesale & Industrial"), ("Unknown", "Other"), (None, "Other")])
def test_classify(value, text, label):
    assert value(classify(F.lit(text).cast("string"))) == label


@pytest.mark.parametrize("raw, clean", [
    ("See [my *blog*](http://x.y/z) now", "See [my blog ]( now"), ("[a](/b)", "a"), ("**x** `y` ~z~ #1 > q|r", "x y z 1 q r"),
    ("a  b\n\tc ", "a b c"), ("https://a.b/c d", "d"), ("", ""), (None, None)])
def test_clean(value, raw, clean):
    assert value(clean_text(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize("raw, number", [
    (" 07", 7), ("x", None), ("78", 78), ("7.9", 7), ("", None), (None, None), ("7d", None), ("7f", None), ("1e1", 10)])
def test_to_int(value, raw, number):
    assert value(to_int(F.lit(raw).cast("string"))) == number


def test_numbers(value):
    assert value(to_number(F.lit("41.9x"))) is None
    assert value(to_number(F.lit(" -87.5 "))) == -87.5
    assert value(to_price(F.lit("$1,150.00"))) == 1150.0
    assert value(to_price(F.lit(""))) is None


def test_slugs(value):
    assert value(make_slug(F.lit("O'Hare"))) == "o_hare"
    assert value(make_slug(F.lit("  Near North-Side "))) == "near_north_side"


def test_small_text_functions(value):
    assert value(squish(F.lit(" a \n b "))) == "a b"
    assert value(file_stem(F.lit("/x/y/near_north.txt"))) == "near_north"
    assert value(not_blank(F.lit(""))) is False


@pytest.mark.parametrize("text, words", [
    ("Don't stop, it's 3.5 or 1,000!", ["don't", "stop", "it's", "3.5", "or", "1,000"]),
    ("end.Next 5.great abc1.def", ["end.next", "5", "great", "abc1", "def"]),
    ("snake_case __ _x", ["snake_case", "_x"]), ("note:this and/or co-op", ["note", "this", "and", "or", "co", "op"]),
    ("l’été naïve a.b.c.", ["l’été", "naïve", "a.b.c"]), ("", [])])
def test_tokens(value, text, words):
    assert value(tokens(F.lit(text))) == words


@pytest.mark.parametrize("score, posts, label", [
    (0.051, 1, "Positive"), (0.05, 1, "Neutral"), (-0.051, 1, "Negative"), (0.9, 0, "Neutral"), (None, 3, "Neutral")])
def test_labels(value, score, posts, label):
    assert value(sentiment_label(F.lit(score).cast("double"), F.lit(posts))) == label


@pytest.mark.parametrize("n, flag", [(0, "business_only"), (9, "low_reddit"), (10, "full")])
def test_flags(value, n, flag):
    assert value(post_flag(F.lit(n))) == flag
    assert value(listing_flag(F.lit(n))) == ("no_airbnb" if n == 0 else "full")


def test_display(value):
    assert [value(plain_number(F.lit(x))) for x in (1.2, 0.0, 1.094, 2.0)] == ["1.2", "0", "1.09", "2"]
    assert value(comma(F.lit(77877))) == "77,877"
    assert value(dollars(F.lit(150.5), "N/A")) == "$150"
    assert value(dollars(F.lit(151.5), "N/A")) == "$152"
    assert value(dollars(F.lit(None).cast("double"), "N/A")) == "N/A"
    assert value(truncate(F.lit("x" * 81))) == "x" * 77 + "..."
    assert value(truncate(F.lit("x" * 80))) == "x" * 80


def test_large_numbers_are_printed_in_full(value):
    from pyspark.sql import functions as F

    from placeweave.functions.display import plain_number

    assert [value(plain_number(F.lit(x))) for x in (12345678.9, 1e9, 1.25, 0.0, -3.10, 100.0)] == [
        "12345678.9", "1000000000", "1.25", "0", "-3.1", "100"]


def test_cleaning_is_that_of_its_single_steps(spark):
    """One pass for marks and whitespace, none for URLs and links where there are none; also with spaces of other scripts."""
    rng = random.Random(5)
    signs = ["http://", "https://x", "://", "](", "[", "]", "(", ")", "*", "_", "#", "|", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85",
             "\u00a0", "\u1680", "\u200b", "\u2028", "\u3000", "a", "bc", "é", "\U00010400", "."]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    steps = F.regexp_replace("t", r"(?U)https?://\S+", " ")
    steps = F.regexp_replace(F.regexp_replace(steps, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[*_~`>|#]", " ")
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    both = df.select("t", clean_text("t").alias("a"), plain(steps).alias("b"), squish("t").alias("c"), plain("t").alias("d"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("c").eqNullSafe(F.col("d"))).collect() == []


def test_single_spaces_are_not_replaced(spark, monkeypatch):
    """Nearly all whitespace of a text is spaces that stay; none of them is written anew."""
    replaced = F.regexp_replace
    monkeypatch.setattr(F, "regexp_replace", lambda c, pattern, text: replaced(c, pattern, "+" if text == " " else text))
    df = spark.createDataFrame([("one two  three\nfour five *six* seven",)], "t string")
    assert df.select(squish("t"), clean_text("t")).first()[:] == (
        "one two+three+four five *six* seven", "one two+three+four five+six+seven")
