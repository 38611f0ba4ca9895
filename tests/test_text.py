import random
import re

import pytest
from pyspark.sql import functions as F

from placeweave.functions.tokens import _SHAPED, shaped_tokens, tokens
from placeweave.operators import text as ops
from placeweave.operators.joins import merged_words
from placeweave.plans import forum


@pytest.fixture(scope="module")
def stop(spark):
    return ops.stopword_table(spark, ["and", "the", "great"], "test")


def grams(df):
    return sorted(r.word for r in df.collect())


def test_a_stopword_breaks_a_phrase(spark, stop):
    df = spark.createDataFrame([("s", "coffee and shop")], "slug string, t string")
    assert grams(ops.ngrams(df, ["slug"], "t", stop)) == []
    df = spark.createDataFrame([("s", "Wicker Park coffee, the best coffee shop in x town")], "slug string, t string")
    assert grams(ops.ngrams(df, ["slug"], "t", stop)) == [
        "best coffee", "best coffee shop", "coffee shop", "park coffee", "wicker park", "wicker park coffee"]


def test_any_stopword_table_gives_the_same_phrases(spark, stop):
    df = spark.createDataFrame([("s", "one great two three the four five six and seven eight"), ("s", "ab cd"), ("t", "")],
                               "slug string, t string")
    want = grams(ops.ngrams(df, ["slug"], "t", stop))
    assert want == ["five six", "four five", "four five six", "seven eight", "two three"]
    unmatched = spark.range(30_000).selectExpr("concat('zz', id) AS word", "'x' AS lexicon")
    null = spark.createDataFrame([(None, "x")], "word string, lexicon string")
    for more in (unmatched, null, stop):
        assert grams(ops.ngrams(df, ["slug"], "t", stop.unionByName(more))) == want
    every = grams(ops.ngrams(df, ["slug"], "t"))
    for none in (null, stop.filter("false")):
        assert grams(ops.ngrams(df, ["slug"], "t", none)) == every


def test_sentiment_counts_matched_words_only(spark, stop):
    docs = spark.createDataFrame([("s", 1, "good bad table great"), ("s", 2, "good Good day"), ("t", 3, "nothing here")],
                                 "slug string, id int, t string")
    lexicon = spark.createDataFrame([("good", 3), ("bad", -3), ("great", 5), ("ok", 9)], "word string, value int")
    hits = ops.lexicon_hits(docs, ["slug", "id"], "t", lexicon, stop)
    got = {r.id: (r.post_value, r.word_count, r.post_norm) for r in ops.post_sentiment(hits, ["slug"], ["id"]).collect()}
    assert got == {1: (0, 2, 0.0), 2: (6, 2, 3.0)}


def test_a_word_listed_twice_counts_twice(spark):
    docs = spark.createDataFrame([("s", "fine fine")], "slug string, t string")
    lexicon = spark.createDataFrame([("fine", 1), ("fine", 2)], "word string, value int")
    assert ops.lexicon_hits(docs, ["slug"], "t", lexicon).count() == 4


def test_two_lexicons_keep_null_polarity(spark):
    docs = spark.createDataFrame([("a", 1, "good good poor"), ("b", 2, "good")], "slug string, id int, t string")
    valued = spark.createDataFrame([("good", 2)], "word string, value int")
    polar = spark.createDataFrame([("poor", "negative")], "word string, sentiment string")
    got = {r.slug: r for r in ops.two_lexicon_scores(docs, "slug", ["id"], "t", valued, polar).collect()}
    assert (got["a"].bing_positive, got["a"].bing_negative, got["a"].bing_pos_ratio) == (0, 1, 0.0)
    assert got["b"].bing_positive is None and got["b"].bing_pos_ratio is None
    assert got["a"].mean_sentiment_score == 2 and got["a"].sd_sentiment_score is None


def test_phrases(spark):
    """A bigram inside any candidate trigram goes whatever its rank; containment is by characters."""
    texts = ["snow tow zones", "lake view", "x lake view", "smart fairs now", "art fair"]
    docs = spark.createDataFrame([("a", t) for t in texts] + [("b", "other words here")], "slug string, t string")
    counts = ops.phrase_counts(ops.ngrams(docs, ["slug"], "t"), "slug")
    kept = ops.distinctive_phrases(counts, "slug")
    a = [r.word for r in kept.filter("slug = 'a'").orderBy("rank").collect()]
    assert a[0] == "lake view"
    assert a == ["lake view", "smart fairs now", "snow tow zones"]
    three = [w for w in a if w.count(" ") == 2]
    assert not [w for w in a if w.count(" ") == 1 and any(w in t for t in three)]
    share = ops.tf_idf(counts, "slug").groupBy("slug").agg(F.round(F.sum("tf"), 9).alias("s"))
    assert {r.s for r in share.collect()} == {1.0}
    assert ops.phrase_string(kept.filter("slug = 'a'"), "slug").first().top_words == ", ".join(a)


def test_one_text_scan_for_phrases(spark, tmp_path):
    spark.createDataFrame([("a", "one two three")], "slug string, t string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = ops.distinctive_phrases(ops.phrase_counts(ops.ngrams(docs, ["slug"], "t"), "slug"), "slug")
    kept.collect()
    final = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_merged_words(spark, stop):
    extra = ops.stopword_table(spark, ["and", "stay"], "more")
    assert sorted(r.word for r in merged_words(stop, extra, None).collect()) == ["and", "great", "stay", "the"]


def test_tf_idf_reads_written_counts(spark, tmp_path):
    """The text is scanned by the job that writes the counts, and by no other."""
    spark.createDataFrame([("a", "one two three"), ("b", "one two")], "slug string, t string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    scored = ops.tf_idf(ops.phrase_counts(ops.ngrams(docs, ["slug"], "t"), "slug"), "slug")
    assert str(tmp_path) not in scored._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.slug, r.word, r.n) for r in scored.collect()) == [
        ("a", "one two", 1), ("a", "one two three", 1), ("a", "two three", 1), ("b", "one two", 1)]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts,first_parts", [(1, 1), (7, 1), (200, 1), (100_000, 1), (100_000, 50)])
def test_top_phrases_are_those_of_the_whole_counts(spark, parts, first_parts):
    """However phrases are dealt and wherever the count begins, also with null groups and texts and ties."""
    rng = random.Random(parts)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(25)]
    rows = [(rng.choice(["a", "b", "c", "d", None]), " ".join(rng.choices(words, range(25, 0, -1), k=rng.randint(0, 40))))
            for _ in range(120)]
    docs = spark.createDataFrame([*rows, ("a", None), ("few", "lake view"), ("none", "x")], "slug string, t string")
    stops = ops.stopword_table(spark, words[:2], "x")
    want = ops.distinctive_phrases(ops.phrase_counts(ops.ngrams(docs, ["slug"], "t", stops), "slug"), "slug", 4, 3)
    got = ops.top_phrases(docs, "slug", "t", stops, 4, 3, parts, first_parts)
    assert _rows(got) == _rows(want) and len(_rows(want)) > 12


def test_top_phrases_of_one_group_and_of_no_text(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("a", "four five")], "slug string, t string")
    want = ops.distinctive_phrases(ops.phrase_counts(ops.ngrams(docs, ["slug"], "t"), "slug"), "slug")
    assert _rows(ops.top_phrases(docs, "slug", "t")) == _rows(want) != []
    assert _rows(ops.top_phrases(docs.filter("false"), "slug", "t")) == []


def test_rare_phrases_are_not_counted_by_name(spark, monkeypatch):
    """Of many phrases that occur once, only those that share a part with a frequent one are written as counts."""
    once = [(g, f"{chr(97 + i)}{chr(97 + j)}{g * 3} {chr(97 + j)}{chr(97 + i)}{g * 3}")
            for g in "abc" for i in range(26) for j in range(26)]
    often = [(g, f"often{g * 3} {chr(97 + k) * 3}") for g in "abc" for k in range(25) for _ in range(9)]
    docs = spark.createDataFrame(once + often, "slug string, t string")
    written = {}
    cut = ops.cut_lineage
    monkeypatch.setattr(ops, "cut_lineage", lambda df, label: written.setdefault(label, []).append(cut(df, label)) or written[label][-1])
    got = ops.top_phrases(docs, "slug", "t", candidates=5, kept=5, first_parts=5)
    assert {r.n for r in got.collect()} == {9} and got.count() == 15
    assert sum(df.count() for df in written["counts"]) < 200


def test_word_lists_in_place_of_texts(spark, stop):
    docs = spark.createDataFrame([("a", "Good coffee shop and x9 good the lake view"), ("b", None)], "slug string, t string")
    lists = ops.word_lists(docs, ["slug"], "t")
    lexicon = spark.createDataFrame([("good", 2), ("the", 1), ("x9", 1)], "word string, value int")
    assert _rows(ops.ngrams(lists, ["slug"], "w", stop)) == _rows(ops.ngrams(docs, ["slug"], "t", stop))
    assert (_rows(ops.lexicon_hits(lists, ["slug"], "w", lexicon, stop).select("slug", "word", "value"))
            == _rows(ops.lexicon_hits(docs, ["slug"], "t", lexicon, stop).select("slug", "word", "value")))


def test_shaped_tokens_are_the_tokens_of_that_shape(spark):
    """One pattern finds and tests words; also beside joining marks, other scripts, digits and underscores."""
    rng = random.Random(3)
    signs = [*"abzß09_.'’·,;: \n-é\u0301Жم中٣", "\U00010400", "İ", "\u212a", "the", "Shop", "abc"]
    texts = ["shop. Shop.x abc_ _abc abc9 ab abc's abc' don’t abc\u0301 x", ""]
    texts += ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tokens("t").alias("a"), shaped_tokens("t").alias("b"), shaped_tokens("t", "^[a-z]+$").alias("c")).collect():
        assert [w or None for w in row.b] == [w if re.fullmatch("[a-z]{3,}", w) else None for w in row.a], row.t
        assert [w or None for w in row.c] == [w if re.fullmatch("[a-z]+", w) else None for w in row.a], row.t
    assert df.select(shaped_tokens(F.lit(None).cast("string")).alias("b")).first().b is None


def test_words_are_looked_up_by_hash_and_compared(spark, stop, monkeypatch):
    """Stopwords and lexicons are joined on a number; words that share it are told apart."""
    docs = spark.createDataFrame([("a", "good coffee shop the lake view and best good tea great bars seen"), ("b", None)], "slug string, t string")
    lexicon = spark.createDataFrame([("good", 2), ("lake", 1), ("the", 1), ("zzzz", 7)], "word string, value int")

    def found():
        hits = ops.lexicon_hits(docs, ["slug"], "t", lexicon, stop).select("slug", "word", "value")
        return [_rows(ops.ngrams(docs, ["slug"], "t", stop)), _rows(hits), _rows(ops.word_rows(docs, ["slug"], "t", stop))]

    want = found()
    assert want[1] == [("a", "good", 2), ("a", "good", 2), ("a", "lake", 1)]
    assert [r[1] for r in want[0]] == ["bars seen", "best good", "best good tea", "coffee shop", "good coffee", "good coffee shop",
                                       "good tea", "lake view"]
    plan = ops.ngrams(docs, ["slug"], "t", stop)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftAnti, .*xxhash64\(w[12]", plan)) == 2
    monkeypatch.setattr(F, "xxhash64", lambda word, *more: F.length(word).cast("long"))
    assert found() == want


def test_parts_left_out_go_before_stopwords_are_looked_up(spark, stop, monkeypatch):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "two three five")], "slug string, t string")
    plans = []
    cut = ops.cut_lineage
    monkeypatch.setattr(ops, "cut_lineage", lambda df, label: plans.append((
        label, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, label))
    ops.top_phrases(docs, "slug", "t", stop).collect()
    plan = next(p for label, p in plans if label == "counts")
    assert plan.index("LeftAnti") < plan.index("LeftSemi")  # the tree's top comes first


def test_posts_are_cleaned_once(spark, stop, monkeypatch):
    """The profile takes measures and words from one written table, without the texts."""
    raw = spark.createDataFrame([("a", "1", "good *tea* here", "", 3, 1), ("a", "2", "bad", "coffee and shop", None, 1), ("b", "3", "x", "", 9, 9)],
                                "slug string, post_id string, title string, selftext string, score int, num_comments int")
    lookup = spark.createDataFrame([(1, "A", "a"), (2, "B", "b")], "community_area_number int, name string, slug string")
    valued = spark.createDataFrame([("good", 2), ("bad", -1)], "word string, value int")
    polar = spark.createDataFrame([("good", "positive")], "word string, sentiment string")
    clean = forum.clean_posts(raw).select(*forum.POST)
    got = forum.forum_profile(clean, lookup, valued, polar, stop)["scores"]
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.slug: r for r in got.collect()}
    assert (rows["a"].post_count, rows["a"].total_engagement, rows["a"].mean_sentiment_score) == (2, 4, 0.5)
    assert rows["b"].post_count == 0


def test_the_space_after_a_word_goes_with_it(spark):
    """Words are those of ``tokens`` whatever follows them, and a space is no place to look for one."""
    rng = random.Random(4)
    signs = ["the", "of", "a", "shop", " ", " ", " ", "  ", ".", ",", "'", "_", "9", "\u00e9", "\n", "-", "E"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tokens("t").alias("a"), shaped_tokens("t").alias("b")).collect():
        assert [w or None for w in row.b] == [w if re.fullmatch("[a-z]{3,}", w) else None for w in row.a], row.t
    whole = F.regexp_extract_all(F.lit("shops of the 9th. end"), F.lit(_SHAPED), F.lit(0))
    assert spark.range(1).select(whole.alias("w")).first().w == ["shops ", "of ", "the ", "9th", "end"]
