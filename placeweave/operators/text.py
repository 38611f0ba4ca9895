"""Word, sentiment and phrase operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from placeweave import fixed
from placeweave.functions.tokens import shaped_tokens, tokens, word_shaped
from placeweave.operators.ranking import ordered_join, top_n
from placeweave.session import cut_lineage
from placeweave.sources.tables import small_table

RANK_DIGITS = 9
#: Parts that phrases are dealt into by a hash, to bound their counts.
PHRASE_PARTS = 65_536
#: Parts looked into first, for each candidate phrase of a group.
FIRST_PARTS = 32


def stopword_table(spark, words: list[str], lexicon: str) -> DataFrame:
    return small_table(spark, word=words, lexicon=[lexicon] * len(words))


def word_lists(df: DataFrame, keys: list[str], text: str, shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """The full word list of each text as column ``w``; a word of another shape is empty or NULL and keeps its place.
    ``ngrams`` and ``lexicon_hits`` take such a column in place of a text."""
    return df.select(*keys, shaped_tokens(text, shape).alias("w"))


def _is_list(df: DataFrame, text: str) -> bool:
    return isinstance(df.schema[text].dataType, ArrayType)


def _hashed(words: DataFrame) -> DataFrame:
    """A word table to look words up in with ``_same_word``."""
    return words.withColumn("_hash", F.xxhash64("word")).withColumnRenamed("word", "_word")


def _same_word(word: str) -> Column:
    """Join condition of a word and a ``_hashed`` table. The key is a 64-bit hash, looked up in less than half the
    time of a string; words of one hash are compared, by two bounds, as an equality would be a join key again."""
    return (F.xxhash64(word) == F.col("_hash")) & (F.col(word) >= F.col("_word")) & (F.col(word) <= F.col("_word"))


def word_rows(df: DataFrame, keys: list[str], text: str, stopwords: DataFrame | None = None,
              shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """One row per surviving word: shaped like a word and not a stopword."""
    rows = df.select(*keys, F.explode(shaped_tokens(text, shape)).alias("word")).filter(F.col("word") != "")
    if stopwords is None:
        return rows
    return rows.join(_hashed(stopwords.select("word")), _same_word("word"), "left_anti").select(*keys, "word")


def live_lexicon(lexicon: DataFrame, stopwords: DataFrame | None, shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """Lexicon rows that can match at all. A word survives the stopwords and the shape test
    or it does not, whichever side is asked, so the small side is asked once."""
    live = lexicon.filter(word_shaped("word", shape))
    if stopwords is None:
        return live
    return live.join(stopwords.select("word"), "word", "left_anti")


def lexicon_hits(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame,
                 stopwords: DataFrame | None = None) -> DataFrame:
    """One row per word and lexicon row; a word listed twice counts twice."""
    words = df.select(*keys, F.explode(F.col(text) if _is_list(df, text) else shaped_tokens(text)).alias("word"))
    hits = words.filter(F.col("word") != "").join(_hashed(live_lexicon(lexicon, stopwords)), _same_word("word"))
    return hits.select("word", *keys, *[c for c in lexicon.columns if c != "word"])


def post_sentiment(hits: DataFrame, group: list[str], post: list[str], value: str = "value") -> DataFrame:
    """Per post: summed value, matched words, and their ratio."""
    per_post = hits.groupBy(*group, *post).agg(F.sum(value).alias("post_value"),
                                               F.count("*").alias("word_count"))
    return per_post.withColumn("post_norm", F.col("post_value") / F.col("word_count"))


def two_lexicon_scores(df: DataFrame, group: str, post: list[str], text: str, valued: DataFrame,
                       polar: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Both lexicons in one pass over the text: mean and deviation of the post scores, and
    polarity counts, per group. A group without a polar word keeps NULL there."""
    both = (valued.select("word", F.col("value").cast("double").alias("value"),
                          F.lit(None).cast("string").alias("sentiment"))
            .unionByName(polar.select("word", F.lit(None).cast("double").alias("value"), "sentiment")))
    hits = lexicon_hits(df, [group, *post], text, both, stopwords)
    per_post = hits.groupBy(group, *post).agg(
        F.sum("value").alias("v"), F.count("value").alias("n"),
        F.count_if(F.col("sentiment") == "positive").alias("pos"),
        F.count_if(F.col("sentiment") == "negative").alias("neg"))
    score = F.when(F.col("n") > 0, F.col("v") / F.col("n"))
    per_group = per_post.groupBy(group).agg(
        F.avg(score).alias("mean_sentiment_score"), F.stddev_samp(score).alias("sd_sentiment_score"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    polar_seen = (F.col("pos") + F.col("neg")) > 0
    return per_group.select(
        group, "mean_sentiment_score", "sd_sentiment_score",
        F.when(polar_seen, F.col("pos") / (F.col("pos") + F.col("neg") + 1)).alias("bing_pos_ratio"),
        F.when(polar_seen, F.col("pos")).alias("bing_positive"),
        F.when(polar_seen, F.col("neg")).alias("bing_negative"))


def neighbours(df: DataFrame, keys: list[str], text: str, shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """Each word (``w1``) with its neighbour, and with the next one (``w3``, NULL where that is no word).

    A rejected word keeps its place, so it breaks a phrase and joins nothing. The list is read next to itself
    shifted by one and two."""
    listed = df.select(*keys, F.col(text).alias("w")) if _is_list(df, text) else word_lists(df, keys, text, shape)
    last = F.lit(2**31 - 1)
    rows = listed.select(*keys, F.inline(F.arrays_zip(
        F.col("w").alias("w1"), F.slice("w", 2, last).alias("w2"), F.slice("w", 3, last).alias("w3"))))
    rows = rows.filter((F.col("w1") != "") & (F.col("w2") != ""))
    return rows.withColumn("w3", F.when(F.col("w3") != "", F.col("w3")))


def without_stopwords(rows: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    """``neighbours`` of which neither is a stopword; one in the third place becomes NULL. Stopwords are joined, however
    many they are: a table of known small size is broadcast by Catalyst, and NULL words are ignored."""
    if stopwords is None:
        return rows
    columns = rows.columns
    stop = _hashed(stopwords.select("word").filter(F.col("word").isNotNull()).distinct())
    for w in ("w1", "w2"):
        rows = rows.join(stop, _same_word(w), "left_anti")
    return (rows.join(stop, _same_word("w3"), "left").withColumn("w3", F.when(F.col("_word").isNull(), F.col("w3")))
            .select(*columns))


def phrase_starts(df: DataFrame, keys: list[str], text: str, stopwords: DataFrame | None = None,
                  shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """Each word that starts a phrase (``w1``) with its neighbour, and with the next one where that goes on (``w3``)."""
    return without_stopwords(neighbours(df, keys, text, shape), stopwords).select(*keys, "w1", "w2", "w3")


def started_phrases(starts: DataFrame, keys: list[str]) -> DataFrame:
    """The two- and three-word phrases of ``phrase_starts``."""
    space = F.lit(" ")
    two = F.struct(F.concat("w1", space, "w2").alias("word"), F.lit(2).alias("n_words"))
    three = F.struct(F.concat("w1", space, "w2", space, "w3").alias("word"), F.lit(3).alias("n_words"))
    return starts.select(*keys, F.inline(F.array(two, three))).filter(F.col("word").isNotNull())


def ngrams(df: DataFrame, keys: list[str], text: str, stopwords: DataFrame | None = None,
           shape: str = fixed.WORD_SHAPE) -> DataFrame:
    """Two- and three-word phrases of neighbours in the full word list."""
    return started_phrases(phrase_starts(df, keys, text, stopwords, shape), keys)


def phrase_counts(phrases: DataFrame, group: str) -> DataFrame:
    """Occurrences per group and phrase. A row without a group is dropped here, so that every
    later use of the counts has the same plan and Spark reuses its one shuffle."""
    return (phrases.filter(F.col(group).isNotNull())
            .groupBy(group, "word", "n_words").agg(F.count("*").alias("n")))


def group_totals(counts: DataFrame, group: str) -> DataFrame:
    return counts.groupBy(group).agg(F.sum("n").alias("_total"))


def _with_idf(counts: DataFrame, group: str, totals: DataFrame | None = None) -> DataFrame:
    """Groups holding the word come from a window on the word, which has at most one row per
    group; the number of groups is a scalar subquery over the group totals."""
    totals = group_totals(counts, group) if totals is None else totals
    groups = totals.agg(F.count("_total")).scalar()
    df_ = F.count("*").over(Window.partitionBy("word"))
    return counts.withColumn("df", df_).withColumn("idf", F.ln(groups / F.col("df")))


def _with_score(counts: DataFrame, group: str, totals: DataFrame | None = None) -> DataFrame:
    return _with_idf(counts, group, totals).withColumn("_score", F.round(F.col("n") * F.col("idf"), RANK_DIGITS))


def tf_idf(counts: DataFrame, group: str) -> DataFrame:
    """Every phrase of every group with tf, idf and their product. The counts are written once: totals and the
    number of groups come from the written table and the text is scanned for none of them. The totals, one row
    per group, are written too, so that their size is known and the counts need not be shuffled on the group."""
    counts = cut_lineage(counts, "counts")
    totals = cut_lineage(group_totals(counts, group), "totals")
    groups = totals.agg(F.count("_total")).scalar()
    seen = counts.withColumn("df", F.count("*").over(Window.partitionBy("word")))
    return (seen.join(totals, group).withColumn("idf", F.ln(groups / F.col("df")))
            .withColumn("tf", F.col("n") / F.col("_total"))
            .withColumn("tf_idf", F.col("tf") * F.col("idf")).drop("_total", "df"))


def distinctive_phrases(counts: DataFrame, group: str, candidates: int = fixed.CANDIDATE_PHRASES,
                        kept: int = fixed.KEPT_PHRASES, totals: DataFrame | None = None) -> DataFrame:
    """The top phrases of each group by tf-idf, without two-word phrases that occur inside a
    three-word candidate. ``totals`` is for counts that lack phrases, as ``top_phrases`` leaves them.

    Within a group the total is the same for all rows, so n x idf ranks as tf-idf does and
    the totals meet only the rows that are left. Both cuts and the containment test share
    one partitioning on the group; the tested lists hold at most ``candidates`` phrases."""
    best = _candidates(counts, group, candidates, totals)
    return _apart(best, group, kept, group_totals(counts, group) if totals is None else totals)


def _best_first() -> list[Column]:
    return [F.desc("_score"), F.asc("word")]


def _candidates(counts: DataFrame, group: str, candidates: int, totals: DataFrame | None) -> DataFrame:
    return top_n(_with_score(counts, group, totals), [group], _best_first(), candidates, rank="_k")


def _apart(best: DataFrame, group: str, kept: int, totals: DataFrame) -> DataFrame:
    """Of the candidates, those that stay."""
    longer = F.collect_list(F.when(F.col("n_words") == 3, F.col("word"))).over(Window.partitionBy(group))
    inside = F.exists("_longer", lambda t: t.contains(F.col("word")))
    apart = best.withColumn("_longer", longer).filter((F.col("n_words") == 3) | ~inside)
    final = top_n(apart, [group], _best_first(), kept, rank="rank")
    tf = F.col("n") / F.col("_total")
    return final.join(totals, group).select(
        group, "rank", "word", "n", tf.alias("tf"), "idf", (tf * F.col("idf")).alias("tf_idf"))


def top_phrases(df: DataFrame, group: str, text: str, stopwords: DataFrame | None = None,
                candidates: int = fixed.CANDIDATE_PHRASES, kept: int = fixed.KEPT_PHRASES,
                parts: int = PHRASE_PARTS, first_parts: int = FIRST_PARTS) -> DataFrame:
    """``distinctive_phrases`` of texts or word lists, counting one by one only phrases that can be candidates.

    Phrases are dealt into parts by a hash of their first two words. How many two-word phrases a group has in a
    part is counted first; no phrase there occurs more often, which bounds its score too. All phrases of the fullest
    parts are counted in all groups, which gives each group a score that its last candidate reaches. Where another
    part's bound reaches it as well, the phrases of all such parts are counted. What is left uncounted scores less
    than every candidate, so the result is that of the whole counts, whatever the texts; at worst all are counted."""
    lists = df if _is_list(df, text) else cut_lineage(word_lists(df, [group], text), "words")
    pairs = (neighbours(lists, [group], text if lists is df else "w").filter(F.col(group).isNotNull())
             .withColumn("_part", F.pmod(F.xxhash64("w1", "w2"), F.lit(parts)).cast("int")))
    loads = cut_lineage(without_stopwords(pairs, stopwords).groupBy(group, "_part").agg(
        F.count("*").alias("_most"), (F.count("*") + F.count("w3")).alias("n")), "loads")
    totals = cut_lineage(group_totals(loads, group), "totals")

    def best(among: DataFrame | None) -> DataFrame:
        """Candidates of the parts; words of other parts go before any is held against the stopwords."""
        rows = pairs if among is None else pairs.join(among, "_part", "left_semi")
        counts = cut_lineage(phrase_counts(started_phrases(without_stopwords(rows, stopwords), [group]), group), "counts")
        return cut_lineage(_candidates(counts, group, candidates, totals), "best")

    fullest = top_n(loads, [group], [F.desc("_most"), F.asc("_part")], first_parts * candidates)
    first = cut_lineage(fullest.select("_part").distinct(), "parts")
    found = best(first)
    last = found.filter(F.col("_k") == candidates).select(group, F.col("_score").alias("_last"))
    bound = F.round(F.col("_most") * F.ln(totals.agg(F.count("_total")).scalar()), RANK_DIGITS)
    reach = cut_lineage(loads.join(last, group, "left").filter(F.col("_last").isNull() | (bound >= F.col("_last")))
                        .select("_part").distinct(), "parts")
    if not reach.join(first, "_part", "left_anti").isEmpty():
        found = best(None if 2 * reach.count() > parts else reach)
    return _apart(found, group, kept, totals)


def phrase_string(phrases: DataFrame, group: str, out: str = "top_words",
                  separator: str = fixed.PHRASE_SEPARATOR) -> DataFrame:
    return ordered_join(phrases, [group], "word", "rank", out, separator)
