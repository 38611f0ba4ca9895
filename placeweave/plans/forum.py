"""Discussion posts: cleaning, sentiment, engagement and phrases per area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions.cleaning import clean_text
from placeweave.functions.display import post_flag, sentiment_label
from placeweave.operators.compute import computed_once
from placeweave.operators.joins import chain_left
from placeweave.operators.stats import engagement
from placeweave.operators.text import phrase_string, top_phrases, two_lexicon_scores, word_lists
from placeweave.session import cut_lineage


#: What the profile reads of a cleaned post.
POST = ["slug", "post_id", "full_text", "score", "num_comments"]


def clean_posts(posts: DataFrame, min_chars: int = fixed.MIN_CLEAN_CHARS) -> DataFrame:
    """Cleaned title and body, both as one text; posts that stay too short go."""
    cleaned = computed_once(posts, title_clean=clean_text("title"), text_clean=clean_text("selftext"))
    cleaned = cleaned.withColumn("full_text", F.trim(F.concat_ws(" ", "title_clean", "text_clean")))
    return cleaned.filter(F.col("slug").isNotNull() & (F.length("full_text") > min_chars))


def post_phrases(clean: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    return top_phrases(clean, "slug", "full_text", stopwords)


def forum_profile(clean: DataFrame, lookup: DataFrame, valued: DataFrame, polar: DataFrame,
                  stopwords: DataFrame | None, phrases: DataFrame | None = None) -> dict[str, DataFrame]:
    """``scores``: one row per lookup area; ``phrases``: top phrases per area, found here
    unless a stored table of them is handed in. The word lists, which both need, are then written once, with the
    measures of the posts, so that the posts are cleaned once and their texts need not be written."""
    posts, text = clean, "full_text"
    if phrases is None:
        posts, text = cut_lineage(word_lists(clean, ["slug", "post_id", "score", "num_comments"], text), "words"), "w"
        phrases = cut_lineage(top_phrases(posts, "slug", text, stopwords), "phrases")
    scores = two_lexicon_scores(posts, "slug", ["post_id"], text, valued, polar, stopwords)
    engaged = engagement(posts, ["slug"], ["score", "num_comments"])
    joined = chain_left(lookup.select("community_area_number", "name", "slug"),
                        [scores, engaged, phrase_string(phrases, "slug")], "slug")
    filled = (joined.withColumn("post_count", F.coalesce("post_count", F.lit(0)))
              .withColumn("mean_sentiment_score", F.coalesce("mean_sentiment_score", F.lit(0.0))))
    scored = (filled.withColumn("sentiment_label", sentiment_label("mean_sentiment_score", "post_count"))
              .withColumn("data_quality_flag", post_flag("post_count")))
    return {"scores": scored, "phrases": phrases}
