"""Cleaning, words, sentiment and phrases over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave import fixed
from placeweave.catalog.base import heavy, query, sql_values, sql_words, table
from placeweave.functions.cleaning import clean_text, strip_edges
from placeweave.functions.display import sentiment_label
from placeweave.functions.tokens import tokens
from placeweave.operators.compute import computed_once
from placeweave.operators.joins import keep_keys, merged_words, union_layers
from placeweave.operators.stats import mean_and_sd, polarity
from placeweave.operators.text import (
    lexicon_hits, ngrams, phrase_counts, phrase_string, post_sentiment, stopword_table, tf_idf, top_phrases,
    two_lexicon_scores, word_rows)
from placeweave.plans.feeds import phrase_bars
from placeweave.plans.forum import clean_posts
from placeweave.sources.tables import small_table

# word lists for the sample corpus, which is invented prose in four languages
FUNCTION_WORDS = ["the", "and", "that", "for", "was", "with", "this", "are", "from", "der", "die", "und", "den", "von",
                  "ein", "das", "mit", "que", "los", "del", "las", "des", "les", "une", "pour", "est", "trash"]
VALUED = [("best", 3), ("idiot", -3), ("stupid", -2), ("moron", -3), ("pathetic", -2), ("worthless", -2),
          ("worthless", -1), ("disgusting", -3), ("loser", -2), ("trash", -2), ("than", 1), ("elle", 1), ("sich", 2),
          ("para", 1), ("auf", -1), ("ok", 5)]
POLAR = [("best", "positive"), ("than", "positive"), ("elle", "positive"), ("idiot", "negative"),
         ("moron", "negative"), ("loser", "negative"), ("loser", "negative"), ("stupid", "negative"),
         ("the", "positive")]
STOPWORDS = FUNCTION_WORDS + fixed.DOMAIN_STOPWORDS

# the same word rule without look-around: joining marks between two letters or two digits
# are first replaced by a private character that counts as a letter
_JOINED = r"""
replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}),
  '([\p{{L}}\p{{M}}])[.''‘’·](\p{{L}})', '\1' || chr(57344) || '\2', 'g'),
  '([\p{{L}}\p{{M}}])[.''‘’·](\p{{L}})', '\1' || chr(57344) || '\2', 'g'),
  '(\p{{Nd}})[.,;''‘’](\p{{Nd}})', '\1' || chr(57344) || '\2', 'g'),
  '(\p{{Nd}})[.,;''‘’](\p{{Nd}})', '\1' || chr(57344) || '\2', 'g'), chr(57344), chr(57344))"""


def sql_tokens(text: str) -> str:
    word = r"_*[\p{L}\p{M}\p{Nd}\x{E000}][\p{L}\p{M}\p{Nd}_\x{E000}]*"
    return f"regexp_extract_all({_JOINED.format(text)}, '{word}')"


def sql_words_of(relation: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, word FROM (SELECT {keys}, unnest({sql_tokens(text)}) AS word FROM {relation})
WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN {sql_words(STOPWORDS)}"""


def sql_phrases(relation: str, group: str, text: str) -> str:
    ok = "regexp_matches({0}, '^[a-z]{{3,}}$') AND {0} NOT IN " + sql_words(STOPWORDS)
    return f"""
lists AS (SELECT {group} AS g, {sql_tokens(text)} AS a FROM {relation}),
spots AS (SELECT g, a, unnest(range(1, len(a))) AS i FROM lists),
trios AS (SELECT g, a[i] AS w1, a[i + 1] AS w2, a[i + 2] AS w3 FROM spots),
good AS (SELECT * FROM trios WHERE {ok.format('w1')} AND {ok.format('w2')}),
phrases AS (SELECT g, w1 || ' ' || w2 AS word, 2 AS n_words FROM good
            UNION ALL SELECT g, w1 || ' ' || w2 || ' ' || w3, 3 FROM good WHERE {ok.format('w3')}),
counts AS (SELECT g, word, n_words, count(*) AS n FROM phrases GROUP BY ALL)"""


SQL_SCORED = """
totals AS (SELECT g, sum(n) AS total FROM counts GROUP BY 1),
freq AS (SELECT word, count(*) AS df FROM counts GROUP BY 1),
scored AS (SELECT counts.*, n / total AS tf, ln((SELECT count(*) FROM totals) / df) AS idf
           FROM counts JOIN totals USING (g) JOIN freq USING (word))"""
SQL_KEPT = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(n * idf, 9) DESC, word) AS r FROM scored),
best AS (SELECT * FROM ranked WHERE r <= 20),
apart AS (SELECT * FROM best b WHERE n_words = 3 OR NOT EXISTS (
          SELECT 1 FROM best t WHERE t.g = b.g AND t.n_words = 3 AND contains(t.word, b.word))),
kept AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) AS k FROM apart)"""


def _docs(spark, sf):
    return heavy(spark, sf, "documents", "doc_id").select("doc_id", "source", "text")


def _stop(spark):
    return merged_words(stopword_table(spark, FUNCTION_WORDS, "function"),
                        stopword_table(spark, fixed.DOMAIN_STOPWORDS, fixed.DOMAIN_LEXICON))


def _valued(spark):
    return small_table(spark, word=[w for w, _ in VALUED], value=[v for _, v in VALUED])


def _polar(spark):
    return small_table(spark, word=[w for w, _ in POLAR], sentiment=[s for _, s in POLAR])


def _counts(spark, sf):
    return phrase_counts(ngrams(_docs(spark, sf), ["source"], "text", _stop(spark)), "source")


_SQL_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  'https?://[^\s]+', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_~`>|#]', ' ', 'g'), '\s+', ' ', 'g'))"""
_SQL_LINKED = "'See [' || url || '](' || url || ') and [page](/p/' || page_id || ') *now*: ' || html"


@query(f"""
WITH c AS (
  SELECT 'page' AS kind, page_id AS id, {_SQL_CLEAN.format(_SQL_LINKED)} AS clean FROM pages
  UNION ALL SELECT 'document', doc_id, {_SQL_CLEAN.format('text')} FROM documents)
SELECT kind, id, md5(clean) AS digest, CAST(length(clean) AS INTEGER) AS chars, substr(clean, 1, 60) AS head FROM c WHERE length(clean) > 5
""", name="clean_text")
def clean_texts(spark, sf):
    linked = F.concat(F.lit("See ["), "url", F.lit("]("), "url", F.lit(") and [page](/p/"),
                      col("page_id").cast("string"), F.lit(") *now*: "), "html")
    pages = computed_once(heavy(spark, sf, "pages", "page_id").select(col("page_id").alias("id"), linked.alias("raw")),
                          clean=clean_text("raw")).drop("raw")
    docs = computed_once(_docs(spark, sf).select(col("doc_id").alias("id"), "text"), clean=clean_text("text")).drop("text")
    both = union_layers({"page": pages, "document": docs}, "kind").filter(F.length("clean") > fixed.MIN_CLEAN_CHARS)
    return both.select("kind", "id", F.md5("clean").alias("digest"), F.length("clean").alias("chars"),
                       F.substring("clean", 1, 60).alias("head"))


@query(r"""
SELECT conv_id, turn, CAST(length(t) AS INTEGER) AS chars, role FROM (
  SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
WHERE t IS NOT NULL AND length(t) > 10
""")
def long_enough(spark, sf):
    edged = table(spark, sf, "conversations").withColumn("t", strip_edges("text"))
    return edged.filter(F.length("t") > fixed.MIN_REVIEW_CHARS).select(
        "conv_id", "turn", F.length("t").alias("chars"), "role")


@query(f"""
SELECT doc_id, count(*) AS n, count(DISTINCT word) AS n_distinct, min(word) AS first_word, max(word) AS last_word
FROM ({sql_words_of('documents', 'doc_id', 'text')}) GROUP BY 1
""")
def document_words(spark, sf):
    return word_rows(_docs(spark, sf), ["doc_id"], "text", _stop(spark)).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("word").alias("n_distinct"), F.min("word").alias("first_word"),
        F.max("word").alias("last_word"))


@query(f"""
SELECT page_id, CAST(len(a) AS INTEGER) AS n,
       md5(replace(array_to_string(a, ' '), chr(57344), '?')) AS digest
FROM (SELECT page_id, {sql_tokens('html')} AS a FROM pages)
""", name="tokens")
def page_tokens(spark, sf):
    marks = "[.,;'‘’·]"
    pages = computed_once(heavy(spark, sf, "pages", "page_id"), a=tokens("html"))
    return pages.select("page_id", F.size("a").alias("n"),
                        F.md5(F.regexp_replace(F.array_join("a", " "), marks, "?")).alias("digest"))


@query(f"""
SELECT source, word, count(*) AS n FROM ({sql_words_of('documents', 'source', 'text')}) GROUP BY 1, 2
""")
def word_counts(spark, sf):
    return word_rows(_docs(spark, sf), ["source"], "text", _stop(spark)).groupBy("source", "word").agg(
        F.count("*").alias("n"))


_SQL_HITS = f"""
hits AS (SELECT d.*, value FROM ({sql_words_of('documents', 'source, doc_id', 'text')}) d
         JOIN (VALUES {sql_values(VALUED)}) lex(word, value) USING (word)),
posts AS (SELECT source, doc_id, sum(value) AS v, count(*) AS n FROM hits GROUP BY 1, 2)"""


@query(f"""
WITH {_SQL_HITS}
SELECT source, doc_id, CAST(v AS BIGINT) AS post_value, n AS word_count, round(v / n, 9) AS post_norm FROM posts
""")
def sentiment_post(spark, sf):
    hits = lexicon_hits(_docs(spark, sf), ["source", "doc_id"], "text", _valued(spark), _stop(spark))
    return post_sentiment(hits, ["source"], ["doc_id"]).withColumn("post_norm", F.round("post_norm", 9))


@query(f"""
WITH {_SQL_HITS},
 g AS (SELECT source, avg(v / n) AS mean_score, stddev_samp(v / n) AS sd_score FROM posts GROUP BY 1)
SELECT source, round(mean_score, 9) AS mean_score, round(sd_score, 9) AS sd_score,
       CASE WHEN mean_score > 0.05 THEN 'Positive' WHEN mean_score < -0.05 THEN 'Negative' ELSE 'Neutral' END AS label
FROM g
""")
def sentiment_group(spark, sf):
    hits = lexicon_hits(_docs(spark, sf), ["source", "doc_id"], "text", _valued(spark), _stop(spark))
    means = mean_and_sd(post_sentiment(hits, ["source"], ["doc_id"]), ["source"], "post_norm", "mean_score", "sd_score")
    return means.select("source", F.round("mean_score", 9).alias("mean_score"), F.round("sd_score", 9).alias("sd_score"),
                        sentiment_label("mean_score").alias("label"))


_SQL_POLAR = f"""
polar AS (SELECT source, count(*) FILTER (sentiment = 'positive') AS pos,
                 count(*) FILTER (sentiment = 'negative') AS neg
          FROM ({sql_words_of('documents', 'source', 'text')}) d
          JOIN (VALUES {sql_values(POLAR)}) lex(word, sentiment) USING (word) GROUP BY 1)"""


@query(f"""
WITH {_SQL_POLAR}
SELECT source, round(pos / (pos + neg + 1), 9) AS pos_ratio, pos AS positive, neg AS negative FROM polar
""")
def polarity_pivot(spark, sf):
    hits = lexicon_hits(_docs(spark, sf), ["source"], "text", _polar(spark), _stop(spark))
    return polarity(hits, ["source"]).withColumn("pos_ratio", F.round("pos_ratio", 9))


@query(f"""
WITH {_SQL_HITS}, {_SQL_POLAR},
 g AS (SELECT source, avg(v / n) AS m, stddev_samp(v / n) AS s FROM posts GROUP BY 1)
SELECT source, round(m, 9) AS mean_sentiment_score, round(s, 9) AS sd_sentiment_score,
       round(pos / (pos + neg + 1), 9) AS bing_pos_ratio, pos AS bing_positive, neg AS bing_negative
FROM g FULL JOIN polar USING (source)
""")
def two_lexicons(spark, sf):
    scores = two_lexicon_scores(_docs(spark, sf), "source", ["doc_id"], "text", _valued(spark), _polar(spark),
                                _stop(spark))
    for c in ("mean_sentiment_score", "sd_sentiment_score", "bing_pos_ratio"):
        scores = scores.withColumn(c, F.round(c, 9))
    return scores


@query(f"""
WITH {sql_phrases('documents', 'source', 'text')}
SELECT g AS source, word, CAST(n_words AS INTEGER) AS n_words, n FROM counts
""")
def ngram_counts(spark, sf):
    return _counts(spark, sf)


@query(f"""
WITH {sql_phrases('documents', 'source', 'text')}, {SQL_SCORED}
SELECT g AS source, word, n, round(1e6 * tf, 6) AS tf_millionths, round(idf, 9) AS idf,
       round(1e6 * tf * idf, 6) AS score FROM scored
""")
def tfidf(spark, sf):
    return tf_idf(_counts(spark, sf), "source").select(
        "source", "word", "n", F.round(col("tf") * 1e6, 6).alias("tf_millionths"), F.round("idf", 9).alias("idf"),
        F.round(col("tf_idf") * 1e6, 6).alias("score"))


@query(f"""
WITH {sql_phrases('documents', 'source', 'text')}, {SQL_SCORED}, {SQL_KEPT}
SELECT g AS source, CAST(k AS INTEGER) AS rank, word, n, round(1e6 * tf, 6) AS tf_millionths,
       round(idf, 9) AS idf, round(1e6 * tf * idf, 6) AS score FROM kept WHERE k <= 10
""", name="distinctive_phrases")
def distinctive(spark, sf):
    return top_phrases(_docs(spark, sf), "source", "text", _stop(spark)).select(
        "source", "rank", "word", "n", F.round(col("tf") * 1e6, 6).alias("tf_millionths"), F.round("idf", 9).alias("idf"),
        F.round(col("tf_idf") * 1e6, 6).alias("score"))


@query(f"""
WITH {sql_phrases('conversations', 'role', 'text')}, {SQL_SCORED}, {SQL_KEPT}
SELECT g AS role, string_agg(word, ', ' ORDER BY k) AS top_words FROM kept WHERE k <= 10 GROUP BY 1
""", name="phrase_string")
def phrase_strings(spark, sf):
    turns = heavy(spark, sf, "conversations", "conv_id").select("role", "text")
    return phrase_string(top_phrases(turns, "role", "text", _stop(spark)), "role")


@query(f"""
WITH {sql_phrases('documents', 'lang', 'text')}, {SQL_SCORED}, {SQL_KEPT},
shown AS (SELECT lang FROM documents GROUP BY 1
          HAVING count(*) > (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)))
SELECT g AS lang, CAST(k AS INTEGER) AS bar, word, round(1e6 * tf * idf, 6) AS score FROM kept
WHERE k <= 10 AND g IN (SELECT lang FROM shown)
""")
def phrase_bar_feed(spark, sf):
    docs = heavy(spark, sf, "documents", "doc_id").select("lang", "text")
    phrases = top_phrases(docs, "lang", "text", _stop(spark))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    flags = sizes.withColumn("flag", F.when(col("n") == sizes.agg(F.min("n")).scalar(), fixed.FLAG_NO_POSTS)
                             .otherwise(fixed.FLAG_FULL))
    bars = phrase_bars(phrases, flags, key="lang", flag="flag")
    return bars.select("lang", "bar", "word", F.round(col("tf_idf") * 1e6, 6).alias("score"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS word FROM documents),
 general AS (SELECT word FROM w WHERE word IN {sql_words(FUNCTION_WORDS)}),
 frequent AS (SELECT word FROM (SELECT unnest({sql_tokens('text')}) AS word FROM conversations)
              GROUP BY 1 HAVING count(*) >= 50)
SELECT 'all' AS layer, word FROM general UNION ALL SELECT 'all', word FROM frequent
UNION ALL SELECT 'merged', word FROM (SELECT word FROM general UNION SELECT word FROM frequent)
UNION ALL SELECT 'left', word FROM (SELECT word FROM frequent WHERE word NOT IN {sql_words(STOPWORDS)})
""")
def stopword_layers(spark, sf):
    seen = _docs(spark, sf).select(F.explode(tokens("text")).alias("word")).distinct()
    general = keep_keys(seen, stopword_table(spark, FUNCTION_WORDS, "function"), "word")
    frequent = (table(spark, sf, "conversations").select(F.explode(tokens("text")).alias("word"))
                .groupBy("word").agg(F.count("*").alias("n")).filter(col("n") >= 50).select("word"))
    return union_layers({"all": general.unionByName(frequent), "merged": merged_words(general, frequent),
                         "left": keep_keys(frequent, _stop(spark), "word", negate=True)}, "layer")


@query(f"""
WITH c AS (SELECT conv_id, role, {_SQL_CLEAN.format("coalesce(role, '')")} || ' ' ||
             {_SQL_CLEAN.format("coalesce(text, '')")} AS t FROM conversations)
SELECT conv_id, count(*) AS post_count, CAST(sum(length(trim(t))) AS BIGINT) AS chars FROM c
WHERE length(trim(t)) > 5 GROUP BY 1
""")
def cleaned_posts(spark, sf):
    turns = table(spark, sf, "conversations").select(
        col("conv_id").alias("slug"), F.coalesce("role", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("selftext"))
    return clean_posts(turns).groupBy(col("slug").alias("conv_id")).agg(
        F.count("*").alias("post_count"), F.sum(F.length("full_text")).alias("chars"))
