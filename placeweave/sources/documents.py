"""Nested JSON, listing payloads, key config and per-key text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.cleaning import file_stem, squish, to_int
from placeweave.sources import schemas


def _text(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit("")).alias(field)


def _count(field: str) -> Column:
    """Absent is 0; present but no number is NULL."""
    return F.when(F.col(field).isNull(), 0).otherwise(to_int(field)).alias(field)


def read_posts(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Post rows and rejected files of a folder with one JSON document per file.

    A document without posts yields no rows; a broken one goes to the rejects."""
    raw = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
           .select(F.col("_metadata.file_path").alias("file"), F.from_json(
               "value", schemas.POST_FILE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
           .select("file", "d.*"))
    posts = raw.filter(F.col("_bad").isNull()).select("slug", F.inline("posts")).select(
        "slug", F.col("id").alias("post_id"), _text("title"), _text("selftext"),
        _count("score"), _count("num_comments"), "subreddit")
    rejects = raw.filter(F.col("_bad").isNotNull()).select("file", F.col("_bad").alias("record"))
    return posts, rejects


def shred_listing(df: DataFrame, payload: str, keys: list[str] = ()) -> DataFrame:
    """Posts of a listing payload column; a malformed payload or one without children has none."""
    parsed = df.select(*keys, F.from_json(payload, schemas.LISTING_PAYLOAD).alias("p"))
    rows = parsed.select(*keys, F.posexplode("p.data.children").alias("position", "c"))
    return rows.select(*keys, "position", "c.data.*").select(
        *keys, "position", "id", _text("title"), _text("selftext"), _count("score"),
        _count("num_comments"), "created_utc", "subreddit", "url", "permalink", "author")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON record per line."""
    return spark.read.schema(schemas.PAGES).json(path)


def broken_pages(pages: DataFrame) -> DataFrame:
    """Pages whose payload is no listing, in the form of the rejects of ``read_posts``."""
    parsed = F.from_json("payload", schemas.LISTING_PAYLOAD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    name = F.concat_ws("/", "slug", "source_name", "feed", F.col("page").cast("string"))
    return pages.filter(F.col("payload").isNull() | parsed["_bad"].isNotNull()).select(name.alias("file"), F.col("payload").alias("record"))


def read_key_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per key with its search terms and dedicated sources; a missing or empty list of
    terms falls back to the single term."""
    raw = spark.read.schema(schemas.KEY_CONFIG).option("multiLine", True).json(path)
    terms = F.when(F.size("search_terms") > 0, F.col("search_terms")).otherwise(F.array("search_term"))
    return (raw.select("min_posts_threshold", "primary_subreddit", "fallback_subreddit", "max_posts",
                       F.inline("neighborhoods"))
            .withColumn("search_terms", terms)
            .withColumn("subreddits", F.coalesce("subreddits", F.array().cast("array<string>")))
            .drop("search_term"))


def read_texts(spark: SparkSession, path: str, key: str = "slug", out: str = "ai_summary",
               extension: str = "txt") -> DataFrame:
    """One row per text file: key from the file name, lines joined and squished."""
    return (spark.read.option("pathGlobFilter", f"*.{extension}").text(path, wholetext=True)
            .select(file_stem(F.col("_metadata.file_name"), extension).alias(key), squish("value").alias(out)))


def write_texts(df: DataFrame, path: str, key: str = "slug", text: str = "prompt", mode: str = "overwrite") -> None:
    """One folder ``key=value`` per key holding its text."""
    df.select(key, text).repartition(key).write.mode(mode).partitionBy(key).text(path)


def read_keyed_texts(spark: SparkSession, path: str, key: str = "slug", out: str = "ai_summary") -> DataFrame:
    """What ``write_texts`` wrote."""
    return (spark.read.schema(f"value string, {key} string").text(path, wholetext=True)
            .select(key, squish("value").alias(out)))


def write_documents(df: DataFrame, path: str, key: str = "slug", mode: str = "overwrite") -> None:
    """Nested documents as JSON, one folder per key and one file per document."""
    spread = [key, "part"] if "part" in df.columns else [key]
    (df.withColumn("_folder", F.col(key)).repartition(*spread)
     .write.mode(mode).option("maxRecordsPerFile", 1).partitionBy("_folder").json(path))
