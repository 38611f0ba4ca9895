"""Rules that turn landed posts of several sources into one stored document per key.

``landed`` holds one row per collected post: slug, source_kind (dedicated, primary or
fallback), source_name, source_no (place in the key's list), feed (sort order or search
term), feed_no, position, and the post.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.operators.joins import fallback_rows
from placeweave.operators.keys import collection_log, nest_by_key, todo_keys
from placeweave.operators.ranking import cap_per_source, priority_dedup
from placeweave.session import cut_lineage
from placeweave.sources import schemas
from placeweave.sources.documents import shred_listing
from placeweave.sources.store import KeyedStore

DEDICATED, PRIMARY, FALLBACK = "dedicated", "primary", "fallback"
FEED = ["slug", "source_kind", "source_name", "feed"]


def _kind(kind: str):
    return F.col("source_kind") == kind


def rules_of(config: DataFrame) -> dict[str, int | None]:
    """Threshold and cap as the key config has them; a config without a cap means none."""
    named = [F.max(c).alias(c) if c in config.columns else F.lit(None).alias(c) for c in ("min_posts_threshold", "max_posts")]
    row = config.agg(F.count("*"), *named).first()
    at_least = fixed.MIN_PRIMARY_POSTS if row.min_posts_threshold is None else row.min_posts_threshold
    return {"at_least": at_least, "cap": row.max_posts}


def capped_posts(landed: DataFrame, cap: int | None) -> DataFrame:
    """At most ``cap`` posts of each source and feed, in collection order."""
    return cap_per_source(landed, FEED, "position", cap)


def chosen_posts(capped: DataFrame, at_least: int) -> DataFrame:
    """Fallback rows only where the primary source is thin, each post once: dedicated sources in the
    order of the config, then the primary one, then the fallback."""
    used = fallback_rows(capped, ["slug"], _kind(PRIMARY), _kind(FALLBACK), at_least)
    rank = F.when(_kind(DEDICATED), 0).when(_kind(PRIMARY), 1).otherwise(2)
    return priority_dedup(used, ["slug"], "id", [rank, "source_no", "feed_no", "position"])


def collect_posts(landed: DataFrame, at_least: int = fixed.MIN_PRIMARY_POSTS, cap: int | None = None) -> DataFrame:
    """Capped per source and feed if a cap is given, then chosen."""
    capped = capped_posts(landed, cap)
    return chosen_posts(capped if cap is None else cut_lineage(capped, "capped"), at_least)


def source_lists(landed: DataFrame, config: DataFrame, at_least: int = fixed.MIN_PRIMARY_POSTS,
                 cap: int | None = None) -> DataFrame:
    """Sources named per key: dedicated ones always, the primary one if it gave rows, the
    fallback one if it was asked and the key has any rows at all. Counts need no ranking: a feed
    counts at most its cap."""
    n = F.count("*") if cap is None else F.least(F.count("*"), F.lit(cap).cast("long"))
    feeds = landed.groupBy(*FEED).agg(n.alias("_n"))
    counts = feeds.groupBy("slug").agg(F.sum(F.when(_kind(PRIMARY), F.col("_n")).otherwise(0)).alias("_primary"), F.sum("_n").alias("_any"))
    joined = config.join(counts, "slug", "left").na.fill(0, ["_primary", "_any"])
    dedicated = F.transform("subreddits", lambda s: F.concat(F.lit("r/"), s))
    primary = F.when(F.col("_primary") > 0, F.concat(F.lit("r/"), "primary_subreddit"))
    fallback = F.when((F.col("_primary") < at_least) & (F.col("_any") > 0),
                      F.concat(F.lit("r/"), "fallback_subreddit"))
    return joined.select("slug", "name", F.array_compact(
        F.concat(dedicated, F.array(primary, fallback))).alias("sources"))


def collected(landed: DataFrame, config: DataFrame, already: DataFrame | None = None,
              at_least: int | None = None, cap: int | None = None) -> dict[str, DataFrame]:
    """``posts`` to store for keys not stored yet, their ``sources``, and the ``log`` over all keys.

    ``already`` holds slug, post_count and sources of stored keys, as ``stored_keys`` reads them.
    Threshold and cap are those of the config unless given. The config and the posts are written once."""
    config = cut_lineage(config, "config")
    rules = rules_of(config)
    at_least, cap = rules["at_least"] if at_least is None else at_least, rules["cap"] if cap is None else cap
    todo = config if already is None else config.join(already.select("slug"), "slug", "left_anti")
    fresh = landed.join(todo.select("slug"), "slug", "left_semi")
    posts = cut_lineage(collect_posts(fresh, at_least, cap), "posts")
    sizes = posts.groupBy("slug").agg(F.count("*").alias("n"))
    sources = source_lists(fresh, todo, at_least, cap)
    stored = sources.join(sizes, "slug", "left")
    log = collection_log(stored, "name", F.coalesce("n", F.lit(0)), F.array_join("sources", ","), F.lit(False))
    if already is not None:
        old = config.select("slug", "name").join(already.drop("name"), "slug")
        log = log.unionByName(collection_log(old, "name", F.col("post_count"), F.col("sources"), F.lit(True)))
    return {"posts": posts, "sources": sources, "log": log}


def collection_documents(posts: DataFrame, sources: DataFrame, fields: list[str], order: str = "id",
                         per_document: int = 10_000) -> DataFrame:
    """Documents to store: slug, name, sources, part, posts. A key without posts has one empty document."""
    nested = nest_by_key(posts, ["slug"], "id", order, fields, per_document=per_document)
    whole = sources.join(nested, "slug", "left")
    none = F.array().cast(nested.schema["posts"].dataType)
    return whole.select("slug", "name", "sources", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("posts", none).alias("posts"))


def stored_keys(spark, path: str) -> DataFrame:
    """What a store of documents holds already: slug, name, post_count, sources (one string)."""
    return keys_in(spark.read.schema(schemas.POST_FILE).option("recursiveFileLookup", True).json(path))


def keys_in(docs: DataFrame) -> DataFrame:
    """The same of a frame of documents."""
    return docs.groupBy("slug").agg(
        F.first("name").alias("name"), F.sum(F.size("posts")).cast("long").alias("post_count"),
        F.first(F.array_join("sources", ",")).alias("sources"))


def landed_posts(pages: DataFrame) -> DataFrame:
    """Posts of landed pages; a feed's posts are in the order of its pages and, in a page, as they came."""
    posts = shred_listing(pages, "payload", schemas.PAGE_KEYS)
    place = F.coalesce("page", F.lit(0)).cast("long") * F.lit(2**32) + F.col("position")
    return posts.withColumn("position", place).drop("page")


@dataclass(frozen=True)
class Collection:
    """The stored documents and the log of a collection, kept under one folder and changed by key."""

    spark: SparkSession
    root: str
    buckets: int = 64
    per_document: int = 10_000

    def documents(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.root}/documents", schemas.STORED_POSTS, "slug", self.buckets, ["part"])

    def log(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.root}/log", schemas.COLLECTION_LOG, "slug", self.buckets)

    def posts(self) -> DataFrame:
        """What is stored, one row per post, as ``read_posts`` gives those of files."""
        rows = self.documents().read().select("slug", F.inline("posts"))
        return rows.select("slug", F.col("id").alias("post_id"), *[c for c in rows.columns if c not in ("slug", "id")])

    def collect(self, pages: DataFrame, config: DataFrame, recollect_at_least: int | None = None,
                count=lambda df, step: df) -> DataFrame:
        """Stores the posts of the keys in ``config`` that have no document yet and logs all its keys; the log.

        Keys that hold ``recollect_at_least`` posts or more lose their documents first and are collected anew. Pages of stored
        keys are not read into, the others once. Documents are committed before the log: a run that broke off
        between the two finds its keys stored and logs them as skipped. Pages of unknown keys are left out. ``count``
        sees the steps that run once."""
        config, store = cut_lineage(config, "config"), self.documents()
        if recollect_at_least is not None:
            full = keys_in(store.read()).filter(F.col("post_count") >= recollect_at_least)
            store.remove(full.join(config.select("slug"), "slug", "left_semi"))
        already = cut_lineage(keys_in(store.read()), "already")
        todo = todo_keys(config, already, "slug")
        fresh = count(pages.join(todo, "slug", "left_semi"), "pages to read")
        landed = cut_lineage(count(landed_posts(fresh), "posts landed"), "landed")
        done = collected(landed, config, already)
        fields = ["id", "title", "selftext", "score", "num_comments", "subreddit"]
        # the order of the choice is the order of the documents
        ranked = done["posts"].withColumn("_at", F.struct(
            F.when(_kind(DEDICATED), 0).when(_kind(PRIMARY), 1).otherwise(2), "source_no", "feed_no", "position"))
        store.replace(collection_documents(ranked, done["sources"], fields, "_at", self.per_document))
        self.log().replace(done["log"])
        return self.log().read()
