"""From input files to stage tables. Tables that exist are left alone unless forced."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.operators.checks import Accounting, Check, enforce, row_count, run_checks
from placeweave.operators.joins import keep_keys, merged_words, missing_keys
from placeweave.operators.text import stopword_table
from placeweave.plans import business, forum, listings, master
from placeweave.plans.collection import Collection
from placeweave.plans.listings import CELL
from placeweave.session import cut_lineage
from placeweave.sources import schemas
from placeweave.sources.documents import broken_pages, read_key_config, read_pages, read_posts, read_texts
from placeweave.sources.regions import read_regions
from placeweave.sources.tables import (
    read_csv, read_optional, read_snapshots, read_table, table_exists, write_bundle, write_table)


@dataclass
class Inputs:
    """Files and tables to build from. ``keys`` keeps some areas only; ``area_range`` None takes any
    area number; ``quoted_newlines`` says whether licence and listing files hold any, None looks first.

    Posts come from a folder of documents, or, where ``pages`` and ``key_config`` are given, from landed pages: these are
    collected into a store under ``collection``, which later builds add to. ``recollect_at_least`` collects large keys anew."""

    lookup: str
    licences: str
    posts: str | None
    valued_lexicon: DataFrame
    polar_lexicon: DataFrame
    stopwords: DataFrame | None = None
    regions: str | None = None
    listings: dict[str, str] = field(default_factory=dict)
    reviews: dict[str, str] = field(default_factory=dict)
    summaries: str | None = None
    review_partitions: int | None = None
    quoted_newlines: bool | None = None
    area_range: tuple[int, int] | None = fixed.AREA_RANGE
    rules: list[tuple[str, str]] | None = None
    cell: float = CELL
    keys: list[str] | None = None
    pages: str | None = None
    key_config: str | None = None
    recollect_at_least: int | None = None


def _checked(df: DataFrame, checks: list[Check], stage: str, out: str) -> DataFrame:
    """The frame, computed once and proven before anything is written from it. What the checks
    found, warnings included, is written as ``checks/<stage>`` first."""
    df = cut_lineage(df)
    results = run_checks(df, checks).select(F.lit(stage).alias("stage"), "*")
    write_table(results, f"{out}/checks/{stage}")
    enforce(read_table(df.sparkSession, f"{out}/checks/{stage}"))
    return df


def build(spark: SparkSession, inputs: Inputs, out: str, force: bool = False) -> DataFrame:
    """Write every stage under ``out`` and return the master table."""
    lookup = read_csv(spark, inputs.lookup, schemas.LOOKUP)
    if inputs.keys is not None:
        lookup = keep_keys(lookup, inputs.keys, "slug")
    rows = lookup.count()
    domain = stopword_table(spark, fixed.DOMAIN_STOPWORDS, fixed.DOMAIN_LEXICON)
    hospitality = stopword_table(spark, fixed.HOSPITALITY_STOPWORDS, fixed.HOSPITALITY_LEXICON)
    words = merged_words(inputs.stopwords, domain)

    def missing(path: str) -> bool:
        return force or not table_exists(spark, f"{out}/{path}")

    if missing("business/summary"):
        steps = Accounting("business")
        raw = steps.count(read_csv(spark, inputs.licences, schemas.RAW_LICENCES, inputs.quoted_newlines), "licences raw")
        write_table(steps.count(business.active_licences(raw), "licences active"), f"{out}/licences")
        write_table(steps.table(spark), f"{out}/accounting/business")
        done = business.business_profile(read_table(spark, f"{out}/licences"), lookup, inputs.rules, inputs.area_range)
        summary = _checked(done["summary"], master.business_checks(rows), "business", out)
        write_bundle({"by_category": done["by_category"], "summary": summary}, f"{out}/business")

    if missing("forum/scores"):
        steps = Accounting("forum")
        if inputs.pages is None:
            posts, rejects = read_posts(spark, inputs.posts)
        else:
            pages, config = read_pages(spark, inputs.pages), read_key_config(spark, inputs.key_config)
            if inputs.keys is not None:
                config = keep_keys(config, inputs.keys, "slug")
            collection = Collection(spark, f"{out}/collection")
            collection.collect(pages, config, inputs.recollect_at_least, steps.count)
            posts, rejects = collection.posts(), broken_pages(pages)
        write_table(steps.count(rejects, "files rejected"), f"{out}/forum/rejects")
        kept = forum.clean_posts(steps.count(posts, "posts raw")).select(*forum.POST)
        write_table(steps.count(kept, "posts kept"), f"{out}/forum/posts")
        write_table(steps.table(spark), f"{out}/accounting/forum")
        clean = read_table(spark, f"{out}/forum/posts")
        write_table(forum.post_phrases(clean, words), f"{out}/forum/phrases")
        phrases = read_table(spark, f"{out}/forum/phrases")
        done = forum.forum_profile(clean, lookup, inputs.valued_lexicon, inputs.polar_lexicon, words, phrases)
        write_table(_checked(done["scores"], master.score_checks(rows), "forum", out), f"{out}/forum/scores")

    if inputs.regions and inputs.listings and missing("listings/summary"):
        steps = Accounting("listings")
        done = listings.listing_profile(
            read_snapshots(spark, inputs.listings, schemas.LISTINGS, quoted_newlines=inputs.quoted_newlines),
            read_snapshots(spark, inputs.reviews, schemas.REVIEWS, partitions=inputs.review_partitions),
            read_regions(spark, inputs.regions), lookup, inputs.valued_lexicon, words,
            merged_words(words, hospitality), inputs.cell, *([steps.count] if inputs.reviews else []))
        if inputs.reviews:  # rows of no file are nothing that a job could count
            write_table(steps.table(spark), f"{out}/accounting/listings")
        summary = _checked(done["summary"], [row_count(rows)], "listings", out)
        write_bundle({"by_room_type": done["by_room_type"], "phrases": done["phrases"], "summary": summary},
                     f"{out}/listings")

    summary = read_table(spark, f"{out}/business/summary")
    scores = read_table(spark, f"{out}/forum/scores")
    stays = read_optional(spark, f"{out}/listings/summary")
    texts = read_texts(spark, inputs.summaries) if inputs.summaries else None
    if texts is not None:
        write_table(missing_keys(lookup, texts, "slug"), f"{out}/missing_summaries")
    write_table(master.prompt_table(summary, scores, stays, texts), f"{out}/prompts")
    profile = master.master_profile(lookup, summary, scores, texts, stays)
    write_table(_checked(profile, master.master_checks(profile, rows), "master", out), f"{out}/master")
    return read_table(spark, f"{out}/master")
