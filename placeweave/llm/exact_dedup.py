"""Exact dedup: groups of one 128-bit content hash, told apart byte by byte, keep their smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import text_of, without_rows
from placeweave.session import cut_lineage

#: Runs of white space that are anything but one space; a single space needs no replacing.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    """The text with every run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), _RUN, " ")


def content_hash(column: Column) -> Column:
    return F.unhex(F.md5(column))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, sig, text_sha256, keep_id, group_size, kept, copies.

    Rows meet by the hash of their normalised text; inside a hash the bytes themselves are part
    of the group, so texts that collide stay apart. Copies fold into one row per map task
    before a text is moved, which is what keeps a text held by a third of all rows harmless.
    Rows find their group again by both digests, without texts.

    NULL texts count as empty and form one group with empty ones. Rows that repeat both id and
    text are copies too: of those that share the smallest id one is kept (``copies`` says how many
    rows share id and text). A NULL id is larger than any other. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("sig", hash_of(F.col("norm")))
    groups = (rows.groupBy("sig", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("sig", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    names = (rows.select("doc_id", "sig", F.sha2("norm", 256).alias("text_sha256"))
             .groupBy("doc_id", "sig", "text_sha256").agg(F.count("*").alias("copies")))
    found = names.join(groups, ["sig", "text_sha256"])
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "sig", "copies")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, one of each text."""
    groups = cut_lineage(duplicate_groups(docs, id_col, text_col), "copies")
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    dropped = groups.filter(~mine).select("doc_id", "sig").distinct()
    repeated = groups.filter(mine & (F.col("copies") > 1)).select("doc_id", "sig").distinct()
    return without_rows(docs, id_col, content_hash(normalised(text_col)), dropped, repeated)


