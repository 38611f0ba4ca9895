"""Line dedup: windows of three lines that stand elsewhere before are covered, covered lines go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import first_places, joined, later_occurrences, merged_spans, text_of
from placeweave.session import cut_lineage

WINDOW = 3
_SPACE = " \t\n\x0b\x0c\r"


def line_windows(rows: DataFrame) -> DataFrame:
    """One row per window: doc_id, mark, start, end (excluded), h1, h2. Windows of lines of ASCII white space alone are left out."""
    def window(i):
        lines = [F.col("lines")[i + k] for k in range(WINDOW)]
        filled = F.btrim(lines[0], F.lit(_SPACE)) != ""
        for line in lines[1:]:
            filled = filled | (F.btrim(line, F.lit(_SPACE)) != "")
        return F.struct(i.alias("start"), F.xxhash64(*lines).alias("h1"),
                        F.xxhash64(F.lit("second"), *lines).alias("h2"), filled.alias("filled"))

    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    return (rows.filter(F.size("lines") >= WINDOW)
            .select("doc_id", "mark", F.inline(F.transform(starts, window)))
            .filter("filled").select("doc_id", "mark", "start", (F.col("start") + WINDOW).alias("end"), "h1", "h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines, n_removed, spans (removed lines, ends excluded).

    Lines end at a line feed and are compared as they are, by a 128-bit hash of each window. The first
    place of a window, by id, then content, then line, stays; lines that any later place covers go,
    also where it overlaps the first. Texts of fewer lines than a window stay whole, as do NULL (as empty) and
    empty ones. Rows that repeat id and text count as one document and come out alike; a NULL id comes last.

    Windows move as hashes; a window met everywhere folds in the map tasks, and its later places
    are joined in split parts. Texts move once, to meet their spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    lines = rows.withColumn("lines", F.split("text", "\n", -1))
    windows = cut_lineage(line_windows(lines.select("doc_id", "mark", "lines")), "windows")
    repeated = cut_lineage(first_places(windows), "repeated")
    covered = cut_lineage(merged_spans(later_occurrences(windows, repeated), ["doc_id", "mark"]), "covered")
    found = joined(rows, covered, ["doc_id", "mark"], "left", merge=True).withColumn("lines", F.split("text", "\n", -1))
    spans, n = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.size("lines")
    before = F.transform(spans, lambda s, i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0))
    kept = F.flatten(F.zip_with(before, spans, lambda b, s: F.slice("lines", b + 1, s["start"] - b)))
    tail = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(0)
    left = F.array_join(F.concat(kept, F.slice("lines", tail + 1, n - tail)), "\n")
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.when(F.size(spans) > 0, left).otherwise(F.col("text")).alias("text"),
                        n.cast("long").alias("n_lines"), removed.alias("n_removed"), spans.alias("spans"))
