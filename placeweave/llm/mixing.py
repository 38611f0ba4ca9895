"""Mixing sources to target weights with a splitting tree over blocks.

Documents of a source lie in a keyed random order that is cut into blocks. A source's target says
how many passes over this order it gets and where the last pass ends, so it owns an exact number
of block draws. A tree splits all draws among the shards: a node hands equal, uniformly random parts
of its draws to its children, and the numbers per source in such parts follow the multivariate
hypergeometric law, with every source's quota kept exactly. The draws themselves are disjoint
blocks of the permuted order; each shard shuffles what it got by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import WORD, joined, numbered, text_of
from placeweave.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
BLOCK_WORDS = 100_000
FANOUT, LEAST_LEVELS = 8, 2
#: Words of a shard at most on average; the depth of the tree follows from it.
SHARD_WORDS = 1 << 20
_BUCKET_BITS, _KEY_BITS, _SUPER_BITS = 10, 60, 10


def _key(*parts: Column) -> Column:
    """Sixty keyed random bits as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _row_key(id_col: str, text_col: str, seed: str) -> Column:
    """By id and text, so that rows without an id lie apart."""
    return _key(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col)))


def _block(key: str, n_blocks: str) -> Column:
    return F.shiftright(F.shiftright(key, 30) * F.col(n_blocks), 30)


def _targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: shares by weight of all words, none above MAX_PASSES times its source.

    What a full source cannot take is shared among the others again; the level per unit of
    weight only rises, so rounds end. Two sums per round reach the driver."""
    cap = F.col("source_size") * MAX_PASSES
    first = sources.agg(F.sum("source_size").alias("r"), F.sum("weight").alias("s")).first()
    rest, weights, total = first.r or 0, first.s or 1, first.r or 0
    while True:
        full = cap < F.lit(float(rest)) * F.col("weight") / F.lit(float(weights))
        row = sources.agg(F.sum(F.when(full, cap)).alias("r"), F.sum(F.when(~full, F.col("weight"))).alias("s")).first()
        if row.s is None or row.s == weights:
            break
        rest, weights = total - (row.r or 0), row.s
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weights))
    return sources.withColumn("target", F.least(cap.cast("double"), share))


def _split(draws: DataFrame, seed: str, fanout: int, levels: int) -> DataFrame:
    """``shard`` for every draw, level by level. Draws of a node are ranked by random bits: in buckets
    first, so that the root is not ranked in one task, then inside each bucket."""
    draws = draws.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        bits = _key(F.lit(seed), F.lit(level), F.col("number"), F.col("block"), F.col("pass"))
        dealt = draws.withColumn("_r", bits).withColumn("_b", F.shiftright("_r", _KEY_BITS - _BUCKET_BITS))
        dealt = cut_lineage(dealt, "draws")
        counts = dealt.groupBy("node", "_b").agg(F.count("*").alias("_n"))
        ahead = counts.select("node", "_b", (F.sum("_n").over(Window.partitionBy("node").orderBy("_b")) - F.col("_n")).alias("_ahead"),
                              F.sum("_n").over(Window.partitionBy("node")).alias("_all"))
        order = Window.partitionBy("node", "_b").orderBy("_r", "number", "block", "pass")
        rank = F.col("_ahead") + F.row_number().over(order) - 1
        draws = (dealt.join(ahead, ["node", "_b"])
                 .withColumn("node", F.col("node") * fanout + F.floor(rank * fanout / F.col("_all")))
                 .drop("_r", "_b", "_ahead", "_all"))
    return draws.withColumnRenamed("node", "shard")


def _starts(blocks: DataFrame, amount: str) -> DataFrame:
    """Adds ``start``: the amount in all earlier blocks of the source, summed over heaps of blocks first."""
    blocks = blocks.withColumn("_heap", F.shiftright("block", _SUPER_BITS))
    heaps = blocks.groupBy("number", "_heap").agg(F.sum(amount).alias("_w"))
    heaps = heaps.select("number", "_heap", (F.sum("_w").over(Window.partitionBy("number").orderBy("_heap")) - F.col("_w")).alias("_ahead"))
    inside = F.sum(amount).over(Window.partitionBy("number", "_heap").orderBy("block")) - F.col(amount)
    return (blocks.withColumn("_in", inside).join(heaps, ["number", "_heap"])
            .withColumn("start", F.col("_ahead") + F.col("_in")).drop("_heap", "_in", "_ahead"))


def _fills(in_block: DataFrame, ends: DataFrame) -> DataFrame:
    """Documents (number, block, key) that fill the gap between what the last pass took and its end: of those it did not
    take the shortest, while they fit, and one more if that comes nearer. So no document that fits is left.

    Lengths are counted before anything is ranked; of the documents of the last length, blocks are counted and
    only those in which the end may lie are ranked."""
    behind = (F.col("block") > F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("key") > F.coalesce("last_key", F.lit(-1))))
    left = (in_block.join(ends, "number").filter(behind & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
            .groupBy("number", "block", "key").agg(F.sum("size").alias("words"), F.max("gap").alias("gap")))
    left = cut_lineage(left, "left")
    lengths = left.groupBy("number", "words").agg((F.col("words") * F.count("*")).alias("_all"), F.max("gap").alias("gap"))
    lengths = lengths.withColumn("_upto", F.sum("_all").over(Window.partitionBy("number").orderBy("words")))
    before, words = F.col("_upto") - F.col("_all"), F.col("words")
    fit = F.floor((F.floor("gap") - before) / words)
    one_more = (words < 2 * (F.col("gap") - before - fit * words)).cast("long")
    marks = (lengths.filter((F.col("_upto") > F.col("gap")) & (before <= F.col("gap")))
             .select("number", words.alias("_last"), (fit + one_more).alias("_take")))
    marked = left.join(cut_lineage(marks, "marks"), "number", "left")
    below = marked.filter(F.col("_last").isNull() | (F.col("words") < F.col("_last")))
    equal = marked.filter(F.col("words") == F.col("_last"))
    starts = _starts(equal.groupBy("number", "block").agg(F.count("*").alias("_n")), "_n").select("number", "block", "start")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("number", "block").orderBy("key"))
    equal = (equal.join(starts, ["number", "block"]).filter(F.col("start") < F.col("_take"))
             .withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_take")))
    return below.select("number", "block", "key").unionByName(equal.select("number", "block", "key"))


@dataclass(frozen=True)
class MixPlan:
    """``sizes``: a row per document; ``sources``: a row per source; ``blocks``: shards of each block's draws;
    ``fills``: documents the last pass takes out of turn."""

    sizes: DataFrame
    sources: DataFrame
    blocks: DataFrame
    fills: DataFrame
    seed: str

    def placed(self, rows: DataFrame) -> DataFrame:
        """Adds what the plan says to rows with ``source`` and ``key``: source_size, target, passes, shards."""
        fills = self.fills.select(F.col("number").alias("_fn"), F.col("key").alias("_fk"))
        rows = joined(rows, self.sources, ["source"]).withColumn("_block", _block("key", "n_blocks"))
        rows = rows.join(fills, (F.col("number") == F.col("_fn")) & (F.col("key") == F.col("_fk")), "left")
        last = (F.col("_block") == F.col("last_block")) & (F.col("key") <= F.col("last_key"))
        partial = (F.col("_block") < F.col("last_block")) | last | F.col("_fk").isNotNull()
        rows = rows.withColumn("passes", F.col("full") + F.coalesce(partial, F.lit(False)).cast("int")).drop("_fn", "_fk")
        shards = self.blocks.select(F.col("number").alias("_n"), F.col("block").alias("_k"), "shards")
        placed = rows.join(shards, (F.col("number") == F.col("_n")) & (F.col("_block") == F.col("_k")), "left")
        drawn = F.slice(F.coalesce("shards", F.array().cast("array<long>")), F.lit(1), F.col("passes"))
        return placed.withColumn("shards", drawn)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, fanout: int = FANOUT, shard_words: int = SHARD_WORDS,
             seed: str = "mix") -> MixPlan:
    """Targets, passes and shards. Only ids, sources and sizes are kept while planning, no texts.

    The last pass over a source takes whole documents in random order up to the first that does not fit, then the
    shortest of the others while they fit, from anywhere in the source, and one more if that brings the sum nearer: a
    source ends less than its shortest document not taken from its target. Rows that repeat id and text lie side by side in the
    order and share their fate; a NULL id counts as an empty one. The tree has as many levels as shards of ``shard_words`` words need. NULL sources are one source, the
    last; documents without words take part with no words. An empty table gives an empty plan."""
    sizes = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), _row_key(id_col, text_col, seed).alias("key")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = cut_lineage(numbered(totals, F.asc_nulls_last("source"), "number", "sources").withColumn("weight", weight), "sources")
    sources = _targets(sources)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = (sources.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
               .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")))
    sources = cut_lineage(sources, "targets")

    in_source = joined(sizes, sources.select("source", "number", "n_blocks"), ["source"])
    in_block = in_source.select("number", _block("key", "n_blocks").alias("block"), "key", "size")
    blocks = cut_lineage(in_block.groupBy("number", "block").agg(F.sum("size").alias("words")), "blocks")
    starts = _starts(blocks, "words")
    cut = (starts.join(sources.select("number", "rest"), "number")
           .filter((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words")))
           .select("number", "block", (F.col("rest") - F.col("start")).alias("room")))
    cut = cut_lineage(cut, "cuts")
    upto = Window.partitionBy("number").orderBy("key")
    alike = (in_block.filter(F.col("size") > 0).join(cut, ["number", "block"])
             .groupBy("number", "block", "key", "room").agg(F.sum("size").alias("words")))
    alike = alike.withColumn("_upto", F.sum("words").over(upto)).withColumn("_fits", F.col("_upto") <= F.col("room"))
    got = alike.filter("_fits").groupBy("number").agg(F.max("key").alias("last_key"), F.max("_upto").alias("_got"))
    ends = cut.join(got, "number", "left").select(
        "number", F.col("block").alias("last_block"), "last_key", (F.col("room") - F.coalesce("_got", F.lit(0))).alias("gap"))
    ends = cut_lineage(ends, "ends")
    fills = cut_lineage(_fills(in_block, ends), "fills")
    sources = cut_lineage(sources.join(ends.drop("gap"), "number", "left").drop("rest"), "sources")

    own = sources.select("number", "full", "last_block", "last_key")
    filled = fills.select("number", "block").distinct().withColumn("_filled", F.lit(True))
    more = ((F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & F.col("last_key").isNotNull())
            | F.col("_filled"))
    draws = (blocks.join(own, "number").join(filled, ["number", "block"], "left")
             .withColumn("_draws", F.col("full") + F.coalesce(more, F.lit(False)).cast("int")).filter(F.col("_draws") > 0)
             .select("number", "block", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)).alias("pass")))
    words, levels = sources.agg(F.sum("source_size")).first()[0] or 0, LEAST_LEVELS
    while fanout ** levels * shard_words < words:
        levels += 1
    dealt = _split(draws, seed, fanout, levels)
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"])
    shards = cut_lineage(dealt.groupBy("number", "block").agg(in_turn.alias("shards")), "shards")
    return MixPlan(sizes, sources, shards, fills, seed)


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards (one per time it is taken)."""
    plan = plan_mix(docs, **options)
    placed = plan.placed(plan.sizes)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        shard_col: str | None = None, **options) -> DataFrame:
    """The mixed corpus: a row with all columns of docs for each time a document is taken, dealt out by
    shard and shuffled inside each shard; ``shard_col`` names a column for the shard."""
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("source"), _row_key(id_col, text_col, plan.seed).alias("key"))
    drawn = plan.placed(rows).select("_row", "key", F.posexplode("shards").alias("_pass", "_shard"))
    order = F.md5(F.concat_ws(":", F.lit(plan.seed), "_shard", "key", "_pass"))
    out = drawn.repartition("_shard").sortWithinPartitions("_shard", order)
    return out.select("_row.*", *([F.col("_shard").alias(shard_col)] if shard_col else []))
