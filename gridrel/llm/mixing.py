"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrel.llm.common import blocks_for, running, shuffle_width, spread_join, stash

#: Words to a block, slots to an output shard; documents, and shards, to a bucket of the prefix sums.
BLOCK, SHARD, BUCKET_DOCS, BUCKET_SHARDS = 32, 16_384, 2_048, 4_096
#: Sources up to so many are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rounds of the swap-or-not permutation, and bits of a slot's draw.
ROUNDS, BITS = 12, 40
#: A prime above any shard: draws, which are in order of source, are laid out in the shard by this stride.
STRIDE = 1_000_000_007
#: The white space between words, and the weights that sources take in turn.
SPACES = r"\x20\x09\x0A\x0B\x0C\x0D"
WEIGHTS = (3, 1, 2)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _source_key() -> Column:
    """A key of the source that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source, source_size, n_docs, rank (by code point, null last), target.

    Sources share budget times all sizes by weight; a target stops at `most` times its source's
    size and the excess is shared again by weight.  With sources ordered by most * size / weight,
    the first j are full, and the rest take the remainder by weight, for the least j that leaves
    none above.  No task holds all sources.  Without rows there are no sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = running(per, [F.col("source").asc_nulls_last()], {}, "mix-ranks").withColumnRenamed("place", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    full = ranked.select("source", "source_size", "n_docs", "rank", w.alias("w"), (most * F.col("source_size")).alias("cap"), (most * F.col("source_size") / w).alias("level"))
    steps = running(full, [F.col("level"), F.col("rank")], {"cap_before": F.col("cap"), "w_before": F.col("w")}, "mix-levels")
    sums = steps.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    steps = steps.crossJoin(F.broadcast(sums))  # one row
    steps = steps.withColumn("share", (budget * F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    # the first source, by level, that its share does not fill fixes the share of all after it
    settled = F.col("share") <= F.col("level")
    share = steps.agg(F.min_by(F.when(settled, F.col("share")), F.when(settled, F.struct("level", "rank"))).alias("s"))
    out = steps.drop("share").crossJoin(F.broadcast(share))  # one row
    return out.select("source", "source_size", "n_docs", "rank", F.least("cap", F.coalesce(F.col("s") * F.col("w"), F.col("cap"))).alias("target"))


def permute(rows: DataFrame, column: str, n: str, key: str, rounds: int = ROUNDS) -> DataFrame:
    """rows with column, an index of 0..n-1, led through a pseudorandom permutation of these: swap-or-not, keyed by key.

    A round is two projections of few operations, so that all rounds fit into a method that the JVM compiles.
    """
    others = [c for c in rows.columns if c != column]
    for r in range(1, rounds + 1):
        x = F.col(column)
        other = F.pmod(F.shiftright(F.xxhash64(F.col(key), F.lit(r)), 1) - x, F.col(n))
        swap = F.xxhash64(F.col(key), F.lit(-r), F.greatest(x, F.col("__other"))).bitwiseAND(1) == 1
        rows = rows.select(*others, column, other.alias("__other")).select(*others, F.when(swap, F.col("__other")).otherwise(x).alias(column))
    return rows


@dataclass
class Mix:
    """sized: rows of docs (doc_id, source, size); goals: a row a source; blocks, slots: see blocks() and slots()."""

    sized: DataFrame
    goals: DataFrame
    blocks: DataFrame
    slots: DataFrame
    few: bool


def _with_goals(rows: DataFrame, goals: DataFrame, few: bool, columns: list[str]) -> DataFrame:
    """rows (source, ...) with columns of their source's goals."""
    rows, table = rows.withColumn("skey", _source_key()), goals.select(_source_key().alias("skey"), "n_docs", *[c for c in columns if c != "n_docs"])
    got = rows.join(F.broadcast(table), "skey") if few else spread_join(rows, table, "skey", "n_docs", "inner")
    return got.drop("skey")


def _goals(sized: DataFrame, block: int, weights: tuple[float, ...], budget: float, most: float) -> tuple[DataFrame, bool]:
    """targets() with n_blocks, buckets, and places: how many slots the source is to have, whole numbers that sum up to all slots."""
    goals = targets(sized, weights, budget, most).withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_DOCS))
    # a slot of a source yields source_size / n_blocks words on average
    goals = goals.withColumn("share", F.when(F.col("n_blocks") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    goals = running(goals, [F.col("rank")], {"lo": F.col("share")}, "mix-shares").drop("place")
    # rounding the ends leaves at most a slot more than a turn's whole number of blocks
    whole = F.least(F.round(F.col("lo") + F.col("share")) - F.round("lo"), F.ceil(most * F.col("n_blocks")))
    goals = stash(goals.withColumn("hi", F.col("lo") + F.col("share")).withColumn("places", whole.cast("long")), "mix-goals")
    return goals, goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _blocks(docs: DataFrame, sized: DataFrame, goals: DataFrame, few: bool, block: int, seed: int) -> DataFrame:
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("rank", "bucket").orderBy(key, "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)

    def bucketed(rows: DataFrame) -> DataFrame:
        return _with_goals(rows, goals, few, ["rank", "buckets"]).withColumn("bucket", F.pmod(key, F.col("buckets"))).drop("buckets", "n_docs")

    totals = bucketed(sized.where("size > 0")).groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    totals = stash(totals.select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "mix-buckets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.col("text").cast("string").alias("text"))
    # not by size: the words would be counted once for the filter and once more
    texts = bucketed(texts.where(F.regexp_like("text", F.lit(f"[^{SPACES}]")))).withColumn("th", F.xxhash64("text"))
    local = texts.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(totals.hint("merge"), ["rank", "bucket"]).withColumn("start", F.col("offset") + F.col("local")).drop("bucket", "offset", "local", "th")
    # runs of `block` words of a text after as many made-up words as its first block holds already
    skip = F.col("start") % block
    runs = F.regexp_extract_all(F.concat(F.repeat(F.lit("_ "), skip.cast("int")), F.col("text")), F.lit(f"(?:[^{SPACES}]++[{SPACES}]*+){{1,{block}}}+"), 0)
    parts = placed.select("rank", "source", "doc_id", "start", "size", F.posexplode(runs).alias("i", "run"))
    first = F.greatest(F.col("i") * block - skip, F.lit(0).cast("long"))
    end = F.least((F.col("i") + 1) * block - skip, F.col("size"))
    opening = F.col("i") == 0
    return stash(
        parts.select(
            "rank", "source", (F.floor(F.col("start") / block) + F.col("i")).alias("block"), F.when(opening, skip).otherwise(F.lit(0).cast("long")).alias("at"),
            "doc_id", "start", "size", first.alias("first"), (end - first).alias("n"), F.when(opening, F.substr("run", (2 * skip + 1).cast("int"))).otherwise(F.col("run")).alias("words"),
        ), "mix-blocks",
    )


def _slots(spark: SparkSession, goals: DataFrame, few: bool, shard: int, seed: int) -> DataFrame:
    small = F.broadcast if few else (lambda df: df)
    ends = goals.agg(F.max("hi").alias("hi"), F.sum("places").alias("n"), F.count("*").alias("sources"), F.max(F.when(F.col("share") > 0, F.col("rank"))).alias("last")).first()
    n_slots, width = ends.n or 0, shuffle_width(spark)
    # every slot draws a place in [0, total); sources lie there by their shares, found by cells of equal width
    cells = max(4_096, 4 * ends.sources)
    cell = lambda c: F.least(F.floor(c / F.lit(ends.hi or 1.0) * cells), F.lit(cells - 1))
    shares = goals.where("share > 0").withColumn("hi", F.when(F.col("rank") == F.lit(ends.last), F.lit(float("inf"))).otherwise(F.col("hi")))
    shares = shares.select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.least("hi", F.lit(ends.hi or 1.0))))).alias("cell"))
    draws = spark.range(0, n_slots, 1, max(width, blocks_for(n_slots, 1 << 24)))
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("u"), "id"), F.lit(1 << BITS)) / F.lit(float(1 << BITS)) * F.lit(ends.hi or 1.0)
    draws = draws.select(F.floor(F.col("id") / shard).alias("shard"), u.alias("u")).withColumn("cell", cell(F.col("u")))
    counts = draws.join(small(shares), "cell").where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).groupBy("shard", "rank").agg(F.count("*").alias("n"))
    # a shard's draws in order of source; a source's draws in order of shard, by buckets of shards
    in_shard = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "rank", "n", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("i0"), F.floor(F.col("shard") / BUCKET_SHARDS).alias("bucket"))
    counts = stash(counts, "mix-counts")
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("rank", "bucket").agg(F.sum("n").alias("n")).select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("k0", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before.hint("merge"), ["rank", "bucket"]).withColumn("k0", F.col("k0") + F.col("offset"))
    counts = stash(counts.select("shard", "rank", "n", "i0", "k0"), "mix-places")
    # sources drawn too often hand what is past their places, in order, to those drawn too seldom
    drawn = counts.groupBy("rank").agg(F.sum("n").alias("drawn"))
    over = goals.join(drawn, "rank", "left").select("rank", "n_blocks", "places", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    over = running(over, [F.col("rank")], {"given": F.greatest(F.col("drawn") - F.col("places"), F.lit(0)), "got": F.greatest(F.col("places") - F.col("drawn"), F.lit(0))}, "mix-over").drop("place")
    over = stash(over, "mix-over")
    counts = counts.join(small(over.select("rank", "n_blocks", "places", "given")), "rank")
    m = F.least(F.lit(shard).cast("long"), F.lit(n_slots) - F.col("shard") * shard)

    def unfolded(first: Column, last: Column) -> DataFrame:
        """A row for each of a count's draws from number first to last of its source; few rows stand for many, so they are dealt out before."""
        some = counts.withColumn("a", first).withColumn("b", last).where(F.col("a") <= F.col("b")).repartition(max(width, blocks_for(n_slots, 1 << 20)), "rank", "shard")
        some = some.select("shard", "rank", "n_blocks", "i0", "k0", "given", "places", F.explode(F.sequence("a", "b")).alias("k"))
        slot = F.pmod((F.col("i0") + F.col("k") - F.col("k0")) * STRIDE + F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "shard"), m), m)
        return some.select("shard", slot.alias("slot"), "rank", "n_blocks", "k", (F.col("given") + F.col("k") - F.col("places")).alias("e"))

    end = F.col("k0") + F.col("n") - 1
    own = unfolded(F.col("k0"), F.least(end, F.col("places") - 1)).drop("e")
    late = unfolded(F.greatest("k0", "places"), end).select("shard", "slot", "e", F.floor(F.col("e") / cells).alias("cell"))
    short = over.where("places > drawn").select(F.col("rank"), "n_blocks", F.col("drawn"), F.col("got").alias("lo"), (F.col("got") + F.col("places") - F.col("drawn")).alias("hi"))
    short = short.select("*", F.explode(F.sequence(F.floor(F.col("lo") / cells), F.floor((F.col("hi") - 1) / cells))).alias("cell"))
    late = late.join(short, "cell").where((F.col("lo") <= F.col("e")) & (F.col("e") < F.col("hi"))).select("shard", "slot", "rank", "n_blocks", (F.col("drawn") + F.col("e") - F.col("lo")).alias("k"))
    picks = own.unionByName(late)
    turn = F.floor(F.col("k") / F.col("n_blocks"))
    picks = picks.select("shard", "slot", "rank", "n_blocks", (F.col("k") % F.col("n_blocks")).alias("block"), F.xxhash64(F.lit(seed), "rank", turn).alias("key"))
    return stash(permute(picks, "block", "n_blocks", "key").select("shard", "slot", "rank", "block"), "mix-slots")


def plan(
    docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0
) -> Mix:
    """Packs the blocks, draws the slots and maps them to blocks; all tables are written.

    blocks (rank, source, block, at, doc_id, start, size, first, n, words): words of a source, its
    documents in hash order, packed into blocks of `block` words, the last one shorter; a row for
    each document's slice of a block: n words from place `at` of the block and from word `first`
    of the document, as they stand in its text.  (rank, start) is the document's row, start being
    its place in its source, size its words.

    slots (shard, slot, rank, block): every slot draws its source by itself, with the sources'
    shares as chances, so the counts of a shard of `shard` slots are multinomial.  Over all
    shards a source is to have a whole number of slots (its target); slots that it drew past that
    number go, in order, to sources that were drawn less often, so targets are met to a block.  A
    source's k-th slot takes the block at the pseudorandom permutation of k modulo its number of
    blocks; every turn through the blocks has a permutation of its own.

    A null text has size 0; documents of size 0 and empty sources take no part.  A null source is
    a source of its own.  Rows that repeat, in ids or in all, are packed each; columns other than
    doc_id, text and source are not read.  Reruns agree: all draws are hashes of seed, slot,
    shard and source rank.  An empty table gives empty tables.
    """
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "mix-sizes")
    goals, few = _goals(sized, block, weights, budget, most)
    return Mix(sized, goals, _blocks(docs, sized, goals, few, block, seed), _slots(docs.sparkSession, goals, few, shard, seed), few)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix: shard, slot, source, rank, block, at, doc_id, start, first, n, words; a row for each document's slice of a slot's block.

    A shard's text is the words of its rows in order of slot and at.  options and edge cases: plan().
    """
    p = plan(docs, **options)
    # both grow with the slots or documents, which estimates of unfolded rows take for small ones: never broadcast
    return p.slots.join(p.blocks.hint("merge"), ["rank", "block"]).select("shard", "slot", "source", "rank", "block", "at", "doc_id", "start", "first", "n", "words")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source, source_size, target, taken (words of it that the mixture holds).

    taken sums the slices of the document's blocks over the slots that the blocks fill.  Documents
    of size 0 and empty sources have taken 0.  Which of two rows alike in doc_id, source and size
    comes first makes no difference to the result as a set.  options and edge cases: plan().
    """
    p = plan(docs, **options)
    uses = p.slots.groupBy("rank", "block").agg(F.count("*").alias("uses"))  # a block has as many rows of slots as turns
    parts = p.blocks.select("rank", "source", "block", "doc_id", "start", "size", "n").join(uses.hint("merge"), ["rank", "block"], "left")
    taken = parts.groupBy("rank", "start").agg(F.first("source").alias("source"), F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.col("n") * F.coalesce("uses", F.lit(0))).alias("taken"))
    rows = taken.select("doc_id", "source", "size", "taken").unionByName(p.sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    return _with_goals(rows, p.goals, p.few, ["source_size", "target"]).select("doc_id", "size", "source", "source_size", "target", "taken")
