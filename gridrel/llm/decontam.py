"""Benchmark decontamination: a prefix-filtered join of item windows against document words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.llm.common import spread_join, stash, text_key

#: A word is a run of ASCII letters and digits and of characters from U+0080 on.  The class lists
#: single characters, which the JVM keeps as one bit set; it tests ranges one after another.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows up to so many, with their words, go to every task; of more, the prefix words meet the
#: documents' words in a shuffle, in which a word has SALT keys.
BROADCAST_WINDOWS, SALT = 200_000, 16
#: Stands for a null doc_id where rows are joined by it.
NO_ID = -(2**63)


def words(text: str | Column) -> Column:
    """Words as written; empty for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of the items: their words (A-Z lowered) and item_ids (as strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))


def _found(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Verified occurrences: doc_id, th (text_key()), the first word's place at, length, items; and one row
    without place and items for each row of docs, whose length is its number of words.

    A window's words are ordered by how often they occur in all documents, the rarest first.  An
    occurrence contains every word of the window, so the necessary prefix is the rarest word
    alone.  Each document word that is some window's prefix is a candidate; the word's place in
    the window fixes where the occurrence would begin and end, which must lie in the document;
    then the document's words there are compared with the window's.
    """
    wins = stash(windows(benchmark, size), "windows")
    few = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    small = F.broadcast if few else (lambda df: df)
    # lower() may fold more than A-Z: it only makes candidates, the comparison is exact
    vocabulary = wins.select(F.explode("window").alias("w")).select(F.lower("w").alias("key")).distinct()
    tokens = docs.select(F.explode(words("text")).alias("w")).select(F.lower("w").alias("key"))
    counts = (tokens.join(small(vocabulary), "key", "left_semi") if few else tokens).groupBy("key").count()
    counts = stash(counts if few else counts.join(vocabulary, "key", "left_semi"), "rarity")
    ranked = wins.select("window", "items", F.posexplode("window").alias("place", "w")).withColumn("key", F.lower("w")).join(small(counts), "key")
    # a window with a word that no document holds occurs nowhere
    prefix = ranked.groupBy("window", "items").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "place"), F.struct("count", "key", "place")).alias("p")).where(F.col("n") == F.size("window"))
    prefix = stash(prefix.select(F.col("p.key").alias("key"), F.col("p.place").alias("place"), F.array_join("window", " ").alias("window"), F.size("window").alias("length"), "items"), "prefix")
    return _met_everywhere(docs, prefix) if few else _met_by_shuffle(docs, prefix)


def _same(begin: Column, size: Column) -> Column:
    """The window begins at that word of doc_words, of which there are so many, and its words stand there."""
    # one string against another: this stays in generated code, so that no row with doc_words is copied
    return (begin >= 0) & (begin + F.col("length") <= size) & (ascii_lower(F.array_join(F.slice("doc_words", begin + 1, F.col("length")), " ")) == F.col("window"))


def _met_everywhere(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """Every task has all prefixes: one pass over the documents."""
    # one more key, the empty word, meets the place past the last word of each row of docs
    whole = docs.sparkSession.range(1).select(F.lit("").alias("key"), *[F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("window", "string"), ("length", "int"), ("items", "array<string>"))])
    at = docs.select(F.col("doc_id"), text_key().alias("th"), F.concat(words("text"), F.array(F.lit(""))).alias("doc_words"))
    # outer: else the words would be extracted once more, for a filter of empty arrays
    at = at.select("doc_id", "th", "doc_words", F.posexplode_outer("doc_words").alias("pos", "w")).withColumn("key", F.lower("w"))
    begin = F.col("pos") - F.col("place")
    found = at.join(F.broadcast(prefix.unionByName(whole)), "key").where(F.col("place").isNull() | _same(begin, F.size("doc_words") - 1))
    return found.select("doc_id", "th", begin.alias("at"), F.coalesce("length", "pos").alias("length"), "items")


def _met_by_shuffle(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """Only places and words are shuffled to meet the prefixes; a document's words are fetched once, for its candidates."""
    rows = docs.select("doc_id", text_key().alias("th"), words("text").alias("doc_words"))
    key = lambda df: df.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALT))
    places = rows.select("doc_id", "th", F.posexplode("doc_words").alias("pos", "w")).select("doc_id", "th", "pos", F.lower("w").alias("key"), salt.alias("salt"))
    salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    begin = (F.col("pos") - F.col("place")).alias("at")
    near = key(places.join(salted, ["key", "salt"]).where(F.col("pos") >= F.col("place")).select("doc_id", "th", begin, "length", "window", "items")).drop("doc_id").distinct()
    one = key(rows).groupBy("doc", "th").agg(F.first("doc_words").alias("doc_words"), F.first("doc_id").alias("doc_id"))
    found = near.join(one.hint("merge"), ["doc", "th"]).where(_same(F.col("at"), F.size("doc_words"))).select("doc_id", "th", "at", "length", "items")
    none = F.lit(None)
    return found.unionByName(rows.select("doc_id", "th", none.cast("int").alias("at"), F.size("doc_words").alias("length"), none.cast("array<string>").alias("items")))


def _covered(spans: str) -> Column:
    """Number of places in the union of sorted (at, length) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], (s["at"] + s["length"]).cast("long"))
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], s["at"].cast("long")))).alias("n"))

    return F.aggregate(spans, zero, cover)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Items of fewer than `size` words, but not none, are one window; null or empty texts have no
    words and no hits; items_sha256 of no item is that of the empty text.  Rows that repeat a
    doc_id are judged by their own texts; a null doc_id is an id like others, a null item_id is
    the id "null".  An item that occurs twice, or items of equal text, count each by item_id.
    """
    spot = F.col("at").isNotNull()
    grouped = _found(docs, benchmark, size).groupBy("doc_id", "th").agg(
        F.count_if(~spot).alias("copies"), F.max(F.when(~spot, F.col("length"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(spot, F.struct("at", "length")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = grouped.select("doc_id", "n_words", _covered("spans").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n_hit = F.col("n_hit")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs, with their own columns, that hold no passage of the benchmark.

    A row goes if a window of `size` words occurs anywhere in it, however long it is, or if the
    windows of shorter items cover a share of one in `share` of its words.  Rows that repeat a
    doc_id, or have none, are judged by their own texts; null and empty texts stay; rows that
    repeat stay or go together.  An empty benchmark, or one without words, drops nothing.
    """
    bad = contamination_keys(docs, benchmark, size, share)
    rows = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__th": text_key()})
    bad = stash(bad.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), F.col("th").alias("__th"), "copies", F.lit(True).alias("__bad")), "contaminated")
    return spread_join(rows, bad.withColumnRenamed("copies", "__copies"), ["__doc", "__th"], "__copies").where(F.col("__bad").isNull()).select(docs.columns)


def contamination_keys(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, th, copies) of the rows that clean() drops."""
    spot = F.col("at").isNotNull()
    grouped = _found(docs, benchmark, size).groupBy("doc_id", "th").agg(
        F.count_if(~spot).alias("copies"), F.max(F.when(~spot, F.col("length"))).alias("n_words"), F.max(F.when(spot, F.col("length"))).alias("longest"),
        F.sort_array(F.collect_set(F.when(spot, F.struct("at", "length")))).alias("spans"),
    )
    n_hit = _covered("spans")
    return grouped.where((F.col("longest") >= size) | ((n_hit > 0) & (share * n_hit >= F.col("n_words")))).select("doc_id", "th", "copies")
