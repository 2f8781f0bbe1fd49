"""Token counts: an exact histogram of encoded lengths with suffix sums."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrel.llm.common import stash

#: Where the lengths of pieces are remembered, at most so many in a worker.
PIECES_KEPT = 250_000
#: Lengths to a bucket of the two-level suffix sums.
SPAN = 1024
#: Fixed value: a pattern of pieces by which a single space starts a piece.  Texts may be cut at
#: spaces under this pattern alone; under any other, whole texts are encoded at once.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: In texts without these, every single space starts a piece that encodes on its own.
_UNSAFE = re.compile(r"[^\S \n]|  | \n|\n |^ | \Z")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_encoding(path: str, pattern: str):
    return encoding_of(load_ranks(path), pattern)


def encoding_of(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class PieceLengths(dict):
    """Token counts of pieces, each with its leading space, encoded once while remembered."""

    def __init__(self, encoding, pattern: str) -> None:
        super().__init__()
        self.encoding, self.spaced = encoding, pattern == SPACED

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES_KEPT:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(" " + piece))
        return n

    def of(self, text: str) -> int:
        """len(encode_ordinary(text)): words after a single space never share a token with what precedes."""
        if not self.spaced or _UNSAFE.search(text):
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.__getitem__, rest))


def length_histogram(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Per encoded length: n_tokens and the number of documents n_docs.

    Whole texts of any length are encoded.  A null or empty text has 0 tokens.  Repeated rows
    count each.  Other columns are not read.  An empty table gives an empty histogram.
    vocabulary: a file of ranks, read on the driver and sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # of the size of the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = PieceLengths(encoding_of(sent.value, pattern), pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen[lengths.of(text.as_py() or "")] += 1
        yield pa.RecordBatch.from_pydict({"n_tokens": list(seen.keys()), "n_docs": list(seen.values())}, schema=pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    partial = docs.select(F.col(text_col)).mapInArrow(count, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: documents and tokens of that length, docs_le, docs_ge, tokens_ge, and the
    tokens kept (truncated_total) and dropped when every document is cut at that length.

    Sums run inside spans of lengths and over the spans' totals, so no task holds all lengths.
    The histogram is written once, as both read it; an empty one gives no rows.
    """
    histogram = stash(histogram, "lengths")
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("span"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("sd"), F.sum("tokens").alias("st"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("sd").over(later), F.lit(0)).alias("later_d"), F.coalesce(F.sum("st").over(later), F.lit(0)).alias("later_t"), F.sum("sd").over(Window.partitionBy()).alias("all_d"), F.sum("st").over(Window.partitionBy()).alias("all_t"))
    here = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    out = h.join(spans, "span").select(
        "n_tokens", "n_docs", "tokens",
        (F.col("later_d") + F.sum("n_docs").over(here)).alias("docs_ge"), (F.col("later_t") + F.sum("tokens").over(here)).alias("tokens_ge"), "all_d", "all_t",
    )
    kept = F.col("all_t") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return out.select("n_tokens", "n_docs", "tokens", (F.col("all_d") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"), "docs_ge", "tokens_ge", kept.alias("truncated_total"), (F.col("all_t") - kept).alias("tokens_cut"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept when documents are cut at any context limit, from the suffix sums."""
    below = F.sum(F.when(F.col("n_tokens") < limit, F.col("tokens")))
    return sums.agg((F.coalesce(below, F.lit(0)) + limit * F.coalesce(F.max(F.when(F.col("n_tokens") >= limit, F.col("docs_ge"))), F.lit(0))).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least the share q of documents do not exceed."""
    total = sums.agg(F.max("docs_ge").alias("n"))
    return sums.crossJoin(F.broadcast(total)).where(F.col("docs_le") >= F.greatest(F.lit(1.0), F.col("n") * q)).agg(F.min("n_tokens").alias("length"))
