"""Line dedup: range-partitioned line hashes in, compressed keep bitmaps per document out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrel.llm.common import SPACE, shuffle_width, spread_join, stash, text_key

#: A null doc_id stands for one document before all others.
NO_ID = -(2**63)
#: Rows of one run of equal hashes that a task holds; a longer run is settled across tasks.
RUN_ROWS = 200_000
_INT = {"h1": pa.int64(), "h2": pa.int64(), "doc": pa.int64(), "th": pa.int64(), "pos": pa.int32()}
LINES = pa.schema(list(_INT.items()))


def line_key(line: str) -> str:
    """ASCII white space stripped at both ends, A-Z in lower case."""
    return line.strip(SPACE).encode().lower().decode()


def _hash_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            h1, h2, doc, th, pos = [], [], [], [], []
            for i, text in enumerate(texts):
                for p, line in enumerate((text.as_py() or "").split("\n")):
                    key = line.strip(SPACE)
                    if len(key) >= least_chars:
                        h = xxhash.xxh3_128_digest(key.encode().lower())
                        h1.append(int.from_bytes(h[:8], "big", signed=True))
                        h2.append(int.from_bytes(h[8:], "big", signed=True))
                        doc.append(docs[i])
                        th.append(keys[i])
                        pos.append(p)
            yield pa.RecordBatch.from_pydict({"h1": h1, "h2": h2, "doc": doc, "th": th, "pos": pos}, schema=LINES)

    return run


#: kind 0: a line to drop.  1: a line of a run that other tasks may share.  2: such a run's part:
#: doc and th its first and last document, pos its number of documents, part its place in order.
SETTLED = pa.schema([("kind", pa.int8()), *_INT.items(), ("part", pa.int64())])
SETTLED_DDL = "kind byte, h1 long, h2 long, doc long, th long, pos int, part long"


def _settle(least_docs: int):
    """Streams sorted lines.  Runs inside a partition are decided at once; its first and last run are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, carry = 0, True, None

        def made(kind: int, h1, h2, doc, th, pos) -> pa.RecordBatch:
            n = len(doc)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(np.asarray(x, t)) for x, t in ((h1, np.int64), (h2, np.int64), (doc, np.int64), (th, np.int64), (pos, np.int32))), pa.array(np.full(n, part, np.int64))], schema=SETTLED)

        def open_run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal part
            h1, h2, doc, th, pos = rows
            yield made(1, h1, h2, doc, th, pos)
            yield made(2, h1[:1], h2[:1], doc[:1], doc[-1:], [1 + np.count_nonzero(doc[1:] != doc[:-1])])
            part += 1

        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(rows[0]):
                continue
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            h1, h2, doc, th, pos = rows
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            if first and len(starts) > 1:
                yield from open_run([x[: starts[1]] for x in rows])
                first, starts = False, starts[1:]
            if not first and len(starts) > 1:
                ends = np.r_[starts[1:]]
                a, b = starts[0], starts[-1]
                new_doc = np.r_[True, doc[a + 1 : b] != doc[a : b - 1]]
                new_doc[starts[:-1] - a] = True
                n_docs = np.add.reduceat(new_doc.astype(np.int64), starts[:-1] - a)
                largest = doc[ends - 1]
                of = np.repeat(np.arange(len(n_docs)), np.diff(starts))
                lose = (n_docs[of] >= least_docs) & (doc[a:b] != largest[of])
                if lose.any():
                    yield made(0, *(x[a:b][lose] for x in rows))
            carry = [x[starts[-1] :] for x in rows]
            if len(carry[0]) > RUN_ROWS:
                yield from open_run(carry)
                # what follows of this hash, if anything, is passed on as well
                first, carry = True, None
        if carry is not None:
            yield from open_run(carry)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for drops in batch.column(2):
            at = np.asarray(drops.values)
            keep = np.ones(int(at.max()) // 8 * 8 + 8, bool)  # whole bytes, so that no padding reads as dropped
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc", "th", "keep"])


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (doc, th, keep) for documents that lose lines; th is text_key().

    keep holds one bit a line, 1 for kept, packed from the high bit and deflated; lines past its
    end are kept.  Keys of at least least_chars code points that occur in at least least_docs
    documents (by doc_id) lose their lines in all but the largest doc_id.  A null doc_id is one
    document below all others (its key in doc is NO_ID); rows that repeat a doc_id are one
    document.  A null or empty text is one empty line and loses nothing; an empty table gives no
    rows; columns other than doc_id and text are not read.  Order: hash, document, text, position; equal keys are held to be equal lines if
    128 bits of their hashes agree.

    Hot lines spread over several range partitions, since the ranges go on to document and
    position; tasks pass on only their first and last runs, whose parts are then summed.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    lines = ids.mapInArrow(_hash_lines(least_chars), "h1 long, h2 long, doc long, th long, pos int")
    order = ["h1", "h2", "doc", "th", "pos"]
    ranged = lines.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    settled = stash(ranged.mapInArrow(_settle(least_docs), SETTLED_DDL), "line-runs")
    shared = Window.partitionBy("h1", "h2").orderBy("part")
    runs = settled.where("kind = 2").withColumn("again", (F.lag("th").over(shared) == F.col("doc")).cast("int"))
    runs = runs.groupBy("h1", "h2").agg((F.sum("pos") - F.coalesce(F.sum("again"), F.lit(0))).alias("n"), F.max("th").alias("largest")).where(F.col("n") >= least_docs)
    # two runs a partition, and one for each RUN_ROWS lines; a run may be of any length
    late = spread_join(settled.where("kind = 1").select("h1", "h2", "doc", "th", "pos"), stash(runs, "line-long"), ["h1", "h2"], "n", "inner").where("doc <> largest")
    drops = settled.where("kind = 0").select("doc", "th", "pos").union(late.select("doc", "th", "pos"))
    return drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("drops")).mapInArrow(_pack, "doc long, th long, keep binary")


def unpack(keep: bytes | None, n_lines: int) -> np.ndarray:
    out = np.ones(n_lines, bool)
    if keep:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines].astype(bool)
        out[: len(bits)] = bits
    return out


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, the rest joined)."""
    text = text or ""
    if not keep:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    mask = unpack(keep, len(lines))
    return len(lines), len(lines) - int(mask.sum()), "\n".join(x for x, k in zip(lines, mask, strict=True) if k)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    bitmaps = bitmaps.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("keep").alias("__keep"))
    return docs.join(bitmaps, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left")


def summary(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_sha256 of the kept lines joined by \\n.

    bitmaps are those of keep_bitmaps() for the same docs.  A null or empty text is one empty
    line; rows that repeat are described each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t.as_py(), k.as_py()) for t, k in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = _with_bitmaps(docs.select("doc_id", "text"), bitmaps).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__keep")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with their texts reduced to the kept lines; n_chars, where present, follows.

    Every row stays, also one that loses all its lines (its text is then empty).  Rows without
    dropped lines, null texts among them, are left as they are; other columns pass unchanged.
    """

    @F.arrow_udf("string")
    def rest(text: pa.Array, keep: pa.Array) -> pa.Array:
        return pa.array([kept_lines(t.as_py(), k.as_py())[2] for t, k in zip(text, keep, strict=True)], pa.string())

    joined = _with_bitmaps(docs, bitmaps)
    out = joined.withColumn("text", F.when(F.col("__keep").isNull(), F.col("text")).otherwise(rest("text", "__keep")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__keep").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
