"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.llm.common import stash

NGRAMS = (3, 4, 5)
BITS = 20
#: Labelled rows that are learnt from, at most: of each class, those whose ids hash lowest.
#: The intercept is that of all labelled rows, whatever share of each class was taken.
MOST_TOXIC, MOST_CLEAN = 2_000, 6_000
#: n-grams kept by their chi-square, out of those in at least LEAST_DOCS labelled documents.
FEATURES, LEAST_DOCS = 4_096, 3
#: Characters that are hashed at once; a long text takes several turns.
TURN = 1 << 18
_SALT = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def ngram_ids(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes below 2**BITS of the n-grams of code points, for one n after another."""
    scaled = [data * _SALT[j] for j in range(max(NGRAMS))]
    for n in NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = scaled[0][:m] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        for j in range(1, n):
            h *= np.uint32(0x01000193)
            h += scaled[j][j : j + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield h >> np.uint32(32 - BITS)


def _turns(text: str | None) -> Iterator[np.ndarray]:
    data = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    for at in range(0, max(len(data) - min(NGRAMS) + 1, 0), TURN):
        yield data[at : at + TURN + max(NGRAMS) - 1]


def present(text: str | None, keep: np.ndarray) -> np.ndarray:
    """Sorted distinct ids of the text's n-grams where keep (one value an id) is not zero."""
    found = [np.empty(0, np.uint32)]
    for data in _turns(text):
        for ids in ngram_ids(data):
            found.append(np.unique(ids[keep[ids] != 0]))
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    weights: np.ndarray  # one an id, log-count ratio included
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[present(text, self.weights)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _train_rows(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[DataFrame, float]:
    """(text, toxic) of the labelled training rows, bounded; an id labelled twice counts as its largest label.

    With them the log ratio of the shares taken, toxic over clean, of all labelled ids: what a
    model of these rows has too much in its log-odds.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.coalesce(train, F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # a row a class
    over = math.log(min(1, MOST_TOXIC / n.get(1, 1)) / min(1, MOST_CLEAN / n.get(0, 1)))
    some = marks.where("toxic = 1").orderBy("h", "doc_id").limit(MOST_TOXIC).union(marks.where("toxic = 0").orderBy("h", "doc_id").limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN ids
    some = some.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    return docs.join(F.broadcast(some), docs["doc_id"] == F.col("__id")).select(F.col("text").cast("string").alias("text"), F.col("__toxic").alias("toxic")), over


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = np.ones(1 << BITS, np.uint8)
    n, seen = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            n[toxic] += 1
            seen[toxic, present(text.as_py(), every)] += 1
    ids = np.flatnonzero(seen.any(0)).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"n": [n.tolist()], "ids": [ids.tobytes()], "seen": [seen[:, ids].tobytes()]}, schema=pa.schema([("n", pa.list_(pa.int64())), ("ids", pa.binary()), ("seen", pa.binary())]))


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """Learns from the rows of labels where `train` holds.  Without both classes, the score is the smoothed share."""
    rows, over = _train_rows(docs, labels, train)
    rows = stash(rows.repartition(6), "toxic-train")
    n, seen = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int64)
    for part in rows.mapInArrow(_counts, "n array<long>, ids binary, seen binary").collect():  # 6 rows
        n += part.n
        ids = np.frombuffer(part.ids, np.int32)
        seen[:, ids] += np.frombuffer(part.seen, np.int32).reshape(2, -1)
    weights, (n0, n1) = np.zeros(1 << BITS, np.float32), n.tolist()
    if not n0 or not n1:
        return Model(weights, float(np.log((n1 + 1) / (n0 + 1))) - over)
    a, b = seen[1].astype(float), seen[0].astype(float)
    total, share = a + b, n1 / (n0 + n1)
    expected = total * share
    chi = (a - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - total / (n0 + n1)), 1e-9)
    chi[(total < LEAST_DOCS) | (total >= n0 + n1)] = 0
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[chi[chosen] > 3.84])
    ratio = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    place = np.zeros(1 << BITS, np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [(place[present(t.as_py(), place)] - 1).astype(np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column(1)], names=["ids", "toxic"])

    got = rows.mapInArrow(vectors, "ids binary, toxic int").collect()  # bounded rows of few features each
    xs, y = [np.frombuffer(r.ids, np.int32) for r in got], np.array([r.toxic for r in got], float)
    at, col = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate([np.empty(0, np.int32), *xs])
    r = ratio[chosen]
    w, bias = _logistic(at, col, r, y)
    weights[chosen] = (w * r).astype(np.float32)
    return Model(weights, bias - over)


def _logistic(at: np.ndarray, col: np.ndarray, r: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on the scaled sparse rows, by Adam on the whole batch."""
    w, bias = np.zeros(len(r)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    value = r[col]
    for t in range(1, steps + 1):
        z = bias + np.bincount(at, value * w[col], len(y))
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, value * d[at], len(r)) + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1 (higher: likelier toxic).

    A null or empty text is scored like one without any known n-gram.  Only text is read; a
    column of docs that has the given name already is replaced.  Texts of any length are hashed
    whole, TURN characters at a time.  Rows that repeat score alike; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 2**BITS floats

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        m = Model(*sent.value)
        return pa.array([m.score(t.as_py()) for t in text], pa.float64())

    return docs.withColumn(name, of(F.col("text").cast("string")))
