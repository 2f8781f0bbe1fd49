"""Exact top-k search by term-at-a-time accumulation over query blocks and candidate blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.llm.common import blocks_for, hash_bucket

#: Rows of a score array (queries) and of a candidate block; together they bound a task's memory.
QUERY_BLOCK, CANDIDATE_BLOCK, SCORE_ROWS = 1024, 8192, 128


def quantised(vec: str, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vec: str) -> Column:
    """Not null and without null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & finite, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Dense rows; vectors shorter than the longest are sparse rows with zeros at the end."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query against every candidate, one term (component) after another."""
    terms = min(queries.shape[1], candidates.shape[1])
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(terms, 1)
    kind = np.int32 if peak < 2**31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    q, c = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    buffer = np.empty_like(scores)
    for t in range(terms):
        rows = np.flatnonzero(q[:, t])
        posts = np.flatnonzero(c[t])
        if not len(rows) or not len(posts):
            continue
        if 2 * len(posts) < len(candidates) or 2 * len(rows) < len(queries):
            scores[np.ix_(rows, posts)] += q[rows, t][:, None] * c[t, posts]
        else:
            np.multiply(q[:, t][:, None], c[t], out=buffer)
            scores += buffer
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, by selection and not a full sort."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        keep = np.concatenate([above, level])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep].astype(np.int64)))]


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row where `queries` holds, the k rows of highest inner product of floor(scale * x).

    Returns query_id, rank (from 1), vec_id, score.  Every usable row is a candidate for every
    query of another id.  Rows with a null id, and vectors that are null or hold null or
    non-finite components, take no part.  Vectors of unlike length are sparse rows over the
    same terms: missing components are zero.  Rows that repeat an id: each is a candidate, none
    is a candidate for a query of its own id, and the id is queried once, with its least vector.
    An empty table gives an empty result.  Scores are exact while they fit in 63 bits.

    Both sides are dealt into blocks by a hash of the id; a task scores one query block against
    one candidate block, so neither a hot vector nor the table's size changes a task's memory.
    Only k rows a query and block leave a task.
    """
    rows = df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantised(vec_col, scale).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    asked = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    n_q, n_c = blocks_for(size.q, QUERY_BLOCK), blocks_for(size.n, CANDIDATE_BLOCK)
    dealt_q = asked.select("id", "vec", F.lit(True).alias("asks"), hash_bucket(n_q, "id", seed=1).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    dealt_c = rows.select("id", "vec", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), hash_bucket(n_c, "id", seed=2).cast("int").alias("cb"))

    def scan(block: pd.DataFrame) -> pd.DataFrame:
        q, c = block[block.asks], block[~block.asks]
        out: list[tuple[int, int, int]] = []
        if len(q) and len(c):
            qi, ci = q.id.to_numpy(), c.id.to_numpy()
            qm, cm = _matrix(q.vec), _matrix(c.vec)
            for at in range(0, len(qi), SCORE_ROWS):
                scores = accumulate(qm[at : at + SCORE_ROWS], cm)
                for row, query in zip(scores, qi[at : at + SCORE_ROWS], strict=True):
                    other = np.flatnonzero(ci != query)
                    best = other[_best(row[other], ci[other], k)]
                    out += [(query, ci[j], row[j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = dealt_q.unionByName(dealt_c).groupBy("qb", "cb").applyInPandas(scan, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
