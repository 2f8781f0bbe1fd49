"""Exact quantiles of whole columns, found by narrowing counts, so that no task holds a column's distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Cells of a doubling in the first round, parts of a cell in the later ones, rows that are ranked at once.
OCTAVE, PARTS, DIRECT = 256, 1 << 20, 1 << 20


def _magnitude(v: Column) -> Column:
    """A number that never falls as v grows, equal for values within one part of OCTAVE."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1025.0)).otherwise(F.log2(F.abs(v)))
    cell = F.floor(size * OCTAVE) + 1100 * OCTAVE  # positive for every double
    return F.when(F.isnan(v), F.lit(3000 * OCTAVE)).when(v > 0, cell).when(v < 0, -cell).otherwise(F.lit(0)).cast("long")


def _ranked(cells: DataFrame, by: list[str], order: str, want: DataFrame) -> list:
    """The cells that hold wanted ranks, with the rank inside the cell; one row a rank."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    hit = cells.withColumn("upto", upto).join(F.broadcast(want), by)  # one row for each wanted rank
    hit = hit.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.withColumn("rank", F.col("rank") - F.col("upto") + F.col("n")).collect()


def around(df: DataFrame, values: dict[str, Column], probs: list[float] | dict[str, list[float]], direct: int = DIRECT) -> dict[str, list[tuple[float, float, float] | None]]:
    """name -> for each of probs the values at the ranks below and above it and its place between them (0 to 1); None for a column without values.

    NULL is no value; NaN is greater than all others.  Each round is a job that reads df, counts
    cells in every task and moves only the counts: first some 300 cells a decade of values, at
    most 10^6 in all, then PARTS equal parts of the few cells that hold a wanted rank, until such
    a cell holds at most `direct` rows or one value; then its values are counted.  Three rounds
    are enough for any doubles, as a part of a part of a cell holds some tens of them.  The driver
    gets two rows for each probability, whatever df holds.
    """
    names = list(values)
    wanted = [probs[k] if isinstance(probs, dict) else probs for k in names]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), c.cast("double").alias("v")) for i, c in enumerate(values.values())])).alias("x"))
    rows = rows.select("x.k", (F.col("x.v") + 0.0).alias("v")).where("v is not null")
    rows = rows.withColumn("cell", _magnitude(F.col("v")))
    spark = df.sparkSession

    cells = rows.groupBy("k", "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = F.sum("n").over(Window.partitionBy("k"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cells = cells.withColumn("before", before).withColumn("total", total)
    asked = F.create_map(*[e for i, p in enumerate(wanted) for e in (F.lit(i), F.array(*[F.lit(float(q)) for q in p]))])
    at = (F.col("total") - 1) * F.col("p")
    hit = cells.select("*", F.posexplode(asked[F.col("k")]).alias("j", "p"))
    hit = hit.select("*", at.alias("at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank"))
    hit = hit.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    found: dict[tuple[int, int], dict[int, float]] = {}
    place: dict[tuple[int, int], float] = {}
    open_ = []
    for r in hit.collect():
        place[r.k, r.j] = r["at"]
        open_.append((r.k, r.j, r["rank"], r["rank"] - r.before, r.cell, r.n, r.lo, r.hi))

    def close(k: int, j: int, rank: int, value: float) -> None:
        found.setdefault((k, j), {})[rank] = value

    path = ["cell"]
    fields = [StructField("k", LongType()), StructField("cell", LongType())]
    while open_:
        rest = []
        for r in open_:
            n, lo, hi = r[-3:]
            close(r[0], r[1], r[2], lo) if lo == hi or (lo != lo and hi != hi) else rest.append(r)
        if not rest:
            break
        by = ["k", *path]
        last = all(r[-3] <= direct for r in rest) or len(path) > 2
        bounds = {(r[0], *r[4:-3]): (r[-2], r[-1]) for r in rest}
        known = spark.createDataFrame([(*key, *b) for key, b in bounds.items()], StructType([*fields, StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
        want = spark.createDataFrame([(r[0], *r[4:-3], r[1], r[2], r[3]) for r in rest], StructType([*fields, StructField("j", LongType()), StructField("which", LongType()), StructField("rank", LongType())]))
        rows = rows.join(F.broadcast(known), by)
        if last:
            counted = rows.groupBy(*by, "v").agg(F.count("*").alias("n"))
            for r in _ranked(counted, by, "v", want):
                close(r.k, r.j, r.which, r.v)
            break
        part = f"part{len(path)}"
        # Halves first, so that the width of a cell never overflows.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        rows = rows.withColumn(part, F.when(F.col("hi") > F.col("lo"), F.floor(share * (PARTS - 1))).otherwise(F.lit(0)).cast("long")).drop("lo", "hi")
        counted = rows.groupBy(*by, part).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        path, fields = [*path, part], [*fields, StructField(part, LongType())]
        open_ = [(r.k, r.j, r.which, r["rank"], *[r[p] for p in path], r.n, r.lo, r.hi) for r in _ranked(counted, by, part, want)]

    def ends(i: int, j: int) -> tuple[float, float, float] | None:
        if (i, j) not in place:
            return None
        at, got = place[i, j], found[i, j]
        return got[math.floor(at)], got[math.ceil(at)], at - math.floor(at)

    return {k: [ends(i, j) for j in range(len(wanted[i]))] for i, k in enumerate(names)}


def quantiles(df: DataFrame, values: dict[str, Column], probs: list[float] | dict[str, list[float]], direct: int = DIRECT) -> dict[str, list[float | None]]:
    """name -> its values' quantiles at probs, linear between ranks; None for a column without values."""

    def value(a: float, b: float, part: float) -> float:
        return a if a == b else (1 - part) * a + part * b

    return {k: [None if x is None else value(*x) for x in found] for k, found in around(df, values, probs, direct).items()}


def cut(value: float | None) -> Column:
    """A found quantile as a column, NULL where there is none."""
    return F.lit(value).cast("double")


def median(df: DataFrame, value: str | Column) -> float | None:
    """The exact median of a column, None without values."""
    return quantiles(df, {"v": F.col(value) if isinstance(value, str) else value}, [0.5])["v"][0]


def off_median(df: DataFrame, value: str) -> Column:
    """Distance of a column's values beyond the two in the middle of df, 0 for both of them.

    It orders rows as their distance from the median does, but where an even number of rows has
    two in the middle, equally far from it, no rounding of that distance tells them apart.
    """
    a, b, _ = around(df, {"v": F.col(value)}, [0.5])["v"][0] or (None, None, None)
    return F.when(F.col(value).isNotNull(), F.greatest(cut(a) - F.col(value), F.col(value) - cut(b), F.lit(0.0)))
