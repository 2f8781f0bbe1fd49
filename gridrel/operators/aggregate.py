"""Block, temporal and statistical aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.functions.algebra import t_cdf_tail, t_quantile
from gridrel.operators.quantiles import cut, median, quantiles


def multilook(df: DataFrame, values: list[str], shape: tuple[int, int], looks: tuple[int, int] = (2, 2)) -> DataFrame:
    """Block means over present pixels; rows and columns beyond the last whole block are left out."""
    ly, lx = looks
    inside = (F.col("row") < shape[0] // ly * ly) & (F.col("col") < shape[1] // lx * lx)
    return df.where(inside).groupBy(F.floor(F.col("row") / ly).cast("int").alias("row"), F.floor(F.col("col") / lx).cast("int").alias("col")).agg(*[F.avg(v).alias(v) for v in values])


def multilook_complex(df: DataFrame, names: list[str], shape: tuple[int, int], looks: tuple[int, int] = (2, 2)) -> DataFrame:
    """Coherent block means of complex bands <name>_re, <name>_im; a pixel with a missing part is missing."""
    parts = [f"{n}_{p}" for n in names for p in ("re", "im")]
    joint = df.select("row", "col", *[F.when(F.col(f"{n}_re").isNotNull() & F.col(f"{n}_im").isNotNull(), F.col(f"{n}_{p}")).alias(f"{n}_{p}") for n in names for p in ("re", "im")])
    return multilook(joint, parts, shape, looks)


def multilook_covariance(df: DataFrame, shape: tuple[int, int], looks: tuple[int, int] = (2, 2)) -> DataFrame:
    """Every term of a covariance set: pairs of _re, _im coherently, all others as power."""
    names = [c for c in df.columns if c not in ("row", "col")]
    cplx = sorted({c[:-3] for c in names if c.endswith("_re") and f"{c[:-3]}_im" in names})
    real = [c for c in names if c.rsplit("_", 1)[0] not in cplx or not c.endswith(("_re", "_im"))]
    guarded = df.select("row", "col", *real, *[F.when(F.col(f"{n}_re").isNotNull() & F.col(f"{n}_im").isNotNull(), F.col(f"{n}_{p}")).alias(f"{n}_{p}") for n in cplx for p in ("re", "im")])
    return multilook(guarded, guarded.columns[2:], shape, looks)


PIXEL = ["row", "col"]


def coefficient_of_variation(cube: DataFrame) -> DataFrame:
    mean = F.avg("value")
    return cube.groupBy(*PIXEL).agg(F.coalesce(F.when(mean > 1e-10, F.stddev_pop("value") / mean), F.lit(0.0)).alias("cov"))


def threshold_fraction(cube: DataFrame, low: float | None = None, high: float | None = None, least: float = 0.0) -> DataFrame:
    """Share of steps in [low, high]; a missing step is out of range and still counts as a step."""
    ok = F.col("value").isNotNull()
    ok = ok & (F.col("value") >= low) if low is not None else ok
    ok = ok & (F.col("value") <= high) if high is not None else ok
    return cube.groupBy(*PIXEL).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("fraction")).withColumn("mask", F.col("fraction") >= least)


def temporal_summary(cube: DataFrame) -> DataFrame:
    """Mean, maximum and the (first) step of the maximum over present steps."""
    return cube.groupBy(*PIXEL).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min_by("t", F.when(F.col("value").isNotNull(), F.struct(-F.col("value"), F.col("t")))).alias("argmax"))


def cusum(cube: DataFrame, baseline: int | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, summary): running sums of deviations from the mean of the first steps, and their peak.

    series: row, col, t, cusum.  summary: row, col, magnitude (largest absolute sum), change_index
    (its first step's place from 0; -1 below the threshold).  A missing step adds 0.
    """
    order = Window.partitionBy(*PIXEL).orderBy("t")
    everything = Window.partitionBy(*PIXEL)
    ranked = cube.withColumn("i", F.row_number().over(order) - 1).withColumn("steps", F.count("*").over(everything))
    first = F.lit(baseline) if baseline is not None else F.greatest(F.lit(1), F.floor(F.col("steps") / 2))
    ranked = ranked.withColumn("base", F.avg(F.when(F.col("i") < first, F.col("value"))).over(everything))
    series = ranked.select(*PIXEL, "t", "i", F.sum(F.coalesce(F.col("value") - F.col("base"), F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cusum"))
    peak = series.groupBy(*PIXEL).agg(F.min(F.struct((-F.abs("cusum")).alias("neg"), "i")).alias("p")).select(*PIXEL, (-F.col("p.neg")).alias("magnitude"), F.col("p.i").alias("i"))
    index = F.col("i") if threshold is None else F.when(F.col("magnitude") >= threshold, F.col("i")).otherwise(-1)
    return series.select(*PIXEL, "t", "cusum"), peak.select(*PIXEL, "magnitude", index.cast("int").alias("change_index"))


def harmonic_fit(cube: DataFrame, period: float = 365.25, time: str = "time") -> DataFrame:
    """Per pixel a0, amplitude, phase, rmse of a0 + a1 cos wt + a2 sin wt, by nine sums and Cramer's rule.

    Missing steps are left out; pixels whose system is singular are left out as well.
    """
    w = 2 * math.pi / period
    c, s, y = F.cos(w * F.col(time)), F.sin(w * F.col(time)), F.col("value")
    rows = cube.where("value is not null").select(*PIXEL, c.alias("c"), s.alias("s"), y.alias("y"))
    m = rows.groupBy(*PIXEL).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in {"sc": F.col("c"), "ss": F.col("s"), "cc": F.col("c") * F.col("c"), "cs": F.col("c") * F.col("s"), "qq": F.col("s") * F.col("s"), "sy": F.col("y"), "cy": F.col("c") * F.col("y"), "qy": F.col("s") * F.col("y"), "yy": F.col("y") * F.col("y")}.items()],
    )

    def det(a: list[list[str]]) -> Column:
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = [[F.col(x) for x in r] for r in a]
        return a0 * (b1 * c2 - b2 * c1) - a1 * (b0 * c2 - b2 * c0) + a2 * (b0 * c1 - b1 * c0)

    full = [["n", "sc", "ss"], ["sc", "cc", "cs"], ["ss", "cs", "qq"]]
    right = ["sy", "cy", "qy"]
    part = lambda k: det([[right[i] if j == k else full[i][j] for j in range(3)] for i in range(3)])
    d = det(full)
    m = m.withColumn("d", d).where(F.abs("d") > 1e-9)
    m = m.select("*", (part(0) / F.col("d")).alias("a0"), (part(1) / F.col("d")).alias("a1"), (part(2) / F.col("d")).alias("a2"))
    rss = F.col("yy") - F.col("a0") * F.col("sy") - F.col("a1") * F.col("cy") - F.col("a2") * F.col("qy")
    return m.select(*PIXEL, F.col("a0").alias("intercept"), F.sqrt(F.col("a1") * F.col("a1") + F.col("a2") * F.col("a2")).alias("amplitude"), F.atan2("a2", "a1").alias("phase"), F.sqrt(F.greatest(rss, F.lit(0.0)) / F.col("n")).alias("rmse"))


def harmonic_series(cube: DataFrame, fit: DataFrame, period: float = 365.25, time: str = "time") -> DataFrame:
    """Fitted values and residuals per step."""
    fitted = F.col("intercept") + F.col("amplitude") * F.cos(2 * math.pi / period * F.col(time) - F.col("phase"))
    return cube.join(fit, PIXEL).select(*PIXEL, "t", fitted.alias("fitted"), (F.col("value") - fitted).alias("residual"))


def fit_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2, se_slope, se_intercept, n, x_mean."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("x_mean"), F.count("*").alias("n"))
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)) * F.col("syy") / F.nullif(F.col("sxx"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0))))
    return m.withColumn("se_slope", se).select("slope", "intercept", "r2", "se_slope", (F.col("se_slope") * F.sqrt(F.col("sxx") / F.col("n") + F.col("x_mean") * F.col("x_mean"))).alias("se_intercept"), "n", "x_mean")


def p_value(fit: dict) -> float:
    """Two-sided p of a fitted slope (one row of fit_ols as a mapping)."""
    return t_cdf_tail(fit["slope"] / fit["se_slope"], fit["n"] - 2)


def ci_band(df: DataFrame, x: str, fit: DataFrame, n: int, alpha: float = 0.05, points: int = 200) -> DataFrame:
    """Fitted line with its band on an even grid over x."""
    t = t_quantile(alpha, n - 2)
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    grid = df.sparkSession.range(points).crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(fit)).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("id") / (points - 1))
    y = F.col("intercept") + F.col("slope") * F.col("x")
    se = F.sqrt(F.pow("se_intercept", F.lit(2)) + F.pow(F.col("x") - F.col("x_mean"), F.lit(2)) * F.pow("se_slope", F.lit(2)))
    return grid.select(F.col("id").cast("int").alias("i"), "x", y.alias("y"), (y - t * se).alias("lower"), (y + t * se).alias("upper"))


def binned_medians(df: DataFrame, x: str, y: str, bins: int = 7, least: int = 3, rows: int = 30) -> DataFrame:
    """Centre, median and quartiles of y in quantile bins of x, left-closed, the last closed; NULL for bins of fewer than `least`.

    No bins for fewer than `rows` points, or fewer than three distinct edges.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    edges = sorted({e for e in quantiles(both, {"x": F.col("x")}, [k / bins for k in range(bins + 1)])["x"] if e is not None})
    enough = both.count() >= rows and len(edges) >= 3
    at = F.least(sum((F.when(F.col("x") >= e, 1).otherwise(0) for e in edges), F.lit(0)), F.lit(max(1, len(edges) - 1))).cast("int")
    both = both.withColumn("bin", at).where(F.lit(enough))
    places = range(1, len(edges)) if enough else []
    per = quantiles(both, {str(k): F.when(F.col("bin") == k, F.col("y")) for k in places}, [0.5, 0.25, 0.75]) if enough else {}
    found = [(k, (edges[k - 1] + edges[k]) / 2, *per[str(k)]) for k in places]
    found = df.sparkSession.createDataFrame(found, "bin int, centre double, median double, q25 double, q75 double")
    keep = F.col("n") >= least
    out = both.groupBy("bin").agg(F.count("*").alias("n")).join(F.broadcast(found), "bin")  # a row a bin
    return out.select("bin", "centre", "n", *[F.when(keep, F.col(k)).alias(k) for k in ("median", "q25", "q75")])


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width counts between minimum and maximum, the last bin closed."""
    v = F.col(value)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    share = (v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).select(F.coalesce(F.least(F.lit(bins - 1), F.floor(share * bins)), F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def trim_mad(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows within k raw median deviations of the median; all rows if the deviation is 0 or there are none."""
    away = F.abs(F.col(column) - cut(median(df, column)))
    mad = median(df, away)
    return df if mad == 0 else df.where(away <= k * cut(mad))


def power_transform(df: DataFrame, value: str, gamma: float = 0.5) -> DataFrame:
    """Min-max over values of at least 0, clipped, raised to gamma and scaled back; all NULL if there is no range."""
    v = F.col(value)
    ends = df.agg(F.min(F.when(v >= 0, v)).alias("lo"), F.max(F.when(v >= 0, v)).alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lo")) / width))
    return df.crossJoin(F.broadcast(ends)).withColumn("power", F.when(v.isNotNull() & width.isNotNull(), F.pow(unit, F.lit(gamma)) * width + F.col("lo"))).drop("lo", "hi")
