"""Polarimetric decompositions of covariance sets (c11, c22, c33 and complex c12, c13, c23)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.functions.algebra import clip, magnitude
from gridrel.operators.window2d import box_mean

TERMS = ["c11", "c22", "c33", "c12_re", "c12_im", "c13_re", "c13_im", "c23_re", "c23_im"]
COHERENCY = ["t11", "t22", "t33", "t12_re", "t12_im", "t13_re", "t13_im", "t23_re", "t23_im"]


def coherency(df: DataFrame, shape: tuple[int, int], window: int = 7) -> DataFrame:
    """Smoothed coherency matrix in the Pauli basis, in closed form."""
    m = box_mean(df, {t: F.col(t) for t in TERMS}, shape, window) if window > 1 else df
    c = {t: F.col(t) for t in TERMS}
    out = {
        "t11": (c["c11"] + c["c33"]) / 2 + c["c13_re"], "t22": (c["c11"] + c["c33"]) / 2 - c["c13_re"], "t33": 2 * c["c22"],
        "t12_re": (c["c11"] - c["c33"]) / 2, "t12_im": -c["c13_im"],
        "t13_re": c["c12_re"] + c["c23_re"], "t13_im": c["c12_im"] - c["c23_im"],
        "t23_re": c["c12_re"] - c["c23_re"], "t23_im": c["c12_im"] + c["c23_im"],
    }
    return m.select("row", "col", *[e.alias(k) for k, e in out.items()])


def three_component(t: DataFrame) -> DataFrame:
    """Surface, double-bounce and volume powers, as the reference defines them."""
    rest = F.col("t33") - magnitude("t13_re", "t13_im")
    zero = F.lit(0.0)
    return t.select("row", "col", F.greatest(F.col("t11") - rest, zero).alias("surface"), F.greatest(F.col("t22") - rest, zero).alias("double_bounce"), (2 * F.col("t33")).alias("volume"))


def eigenvalues(t: DataFrame) -> DataFrame:
    """Non-negative eigenvalues l1 >= l2 >= l3 by the trigonometric closed form, without a kernel."""
    c = {k: F.col(k) for k in COHERENCY}
    sq = lambda n: c[f"{n}_re"] * c[f"{n}_re"] + c[f"{n}_im"] * c[f"{n}_im"]
    q = (c["t11"] + c["t22"] + c["t33"]) / 3
    a, b, d = c["t11"] - q, c["t22"] - q, c["t33"] - q
    p = F.sqrt((a * a + b * b + d * d + 2 * (sq("t12") + sq("t13") + sq("t23"))) / 6)
    # Re(t12 t23 conj(t13))
    re = c["t12_re"] * c["t23_re"] - c["t12_im"] * c["t23_im"]
    im = c["t12_re"] * c["t23_im"] + c["t12_im"] * c["t23_re"]
    triple = re * c["t13_re"] + im * c["t13_im"]
    det = a * b * d + 2 * triple - a * sq("t23") - b * sq("t13") - d * sq("t12")
    angle = F.acos(clip(F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(0.0)), -1.0, 1.0)) / 3
    rows = t.withColumn("__q", q).withColumn("__p", p).withColumn("__a", angle)
    l1 = F.col("__q") + 2 * F.col("__p") * F.cos("__a")
    l3 = F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__a") + 2 * math.pi / 3)
    zero = F.lit(0.0)
    return rows.select(*t.columns, F.greatest(l1, zero).alias("l1"), F.greatest(3 * F.col("__q") - l1 - l3, zero).alias("l2"), F.greatest(l3, zero).alias("l3"))


def _entropy_anisotropy() -> tuple[Column, Column]:
    total = F.col("l1") + F.col("l2") + F.col("l3") + 1e-12
    p = [F.col(k) / total for k in ("l1", "l2", "l3")]
    h = -sum((x * F.log(x + 1e-12) for x in p[1:]), p[0] * F.log(p[0] + 1e-12)) / math.log(3)
    return clip(h, 0.0, 1.0), clip((p[1] - p[2]) / (p[1] + p[2] + 1e-12), 0.0, 1.0)


def entropy_anisotropy(t: DataFrame) -> DataFrame:
    h, a = _entropy_anisotropy()
    return eigenvalues(t).select("row", "col", h.alias("entropy"), a.alias("anisotropy"))


def alpha_of(rows: np.ndarray) -> np.ndarray:
    """Alpha (degrees) of the dominant eigenvector for rows of COHERENCY values; NaN rows give NaN."""
    m = np.zeros((len(rows), 3, 3), complex)
    for i, (a, b) in enumerate(((0, 0), (1, 1), (2, 2))):
        m[:, a, b] = rows[:, i]
    for k, (a, b) in zip((3, 5, 7), ((0, 1), (0, 2), (1, 2)), strict=True):
        m[:, a, b] = rows[:, k] + 1j * rows[:, k + 1]
        m[:, b, a] = rows[:, k] - 1j * rows[:, k + 1]
    ok = np.isfinite(rows).all(1)
    out = np.full(len(rows), np.nan)
    if ok.any():
        power = np.abs(np.linalg.eigh(m[ok])[1][:, :, 2]) ** 2
        out[ok] = np.degrees(np.arctan(np.sqrt((power[:, 0] + power[:, 1]) / (2 * (power[:, 2] + 1e-12)))))
    return out


def cloude_pottier(t: DataFrame) -> DataFrame:
    """entropy, anisotropy in generated code; alpha (degrees) by a batched eigen kernel over Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, 11)]
            alpha = alpha_of(np.stack(cols, 1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(11), b.column(12), pa.array(alpha, from_pandas=True)], names=["row", "col", "entropy", "anisotropy", "alpha"])

    h, a = _entropy_anisotropy()
    rows = eigenvalues(t).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(k).cast("double").alias(k) for k in COHERENCY], h.alias("entropy"), a.alias("anisotropy"))
    return rows.mapInArrow(run, "row int, col int, entropy double, anisotropy double, alpha double")


def pauli(df: DataFrame) -> DataFrame:
    """|HH - VV|, sqrt(2) |HV|, |HH + VV| of complex hh, hv, vv."""
    d = magnitude(F.col("hh_re") - F.col("vv_re"), F.col("hh_im") - F.col("vv_im"))
    s = magnitude(F.col("hh_re") + F.col("vv_re"), F.col("hh_im") + F.col("vv_im"))
    return df.select("row", "col", d.alias("red"), (math.sqrt(2) * magnitude("hv_re", "hv_im")).alias("green"), s.alias("blue"))
