"""Exact quantiles in every round, neighbours over strips, texture over tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import grid, raster

from gridrel.operators import quantiles as Q
from gridrel.operators import window2d as W

PROBS = [0, 0.02, 0.25, 0.5, 0.9, 0.98, 1]
RNG = np.random.default_rng(5)
COLUMNS = {
    "normal": RNG.normal(size=3001),
    "ties": RNG.integers(0, 3, 2000).astype(float),
    "wide": np.exp(RNG.normal(size=1500) * 100) * RNG.choice([-1, 1], 1500),
    "narrow": 1e6 + RNG.random(2000) * 1e-6,
    "one": np.array([5.5]),
    "ends": np.array([-np.inf, 1, 2, np.inf, 0, -0.0, 5e-324, 1.7e308, -1.7e308]),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
@pytest.mark.parametrize("direct", [Q.DIRECT, 1])
def test_quantiles_against_sorted_values(spark, name, direct):
    a = COLUMNS[name]
    df = spark.createDataFrame([(float(x),) for x in a] + [(None,)], "v double")
    got = Q.quantiles(df, {"up": F.col("v"), "down": -F.col("v"), "none": F.lit(None)}, PROBS, direct)
    for key, values in (("up", np.sort(a)), ("down", np.sort(-a))):
        at = np.array(PROBS) * (len(values) - 1)
        low, high = values[np.floor(at).astype(int)], values[np.ceil(at).astype(int)]
        want = [x if x == y else (1 - f) * x + f * y for x, y, f in zip(low, high, at - np.floor(at), strict=True)]
        assert np.allclose(got[key], want, rtol=1e-15, atol=0)
    assert got["none"] == [None] * len(PROBS)


def test_quantiles_of_an_empty_table_and_of_nan(spark):
    df = spark.createDataFrame([], "v double")
    assert Q.quantiles(df, {"v": F.col("v")}, [0.5])["v"] == [None] and Q.median(df, "v") is None
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert Q.median(nan, "v") == 2.0 and np.isnan(Q.quantiles(nan, {"v": F.col("v")}, [1.0])["v"][0])


def test_neighbours_over_several_strips(spark, monkeypatch):
    monkeypatch.setattr(W, "STRIP", 3)
    a = np.arange(56.0).reshape(7, 8)
    a[2, 3] = np.nan
    got = W.neighbours(raster(spark, a), a.shape)
    flat = [o for pair in W.DIRECTIONS for o in pair]
    for mode, letter in (("edge", "n"), ("wrap", "w")):
        padded = np.pad(a, 1, mode)
        for i, (dr, dc) in enumerate(flat):
            assert np.array_equal(grid(got, f"{letter}{i}", a.shape), padded[1 + dr : 8 + dr, 1 + dc : 9 + dc], equal_nan=True)


@pytest.mark.parametrize("tile", [4, 256])
def test_texture_over_tiles(spark, tile):
    a = RNG.gamma(3.0, 1.0, (11, 9))
    a[4, 4] = np.nan
    lo, hi = np.nanpercentile(a, [2, 98])
    level = np.nan_to_num(np.floor(np.clip((a - lo) / (hi - lo + 1e-10), 0, 1) * 15))
    got = W.texture(raster(spark, a), a.shape, 5, 16, tile=tile)
    want = {k: np.full(a.shape, np.nan) for k in ("entropy", "mean", "variance", "range")}
    for i in range(11):
        for j in range(9):
            if a[i, j] == a[i, j]:
                seen = np.array([level[y, x] for y in range(11) for x in range(9) if (y - i) ** 2 + (x - j) ** 2 <= 4])
                share = np.unique(seen, return_counts=True)[1] / len(seen)
                want["entropy"][i, j], want["mean"][i, j] = -(share * np.log2(share)).sum(), seen.mean()
                want["variance"][i, j], want["range"][i, j] = seen.var(), np.ptp(seen)
    for k, w in want.items():
        assert np.allclose(grid(got, k, a.shape), w, equal_nan=True), k


def test_complete_adds_missing_pixels(spark):
    df = spark.createDataFrame([(0, 1, 2.0)], "row int, col int, value double")
    assert sorted(tuple(r) for r in W.complete(df, (1, 2)).collect()) == [(0, 0, None), (0, 1, 2.0)]
