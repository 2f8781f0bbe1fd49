"""Two-dimensional neighbourhood operators on pixel relations (row, col, values); a missing pixel is a row with NULL, see complete()."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.functions.algebra import EPS, clip
from gridrel.operators.quantiles import cut, median, quantiles

#: Columns of a window task's strip; wider images are cut, with the window's reach repeated.
STRIP = 4096


def complete(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """All pixels of an image of that shape, NULL where df has no row."""
    grid = df.sparkSession.range(shape[0]).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))).alias("col"))
    return grid.join(df, ["row", "col"], "left")


def _padded(pos: Column, n: int, before: int, after: int, mode: str) -> Column:
    """Places at which a value at pos is seen: its own, and those that edges repeat it at."""
    own = F.array(pos)
    if mode == "truncate":
        return own
    far = max(before, after)
    if mode == "nearest":
        lead = F.when(pos == 0, F.sequence(F.lit(-far), F.lit(-1))) if far else F.lit(None)
        tail = F.when(pos == n - 1, F.sequence(F.lit(n), F.lit(n - 1 + far))) if far else F.lit(None)
    elif mode == "reflect":
        lead = F.when(pos < far, F.array(-1 - pos))
        tail = F.when(pos >= n - far, F.array(2 * n - 1 - pos))
    elif mode == "wrap":
        lead = F.when(pos >= n - far, F.array(pos - n))
        tail = F.when(pos < far, F.array(pos + n))
    else:
        raise ValueError(f"unknown edge mode {mode!r}")
    none = F.array().cast("array<int>")
    return F.concat(own, F.coalesce(lead, none), F.coalesce(tail, none))


def _pass(df: DataFrame, keys: list[str], axis: str, other: str, n: int, size: int, mode: str, sums: list[str]) -> DataFrame:
    """Moving sums along one axis; a range frame by position, so that missing pixels are no matter."""
    before, after = size // 2, size - size // 2 - 1
    seen = df.withColumn("__p", F.explode(_padded(F.col(axis).cast("int"), n, before, after, mode)))
    strips = F.array_distinct(F.array(F.floor((F.col("__p") - after) / STRIP), F.floor(F.col("__p") / STRIP), F.floor((F.col("__p") + before) / STRIP)))
    seen = seen.withColumn("__s", F.explode(strips))
    w = Window.partitionBy(*keys, other, "__s").orderBy("__p").rangeBetween(-before, after)
    out = seen.select(*keys, other, F.col("__p"), "__s", *[F.sum(c).over(w).alias(c) for c in sums])
    inside = (F.col("__p") >= 0) & (F.col("__p") < n) & (F.floor(F.col("__p") / STRIP) == F.col("__s"))
    return out.where(inside).select(*keys, other, F.col("__p").alias(axis), *sums)


def box_sums(df: DataFrame, values: dict[str, Column], shape: tuple[int, int], size: int, mode: str = "nearest", keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable size x size moving sums of each value, and n_<name>, its number of present pixels.

    Two shuffles, one for each axis, and 2 * size work a pixel instead of size ** 2.
    """
    names = list(values)
    df = df.select(*keys, "row", "col", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in values.items()], *[c.isNotNull().cast("int").alias(f"n_{k}") for k, c in values.items()])
    sums = names + [f"n_{k}" for k in names]
    once = _pass(df, list(keys), "col", "row", shape[1], size, mode, sums)
    return _pass(once, list(keys), "row", "col", shape[0], size, mode, sums)


def box_mean(df: DataFrame, values: dict[str, Column], shape: tuple[int, int], size: int, mode: str = "nearest", keys: tuple[str, ...] = ()) -> DataFrame:
    """Moving means; NULL where the window holds a missing pixel (only there)."""
    out = box_sums(df, values, shape, size, mode, keys)
    return out.select(*keys, "row", "col", *[F.when(F.col(f"n_{k}") == size * size, F.col(k) / (size * size)).alias(k) for k in values])


def _global(df: DataFrame, **aggs: Column) -> DataFrame:
    return F.broadcast(df.agg(*[c.alias(k) for k, c in aggs.items()]))  # one row


def estimate_enl(df: DataFrame, shape: tuple[int, int], size: int = 15, value: str = "value") -> DataFrame:
    v = F.col(value)
    m = box_mean(df, {"m": v, "q": v * v}, shape, size)
    return m.select("row", "col", (F.col("m") * F.col("m") / F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(EPS))).alias("enl"))


def lee_filter(df: DataFrame, shape: tuple[int, int], size: int = 5, value: str = "value") -> DataFrame:
    """Lee speckle filter: local statistics over valid pixels, edges reflected, global variance as noise."""
    v = F.col(value)
    local = box_sums(df, {"s": v, "q": v * v}, shape, size, "reflect")
    n = F.nullif(F.col("n_s"), F.lit(0))
    mean = F.col("s") / n
    var = F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))
    weight = var / (var + F.col("noise") + EPS)
    out = df.select("row", "col", v.alias("v")).join(local, ["row", "col"]).crossJoin(_global(df, noise=F.var_pop(v)))
    return out.select("row", "col", F.when(F.col("v").isNotNull(), mean + weight * (F.col("v") - mean)).alias("filtered"))


def _beside(df: DataFrame, axis: str, other: str, n: int, values: list[str]) -> DataFrame:
    """Each value's neighbours one place before (<name>-) and after (<name>+) along an axis, both ends meeting."""
    seen = df.withColumn("__p", F.explode(_padded(F.col(axis).cast("int"), n, 1, 1, "wrap")))
    seen = seen.withColumn("__s", F.explode(F.array_distinct(F.array(*[F.floor((F.col("__p") + d) / STRIP) for d in (-1, 0, 1)]))))
    at = lambda d: Window.partitionBy(other, "__s").orderBy("__p").rangeBetween(d, d)
    out = seen.select("*", *[F.max(v).over(at(d)).alias(f"{v}{sign}") for v in values for d, sign in ((-1, "-"), (1, "+"))])
    inside = (F.col("__p") >= 0) & (F.col("__p") < n) & (F.floor(F.col("__p") / STRIP) == F.col("__s"))
    return out.where(inside).drop("__p", "__s")


def neighbours(df: DataFrame, shape: tuple[int, int], value: str = "value") -> DataFrame:
    """Per pixel, the values at the eight offsets: n<i> with edges repeated, w<i> with ends meeting, in the order of DIRECTIONS.

    Two shuffles, one for each axis; every line of the image must have all its pixels, the missing ones NULL.
    """
    rows = _beside(df.select("row", "col", F.col(value).alias("v")), "col", "row", shape[1], ["v"])
    rows = rows.select(
        "row", "col", "v", F.col("v-").alias("wl"), F.col("v+").alias("wr"),
        F.when(F.col("col") > 0, F.col("v-")).otherwise(F.col("v")).alias("nl"), F.when(F.col("col") < shape[1] - 1, F.col("v+")).otherwise(F.col("v")).alias("nr"),
    )
    rows = _beside(rows, "row", "col", shape[0], ["v", "wl", "wr", "nl", "nr"])
    top, bottom = F.col("row") == 0, F.col("row") == shape[0] - 1

    def near(a: int, b: int) -> Column:
        name = {-1: "nl", 0: "v", 1: "nr"}[b]
        if a == 0:
            return F.col(name)
        return F.when(top if a < 0 else bottom, F.col(name)).otherwise(F.col(f"{name}{'-' if a < 0 else '+'}"))

    def meeting(a: int, b: int) -> Column:
        return F.col({-1: "wl", 0: "v", 1: "wr"}[b] + {-1: "-", 0: "", 1: "+"}[a])

    flat = [o for pair in DIRECTIONS for o in pair]
    return rows.select("row", "col", "v", *[near(*o).alias(f"n{i}") for i, o in enumerate(flat)], *[meeting(*o).alias(f"w{i}") for i, o in enumerate(flat)])


#: Pairs of opposite neighbours in four directions (0, 45, 90 and 135 degrees).
DIRECTIONS = [((0, -1), (0, 1)), ((-1, 1), (1, -1)), ((-1, 0), (1, 0)), ((-1, -1), (1, 1))]


def refined_lee(df: DataFrame, shape: tuple[int, int], size: int = 7, value: str = "value") -> DataFrame:
    """Half Lee estimate, half the mean of the two neighbours along the smoothest direction.

    The smoothest direction has the least second difference (edges repeated, the first wins);
    the averaged neighbours wrap around the image's borders, as the reference's do.
    """
    size, v = max(5, size), F.col(value)
    m = box_mean(df, {"m": v, "q": v * v}, shape, size)
    var = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))
    noise = cut(median(m.join(df.where(v.isNotNull()).select("row", "col"), ["row", "col"], "left_semi"), var)) + EPS
    rows = neighbours(df, shape, value).join(m.withColumn("var", var), ["row", "col"])
    diffs = [F.abs(F.col(f"n{2 * d}") + F.col(f"n{2 * d + 1}") - 2 * F.col("v")) for d in range(4)]
    best, pick = F.least(*diffs), F.lit(None).cast("double")
    for d in (3, 2, 1, 0):
        pick = F.when(diffs[d] == best, (F.col(f"w{2 * d}") + F.col(f"w{2 * d + 1}")) * 0.5).otherwise(pick)
    lee = F.col("m") + F.col("var") / (F.col("var") + noise) * (F.col("v") - F.col("m"))
    return rows.select("row", "col", (0.5 * lee + 0.5 * pick).alias("filtered"))


def contrast_homogeneity(df: DataFrame, shape: tuple[int, int], size: int = 11, value: str = "value") -> DataFrame:
    """Local standard deviation of present pixels, and homogeneity; windows end at the image's border, missing pixels stay missing."""
    v = F.col(value)
    s = box_sums(df, {"s": v, "q": v * v}, shape, size, "truncate")
    n = F.nullif(F.col("n_s"), F.lit(0))
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0)))
    ratio = sd / (mean + EPS)
    out, there = df.select("row", "col", v.alias("v")).join(s, ["row", "col"]), F.col("v").isNotNull()
    return out.select("row", "col", F.when(there, sd).alias("contrast"), F.when(there, 1 / (1 + ratio)).alias("homogeneity"))


def texture(df: DataFrame, shape: tuple[int, int], size: int = 11, levels: int = 32, value: str = "value", tile: int = 256) -> DataFrame:
    """Entropy (bits), mean, variance and range of quantised levels over a disk inside the image; pixels without a value count as level 0 and give no row.

    The variance is the true one of the levels; the reference's overflows eight bits.  Tiles with
    their border, as wide as the disk, each go to one call of a kernel: one shuffle, in which a
    pixel is sent once but for those within a radius of a tile's edge.
    """
    v, radius = F.col(value), size // 2
    lo, hi = quantiles(df, {"v": v}, [0.02, 0.98])["v"]
    q = F.floor(clip((v - cut(lo)) / (cut(hi) - cut(lo) + EPS), 0.0, 1.0) * (levels - 1)).cast("int")
    rows = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce(q, F.lit(0)).alias("q"), v.isNotNull().alias("valid"))
    for axis, name in (("row", "ti"), ("col", "tj")):
        rows = rows.withColumn(name, F.explode(F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / tile) for d in (-radius, 0, radius)]))))
    chords = [(a, int((radius * radius - a * a) ** 0.5)) for a in range(-radius, radius + 1)]

    def kernel(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile - radius, int(key[1]) * tile - radius
        grid = np.full((tile + 2 * radius, tile + 2 * radius), -1, np.int32)
        grid[p["row"].to_numpy() - top, p["col"].to_numpy() - left] = p["q"].to_numpy()
        kinds = ("n", "nlogn", "s", "s2")
        sums = {k: np.zeros((tile, tile)) for k in kinds}
        least, most = np.full((tile, tile), levels), np.full((tile, tile), -1)
        for level in np.unique(grid[grid >= 0]):
            run = np.zeros((grid.shape[0], grid.shape[1] + 1), np.int32)
            np.cumsum(grid == level, 1, out=run[:, 1:])
            n = np.zeros((tile, tile), np.int32)
            for a, b in chords:  # a disk's line is a run of pixels
                line = run[radius + a : radius + a + tile]
                n += line[:, radius + b + 1 : radius + b + 1 + tile] - line[:, radius - b : radius - b + tile]
            sums["n"] += n
            sums["nlogn"] += n * np.log2(np.maximum(n, 1))
            sums["s"] += n * float(level)
            sums["s2"] += n * float(level) ** 2
            least = np.where((n > 0) & (least == levels), level, least)
            most = np.where(n > 0, level, most)
        own = p[p["valid"] & (p["row"] // tile == key[0]) & (p["col"] // tile == key[1])]
        i, j = own["row"].to_numpy() - top - radius, own["col"].to_numpy() - left - radius
        n, nlogn, s, s2 = (sums[k][i, j] for k in kinds)
        return pd.DataFrame({"row": own["row"], "col": own["col"], "entropy": np.log2(n) - nlogn / n, "mean": s / n, "variance": s2 / n - (s / n) ** 2, "range": (most - least)[i, j]})

    return rows.groupBy("ti", "tj").applyInPandas(kernel, "row int, col int, entropy double, mean double, variance double, range int")


def coherence(df: DataFrame, shape: tuple[int, int], size: int = 5) -> DataFrame:
    """Interferogram (ifg_re, ifg_im), amplitude and coherence of columns a_re, a_im, b_re, b_im."""
    from gridrel.functions.algebra import conj_product, magnitude

    re, im = conj_product("a_re", "a_im", "b_re", "b_im")
    p1, p2 = F.pow(magnitude("a_re", "a_im"), F.lit(2)), F.pow(magnitude("b_re", "b_im"), F.lit(2))
    m = box_mean(df, {"cre": re, "cim": im, "p1": p1, "p2": p2}, shape, size)
    coh = clip(magnitude("cre", "cim") / F.greatest(F.sqrt(F.col("p1") * F.col("p2")), F.lit(EPS)), 0.0, 1.0)
    amp = F.sqrt(magnitude("a_re", "a_im") * magnitude("b_re", "b_im"))
    return df.select("row", "col", re.alias("ifg_re"), im.alias("ifg_im"), amp.alias("amplitude")).join(m.select("row", "col", coh.alias("coherence")), ["row", "col"])
