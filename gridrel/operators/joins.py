"""Spatial, temporal and lookup joins, each planned as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.functions.algebra import M_LAT, M_LON


def metres(df: DataFrame, lat0: Column) -> DataFrame:
    """x, y in metres on an equirectangular plane."""
    return df.withColumn("x", F.col("lon") * M_LON * F.cos(F.radians(lat0))).withColumn("y", F.col("lat") * M_LAT)


def distance_join(pre: DataFrame, post: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within radius metres (inclusive): pre_<f>, post_<f>, distance_m.

    Left rows are keyed by their grid cell and right rows by each of the at most four cells that
    their circle meets: a hash join on the cell, never a nested loop.  With keys (a tile), pairs stay
    within equal keys.  The plane's latitude is the mean over both sides, of each tile by itself.
    """
    cell, reach = 2.1 * radius, 1.01 * radius  # a circle's box spans two cells each way at most, with room for rounding
    every = pre.select(*keys, "lat").unionByName(post.select(*keys, "lat"))
    lat0 = every.groupBy(*keys).agg(F.avg("lat").alias("__lat0"))  # one row, or one a tile

    def placed(df: DataFrame, back: float) -> DataFrame:
        return metres(df.join(lat0, list(keys)) if keys else df.crossJoin(F.broadcast(lat0)), F.col("__lat0")).drop("__lat0").withColumn("gx", F.floor((F.col("x") - back) / cell)).withColumn("gy", F.floor((F.col("y") - back) / cell))

    gap = lambda v, g: F.greatest(F.col(g) * cell - F.col(v), F.col(v) - (F.col(g) + 1) * cell, F.lit(0.0))
    a = placed(pre, 0.0)
    b = placed(post, reach).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("gx", F.col("gx") + (F.col("__o") >= 2).cast("int")).withColumn("gy", F.col("gy") + F.col("__o") % 2).drop("__o")
    b = b.where(gap("x", "gx") * gap("x", "gx") + gap("y", "gy") * gap("y", "gy") <= reach * reach)
    a = a.select(*[F.col(c).alias(f"pre_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"post_{c}") for c in b.columns])
    on = [F.col(f"pre_{k}") == F.col(f"post_{k}") for k in ("gx", "gy", *keys)]
    dx, dy = F.col("pre_x") - F.col("post_x"), F.col("pre_y") - F.col("post_y")
    d2 = dx * dx + dy * dy
    helper = [f"{p}_{c}" for p in ("pre", "post") for c in ("x", "y", "gx", "gy")]
    return a.join(b, on).where(d2 <= radius * radius).withColumn("distance_m", F.sqrt(d2)).drop(*helper)


def group_matches(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per left key with the array of its matches, nearest first.  Every pair moves to its key's task; count_matches moves none."""
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance_m", *fields))).alias("matches"))


def count_matches(pairs: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """One row per left key with the number of its matches n, the sums of fields (name -> field) and the nearest one's distance.

    Tasks of the join add up their pairs, and only their totals move.
    """
    return pairs.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(f).alias(name) for name, f in sums.items()], F.min("distance_m").alias("nearest"))


def as_of(targets: DataFrame, scenes: DataFrame, keys: list[str], window: int, time: str = "ms", id_: str = "target_id") -> DataFrame:
    """Left join with the nearest scene in [t - window, t + window): ties go to the smaller scene_id.

    Scenes are keyed by time buckets of one window and targets look at three, so a key's whole
    history never meets one target.
    """
    t = targets.withColumn("__b", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col(time) / window) + k)))
    s = scenes.withColumn("__b", F.floor(F.col("scene_ms") / window))
    dt = F.col("scene_ms") - F.col(time)
    near = t.join(s, [*keys, "__b"]).where((dt >= -window) & (dt < window)).withColumn("abs_dt", F.abs(dt))
    rank = Window.partitionBy(id_).orderBy("abs_dt", "scene_id")
    best = near.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select(id_, "scene_id", "scene_ms", "abs_dt")
    return targets.join(best, id_, "left")


def key_text(*cols: str) -> Column:
    """Composite key in which nulls match each other."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("UNK")) for c in cols])


def joint_as_of(targets: DataFrame, scenes: DataFrame, keys: list[str], window: int, id_: str = "target_id") -> DataFrame:
    """Nearest scene before and after with one and the same scene key, least total distance in time.

    targets: id, pre_ms, post_ms; scenes carry skey.  Returns every target with match_key,
    pre_scene_id, post_scene_id, match_total_dt and match_n_candidates (0 and nulls if no key
    occurs on both sides).
    """

    def side(name: str) -> DataFrame:
        t = targets.select(id_, *keys, F.col(f"{name}_ms").alias("ms"))
        t = t.withColumn("__b", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col("ms") / window) + k)))
        s = scenes.withColumn("__b", F.floor(F.col("scene_ms") / window))
        dt = F.col("scene_ms") - F.col("ms")
        near = t.join(s, [*keys, "__b"]).where((dt >= -window) & (dt < window))
        best = F.min(F.struct(F.abs(dt).alias("dt"), "scene_id"))
        return near.groupBy(id_, "skey").agg(best.alias("b")).select(id_, "skey", F.col("b.dt").alias(f"{name}_dt"), F.col("b.scene_id").alias(f"{name}_scene_id"))

    both = side("pre").join(side("post"), [id_, "skey"]).withColumn("total", F.col("pre_dt") + F.col("post_dt"))
    best = both.groupBy(id_).agg(F.min(F.struct("total", "skey", "pre_scene_id", "post_scene_id")).alias("m"), F.count("*").alias("n"))
    return targets.join(best, id_, "left").select(
        *targets.columns, F.col("m.skey").alias("match_key"), F.col("m.pre_scene_id").alias("pre_scene_id"), F.col("m.post_scene_id").alias("post_scene_id"),
        F.col("m.total").alias("match_total_dt"), F.coalesce("n", F.lit(0).cast("long")).alias("match_n_candidates"),
    )


def point_to_raster(points: DataFrame, pixels: DataFrame, radius: float, spacing: float, value: str, id_: str = "point_id") -> DataFrame:
    """Mean, min, max, mode and number of pixels whose centres lie within radius of each point (px, py in metres).

    Mode ties go to the smaller value.  Points without a pixel stay, with nulls.
    """
    reach = int(radius // spacing) + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    p = points.withColumn("__r", F.explode(span)).withColumn("__c", F.explode(span))
    p = p.withColumn("row", (F.floor(F.col("py") / spacing) + F.col("__r")).cast("int")).withColumn("col", (F.floor(F.col("px") / spacing) + F.col("__c")).cast("int"))
    dy, dx = (F.col("row") + 0.5) * spacing - F.col("py"), (F.col("col") + 0.5) * spacing - F.col("px")
    hit = p.where(dx * dx + dy * dy <= radius * radius).join(pixels.select("row", "col", F.col(value).alias("__v")), ["row", "col"])
    per = hit.groupBy(id_, "__v").agg(F.count("*").alias("k"))
    agg = per.groupBy(id_).agg((F.sum(F.col("k") * F.col("__v")) / F.sum(F.when(F.col("__v").isNotNull(), F.col("k")))).alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.min(F.when(F.col("__v").isNotNull(), F.struct((-F.col("k")).alias("k"), F.col("__v").alias("v"))))["v"].alias("mode"), F.sum("k").alias("n"))
    return points.select(id_).join(agg, id_, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def annotate(rows: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Left join by key; columns of notes replace columns of the same name."""
    new = [c for c in notes.columns if c != key]
    return rows.drop(*[c for c in new if c in rows.columns]).join(notes, key, "left")


def keep_first(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union in which the rows of old win over rows of new with the same key."""
    both = old.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct("__s", *rest)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def free_labels(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Labels that clash get the suffix _2, _3 and so on, in order; suffixes that make a label of another row are passed over."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    parts = rows.select(F.col(label).alias("__whole")).distinct().select(F.regexp_extract("__whole", "^(.*)_[0-9]+$", 1).alias(label), F.regexp_extract("__whole", "_([0-9]{1,9})$", 1).try_cast("long").alias("__t"))
    used = parts.where("__t is not null").groupBy(label).agg(F.collect_set("__t").alias("__used"))
    out = rows.withColumn("__n", n).join(used, label, "left").withColumn("__used", F.coalesce("__used", F.array().cast("array<bigint>")))
    free = F.element_at(F.array_except(F.sequence(F.lit(2).cast("long"), F.col("__n") + F.size("__used")), "__used"), (F.col("__n") - 1).cast("int"))
    return out.withColumn(label, F.when(F.col("__n") == 1, F.col(label)).otherwise(F.concat_ws("_", label, free.cast("string")))).select(rows.columns)
