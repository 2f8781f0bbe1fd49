"""The pair pipeline: masks and flags, one job over all tiles, one job over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.functions.algebra import col
from gridrel.operators import joins, rules

#: Years of loss, classes of cloud and shadow, share of cloud, limits of the inundation rules.
LOSS_YEARS, CLOUDS, CLOUD_SHARE = (20, 21, 22), (3, 8, 9, 10), 60
OPEN_WATER, WET_HH, WET_RATIO = 5e-5, 0.5, 8.0


def good_shot(quality: str | Column = "quality", degrade: str | Column = "degrade") -> Column:
    """Quality flag set and not degraded; also the mask of a monthly raster with these bands.  A missing flag fails."""
    return F.coalesce((col(quality) == 1) & (col(degrade) == 0), F.lit(False))


def lost_forest(year: str | Column, years: tuple[int, ...] = LOSS_YEARS) -> Column:
    return F.coalesce(col(year).isin(*years), F.lit(False))


def clear_pixel(scene_class: str | Column, cloud: str | Column | None = None) -> Column:
    """No cloud or shadow, of a scene with less than CLOUD_SHARE per cent of cloud."""
    ok = ~col(scene_class).isin(*CLOUDS)
    return ok if cloud is None else ok & (col(cloud) < CLOUD_SHARE)


def has_band(bands: str | Column, band: str = "HV") -> Column:
    return F.array_contains(col(bands), band)


def without_ionosphere(phase: str | Column, screen: str | Column) -> Column:
    return col(phase) - col(screen)


def centre(df: DataFrame, shape: tuple[int, int], size: int) -> DataFrame:
    """The size x size pixels in the middle."""
    r, c = (shape[0] - size) // 2, (shape[1] - size) // 2
    return df.where(F.col("row").between(r, r + size - 1) & F.col("col").between(c, c + size - 1))


def missing_share(value: str | Column) -> Column:
    return F.avg(col(value).isNull().cast("double"))


def inundation(cube: DataFrame) -> DataFrame:
    """Class of each pixel by its means over time (columns hh, hv): open_water, inundated or other."""
    means = cube.groupBy("row", "col").agg(F.avg("hh").alias("hh"), F.avg("hv").alias("hv"))
    hh, hv = F.col("hh"), F.col("hv")
    kind = F.when(hh * hv < OPEN_WATER, "open_water").when((hh > WET_HH) | (hh / F.nullif(hv, F.lit(0.0)) > WET_RATIO), "inundated").otherwise("other")
    return means.select("row", "col", kind.alias("class"))


def disturbed_tiles(shots: DataFrame, disturbed: Column, key: str = "tile_id") -> DataFrame:
    """Shots of the tiles that hold any disturbed one: whole tiles are left out before anything else is done with them."""
    hot = shots.groupBy(key).agg(F.bool_or(F.coalesce(disturbed, F.lit(False))).alias("__any")).where("__any").select(key)
    return shots.join(hot, key, "left_semi")


def tile_pairs(shots: DataFrame, disturbed: Column, distance: float = 25.0, strict: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, summary) of all tiles in one job.  shots: tile_id, side (0 before, 1 after), lon, lat and fields.

    Tiles without a disturbed shot are skipped; of the others the disturbed shots are paired
    within distance metres, inside their tile.  pairs: pre_<field>, post_<field>, distance_m,
    tile_id, within_strict.  summary: tile_id, n_pre, n_post, n_pairs_25m, n_pairs_10m, status.
    """
    hit = F.coalesce(disturbed, F.lit(False))
    used = disturbed_tiles(shots, disturbed).where(hit)
    pre, post = used.where("side = 0").drop("side"), used.where("side = 1").drop("side")
    pairs = joins.distance_join(pre, post, distance, ("tile_id",)).withColumnRenamed("pre_tile_id", "tile_id").drop("post_tile_id")
    pairs = pairs.withColumn("within_strict", F.col("distance_m") <= strict)
    every = shots.groupBy("tile_id").agg(F.count_if(hit & (F.col("side") == 0)).alias("n_pre"), F.count_if(hit & (F.col("side") == 1)).alias("n_post"))
    found = pairs.groupBy("tile_id").agg(F.count("*").alias("a"), F.count_if("within_strict").alias("b"))
    zero = F.lit(0).cast("long")
    summary = every.join(found, "tile_id", "left").select(
        "tile_id", "n_pre", "n_post", F.coalesce("a", zero).alias("n_pairs_25m"), F.coalesce("b", zero).alias("n_pairs_10m"),
        F.when(F.col("n_pre") + F.col("n_post") == 0, "skipped_no_disturbance").otherwise("ok").alias("status"),
    )
    return pairs, summary


def matched_pairs(pairs: DataFrame, scenes: DataFrame, keys: list[str], window: int, id_: str = "pair_id") -> DataFrame:
    """pairs (id, pre_ms, post_ms) with their joint scenes before and after, the scenes' values and sar_status, in one job.

    scenes: keys, scene_id, scene_ms, pass, path and band columns <band>_dn, of which a pair gets pre_<band>_dn and post_<band>_dn.
    """
    bands = [c for c in scenes.columns if c.endswith("_dn")]
    keyed = scenes.withColumn("skey", joins.key_text("pass", "path"))
    out = joins.joint_as_of(pairs, keyed.select(*keys, "scene_id", "scene_ms", "skey"), keys, window, id_)
    for side in ("pre", "post"):
        values = scenes.select(F.col("scene_id").alias(f"{side}_scene_id"), *[F.col(c).alias(f"{side}_{c}") for c in bands])
        out = joins.annotate(out, values, f"{side}_scene_id")
    return out.withColumn("sar_status", rules.status_v2("pre_scene_id", "post_scene_id", "match_n_candidates"))


def clean_pairs(pairs: DataFrame, notes: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(kept, audit): pairs annotated by notes, judged by the edge and timing rules; kept are those that pass."""
    judged = rules.audit(joins.annotate(pairs, notes, key))
    return judged.where("passes_v2c").select([c for c in judged.columns if c not in ("v2c_drop_reason", "passes_v2c")]), judged
