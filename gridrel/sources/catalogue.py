"""Scene catalogues: search, links, sizes, paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.functions.algebra import col
from gridrel.functions.geo import BBox, validate_bbox

#: Layers by product, with those a subset takes by default.
LAYERS = {
    "GCOV": ("HHHH", "HVHV", "VVVV", "VHVH"),
    "GSLC": ("HH", "HV", "VV", "VH"),
    "GUNW": ("unwrappedPhase", "coherenceMagnitude", "connectedComponents", "ionospherePhaseScreen", "ionospherePhaseScreenUncertainty", "wrappedInterferogram"),
    "GOFF": ("alongTrackOffset", "slantRangeOffset", "snr"),
    "RSLC": ("HH", "HV", "VV", "VH"),
}
COVARIANCE = {"HH": "HHHH", "HV": "HVHV", "VV": "VVVV", "VH": "VHVH"}


def search(catalogue: DataFrame, product: str | None = None, bbox: BBox | None = None, start=None, end=None, limit: int | None = 100) -> DataFrame:
    """Granules of a product whose box meets bbox and whose start_time lies in [start, end), in id order."""
    out = catalogue
    if product:
        out = out.where(F.col("product_type") == product)
    if bbox:
        w, s, e, n = validate_bbox(bbox)
        out = out.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    if start is not None:
        out = out.where(F.col("start_time") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("start_time") < F.lit(end))
    return out if limit is None else out.orderBy("granule").limit(limit)


def search_gcov(catalogue: DataFrame, bbox: BBox | None = None, start=None, end=None, limit: int | None = 100) -> DataFrame:
    return search(catalogue, "GCOV", bbox, start, end, limit)


#: Fixed value: the cloud region that holds the archive, from which alone direct access works.
REGION = "us-west-2"


def granule_url(links: str | Column, access: str = "auto", region: str | None = None) -> Column:
    """The first link of the scheme asked for ("s3" or "https"); "auto" is s3 in REGION and https elsewhere.  A row without one is an error."""
    if access not in ("auto", "s3", "https"):
        raise ValueError(f"access is auto, s3 or https, not {access!r}")
    scheme = access if access != "auto" else "s3" if region == REGION else "https"
    first = F.get(F.filter(col(links), lambda x: x.startswith(f"{scheme}://")), F.lit(0))
    return F.coalesce(first, F.raise_error(F.lit(f"no {scheme} link among the granule's")).cast("string"))


def result_size(properties: str | Column, name: str | Column) -> Column:
    """Bytes of a search result from its JSON: a number, or a mapping with the file's own entry, a number
    named bytes, or one entry alone, in this order; entries are numbers or {"bytes": n}."""
    p = col(properties)
    at = F.get_json_object(p, "$.bytes")
    entries = F.from_json(at, "map<string,string>")
    own = F.try_element_at(entries, col(name))
    sole = F.when(F.size(F.map_values(entries)) == 1, F.get(F.map_values(entries), F.lit(0)))
    number = lambda c: F.coalesce(c.try_cast("long"), F.get_json_object(c, "$.bytes").try_cast("long"))
    return F.coalesce(at.try_cast("long"), number(own), F.try_element_at(entries, F.lit("bytes")).try_cast("long"), number(sole))


def exact_or_nearest(targets: DataFrame, scenes: DataFrame, tolerance: int) -> DataFrame:
    """Scene of exactly the target's time, else the first in [time - tolerance, time + tolerance); both of its pass and path.

    targets: target_id, ms, pass, path, of which a null pass or path admits any; scenes: scene_id,
    scene_ms, scene_pass, scene_path.  A target without a time has no scene.

    Scenes are put in buckets of time as wide as the window, under each pass and path that admits
    them.  A target asks three times for the first scene of a bucket from some time on: from its own
    time, from the window's start, and from the next bucket's start.  A running value over the
    bucket, from its end to its start, answers, so no target meets the scenes of its window one by one.
    """
    width = 2 * tolerance
    either = lambda name: (F.col(name), F.lit(None).cast(scenes.schema[name].dataType))
    ways = F.array_distinct(F.array(*[F.struct(a.alias("pass"), b.alias("path")) for a in either("scene_pass") for b in either("scene_path")]))
    s = scenes.where("scene_ms is not null and scene_id is not null").select("scene_id", "scene_ms", F.explode(ways).alias("w"))
    s = s.select("w.pass", "w.path", F.col("scene_ms").alias("__at"), "scene_ms", "scene_id")
    after = (F.floor((F.col("ms") - tolerance) / width) + 1) * width
    asked = F.array(*[F.struct(F.lit(k == 0).alias("exact"), at.cast("long").alias("at")) for k, at in enumerate((F.col("ms"), F.col("ms") - tolerance, after))])
    t = targets.where("ms is not null").select("target_id", "ms", "pass", "path", F.explode(asked).alias("q"))
    rows = s.unionByName(t.select("pass", "path", F.col("q.at").alias("__at"), "target_id", "ms", F.col("q.exact").alias("exact")), allowMissingColumns=True)
    back = Window.partitionBy("pass", "path", "__b").orderBy(F.desc("__at"), F.desc_nulls_last("scene_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__b", F.floor(F.col("__at") / width)).withColumn("found_ms", F.last("scene_ms", True).over(back)).withColumn("found_id", F.last("scene_id", True).over(back))
    hit = rows.where(F.when(F.col("exact"), F.col("found_ms") == F.col("ms")).otherwise(F.col("found_ms") < F.col("ms") + tolerance))
    hit = hit.groupBy("target_id").agg(F.min(F.when(F.col("exact"), F.col("found_id"))).alias("exact_id"), F.min(F.when(~F.col("exact"), F.struct("found_ms", "found_id")))["found_id"].alias("near_id"))
    return targets.join(hit, "target_id", "left").select("target_id", F.coalesce("exact_id", "near_id").alias("scene_id"), F.col("exact_id").isNotNull().alias("is_exact"))


def dataset_path(product: str, frequency: str, layer: str, polarization: str = "HH", posting: int | None = None) -> str:
    """Path of a dataset inside a product file; ValueError for an unknown product or layer."""
    if product not in LAYERS:
        raise ValueError(f"unsupported product {product!r}")
    layer = COVARIANCE.get(layer, layer) if product == "GCOV" else layer
    if product in ("GUNW", "GOFF") and layer not in LAYERS[product]:
        raise ValueError(f"unknown layer {layer!r}")
    root = f"/science/LSAR/{product}/{'swaths' if product == 'RSLC' else 'grids'}/frequency{frequency}"
    if product == "GUNW":
        return f"{root}/{gunw_group(layer, posting)}/{polarization}/{layer}"
    return f"{root}/pixelOffsets/{polarization}/{layer}" if product == "GOFF" else f"{root}/{layer}"


def gunw_group(layer: str, posting: int | None = None) -> str:
    """Group of a layer: wrapped layers lie at 20 m, all others at 80 m; the coherence at both."""
    if posting not in (None, 20, 80):
        raise ValueError("posting is 20 or 80")
    if layer == "wrappedInterferogram":
        return "wrappedInterferogram"
    if posting == 20 and layer != "coherenceMagnitude":
        raise ValueError(f"{layer} has no 20 m posting")
    return "wrappedInterferogram" if posting == 20 else "unwrappedInterferogram"


def item_size(layer: str | Column, product: str | Column | None = None) -> Column:
    """Bytes of a pixel: 8 for complex layers and complex products, 2 for component labels, else 4."""
    l, p = col(layer), F.lit("") if product is None else col(product)
    return F.when(p.isin("GSLC", "RSLC"), 8).when(l == "connectedComponents", 2).when(l.isin("wrappedInterferogram", "HHHV", "HHVV", "HVVV"), 8).otherwise(4)


def subset_size(rows: DataFrame) -> DataFrame:
    """Bytes of each granule's window: rows x columns x item size, summed over its layers; rows may name their product_type."""
    size = item_size("layer", "product_type" if "product_type" in rows.columns else None)
    return rows.groupBy("granule").agg(F.sum(F.col("height") * F.col("width") * size).cast("long").alias("bytes"))


def calibration_of(name: str | Column) -> Column:
    """Calibration that a file's name tells: sigma0 before all else, gamma0 for gamma, db or linear."""
    n = F.lower(col(name))
    return F.when(n.contains("sigma0"), "sigma0").when(n.contains("gamma") | n.contains("db") | n.contains("linear"), "gamma0").otherwise("unknown")


def granule_stem(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"([^/?]+?)(?:\.[A-Za-z0-9]+)?(?:\?.*)?$", 1)


def output_name(product, frequency, polarization, layer, date=None) -> Column:
    """<product>_freq<frequency>_<polarization>_<layer>[_<date>]_subset.tif; the date is the first ten characters of a time."""
    day = F.lit(None) if date is None else F.nullif(F.substring(col(date), 1, 10), F.lit(""))
    return F.concat(F.concat_ws("_", col(product), F.concat(F.lit("freq"), col(frequency)), col(polarization), col(layer), day, F.lit("subset")), F.lit(".tif"))
