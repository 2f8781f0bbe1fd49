"""Rules, cascades and status columns of the pair pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrel.functions.algebra import FULL_POWER_BEAMS, dn_to_db, year_of
from gridrel.operators.quantiles import cut, off_median, quantiles

COMPLETE = ["pre_agbd", "post_agbd", "pre_HH_db", "pre_HV_db", "post_HH_db", "post_HV_db"]


def all_of(cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def cascade(min_sensitivity: float = 0.95, min_pre_agbd: float = 50.0, beams: bool = True, same_pointing: bool = True, same_beam: bool = False) -> list[tuple[str, Column]]:
    """Named steps in order; 0 switches a numeric step off."""
    steps = [("complete", all_of(COMPLETE))]
    yes = F.lit(True)
    steps.append(("sensitivity", (F.col("pre_sensitivity") >= min_sensitivity) & (F.col("post_sensitivity") >= min_sensitivity) if min_sensitivity else yes))
    steps.append(("pre_agbd", F.col("pre_agbd") >= min_pre_agbd if min_pre_agbd else yes))
    in_power = F.col("pre_beam").cast("string").isin(*FULL_POWER_BEAMS) & F.col("post_beam").cast("string").isin(*FULL_POWER_BEAMS)
    steps.append(("beams", in_power if beams else yes))
    steps.append(("pointing", F.col("pre_AntennaPointing") == F.col("post_AntennaPointing") if same_pointing else yes))
    if same_beam:
        steps.append(("same_beam", F.col("pre_BeamID") == F.col("post_BeamID")))
    return steps


def apply_cascade(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for _, rule in steps:
        df = df.where(rule)
    return df


def cascade_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_order, step, n): rows left after each step, all in one pass."""
    so_far, counts = F.lit(True), [F.count("*").alias("input")]
    for name, rule in steps:
        so_far = so_far & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    names = ["input", *[n for n, _ in steps]]
    pairs = F.array(*[F.struct(F.lit(i).alias("step_order"), F.lit(n).alias("step"), F.col(n).alias("n")) for i, n in enumerate(names)])
    return df.agg(*counts).select(F.inline(pairs))


def add_db(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{s}_{p}_db": dn_to_db(f"{s}_{p}_dn") for s in ("pre", "post") for p in ("HH", "HV")})


def add_derived(df: DataFrame) -> DataFrame:
    """Differences of biomass and backscatter, and of the RFDI from dB without guard term."""
    lin = lambda c: F.pow(F.lit(10.0), F.col(c) / 10)
    ratio = {s: (lin(f"{s}_HH_db") - lin(f"{s}_HV_db")) / (lin(f"{s}_HH_db") + lin(f"{s}_HV_db")) for s in ("pre", "post")}
    return df.withColumns({
        "d_agbd": F.col("post_agbd") - F.col("pre_agbd"), "d_hv": F.col("post_HV_db") - F.col("pre_HV_db"), "d_hh": F.col("post_HH_db") - F.col("pre_HH_db"),
        "pre_rfdi": ratio["pre"], "post_rfdi": ratio["post"], "d_rfdi": ratio["post"] - ratio["pre"],
    })


def drop_reason() -> Column:
    """edge before timing; NULL where neither rule drops the row."""
    lo, hi = F.col("hansen_loss_min").try_cast("double"), F.col("hansen_loss_max").try_cast("double")
    edge = lo.isNotNull() & hi.isNotNull() & (lo != hi)
    timing = F.coalesce((hi > 0) & (year_of("post_sar_date") <= 2000 + hi), F.lit(False))
    return F.when(edge, "edge").when(timing, "timing")


def audit(df: DataFrame) -> DataFrame:
    """Every row with v2c_drop_reason and passes_v2c."""
    ok = drop_reason().isNull() & F.coalesce(F.col("sar_status") == "ok", F.lit(False)) & F.col("hansen_loss_min").try_cast("double").isNotNull()
    return df.withColumn("v2c_drop_reason", drop_reason()).withColumn("passes_v2c", ok)


def status_v1(pre: str, post: str) -> Column:
    a, b = F.col(pre).isNotNull(), F.col(post).isNotNull()
    return F.when(a & b, "ok").when(a, "no_post").when(b, "no_pre").otherwise("no_match")


def status_v2(pre: str, post: str, n_candidates: str) -> Column:
    return F.when(F.col(pre).isNotNull() & F.col(post).isNotNull(), "ok").when(F.coalesce(F.col(n_candidates), F.lit(0)) == 0, "no_pass_path_match").otherwise("no_match")


def error_kind(message: str) -> Column:
    return F.when(F.lower(message).contains("memory"), "memory_error").otherwise("ee_error")


def stratified_sample(df: DataFrame, fit: DataFrame, x: str, y: str, id_: str, n: int, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """(stratum, id): a typical row of each of signal, noise and false_alarm, and random ones up to n rows.

    Residuals are those of the fit; rows named by exclude (its column id_) are left out before
    the cuts are made.  signal: x and y both in their lowest fifths; noise: |x| in its lowest two
    fifths, y in its lowest fifth; false_alarm: x in its lowest fifth, y at least its median.
    Each gives the row nearest its median residual (ties to the smaller id), and a row serves
    once.  A stratum without rows is left out, and one more row is random: random_1 and so on,
    in hash order.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(fit.select("slope", "intercept")))
    rows = rows.select(F.col(id_).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).alias("res"))
    if exclude is not None:
        rows = rows.join(exclude.select(F.col(id_).alias("id")).distinct(), "id", "left_anti")
    cuts = quantiles(rows, {"x": F.col("x"), "y": F.col("y"), "a": F.abs("x")}, {"x": [0.2], "y": [0.2, 0.5], "a": [0.4]})
    low_x, low_y = F.col("x") <= cut(cuts["x"][0]), F.col("y") <= cut(cuts["y"][0])
    strata = {"signal": low_x & low_y, "noise": (F.abs("x") <= cut(cuts["a"][0])) & low_y, "false_alarm": low_x & (F.col("y") >= cut(cuts["y"][1]))}
    picks: list[tuple[str, int]] = []
    for name, rule in strata.items():
        some = rows.where(rule & ~F.col("id").isin([i for _, i in picks]) if picks else rule)
        best = some.agg(F.min(F.struct(off_median(some, "res").alias("d"), "id")).alias("b")).first()  # one row
        if best.b is not None:
            picks.append((name, best.b.id))
    fixed = df.sparkSession.createDataFrame(picks, f"stratum string, id {rows.schema['id'].dataType.simpleString()}")
    rest = rows.where(~F.col("id").isin([i for _, i in picks])) if picks else rows
    rest = rest.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(0, n - len(picks)))
    k = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id"))  # n rows at most
    return fixed.unionByName(rest.select(F.concat(F.lit("random_"), k.cast("string")).alias("stratum"), "id"))


def median_row(df: DataFrame, value: str, id_: str) -> DataFrame:
    """The row nearest the median, ties to the smaller id."""
    return df.orderBy(off_median(df, value).asc_nulls_last(), id_).limit(1)


def split_tiles(tiles: DataFrame, factor: int = 2) -> DataFrame:
    """factor x factor children with the id suffix _s<i><j>."""
    side = F.sequence(F.lit(0), F.lit(factor - 1))
    t = tiles.withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
    w, h = (F.col("east") - F.col("west")) / factor, (F.col("north") - F.col("south")) / factor
    return t.select(F.concat("tile_id", F.lit("_s"), F.col("i").cast("string"), F.col("j").cast("string")).alias("tile_id"), (F.col("west") + F.col("i") * w).alias("west"), (F.col("south") + F.col("j") * h).alias("south"), (F.col("west") + (F.col("i") + 1) * w).alias("east"), (F.col("south") + (F.col("j") + 1) * h).alias("north"))


def tile_aoi(aoi: DataFrame, size: float) -> DataFrame:
    """Grid tiles snapped to multiples of size whose intersection with an envelope (w, s, e, n) has an area."""
    from gridrel.functions.algebra import tile_id

    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.ceil(F.col(b) / size) - 1)
    t = aoi.withColumn("i", F.explode(span("west", "east"))).withColumn("j", F.explode(span("south", "north")))
    w, s = F.col("i") * F.lit(size), F.col("j") * F.lit(size)
    box = t.select(w.alias("tw"), s.alias("ts"), (w + size).alias("te"), (s + size).alias("tn"), "west", "south", "east", "north")
    hit = (F.col("tw") < F.col("east")) & (F.col("te") > F.col("west")) & (F.col("ts") < F.col("north")) & (F.col("tn") > F.col("south"))
    return box.where(hit).select(tile_id("tw", "ts").alias("tile_id"), F.col("tw").alias("west"), F.col("ts").alias("south"), F.col("te").alias("east"), F.col("tn").alias("north")).distinct()
