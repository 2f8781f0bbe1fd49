"""Analytic cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrel.functions import algebra as A
from gridrel.functions import geo as G
from gridrel.operators import aggregate as AG
from gridrel.operators import joins as J
from gridrel.operators import pairs as PP
from gridrel.operators import polsar as P
from gridrel.operators import rgb, rules
from gridrel.operators import window2d as W


def raster(spark, a):
    return spark.createDataFrame([(i, j, None if a[i, j] != a[i, j] else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row int, col int, value double")


def grid(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_db_round_trip_and_fill(spark):
    assert one(spark, A.db_to_linear(A.linear_to_db(F.lit(0.3)))) == pytest.approx(0.3, rel=1e-12)
    assert one(spark, A.linear_to_db(F.lit(-1.0))) is None and one(spark, A.linear_to_db(F.lit(0.0), -9.0)) == -9.0


def test_look_factors_round_to_even():
    assert A.look_factors(12.5, 6.0, 45.0) == (4, 8) and A.look_factors(50, 40, 4) == (1, 1) and A.look_factors(4, 4, 14) == (4, 4)


def test_displacement(spark):
    assert one(spark, A.displacement(F.lit(2 * math.pi))) == pytest.approx(-0.12)
    assert abs(one(spark, A.displacement(F.lit(2.0), 0.24, F.lit(0.7)))) > abs(one(spark, A.displacement(F.lit(2.0))))


def test_mask_keeps_value_where_quality_is_missing(spark):
    assert one(spark, A.mask_below(F.lit(5.0), F.lit(None).cast("double"))) == 5.0
    assert one(spark, A.mask_below(F.lit(5.0), F.lit(0.1))) is None


def test_span_and_rfdi_need_bands():
    assert A.span() is None and A.rfdi("hh", None) is None and A.rfdi(None, "hv") is None


@pytest.mark.parametrize("mode,pad", [("nearest", "edge"), ("reflect", "symmetric"), ("wrap", "wrap")])
@pytest.mark.parametrize("size", [3, 4])
def test_box_matches_numpy(spark, mode, pad, size):
    a = np.random.default_rng(1).normal(size=(9, 11))
    b, f = size // 2, size - size // 2 - 1
    padded = np.pad(a, ((b, f), (b, f)), pad)
    want = np.lib.stride_tricks.sliding_window_view(padded, (size, size)).mean((2, 3))
    got = grid(W.box_mean(raster(spark, a), {"m": F.col("value")}, a.shape, size, mode), "m", a.shape)
    assert np.allclose(got, want)


def test_box_over_several_strips(spark, monkeypatch):
    monkeypatch.setattr(W, "STRIP", 4)
    a = np.random.default_rng(2).normal(size=(10, 13))
    want = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, "edge"), (3, 3)).mean((2, 3))
    assert np.allclose(grid(W.box_mean(raster(spark, a), {"m": F.col("value")}, a.shape, 3), "m", a.shape), want)


def windows_of(a, size, pad):
    h = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, h, pad), (size, size)).reshape(*a.shape, -1)


def test_lee_against_numpy(spark):
    rng = np.random.default_rng(11)
    a = rng.gamma(2.0, 0.03, (13, 17))
    a[rng.random(a.shape) < 0.08] = np.nan
    w = windows_of(a, 5, "symmetric")
    mean, var = np.nanmean(w, 2), np.nanvar(w, 2)
    want = np.where(np.isnan(a), np.nan, mean + var / (var + np.nanvar(a) + 1e-10) * (a - mean))
    assert np.allclose(grid(W.lee_filter(raster(spark, a), a.shape), "filtered", a.shape), want, equal_nan=True)


def test_refined_lee_against_numpy(spark):
    a = np.random.default_rng(12).gamma(3.0, 0.02, (12, 15))
    w = windows_of(a, 7, "edge")
    mean, var = w.mean(2), np.maximum((w**2).mean(2) - w.mean(2) ** 2, 0)
    e = np.pad(a, 1, "edge")
    at = lambda p, dr, dc: p[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]]
    diffs = np.stack([abs(at(e, *x) + at(e, *y) - 2 * a) for x, y in W.DIRECTIONS])
    turned = np.pad(a, 1, "wrap")
    means = np.stack([(at(turned, *x) + at(turned, *y)) / 2 for x, y in W.DIRECTIONS])
    pick = np.take_along_axis(means, diffs.argmin(0)[None], 0)[0]
    want = 0.5 * (mean + var / (var + np.median(var) + 1e-10) * (a - mean)) + 0.5 * pick
    assert np.allclose(grid(W.refined_lee(raster(spark, a), a.shape), "filtered", a.shape), want)


def test_looks_and_contrast_against_numpy(spark):
    a = np.random.default_rng(13).gamma(4.0, 0.02, (11, 9))
    w = windows_of(a, 5, "edge")
    want = w.mean(2) ** 2 / np.maximum((w**2).mean(2) - w.mean(2) ** 2, 1e-10)
    assert np.allclose(grid(W.estimate_enl(raster(spark, a), a.shape, 5), "enl", a.shape), want)
    a[2:4, 5] = np.nan
    w = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, constant_values=np.nan), (3, 3)).reshape(*a.shape, -1)
    sd, mean = np.nanstd(w, 2), np.nanmean(w, 2)
    sd[np.isnan(a)] = np.nan  # missing pixels stay missing
    got = W.contrast_homogeneity(raster(spark, a), a.shape, 3)
    assert np.allclose(grid(got, "contrast", a.shape), sd, equal_nan=True)
    assert np.allclose(grid(got, "homogeneity", a.shape), 1 / (1 + sd / (mean + 1e-10)), equal_nan=True)


def test_coherence_of_identical_and_random(spark):
    rng = np.random.default_rng(50)
    rows = [(i, j, *map(float, rng.normal(size=4))) for i in range(16) for j in range(16)]
    df = spark.createDataFrame(rows, "row int, col int, a_re double, a_im double, b_re double, b_im double")
    same = df.withColumns({"b_re": F.col("a_re"), "b_im": F.col("a_im")})
    assert W.coherence(same, (16, 16)).agg(F.min("coherence")).first()[0] > 0.95
    assert W.coherence(df, (16, 16), 11).agg(F.median("coherence")).first()[0] < 0.3


def test_multilook(spark):
    assert grid(AG.multilook(raster(spark, np.arange(16.0).reshape(4, 4)), ["value"], (4, 4)), "value", (2, 2))[0, 0] == 2.5
    assert AG.multilook(raster(spark, np.ones((11, 13))), ["value"], (11, 13), (3, 4)).count() == 9


def cube(spark, series):
    return spark.createDataFrame([(0, 0, t, float(t) * 30.4, None if v is None else float(v)) for t, v in enumerate(series)], "row int, col int, t int, time double, value double")


def test_cusum_step(spark):
    step = [0.0] * 10 + [1.0] * 10
    assert AG.cusum(cube(spark, step), 8)[1].first().change_index >= 8
    assert AG.cusum(cube(spark, step), 8, 1e9)[1].first().change_index == -1
    assert AG.coefficient_of_variation(cube(spark, [2.0] * 10)).first()["cov"] == 0


def test_threshold_counts_missing_steps(spark):
    r = AG.threshold_fraction(cube(spark, [1, 1, 1, None, 5, 5, 5, 5, 5, 5]), 0.5, 2, 0.5).first()
    assert r.fraction == 0.3 and r.mask is False


def test_harmonic_recovers(spark):
    t = np.arange(48) * 30.4
    r = AG.harmonic_fit(cube(spark, 1 + 0.5 * np.cos(2 * np.pi / 365.25 * t))).first()
    assert r.intercept == pytest.approx(1, abs=1e-6) and r.amplitude == pytest.approx(0.5, abs=1e-6) and r.rmse < 1e-5


def test_ols_p_value_against_known_table():
    assert A.t_cdf_tail(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert A.t_quantile(0.05, 10) == pytest.approx(2.228139, abs=1e-5)
    # published fits: slope, standard error, n and p
    for slope, se, n, p in ((7.394, 6.068, 233, 0.224), (12.865, 5.376, 329, 0.0173), (16.286, 8.032, 141, 0.0445)):
        assert A.t_cdf_tail(slope / se, n - 2) == pytest.approx(p, abs=6e-4)


def test_trim_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "v double")
    assert AG.trim_mad(df, "v").count() == 3 and AG.trim_mad(df.where("v > 5"), "v").count() == 0


def coherency_rows(spark, n=20):
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        k = rng.normal(size=(3, 5)) + 1j * rng.normal(size=(3, 5))
        m = k @ k.conj().T / 5
        rows.append((0, i, *m.diagonal().real.tolist(), *[float(f(m[a])) for a in ((0, 1), (0, 2), (1, 2)) for f in (np.real, np.imag)]))
    return rows, spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{t} double" for t in P.COHERENCY))


def test_eigenvalues_closed_form_against_numpy(spark):
    rows, df = coherency_rows(spark)
    for r in P.eigenvalues(df).collect():
        _, i, *v = rows[r["col"]]
        m = np.array([[v[0], v[3] + 1j * v[4], v[5] + 1j * v[6]], [0, v[1], v[7] + 1j * v[8]], [0, 0, v[2]]])
        m = m + np.triu(m, 1).conj().T
        assert np.allclose(np.linalg.eigvalsh(m)[::-1], [r.l1, r.l2, r.l3])


def test_cloude_pottier_ranges_and_missing(spark):
    _, df = coherency_rows(spark)
    df = df.withColumn("t12_re", F.when(F.col("col") == 4, None).otherwise(F.col("t12_re")))
    for r in P.cloude_pottier(df).collect():
        if r["col"] == 4:
            assert r.alpha is None or r.alpha != r.alpha
        else:
            assert 0 <= r.entropy <= 1 and 0 <= r.anisotropy <= 1 and 0 <= r.alpha <= 90


def test_coherency_of_identity_transform(spark):
    """Against U C U* by numpy, on a random covariance."""
    rng = np.random.default_rng(4)
    k = rng.normal(size=(3, 4)) + 1j * rng.normal(size=(3, 4))
    c = k @ k.conj().T
    u = np.array([[1, 0, 1], [1, 0, -1], [0, 2, 0]]) / math.sqrt(2)
    t = u @ c @ u.T
    row = (0, 0, c[0, 0].real, c[1, 1].real, c[2, 2].real, c[0, 1].real, c[0, 1].imag, c[0, 2].real, c[0, 2].imag, c[1, 2].real, c[1, 2].imag)
    r = P.coherency(spark.createDataFrame([tuple(map(float, row[2:]))], ", ".join(f"{x} double" for x in P.TERMS)).select(F.lit(0).alias("row"), F.lit(0).alias("col"), "*"), (1, 1), 1).first()
    assert r.t11 == pytest.approx(t[0, 0].real) and r.t22 == pytest.approx(t[1, 1].real) and r.t33 == pytest.approx(t[2, 2].real)
    for name, (a, b) in {"t12": (0, 1), "t13": (0, 2), "t23": (1, 2)}.items():
        assert complex(r[f"{name}_re"], r[f"{name}_im"]) == pytest.approx(complex(t[a, b]))


def test_distance_join_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.01, (300, 2)))]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {(r.pre_id, r.post_id) for r in J.distance_join(df.where("id < 150"), df.where("id >= 150"), 60.0).collect()}
    lat0 = np.mean([p[2] for p in pts])
    x = np.array([[p[1] * A.M_LON * math.cos(math.radians(lat0)), p[2] * A.M_LAT] for p in pts])
    want = {(i, j) for i in range(150) for j in range(150, 300) if np.hypot(*(x[i] - x[j])) <= 60}
    assert got == want and want
    assert J.distance_join(df.where("id < 0"), df, 60.0).count() == 0


def moved(spark, df):
    """(records, bytes) that a run of df shuffles."""
    store, seen = spark.sparkContext._jsc.sc(), set()

    def stages():
        store.listenerBus().waitUntilEmpty(60000)
        new = spark.sparkContext._jvm.java.util.ArrayList
        it = store.statusStore().stageList(new(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), new())
        return [it.apply(i) for i in range(it.size())]

    seen = {s.stageId() for s in stages()}
    df.write.format("noop").mode("overwrite").save()
    new = [s for s in stages() if s.stageId() not in seen]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distance_join_copies_a_row_to_four_cells_at_most(spark, no_broadcast):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.01, 0.01, (2000, 2)))], "id long, lon double, lat double")
    records, _ = moved(spark, J.distance_join(df.where("id < 1000"), df.where("id >= 1000"), 25.0))
    assert 1000 < records < 1000 + 4 * 1000 + 100


def test_distance_join_at_cell_borders(spark):
    """Points on the borders of cells of either size, of which many lie at the very distance."""
    step = 1 / A.M_LAT  # a metre
    pts = [(0.0, k * 12.5 * step) for k in range(-20, 21)] + [(0.0, k * 26.25 * step) for k in range(-8, 9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, lon double, lat double")
    got = {(r.pre_id, r.post_id) for r in J.distance_join(df, df, 25.000001).collect()}
    assert got == {(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if abs(p[1] - q[1]) * A.M_LAT <= 25.000001}


def test_count_matches_moves_totals_not_pairs(spark, no_broadcast):
    df = spark.createDataFrame([(i, 0.00001 * (i % 7), 0.00001 * (i % 5)) for i in range(800)], "id long, lon double, lat double")
    pairs = J.distance_join(df.where("id < 400"), df.where("id >= 400"), 25.0)  # all 160,000
    got = {r.pre_id: (r.n, r.ids, r.nearest) for r in J.count_matches(pairs, "pre_id", {"ids": "post_id"}).collect()}
    arrays = {r.pre_id: r.matches for r in J.group_matches(pairs, "pre_id", ["post_id"]).collect()}
    assert got == {k: (len(m), sum(x.post_id for x in m), m[0].distance_m) for k, m in arrays.items()} and {v[0] for v in got.values()} == {400}


def test_grouped_matches_moves_no_pairs(spark, no_broadcast, tmp_path):
    """Orders of two prices: every left row pairs with every right row of its price."""
    from gridrel.plans.queries import REGISTRY, Context

    rows = spark.range(2000).selectExpr("id * 91 + 1 AS o_orderkey", "id AS o_custkey", "CAST(2000 + floor(id / 2) % 2 AS DOUBLE) AS o_totalprice")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    c = Context(spark, str(tmp_path))
    assert REGISTRY["distance_join"].run(c).count() == 2 * 500 * 500
    assert moved(spark, REGISTRY["grouped_matches"].run(c))[1] < 250_000, "half a byte a pair"


def test_as_of_keeps_every_target_and_breaks_ties(spark):
    t = spark.createDataFrame([(1, "a", 100), (2, "a", 10_000), (3, None, 5)], "target_id long, k string, ms long")
    s = spark.createDataFrame([(9, "a", 90), (8, "a", 110), (7, "a", 150)], "scene_id long, k string, scene_ms long")
    got = {r.target_id: r.scene_id for r in J.as_of(t, s, ["k"], 50).collect()}
    assert got == {1: 8, 2: None, 3: None}


def test_rgb_methods(spark):
    rng = np.random.default_rng(6)
    rows = [(i, j, float(rng.exponential(0.05)), float(rng.exponential(0.01))) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(rows, "row int, col int, hh double, hv double")
    assert len(rgb.list_rgb_methods()) == 12
    for name in (*rgb.list_rgb_methods(), "standard_dualpol"):
        r = rgb.make_rgb(df, name).agg(F.min("red"), F.max("green"), F.max("blue"), F.count("*")).first()
        assert r[0] >= 0 and r[1] <= 255 and r[2] <= 255 and r[3] == 100
    with pytest.raises(ValueError):
        rgb.make_rgb(df, "nothing")


def test_bbox_forms(tmp_path):
    ring = {"type": "Polygon", "coordinates": [[[-3, 1], [4, 1], [4, 6], [-3, 6], [-3, 1]]]}
    f = tmp_path / "a.geojson"
    import json

    f.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": ring}]}))
    for source in ((-3, 1, 4, 6), [-3, 1, 4, 6], "-3, 1,4,6", ring, json.dumps(ring), str(f)):
        assert G.parse_bbox(source) == (-3, 1, 4, 6)
    for bad in ((1, 2, 3), (4, 1, -3, 6), (0, 0, 200, 1), "a,b,c,d", "1,2,3"):
        with pytest.raises(ValueError):
            G.parse_bbox(bad)
    assert G.parse_window("2020-01-01, 2020-06-01") == ("2020-01-01T00:00:00Z", "2020-06-01T00:00:00Z")


def test_utm_of_known_points(spark):
    # CN Tower and a southern point, from published coordinate tables
    df = spark.createDataFrame([(-79.387139, 43.642567, 32617), (-43.2096, -22.9035, 32723)], "lon double, lat double, epsg int")
    u = G.utm_forward("lon", "lat", "epsg")
    a, b = df.select(u["easting"].alias("e"), u["northing"].alias("n")).collect()
    assert a.e == pytest.approx(630_084, abs=2) and a.n == pytest.approx(4_833_438, abs=2)
    assert 683_000 < b.e < 684_500 and 7_465_000 < b.n < 7_467_000


def test_affines():
    assert G.multilooked_affine((30, 0, 5, 0, -30, 9), (2, 3)) == (90, 0, 5, 0, -60, 9)
    assert G.window_affine([15.0, 45.0], [-15.0, -45.0], (30, 0, 0, 0, -30, 0)) == (30, 0, 0, 0, -30, 0)
    assert G.window_affine([15.0], [-15.0], (30, 0, 0, 0, -30, 0)) == (30, 0, 0, 0, -30, 0)


@pytest.mark.parametrize("h,alpha,zone", [(0.2, 10.0, 1), (0.2, 45.0, 2), (0.2, 80.0, 3), (0.7, 10.0, 4), (0.7, 45.0, 5), (0.7, 80.0, 6), (0.95, 30.0, 7), (0.95, 45.0, 8), (0.95, 60.0, 9), (0.5, 42.5, 5), (0.9, 47.5, 9), (None, 3.0, None)])
def test_entropy_alpha_zones(spark, h, alpha, zone):
    assert one(spark, A.h_alpha_zone(F.lit(h).cast("double"), F.lit(alpha))) == zone


def test_status(spark):
    df = spark.createDataFrame([(1, 2, 1), (None, None, 0), (1, None, 2)], "a int, b int, n int")
    assert [r[0] for r in df.select(rules.status_v2("a", "b", "n")).collect()] == ["ok", "no_pass_path_match", "no_match"]


def test_tile_ids(spark):
    assert one(spark, A.tile_id(F.lit(-72.5), F.lit(4.25))) == "xm072.5000_yp004.2500"
    assert one(spark, A.tile_id(F.lit(0.0), F.lit(-0.0625))) == "xp000.0000_ym000.0625"


def test_colours(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (9.0,), (None,)], "x double").select(A.colour("x", F.lit(0.0), F.lit(1.0), [(k, 255 - k, 7) for k in range(256)]).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [(0, 255, 7, 255), (255, 0, 7, 255), (128, 127, 7, 255), (255, 0, 7, 255), (0, 255, 7, 0)]


def test_full_power_beams(spark):
    rows = [("5", "6"), ("8", "11"), ("11", "7"), ("BEAM1011", "BEAM0101"), ("0", "5"), ("10", "8")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "pre_beam string, post_beam string, id int")
    step = dict(rules.cascade(same_pointing=False))["beams"]
    assert [r.id for r in df.where(step).orderBy("id").collect()] == [0, 1, 3]


def test_cloude_pottier_alpha_of_pure_targets(spark):
    """alpha by hand: the dominant eigenvector of diag(1, 0, 0) is e1, of diag(0, 0, 1) e3, of a mixture of both arms known."""
    zero = [0.0] * 6
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, *zero), (0, 1, 1.0, 0.0, 0.5, *zero), (0, 2, 0.5, 0.0, 0.5, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0)], "row int, col int, " + ", ".join(f"{t} double" for t in P.COHERENCY))
    got = {r["col"]: r.alpha for r in P.cloude_pottier(df).collect()}
    assert got[0] == pytest.approx(0.0, abs=1e-3) and got[1] == pytest.approx(90.0, abs=1e-3)
    assert got[2] == pytest.approx(math.degrees(math.atan(math.sqrt(0.5 / (2 * 0.5)))), abs=1e-3)


def test_confidence_band_against_the_formula(spark):
    """Student's t for 8 degrees of freedom at 5 %, from tables: 2.306004."""
    x = np.arange(10.0)
    y = 2 * x + np.array([1, -1, 2, 0, -2, 1, 0, 1, -1, -1.0])
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    got = AG.ci_band(df, "x", AG.fit_ols(df, "x", "y"), 10, points=4).orderBy("i").collect()
    slope, intercept = np.polyfit(x, y, 1)
    sxx, s2 = ((x - x.mean()) ** 2).sum(), ((y - intercept - slope * x) ** 2).sum() / 8
    for r in got:
        half = 2.306004 * math.sqrt(s2 * (1 / 10 + x.mean() ** 2 / sxx) + (r.x - x.mean()) ** 2 * s2 / sxx)
        assert r.y == pytest.approx(intercept + slope * r.x) and r.upper - r.y == pytest.approx(half, rel=1e-5) and r.y - r.lower == pytest.approx(half, rel=1e-5)


def test_binned_medians_need_points_and_edges(spark):
    x = np.linspace(0, 1, 71)
    df = spark.createDataFrame([(float(v), float(v * v)) for v in x], "x double, y double")
    got = {r.bin: r for r in AG.binned_medians(df, "x", "y").collect()}
    edges = np.quantile(x, np.linspace(0, 1, 8))
    assert sorted(got) == list(range(1, 8))
    for k in range(1, 8):
        part = (x * x)[(x >= edges[k - 1]) & ((x < edges[k]) | (k == 7))]
        assert got[k].centre == pytest.approx((edges[k - 1] + edges[k]) / 2) and got[k].median == pytest.approx(np.median(part)) and got[k].q75 == pytest.approx(np.percentile(part, 75))
    assert AG.binned_medians(df.limit(29), "x", "y").count() == 0
    assert AG.binned_medians(df.withColumn("x", F.when(F.col("x") > 0.5, 1.0).otherwise(1.0)), "x", "y").count() == 0


def test_labels_pass_over_taken_suffixes(spark):
    rows = [(1, "a"), (2, "a_2"), (3, "a"), (4, "a"), (5, "a_2"), (6, "b")]
    got = {r.id: r.label for r in J.free_labels(spark.createDataFrame(rows, "id int, label string"), "label", "id").collect()}
    assert got == {1: "a", 2: "a_2", 3: "a_3", 4: "a_4", 5: "a_2_2", 6: "b"}


def test_distance_join_takes_each_tile_by_its_latitude(spark):
    """0.0003 degrees of longitude: 33.4 m at the equator, 16.7 m at 60 degrees north."""
    pts = [(1, 0.0, 0.0, "s", 0), (2, 0.0003, 0.0, "s", 1), (3, 0.0, 60.0, "n", 0), (4, 0.0003, 60.0, "n", 1)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double, tile_id string, side int")
    got = J.distance_join(df.where("side = 0").drop("side"), df.where("side = 1").drop("side"), 25.0, ("tile_id",)).collect()
    assert [(r.pre_id, r.post_id) for r in got] == [(3, 4)] and got[0].distance_m == pytest.approx(16.698, abs=1e-3)
    pairs, summary = PP.tile_pairs(df, F.col("id") > 0)
    assert pairs.count() == 1 and {r.tile_id: (r.n_pre, r.n_post, r.n_pairs_25m, r.n_pairs_10m, r.status) for r in summary.collect()} == {"s": (1, 1, 0, 0, "ok"), "n": (1, 1, 1, 0, "ok")}
    assert {r.status for r in PP.tile_pairs(df, F.col("id") < 0)[1].collect()} == {"skipped_no_disturbance"}


def test_stratified_sample_against_numpy(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    fit = AG.fit_ols(df, "x", "y")
    slope, intercept = np.polyfit(x, y, 1)
    for exclude in (None, [3, 50, 120]):
        keep = np.setdiff1d(np.arange(200), exclude or [])
        res, q = y - slope * x - intercept, lambda v, p: np.quantile(v[keep], p)  # noqa: B023
        low_x, low_y = x <= q(x, 0.2), y <= q(y, 0.2)
        used, want = [], {}
        for name, rule in (("signal", low_x & low_y), ("noise", (abs(x) <= q(abs(x), 0.4)) & low_y), ("false_alarm", low_x & (y >= q(y, 0.5)))):
            ids = [i for i in keep if rule[i] and i not in used]
            best = min(ids, key=lambda i: (abs(res[i] - np.median(res[ids])), i))  # noqa: B023
            used.append(best)
            want[name] = best
        got = {r.stratum: r.id for r in rules.stratified_sample(df, fit, "x", "y", "id", 8, exclude=spark.createDataFrame([(i,) for i in exclude], "id long") if exclude else None).collect()}
        assert {k: v for k, v in got.items() if k in want} == want and sorted(got) == sorted([*want, *(f"random_{k}" for k in range(1, 6))])
        assert len(set(got.values())) == 8 and not set(got.values()) & set(exclude or [])


def test_two_middle_rows_tie_whatever_the_rounding(spark):
    """0.1 and 0.3 lie equally far from 0.2; in doubles 0.3 is nearer."""
    rows = [(1, -10.0, 0.1), (2, -9.0, 0.3), *[(i, float(i), float(i)) for i in range(3, 11)]]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    fit = spark.createDataFrame([(0.0, 0.0)], "slope double, intercept double")
    got = {r.stratum: r.id for r in rules.stratified_sample(df, fit, "x", "y", "id", 1).collect()}
    assert got["signal"] == 1
    few = spark.createDataFrame([(2, 0.3), (1, 0.1), (0, None)], "id long, v double")
    assert rules.median_row(few, "v", "id").first().id == 1
    assert rules.median_row(few.where("id = 0"), "v", "id").first().id == 0


def test_masks(spark):
    df = spark.createDataFrame([(1, 0, 20, 4, 10.0), (1, 1, 22, 3, 10.0), (0, 0, 19, 5, 70.0), (None, 0, None, 6, 0.0)], "quality int, degrade int, year int, scl int, cloud double")
    got = df.select(PP.good_shot().alias("a"), PP.lost_forest("year").alias("b"), PP.clear_pixel("scl", "cloud").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (False, False, False), (False, False, True)]


def test_pairs_end_to_end(spark):
    day = 86_400_000
    pairs = spark.createDataFrame([(1, "u", 100 * day, 200 * day), (2, "u", 500 * day, 600 * day)], "pair_id long, k string, pre_ms long, post_ms long")
    scenes = spark.createDataFrame([(7, "u", 101 * day, "A", 3, 10.0), (8, "u", 203 * day, "A", 3, 20.0), (9, "u", 100 * day, "D", 3, 30.0)], "scene_id long, k string, scene_ms long, pass string, path int, HV_dn double")
    got = {r.pair_id: r for r in PP.matched_pairs(pairs, scenes, ["k"], 7 * day).collect()}
    assert (got[1].sar_status, got[1].pre_scene_id, got[1].post_scene_id, got[1].pre_HV_dn, got[1].post_HV_dn, got[1].match_total_dt) == ("ok", 7, 8, 10.0, 20.0, 4 * day)
    assert got[2].sar_status == "no_pass_path_match"
    judged = spark.createDataFrame([(1, "ok", "2004-01-01"), (2, "ok", "2001-01-01"), (3, "ok", "2004-01-01")], "pair_id long, sar_status string, post_sar_date string")
    notes = spark.createDataFrame([(1, "2", "2"), (2, "2", "2"), (3, "1", "2")], "pair_id long, hansen_loss_min string, hansen_loss_max string")
    kept, audit = PP.clean_pairs(judged, notes)
    assert [r.pair_id for r in kept.collect()] == [1] and {r.pair_id: r.v2c_drop_reason for r in audit.collect()} == {1: None, 2: "timing", 3: "edge"}


def test_utm_there_and_back(spark):
    df = spark.createDataFrame([(-79.387139, 43.642567, 32617), (-43.2096, -22.9035, 32723), (9.0, 0.0, 32632), (11.9, 71.0, 32632)], "lon double, lat double, epsg int")
    u = df.select("*", *[e.alias(k) for k, e in G.utm_forward("lon", "lat", "epsg").items()])
    for r in u.select("*", *[e.alias(f"{k}2") for k, e in G.utm_inverse("easting", "northing", "epsg").items()]).collect():
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))
        assert G.project(r.lon, r.lat, r.epsg) == (pytest.approx(r.easting), pytest.approx(r.northing))
    b = spark.range(1).select(*[e.alias(k) for k, e in G.latlon_bounds(30.0, 500_000.0, -30.0, 4_000_000.0, 100, 200, 32611).items()]).first()
    assert b.west == pytest.approx(-117.0) and b.east > b.west and b.south < b.north and b.north == pytest.approx(36.1446, abs=0.002)
    with pytest.raises(ValueError):
        G.project(0, 0, 3857)


def test_geojson_reads_coordinates_only(spark):
    texts = {
        1: '{"type": "Feature", "bbox": [-100, -100, 100, 100], "properties": {"v": [999, 888]}, "geometry": {"type": "Point", "coordinates": [1, 2]}}',
        2: '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": [5, 6]}, "geometry": {"type": "LineString", "coordinates": [[3, 4, 50], [-1, 8.5, 60]]}}, {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, -3]}]}}]}',
        3: '{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6e0, 5], [6, 7], [5, 5]]]]}',
        4: '{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [2, 3]}, {"type": "Point", "coordinates": [4, 1]}]}',
        5: '{"type": "Feature", "properties": {"v": [1, 2]}, "geometry": null}',
    }
    df = spark.createDataFrame(list(texts.items()), "id int, g string")
    got = {r.id: (r.west, r.south, r.east, r.north) for r in G.geojson_envelopes(df, "id", "g").collect()}
    assert got == {1: (1, 2, 1, 2), 2: (-1, -3, 7, 8.5), 3: (0, 0, 6, 7), 4: (2, 1, 4, 3)}
    f = spark.createDataFrame([('{"features": [{"geometry": {"coordinates": [1.5, 2]}, "properties": {"agbd": 7, "beam": "5"}}, {"geometry": null, "properties": null}]}',)], "g string")
    assert [tuple(r) for r in G.geojson_features(f, "g", ["agbd", "none"]).collect()] == [(1.5, 2.0, "7", None), (None, None, None, None)]
