"""Catalogue helpers, product source, sinks, streaming and command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrel import cli
from gridrel.functions.geo import project
from gridrel.sources import catalogue as C
from gridrel.sources import product
from gridrel.streaming import new_scenes, run_once, windowed_counts


def tiles(spark, path, n=12):
    rng = np.random.default_rng(0)
    rows = [(i, j, *map(float, rng.exponential((0.05, 0.05, 0.01)))) for i in range(n) for j in range(n)]
    product.write_tiles(spark.createDataFrame(rows, "row int, col int, value double, hh double, hv double"), path, 4, {"units": "linear"})


def test_paths():
    assert C.dataset_path("GCOV", "A", "HH") == "/science/LSAR/GCOV/grids/frequencyA/HHHH"
    assert C.dataset_path("RSLC", "B", "HV") == "/science/LSAR/RSLC/swaths/frequencyB/HV"
    assert C.gunw_group("coherenceMagnitude", 20) == "wrappedInterferogram" and C.gunw_group("wrappedInterferogram", 80) == "wrappedInterferogram"
    for bad in (("XXXX", "A", "HH"), ("GUNW", "A", "nothing")):
        with pytest.raises(ValueError):
            C.dataset_path(*bad)
    with pytest.raises(ValueError):
        C.gunw_group("unwrappedPhase", 20)


def test_check_path(tmp_path):
    with pytest.raises(FileNotFoundError):
        product.check_path(str(tmp_path / "none.h5"))
    for remote in ("s3://a/b.h5", "https://a/b.h5"):
        with pytest.raises(ValueError):
            product.check_path(remote)


def test_product_source_without_reader(spark, tmp_path):
    product.register(spark)
    df = spark.read.format("sar_product").option("path", str(tmp_path / "none.h5")).load()
    assert df.columns[:5] == ["scene_id", "product", "frequency", "polarization", "layer"]
    with pytest.raises(Exception):
        df.collect()


@pytest.mark.parametrize("js,want", [('{"bytes": 12}', 12), ('{"bytes": {"f": 3, "g": 4}}', 3), ('{"bytes": {"f": {"bytes": 5}}}', 5), ('{"bytes": {"x": 6}}', 6), ('{"bytes": {"x": 6, "y": 7}}', None), ('{"bytes": {"bytes": 6, "y": 7}}', 6), ('{"bytes": {"f": {"bytes": "no"}, "bytes": 8}}', 8), ("{}", None)])
def test_result_size(spark, js, want):
    assert spark.range(1).select(C.result_size(F.lit(js), F.lit("f"))).first()[0] == want


def test_tiles_round_trip_and_cli(spark, tmp_path, capsys):
    src = str(tmp_path / "a")
    tiles(spark, src)
    df, meta = product.read_tiles(spark, src)
    assert df.count() == 144 and meta == {"units": "linear"}
    for argv, columns in (
        (["multilook", src], {"row", "col", "value"}),
        (["rgb", src, "--method", "standard_dualpol"], {"row", "col", "red", "green", "blue"}),
        (["timeseries", src, src, "--method", "cusum"], {"row", "col", "magnitude"}),
        (["timeseries", src, src], {"row", "col", "cov"}),
    ):
        assert set(cli.run(spark, cli.build_parser().parse_args(argv)).columns) == columns
    assert cli.run(spark, cli.build_parser().parse_args(["info", src]))["pixels"] == 144
    assert cli.run(spark, cli.build_parser().parse_args(["forests", src])).where("forest is not null").count() == 144


def test_links_sizes_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    both = F.array(F.lit("s3://b/g.h5"), F.lit("https://h/g.h5"))
    assert one(C.granule_url(both)) == "https://h/g.h5" and one(C.granule_url(both, "auto", "us-west-2")) == "s3://b/g.h5"
    assert one(C.granule_url(both, "auto", "eu-west-1")) == "https://h/g.h5" and one(C.granule_url(both, "s3")) == "s3://b/g.h5"
    with pytest.raises(Exception, match="no s3 link"):
        one(C.granule_url(F.array(F.lit("https://h/g.h5")), "s3"))
    with pytest.raises(ValueError):
        C.granule_url(both, "direct")
    for name, want in (("A_Sigma0_db.tif", "sigma0"), ("hh_db.tif", "gamma0"), ("hh_linear.tif", "gamma0"), ("x_gamma0.tif", "gamma0"), ("phase.tif", "unknown")):
        assert one(C.calibration_of(F.lit(name))) == want == product.calibration_name(name)
    assert one(C.output_name(F.lit("GUNW"), F.lit("A"), F.lit("HH"), F.lit("unwrappedPhase"), F.lit("2025-11-03T05:06:07"))) == "GUNW_freqA_HH_unwrappedPhase_2025-11-03_subset.tif"
    assert one(C.output_name(F.lit("GCOV"), F.lit("B"), F.lit("HV"), F.lit("HVHV"))) == "GCOV_freqB_HV_HVHV_subset.tif"
    assert [one(C.item_size(F.lit(x), F.lit(p))) for x, p in (("HH", "GSLC"), ("HHHH", "GCOV"), ("HHHV", "GCOV"), ("connectedComponents", "GUNW"), ("snr", "GOFF"))] == [8, 4, 8, 2, 4]
    assert [product.human_size(n) for n in (10, 1536, 3 << 20, 5 << 40)] == ["10.0 B", "1.5 KB", "3.0 MB", "5.0 TB"]


def test_sizes_in_the_query_s_unit(spark, tmp_path):
    """The query names KB whatever the size, as its SQL does; the operator by itself goes on to MB, as the reference does."""
    from gridrel.functions import algebra as A
    from gridrel.plans.queries import REGISTRY, Context

    spark.range(3, 3000, 100).selectExpr("explode(sequence(id, id + 96 * 300, 300)) AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    row = REGISTRY["subset_size"].run(Context(spark, str(tmp_path))).first()
    bytes_ = sum((k % 100 + 1) * 64 * (2, 8, 4)[k % 3] for i in range(3, 3000, 100) for k in range(i, i + 96 * 300 + 1, 300))
    assert bytes_ > 1 << 20
    assert (row.bytes, row.human) == (bytes_, f"{bytes_ / 1024:.1f} KB")
    big = spark.createDataFrame([(2_000_000,)], "n long")
    assert tuple(big.select(A.human_size("n"), A.human_size("n", "KB"), A.human_size("n", "B")).first()) == ("1.9 MB", "1953.1 KB", "2000000.0 B")


def test_exact_or_nearest_keeps_pass_and_path(spark):
    t = spark.createDataFrame([(1, 1000, "A", 5), (2, 1000, None, None), (3, 5000, "A", 5), (4, 5000, "D", 5), (5, 9000, "A", None), (6, None, "A", 5)], "target_id long, ms long, pass string, path int")
    s = spark.createDataFrame([(10, 1000, "A", 5), (9, 1000, "D", 5), (20, 4900, "A", 5), (21, 4950, "A", 6), (22, 5100, "D", 5), (30, 9100, "A", 7), (31, 9099, "D", 7)], "scene_id long, scene_ms long, scene_pass string, scene_path int")
    got = {r.target_id: (r.scene_id, r.is_exact) for r in C.exact_or_nearest(t, s, 100).collect()}
    # the window is closed at its beginning and open at its end
    assert got == {1: (10, True), 2: (9, True), 3: (20, False), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_exact_or_nearest_against_brute_force(spark):
    """Negative times, nulls, repeated times, and no operator that makes a row of every scene in a target's window."""
    rng = np.random.default_rng(3)
    some = lambda values, k: [None if v == len(values) else values[v] for v in rng.integers(0, len(values) + 1, k)]
    tt = list(zip(range(300), rng.integers(-3000, 3000, 300).tolist(), some(["A", "D"], 300), some([1, 2, 3], 300), strict=True))
    ss = list(zip(range(1000, 1300), (rng.integers(-300, 300, 300) * 10).tolist(), some(["A", "D"], 300), some([1, 2, 3], 300), strict=True))
    ss += [(i + 1000, *rest) for i, *rest in ss]
    t, s = spark.createDataFrame(tt, "target_id long, ms long, pass string, path int"), spark.createDataFrame(ss, "scene_id long, scene_ms long, scene_pass string, scene_path int")
    want = {}
    for i, ms, p, q in tt:
        fit = [x for x in ss if (p is None or p == x[2]) and (q is None or q == x[3])]
        exact = [x[0] for x in fit if x[1] == ms]
        near = [(x[1], x[0]) for x in fit if ms - 100 <= x[1] < ms + 100]
        want[i] = (min(exact), True) if exact else (min(near)[1] if near else None, False)
    got = C.exact_or_nearest(t, s, 100)
    assert {r.target_id: (r.scene_id, r.is_exact) for r in got.collect()} == want and len({v[1] for v in want.values()}) == 2
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "LeftOuter" in joins[0]


FAKE = """
import pickle

class _Node:
    def __init__(self, value):
        self.value, self.attrs = value.get("data") if isinstance(value, dict) else value, value.get("attrs", {}) if isinstance(value, dict) else {}
        if hasattr(self.value, "dtype"):
            self.shape, self.dtype = self.value.shape, self.value.dtype
    def __getitem__(self, key):
        return self.value if key == () else self.value[key]

class File:
    def __init__(self, source, mode):
        self.tree = pickle.load(open(source, "rb") if isinstance(source, str) else source)
    def __contains__(self, name):
        return name in self.tree
    def __getitem__(self, name):
        return _Node(self.tree[name])
    def visititems(self, f):
        for name in self.tree:
            f(name.lstrip("/"), self[name])
    def close(self):
        pass
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass

class Store:
    protocol = ("s3", "s3a")
    def open(self, path, mode):
        return open(path.replace("s3://bucket", "/"), mode)

def store():
    return Store()
"""


@pytest.fixture(scope="module")
def fake(spark, tmp_path_factory):
    """A product file of nested arrays and the module that opens it, on executors too."""
    import pickle

    folder = tmp_path_factory.mktemp("fake")
    (folder / "fake_products.py").write_text(FAKE)
    spark.sparkContext.addPyFile(str(folder / "fake_products.py"))
    rng, grid, ident = np.random.default_rng(5), "/science/LSAR/GCOV/grids/frequencyA", "/science/LSAR/identification"
    x, y = 500_015.0 + 30 * np.arange(40), 4_000_000.0 - 15 - 30 * np.arange(30)
    hh = rng.gamma(2, 0.05, (30, 40)).astype(np.float32)
    hh[3, 4] = np.nan
    cross = np.zeros((30, 40), [("r", np.float32), ("i", np.float32)])
    cross["r"], cross["i"] = rng.normal(size=(30, 40)), rng.normal(size=(30, 40))
    slc = (rng.normal(size=(30, 40)) + 1j * rng.normal(size=(30, 40))).astype(np.complex64)
    t = {f"{grid}/HHHH": hh, f"{grid}/HVHV": hh * 0.2, f"{grid}/HHHV": cross, f"{grid}/listOfPolarizations": np.array([b"HH", b"HV", b"VV"]), f"{ident}/listOfFrequencies": np.array([b"A"])}
    t |= {f"{ident}/{k}": v for k, v in {"productType": b"GCOV", "zeroDopplerStartTime": b"2025-11-03T05:06:07", "zeroDopplerEndTime": b"2025-11-03T05:06:30", "absoluteOrbitNumber": 77, "trackNumber": 5, "frameNumber": 9}.items()}
    unwrapped, slcs = "/science/LSAR/GUNW/grids/frequencyA/unwrappedInterferogram/HH", "/science/LSAR/GSLC/grids/frequencyA"
    for g in (grid, unwrapped, slcs):
        t |= {f"{g}/xCoordinates": x, f"{g}/yCoordinates": y, f"{g}/xCoordinateSpacing": 30.0, f"{g}/yCoordinateSpacing": -30.0, f"{g}/projection": {"attrs": {"epsg_code": 32611}}}
    t |= {f"{unwrapped}/connectedComponents": np.arange(1200, dtype=np.uint16).reshape(30, 40), f"{slcs}/HH": slc, "/science/LSAR/RSLC/swaths/frequencyA/HH": slc, "/science/LSAR/GOFF/grids/frequencyA/pixelOffsets/HH/snr": hh}
    path = str(folder / "g.h5")
    with open(path, "wb") as out:
        pickle.dump(t, out)
    return path, t, x, y


def test_product_metadata(spark, fake):
    path, _, x, y = fake
    with product.open_product(path, "fake_products") as f:
        assert product.frequencies(f) == ["A"] and product.polarizations(f) == ["HH", "HV", "VV"]
        assert product.identification(f) == {"product_type": "GCOV", "start_time": "2025-11-03T05:06:07", "end_time": "2025-11-03T05:06:30", "orbit": 77, "track": 5, "frame": 9}
        grid = product.projection(f, product.grid_folder("GCOV"))
        assert grid["affine"] == (30.0, 0.0, 500_000.0, 0.0, -30.0, 4_000_000.0) and grid["epsg"] == 32611 and grid["x"] == x.tolist()
        assert product.projection(f, product.grid_folder("GUNW", posting=80))["y"] == y.tolist()
        assert ("science/LSAR/GCOV/grids/frequencyA/HHHH", [30, 40], "float32") in product.tree(f)
        with pytest.raises(KeyError):
            product.polarizations(f, "B")
        with pytest.raises(KeyError):
            product.projection(f, "/science/LSAR/RSLC/swaths/frequencyA")
    r = product.read_catalogue(spark, [path], "fake_products").first()
    assert (r.granule, r.frequencies, r.polarizations, r.orbit, r.epsg, r.height, r.width) == (path, ["A"], ["HH", "HV", "VV"], 77, 32611, 30, 40) and r.affine[2] == 500_000.0
    with product.open_product(f"s3://bucket{path}", "fake_products", product.filesystem_of("fake_products:store")) as f:
        assert product.frequencies(f) == ["A"]
    with pytest.raises(ValueError):
        product.open_product(f"https://bucket{path}", "fake_products", product.filesystem_of("fake_products:store"))


def test_product_pixels(spark, fake):
    path, t, x, y = fake
    product.register(spark)
    load = lambda **o: spark.read.format("sar_product").options(engine="fake_products", tile="16", **o).load(path).collect()
    grid = "/science/LSAR/GCOV/grids/frequencyA"
    got = {(r.row, r.col): r for r in load(product="GCOV", layer="HH")}
    assert len(got) == 1200 and got[3, 4].value is None and got[29, 39].value == pytest.approx(float(t[f"{grid}/HHHH"][29, 39]))
    assert (got[2, 7].x, got[2, 7].y, got[2, 7].epsg) == (x[7], y[2], 32611)
    wide = {(r.row, r.col): r for r in load(product="GCOV", layer="*", window="5,20,10,30")}
    assert len(wide) == 300 and wide[5, 10].HHHH == pytest.approx(float(t[f"{grid}/HHHH"][5, 10])) and wide[5, 10].VVVV is None
    assert (wide[6, 11].HHHV_re, wide[6, 11].HHHV_im) == (pytest.approx(float(t[f"{grid}/HHHV"]["r"][6, 11])), pytest.approx(float(t[f"{grid}/HHHV"]["i"][6, 11])))
    slc = t["/science/LSAR/GSLC/grids/frequencyA/HH"]
    for name, has_map in (("GSLC", True), ("RSLC", False)):
        r = next(r for r in load(product=name, layer="HH") if (r.row, r.col) == (1, 2))
        assert complex(r.value, r.value_im) == pytest.approx(complex(slc[1, 2])) and (r.x is not None) is has_map
    assert max(r.value for r in load(product="GUNW", layer="connectedComponents")) == 1199
    assert len(load(product="GOFF", layer="snr")) == 1200
    with pytest.raises(Exception):
        load(product="GCOV", layer="VV")


def test_subset_of_a_product(spark, fake, tmp_path):
    path, t, x, y = fake
    lon, lat = -117.0 + 600 / 90_000, 36.1446 - 450 / 111_000
    box = (lon - 0.001, lat - 0.001, lon + 0.001, lat + 0.001)
    asked = []
    done = product.subset_product(spark, path, "gcov", box, str(tmp_path / "out"), engine="fake_products", confirm=lambda n, text: asked.append((n, text)) or True)
    assert [d.rsplit("/", 1)[1] for d in done] == ["GCOV_freqA_HH_HHHH_2025-11-03_subset", "GCOV_freqA_HV_HVHV_2025-11-03_subset"]
    df, meta = product.read_tiles(spark, done[0])
    w = meta["pixel_window"]
    assert df.count() == w["height"] * w["width"] > 0 and asked == [(2 * 4 * w["height"] * w["width"], product.human_size(8 * w["height"] * w["width"]))]
    (x0, y0), (x1, y1) = project(*box[:2], 32611), project(*box[2:], 32611)
    assert w["width"] == int(((x >= x0) & (x <= x1)).sum()) and w["height"] == int(((y >= y0) & (y <= y1)).sum())
    r = df.where("row = 1 and col = 2").first()
    assert r.value == pytest.approx(float(t["/science/LSAR/GCOV/grids/frequencyA/HHHH"][w["row_start"] + 1, w["col_start"] + 2])) and r.x == x[w["col_start"] + 2]
    assert {"source_granule", "product_type", "frequency", "polarization", "layer", "date", "start_time", "end_time", "orbit", "track", "frame", "crs", "epsg", "bbox_wgs84", "pixel_window", "dtype", "output"} <= set(meta)
    assert (meta["source_granule"], meta["orbit"], meta["date"], meta["transform"][2]) == ("g", 77, "2025-11-03", 500_000.0 + 30 * w["col_start"])
    amp = product.subset_product(spark, path, "GSLC", box, str(tmp_path / "slc"), bands=["HH"], engine="fake_products")
    r = product.read_tiles(spark, amp[0])[0].where("row = 0 and col = 0").first()
    assert amp[0].endswith("GSLC_freqA_HH_HH_amplitude_2025-11-03_subset") and r.value == pytest.approx(abs(complex(t["/science/LSAR/GSLC/grids/frequencyA/HH"][w["row_start"], w["col_start"]])))
    assert product.subset_product(spark, path, "GCOV", box, str(tmp_path / "no"), engine="fake_products", confirm=lambda *a: False) == []
    for bad in (("GCOV", (0, 0, 1, 1)), ("RSLC", box)):
        with pytest.raises(ValueError):
            product.subset_product(spark, path, bad[0], bad[1], str(tmp_path / "no"), engine="fake_products")
    # the commands, on the product and on the tiles made of it
    run = lambda *argv: cli.run(spark, cli.build_parser().parse_args(list(argv)))
    text = ",".join(map(str, box))
    assert len(run("subset", path, f"--bbox={text}", "--engine", "fake_products", "--output", str(tmp_path / "cli"))["written"]) == 2
    assert run("subset", done[0], f"--bbox={text}").count() == df.count()
    assert run("subset", done[0], f"--bbox={box[0]},{box[1]},{lon},{lat}").count() < df.count()
    assert run("read", path, "--engine", "fake_products").count() == 1200
    product.write_tiles(df.withColumn("phase", F.lit(1.0)).withColumn("iono", F.lit(0.25)), str(tmp_path / "phase"))
    assert run("insar", str(tmp_path / "phase"), "--ionosphere", "iono").first().displacement == pytest.approx(-0.24 * 0.75 / (4 * np.pi))


def test_rgb_and_band_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, j, float(i * 10 + j), 2 * i, 3) for i in range(10) for j in range(10)], "row int, col int, red double, green int, blue int")
    product.export_rgb(df, str(tmp_path / "rgb_db"))
    out, meta = product.read_tiles(spark, str(tmp_path / "rgb_db"))
    assert meta["stretch"] == {"red": [pytest.approx(1.98), pytest.approx(97.02)]} and meta["band_count"] == 3 and meta["calibration"] == "gamma0"
    assert out.agg(F.min("red"), F.max("red"), F.max("green")).first()[:] == (0, 255, 18)


def test_shards_audit_and_fits(spark, tmp_path):
    import json

    a = spark.createDataFrame([("t1", 1)], "tile_id string, x int")
    product.write_shards(a, str(tmp_path / "shards"))
    product.write_shards(spark.createDataFrame([("t2", 2, "new")], "tile_id string, x int, y string"), str(tmp_path / "shards"))
    product.write_shards(a.withColumn("x", F.lit(9)), str(tmp_path / "shards"))
    assert sorted((r.tile_id, r.x, r.y) for r in product.read_shards(spark, str(tmp_path / "shards")).collect()) == [("t1", 9, None), ("t2", 2, "new")]
    product.write_audit(a, str(tmp_path / "audit"), ["x", "nothing", "tile_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).columns == ["x", "tile_id"]
    from gridrel.operators.aggregate import fit_ols

    rows = spark.createDataFrame([(float(i), 2.0 * i + (-1) ** i) for i in range(10)], "x double, y double")
    stats = product.write_fits({"d_hv": fit_ols(rows, "x", "y")}, str(tmp_path / "fit"), ["kept 10 rows"])
    assert json.loads((tmp_path / "fit/fit_stats.json").read_text()) == stats and stats["d_hv"]["n"] == 10
    assert stats["d_hv"]["slope"] == pytest.approx(np.polyfit(range(10), [2.0 * i + (-1) ** i for i in range(10)], 1)[0])
    assert "- d_hv: slope=+" in (tmp_path / "fit/decisions_log.md").read_text()


def test_raster_files(spark, tmp_path):
    (tmp_path / "fake_rasters.py").write_text("import numpy as np\n\nclass open:\n    def __init__(self, path):\n        self.nodata = -1.0\n    def read(self):\n        return np.array([[[1, -1], [3, 4]], [[5, 6], [np.nan, 8]]], np.float32)\n    def __enter__(self):\n        return self\n    def __exit__(self, *a):\n        pass\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_rasters.py"))
    (tmp_path / "a.tif").write_text("x")
    rows = product.read_rasters(spark, [str(tmp_path / "a.tif"), str(tmp_path / "none.tif")], "fake_rasters").collect()
    assert {(r.band, r.row, r.col): r.value for r in rows} == {(1, 0, 0): 1, (1, 0, 1): None, (1, 1, 0): 3, (1, 1, 1): 4, (2, 0, 0): 5, (2, 0, 1): 6, (2, 1, 0): None, (2, 1, 1): 8}


def test_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    for k, s in (("t1", "ok"), ("t2", "memory_error"), ("t2", "memory_error")):
        product.append_log(spark.createDataFrame([(k, s)], "tile_id string, status string"), log)
    assert [r.tile_id for r in product.failed_tiles(spark, log).collect()] == ["t2"]


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    part = lambda a, b: spark.range(a, b).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 2).alias("key"), F.lit(1.0).alias("value"))
    part(0, 100).write.mode("append").parquet(src)
    schema = part(0, 1).schema
    run_once(new_scenes(spark, src, schema), out, ck)
    part(100, 150).write.mode("append").parquet(src)
    run_once(new_scenes(spark, src, schema), out, ck)
    assert spark.read.parquet(out).count() == 150
    agg = windowed_counts(new_scenes(spark, src, schema))
    q = agg.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 150
