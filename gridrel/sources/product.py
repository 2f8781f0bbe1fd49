"""Data source "sar_product" for HDF5 products, their metadata, subsets, and raster sinks.

h5py and rasterio are used where installed; an option engine names another module with the same calls.
"""

from __future__ import annotations

import importlib
import json
import logging
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridrel.functions.geo import parse_bbox, pixel_window
from gridrel.sources.catalogue import COVARIANCE, LAYERS, dataset_path, gunw_group

HEAD = "scene_id string, product string, frequency string, polarization string, layer string, row int, col int, x double, y double, epsg int"
#: Terms of a full covariance set (the last three complex), complex layers, default layers of a subset.
TERMS = ("HHHH", "HVHV", "VVVV", "HHHV", "HHVV", "HVVV")
COMPLEX = {*TERMS[3:], "wrappedInterferogram"}
DEFAULT_LAYERS = {"GUNW": ("unwrappedPhase",), "GOFF": ("alongTrackOffset",)}
SUBSETS = ("GCOV", "GSLC", "GUNW", "GOFF")
IDENTITY = "/science/LSAR/identification"
log = logging.getLogger(__name__)


def check_path(path: str, filesystem=None) -> None:
    """Remote paths need a filesystem of their scheme; local ones must exist."""
    scheme = path.split("://", 1)[0] if "://" in path else ""
    if scheme in ("s3", "https"):
        if filesystem is None:
            raise ValueError(f"{scheme} needs a filesystem")
        protocol = getattr(filesystem, "protocol", scheme)
        if scheme not in ((protocol,) if isinstance(protocol, str) else tuple(protocol)):
            raise ValueError(f"the filesystem is not for {scheme}")
    elif not Path(path).exists():
        raise FileNotFoundError(path)


def filesystem_of(name: str | None):
    """The filesystem that a "module:function" makes, on whatever machine it is asked for."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def open_product(path: str, engine: str = "h5py", filesystem=None):
    """A product file for reading, local or remote."""
    check_path(path, filesystem)
    try:
        module = importlib.import_module(engine)
    except ImportError as e:
        raise RuntimeError(f"reading products needs {engine}") from e
    return module.File(filesystem.open(path, "rb") if "://" in path else path, "r")


def _text(v) -> str:
    return v.decode() if isinstance(v, bytes) else str(v)


def frequencies(h5) -> list[str]:
    return [_text(v) for v in h5[f"{IDENTITY}/listOfFrequencies"][:]]


def polarizations(h5, frequency: str = "A") -> list[str]:
    """Polarizations of a frequency, whatever the product; KeyError where none are listed."""
    for product in LAYERS:
        path = f"/science/LSAR/{product}/{'swaths' if product == 'RSLC' else 'grids'}/frequency{frequency}/listOfPolarizations"
        if path in h5:
            return [_text(v) for v in h5[path][:]]
    raise KeyError(f"no polarizations are listed for frequency {frequency}")


def identification(h5) -> dict:
    """product_type, start_time, end_time, orbit, track, frame."""
    texts = {"product_type": "productType", "start_time": "zeroDopplerStartTime", "end_time": "zeroDopplerEndTime"}
    numbers = {"orbit": "absoluteOrbitNumber", "track": "trackNumber", "frame": "frameNumber"}
    return {k: _text(h5[f"{IDENTITY}/{v}"][()]) for k, v in texts.items()} | {k: int(h5[f"{IDENTITY}/{v}"][()]) for k, v in numbers.items()}


def projection(h5, folder: str) -> dict:
    """epsg, affine (a, b, c, d, e, f; origin at the corner), x and y (centres) of the grid that a folder's datasets lie on.

    Coordinates stand beside a dataset (each posting has its own) or in a folder above it.
    """
    parts = folder.rstrip("/").split("/")
    for n in range(len(parts), 1, -1):
        at = "/".join(parts[:n])
        if f"{at}/xCoordinates" in h5:
            x, y = [float(v) for v in h5[f"{at}/xCoordinates"][:]], [float(v) for v in h5[f"{at}/yCoordinates"][:]]
            dx, dy = float(h5[f"{at}/xCoordinateSpacing"][()]), float(h5[f"{at}/yCoordinateSpacing"][()])
            return {"epsg": int(h5[f"{at}/projection"].attrs["epsg_code"]), "affine": (dx, 0.0, x[0] - dx / 2, 0.0, dy, y[0] - dy / 2), "x": x, "y": y}
    raise KeyError(f"no coordinates for {folder}")


def grid_folder(product: str, frequency: str = "A", polarization: str = "HH", posting: int | None = None) -> str:
    """Folder whose projection() is a product's grid; the postings of an unwrapped product have one each."""
    root = f"/science/LSAR/{product}/grids/frequency{frequency}"
    if product != "GUNW":
        return root
    return f"{root}/{gunw_group('coherenceMagnitude', posting)}/{polarization}"


def tree(h5) -> list[tuple[str, list[int], str]]:
    """(name, shape, dtype) of every dataset, in order of name."""
    found: list[tuple[str, list[int], str]] = []
    h5.visititems(lambda name, node: found.append((name, list(node.shape), str(node.dtype))) if hasattr(node, "shape") else None)
    return sorted(found)


CATALOGUE = "granule string, frequencies array<string>, polarizations array<string>, product_type string, start_time string, end_time string, orbit long, track long, frame long, epsg int, affine array<double>, height int, width int"


def read_catalogue(spark: SparkSession, paths: list[str], engine: str = "h5py", filesystem: str | None = None) -> DataFrame:
    """A row of metadata for each file, read by the executors; parts that a file lacks are null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                h5 = open_product(path, engine, filesystem_of(filesystem))
                row = {"granule": path}
                try:
                    bands = frequencies(h5)
                    row |= {"frequencies": bands, "polarizations": polarizations(h5, bands[0])} | identification(h5)
                    grid = projection(h5, grid_folder(row["product_type"], bands[0], row["polarizations"][0]))
                    row |= {"epsg": grid["epsg"], "affine": list(grid["affine"]), "height": len(grid["y"]), "width": len(grid["x"])}
                except KeyError as e:
                    log.warning("%s lacks %s", path, e)
                finally:
                    h5.close()
                rows.append(row)
            texts, longs = pa.list_(pa.string()), ("orbit", "track", "frame")
            kinds = {"granule": pa.string(), "frequencies": texts, "polarizations": texts, "product_type": pa.string(), "start_time": pa.string(), "end_time": pa.string()} | dict.fromkeys(longs, pa.int64())
            kinds |= {"epsg": pa.int32(), "affine": pa.list_(pa.float64()), "height": pa.int32(), "width": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200))).mapInArrow(run, CATALOGUE)


class _Tile(InputPartition):
    def __init__(self, path: str, window: tuple[int, int, int, int]) -> None:
        self.path, self.window = path, window


def _layers(options: dict) -> list[str]:
    return list(TERMS) if options.get("layer") == "*" else options.get("layer", "HH").split(",")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = options

    def _file(self, path: str):
        return open_product(path, self.o.get("engine", "h5py"), filesystem_of(self.o.get("filesystem")))

    def _name(self, layer: str) -> str:
        o = self.o
        product, posting = o.get("product", "GCOV"), int(o["posting"]) if "posting" in o else None
        return dataset_path(product, o.get("frequency", "A"), layer, o.get("polarization", "HH"), posting)

    def partitions(self) -> list[InputPartition]:
        """Tiles of the requested window only: coordinates are planned before any pixel is read."""
        o, out = self.o, []
        tile = int(o.get("tile", 1024))
        for path in o["path"].split(","):
            with self._file(path) as f:
                have = [n for n in map(self._name, _layers(o)) if n in f]
                if not have:
                    raise KeyError(f"{path} has none of {', '.join(_layers(o))}")
                h, w = f[have[0]].shape
                if "window" in o:
                    r0, r1, c0, c1 = (int(v) for v in o["window"].split(","))
                elif "bbox" in o:
                    grid = projection(f, have[0].rsplit("/", 1)[0])
                    r0, r1, c0, c1 = pixel_window(grid["x"], grid["y"], grid["epsg"], parse_bbox(o["bbox"]))
                else:
                    r0, r1, c0, c1 = 0, h, 0, w
            out += [_Tile(path, (r, min(r + tile, r1), c, min(c + tile, c1))) for r in range(r0, r1, tile) for c in range(c0, c1, tile)]
        return out

    def read(self, partition: _Tile) -> Iterator:
        """One Arrow batch a tile; missing values and layers are null."""
        import numpy as np
        import pyarrow as pa

        (r0, r1, c0, c1), o = partition.window, self.o
        n, names = (r1 - r0) * (c1 - c0), _layers(o)
        row, column = np.repeat(np.arange(r0, r1, dtype=np.int32), c1 - c0), np.tile(np.arange(c0, c1, dtype=np.int32), r1 - r0)
        head = [partition.path, o.get("product", "GCOV"), o.get("frequency", "A"), o.get("polarization", "HH"), o.get("layer", "HH")]
        arrays = [pa.array([v] * n, pa.string()) for v in head] + [pa.array(row), pa.array(column)]
        number = lambda a: pa.array(np.ascontiguousarray(a, np.float64).ravel(), pa.float64(), mask=np.isnan(np.asarray(a, np.float64)).ravel())
        with self._file(partition.path) as f:
            have = [x for x in map(self._name, names) if x in f]
            try:
                grid = projection(f, have[0].rsplit("/", 1)[0])
                arrays += [pa.array(np.asarray(grid["x"])[column]), pa.array(np.asarray(grid["y"])[row]), pa.array(np.full(n, grid["epsg"], np.int32))]
            except KeyError:  # a swath in radar geometry has no map coordinates
                arrays += [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32())]
            for layer in names:
                data = f[self._name(layer)][r0:r1, c0:c1] if self._name(layer) in f else None
                if data is not None and data.dtype.names:
                    data = data[data.dtype.names[0]] + 1j * data[data.dtype.names[1]]
                is_complex = data is not None and np.iscomplexobj(data)
                arrays.append(pa.nulls(n, pa.float64()) if data is None else number(data.real if is_complex else data))
                if len(names) == 1 or layer in COMPLEX:
                    arrays.append(number(data.imag) if is_complex else pa.nulls(n, pa.float64()))
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _schema(o).split(", ")])


def _schema(options: dict) -> str:
    """One layer: value and value_im.  Several: a column each, two (<layer>_re, <layer>_im) for complex ones."""
    names = _layers(options)
    if len(names) == 1:
        return f"{HEAD}, value double, value_im double"
    return ", ".join([HEAD, *[f"{n}_re double, {n}_im double" if n in COMPLEX else f"{n} double" for n in names]])


class SarProduct(DataSource):
    """spark.read.format("sar_product").option("product", ...).option("layer", ...).load(path)

    Options: product, frequency, polarization, layer (one, several with commas, or * for the whole
    covariance set), posting, window (row and column starts and stops) or bbox (degrees), tile,
    engine, filesystem ("module:function", for s3 and https).
    """

    @classmethod
    def name(cls) -> str:
        return "sar_product"

    def schema(self) -> str:
        return _schema(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SarProduct)


def calibration_name(name: str) -> str:
    """As catalogue.calibration_of, for one name on the driver."""
    base = name.lower()
    return "sigma0" if "sigma0" in base else "gamma0" if any(k in base for k in ("gamma", "db", "linear")) else "unknown"


def write_tiles(df: DataFrame, path: str, tile: int = 256, metadata: dict | None = None) -> None:
    """Pixels as parquet tiles with a JSON sidecar of the band's description beside them."""
    spark = df.sparkSession
    tiled = df.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int")).withColumn("tile_col", F.floor(F.col("col") / tile).cast("int"))
    tiled.repartition("tile_row", "tile_col").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("tile_row").parquet(f"{path}/pixels")
    spark.createDataFrame([(json.dumps(metadata or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def export_band(df: DataFrame, path: str, affine: tuple | None = None, epsg: int | None = None, description: str = "", extra: dict | None = None) -> None:
    """write_tiles() with the sidecar of a band: output, band_count, calibration by name, transform, crs, nodata, description, and extra."""
    base = {"output": path, "band_count": 1, "calibration": calibration_name(path.rstrip("/").rsplit("/", 1)[-1])}
    write_tiles(df, path, metadata=base | {"transform": affine and list(affine), "crs": epsg and f"EPSG:{epsg}", "nodata": None, "description": description} | (extra or {}))


def export_rgb(df: DataFrame, path: str, bands: tuple[str, str, str] = ("red", "green", "blue"), extra: dict | None = None) -> None:
    """Three bands as eight-bit tiles; bands that are no integers are stretched between their 2nd and 98th percentiles, which the sidecar tells."""
    from gridrel.operators.rgb import percentile_uint8

    stretched, out = {}, df.select("row", "col", *bands)
    for b in bands:
        if out.schema[b].dataType.typeName() in ("double", "float"):
            u8 = percentile_uint8(out, b)
            stretched[b] = list(u8.select("lo", "hi").first())  # two numbers
            out = out.drop(b).join(u8.select("row", "col", F.col("u8").alias(b)), ["row", "col"])
    write_tiles(out.select("row", "col", *bands), path, metadata={"output": path, "band_count": 3, "calibration": calibration_name(path.rsplit("/", 1)[-1]), "stretch": stretched} | (extra or {}))


def read_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/pixels"), json.loads(spark.read.text(f"{path}/sidecar").first()[0])


def read_rasters(spark: SparkSession, paths: list[str], engine: str = "rasterio") -> DataFrame:
    """Pixels of raster files, a row for each band of each (path, band, row, col, value); no data is null.  A file that can't be read has no rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        module = importlib.import_module(engine)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if not Path(path).exists():
                    continue
                with module.open(path) as f:
                    data, nodata = np.asarray(f.read(), np.float64), f.nodata
                for k, band in enumerate(data, 1):
                    void = np.isnan(band) if nodata is None else np.isnan(band) | (band == nodata)
                    r, c = np.indices(band.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * band.size), pa.array(np.full(band.size, k, np.int32)), pa.array(r.ravel()), pa.array(c.ravel()), pa.array(band.ravel(), mask=void.ravel())], names=["path", "band", "row", "col", "value"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200))).mapInArrow(run, "path string, band int, row int, col int, value double")


def subset_paths(product: str, frequency: str, polarization: str, layers: list[str] | None = None) -> list[str]:
    """Layers (as dataset_path takes them) that a subset reads for one polarization; ValueError for other products."""
    if product not in SUBSETS:
        raise ValueError(f"subsets are made of {', '.join(SUBSETS)}, not {product!r}")
    return list(layers or DEFAULT_LAYERS[product]) if product in DEFAULT_LAYERS else [COVARIANCE.get(polarization, polarization) if product == "GCOV" else polarization]


def human_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def subset_product(
    spark: SparkSession, path: str, product: str, bbox, out: str, frequency: str = "A", bands: list[str] | None = None, layers: list[str] | None = None, engine: str = "h5py", filesystem: str | None = None, confirm=None
) -> list[str]:
    """Writes the pixels inside a box, a folder of tiles with its provenance for each band, and returns the folders.

    bands: polarizations, all that the file lists by default.  confirm, where given, is asked with
    the size in bytes and as text before any pixel is read.  Datasets that the file lacks are
    passed over; complex ones are written as amplitudes.  ValueError where the box meets no pixel.
    """
    register(spark)
    product, box = product.upper(), parse_bbox(bbox)
    subset_paths(product, frequency, "HH", layers)
    with open_product(path, engine, filesystem_of(filesystem)) as f:
        try:
            ident = identification(f)
        except KeyError:
            ident = {}
        try:
            bands = bands or polarizations(f, frequency)
        except KeyError:
            bands = ["HH"]
        wanted = []
        for pol in bands:
            for layer in subset_paths(product, frequency, pol, layers):
                name = dataset_path(product, frequency, layer, pol)
                if name not in f:
                    log.warning("%s is not there", name)
                    continue
                grid = projection(f, name.rsplit("/", 1)[0])
                wanted.append((pol, layer, grid, pixel_window(grid["x"], grid["y"], grid["epsg"], box), str(f[name].dtype), f[name].dtype.itemsize))
    total = sum((w[1] - w[0]) * (w[3] - w[2]) * size for *_, w, _, size in wanted)
    if confirm and not confirm(total, human_size(total)):
        return []
    done = []
    for pol, layer, grid, (r0, r1, c0, c1), _, _ in wanted:
        options = {"path": path, "product": product, "frequency": frequency, "polarization": pol, "layer": layer, "window": f"{r0},{r1},{c0},{c1}", "engine": engine} | ({"filesystem": filesystem} if filesystem else {})
        px = spark.read.format("sar_product").options(**options).load()
        cplx = product == "GSLC" or layer in COMPLEX
        value = F.sqrt(F.col("value") * F.col("value") + F.col("value_im") * F.col("value_im")) if cplx else F.col("value")
        label = f"{layer}_amplitude" if cplx else layer
        day = ident.get("start_time", "")[:10]
        name = "_".join([product, f"freq{frequency}", pol, label, *([day] if day else []), "subset"])
        a, _, x0, _, e, y0 = grid["affine"]
        sidecar = {
            "source_granule": Path(path.split("?")[0]).stem, "product_type": product, "frequency": frequency, "polarization": pol, "layer": label, "date": day or None,
            **{k: ident.get(k) for k in ("start_time", "end_time", "orbit", "track", "frame")}, "crs": f"EPSG:{grid['epsg']}", "epsg": grid["epsg"], "bbox_wgs84": dict(zip(("west", "south", "east", "north"), box, strict=True)),
            "pixel_window": {"row_start": r0, "row_stop": r1, "col_start": c0, "col_stop": c1, "height": r1 - r0, "width": c1 - c0}, "dtype": "float32", "output": f"{out}/{name}",
        }
        pixels = px.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "x", "y", value.alias("value"))
        export_band(pixels, f"{out}/{name}", (a, 0.0, x0 + c0 * a, 0.0, e, y0 + r0 * e), grid["epsg"], f"{product} {pol} {label}", sidecar)
        done.append(f"{out}/{name}")
    return done


def write_shards(df: DataFrame, path: str, key: str = "tile_id") -> None:
    """A folder of parquet for each tile or chunk; those that df has are replaced, others stay."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards as one table; columns that some lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_audit(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns, as far as they exist, as CSV with a header."""
    df.select([c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_fits(fits: dict[str, DataFrame], folder: str, decisions: list[str]) -> dict:
    """fit_stats.json and decisions_log.md of fits of one row each; returns what the JSON holds."""
    from gridrel.operators.aggregate import p_value

    rows = {k: f.first().asDict() for k, f in fits.items()}
    stats = {k: {"slope": r["slope"], "intercept": r["intercept"], "r_squared": r["r2"], "p_value": p_value(r), "stderr_slope": r["se_slope"], "stderr_intercept": r["se_intercept"], "n": r["n"]} for k, r in rows.items()}
    lines = [f"{k}: slope={v['slope']:+.3g} (SE {v['stderr_slope']:.3g}), intercept={v['intercept']:+.3g}, R2={v['r_squared']:.3f}, p={v['p_value']:.2e}, n={v['n']}" for k, v in stats.items()]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "fit_stats.json").write_text(json.dumps(stats, indent=2) + "\n")
    Path(folder, "decisions_log.md").write_text("\n".join(["# Decisions log", "", *[f"- {d}" for d in decisions], "", "## Fit results", *[f"- {x}" for x in lines], ""]))
    return stats


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def failed_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a run log that ran out of memory."""
    return spark.read.option("header", True).csv(path).where("status = 'memory_error'").select("tile_id").distinct()
