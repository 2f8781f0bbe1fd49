"""Command line: python -m gridrel.cli COMMAND ...; rasters are parquet tiles (see sources.product)."""

from __future__ import annotations

import argparse
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrel.functions import algebra as A
from gridrel.functions.geo import bbox_window, parse_bbox, pixel_centre, project
from gridrel.operators import aggregate, rgb, window2d
from gridrel.sources import product


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridrel")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        s = sub.add_parser(name)
        s.add_argument("source", nargs="+" if name == "timeseries" else None)
        s.add_argument("--output")
        for flag, kw in options:
            s.add_argument(flag, **kw)

    add("info")
    engine = ("--engine", {"default": "h5py", "help": "module that opens product files"})
    add("read", ("--product", {"default": "GCOV"}), ("--layer", {"default": "HH"}), ("--frequency", {"default": "A"}), engine)
    add("multilook", ("--looks-y", {"type": int, "default": 3}), ("--looks-x", {"type": int, "default": 3}), ("--band", {"default": "value"}))
    add("rgb", ("--method", {"default": "standard"}))
    add("insar", ("--mode", {"choices": ("phase2disp", "coherence"), "default": "phase2disp"}), ("--wavelength", {"type": float, "default": 0.24}), ("--window", {"type": int, "default": 5}), ("--ionosphere", {"help": "column of the ionospheric phase to take off first"}))
    add("timeseries", ("--method", {"choices": ("cov", "cusum"), "default": "cov"}))
    add("forests", ("--threshold-db", {"type": float, "default": -15.0}))
    add("subset", ("--bbox", {"required": True}), ("--product", {"default": "GCOV"}), ("--frequency", {"default": "A"}), ("--layers", {"nargs": "*"}), engine)
    return p


def shape_of(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.max("row"), F.max("col")).first()
    return r[0] + 1, r[1] + 1


def is_tiles(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pixels")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | dict:
    if a.command == "timeseries":
        scenes = [product.read_tiles(spark, s)[0].withColumn("t", F.lit(i)) for i, s in enumerate(a.source)]
        cube = reduce(DataFrame.unionByName, scenes)
        return aggregate.coefficient_of_variation(cube) if a.method == "cov" else aggregate.cusum(cube)[1].select("row", "col", "magnitude")
    if a.command == "read":
        product.register(spark)
        px = spark.read.format("sar_product").options(product=a.product, layer=a.layer, frequency=a.frequency, path=a.source, engine=a.engine).load()
        return px.withColumn("value", F.when(F.col("value_im").isNotNull(), A.magnitude("value", "value_im")).otherwise(F.col("value"))).drop("value_im")
    if a.command == "subset" and not is_tiles(spark, a.source):
        return {"written": product.subset_product(spark, a.source, a.product, a.bbox, a.output or "subset", a.frequency, layers=a.layers, engine=a.engine)}
    df, meta = product.read_tiles(spark, a.source)
    if a.command == "info":
        return meta | {"columns": df.columns, "pixels": df.count()}
    if a.command == "multilook":
        return aggregate.multilook(df, [a.band], shape_of(df), (a.looks_y, a.looks_x))
    if a.command == "rgb":
        return rgb.make_rgb(df, a.method)
    if a.command == "insar":
        phase = F.col("phase") - F.col(a.ionosphere) if a.ionosphere else F.col("phase")
        return df.withColumn("displacement", A.displacement(phase, a.wavelength)) if a.mode == "phase2disp" else window2d.coherence(df, shape_of(df), a.window)
    if a.command == "forests":
        return df.withColumn("forest", A.linear_to_db("hv") > a.threshold_db)
    # tiles: by their x and y, else by the transform and projection that their sidecar tells
    if not {"x", "y"} <= set(df.columns):
        if not meta.get("transform"):
            raise ValueError("these tiles have neither x and y nor a transform")
        dx, _, x0, _, dy, y0 = meta["transform"]
        xy = pixel_centre("row", "col", dx, x0, dy, y0)
        df = df.withColumns({"x": xy["x"], "y": xy["y"]})
    w, s, e, n = parse_bbox(a.bbox)
    epsg = int(str(meta.get("crs") or "EPSG:4326").rsplit(":", 1)[-1])
    return bbox_window(df, (*project(w, s, epsg), *project(e, n, epsg)))


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("gridrel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, a)
    if isinstance(out, dict):
        print(json.dumps(out, sort_keys=True))
    elif a.output:
        product.write_tiles(out, a.output, metadata={"command": a.command})
    else:
        out.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
