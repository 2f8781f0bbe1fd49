"""Bounding boxes, GeoJSON envelopes, UTM and affine grids."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.functions.algebra import col

BBox = tuple[float, float, float, float]


def validate_bbox(bbox: BBox) -> BBox:
    """(west, south, east, north) in degrees; ValueError where it is no box (the antimeridian is not crossed)."""
    w, s, e, n = map(float, bbox)
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s <= 90 and -90 <= n <= 90):
        raise ValueError(f"bounding box outside the globe: {bbox}")
    if s >= n or w >= e:
        raise ValueError(f"empty bounding box: {bbox}")
    return w, s, e, n


def bbox_is_valid(w, s, e, n) -> Column:
    w, s, e, n = map(col, (w, s, e, n))
    return F.coalesce(w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90) & (s < n) & (w < e), F.lit(False))


def _positions(node) -> list[tuple[float, float]]:
    """All positions below coordinates of any depth."""
    if node and isinstance(node[0], int | float):
        return [(node[0], node[1])]
    return [p for child in node or [] for p in _positions(child)]


def geojson_bbox(g: dict) -> BBox:
    """Envelope of a geometry, a Feature or a FeatureCollection."""
    kind, todo = g.get("type"), []
    if kind == "FeatureCollection":
        todo = [geojson_bbox(f) for f in g["features"]]
    elif kind == "Feature":
        return geojson_bbox(g["geometry"])
    elif kind == "GeometryCollection":
        todo = [geojson_bbox(f) for f in g["geometries"]]
    elif "coordinates" in g:
        todo = [(x, y, x, y) for x, y in _positions(g["coordinates"])]
    if not todo:
        raise ValueError("no coordinates")
    w, s, e, n = zip(*todo, strict=True)
    return min(w), min(s), max(e), max(n)


def parse_bbox(source) -> BBox:
    """A 4-sequence, a GeoJSON mapping or text, a GeoJSON file, or text of four numbers with commas, in this order."""
    if isinstance(source, list | tuple):
        if len(source) != 4:
            raise ValueError("a bounding box has four numbers")
        return validate_bbox(tuple(source))
    if isinstance(source, dict):
        return validate_bbox(geojson_bbox(source))
    text = str(source).strip()
    if text.startswith("{"):
        return validate_bbox(geojson_bbox(json.loads(text)))
    if text.lower().endswith((".geojson", ".json")):
        return validate_bbox(geojson_bbox(json.loads(Path(text).read_text())))
    if text.lower().endswith((".shp", ".gpkg")):
        raise ValueError("shapefiles and geopackages need a reader that is not installed; convert to GeoJSON")
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"cannot read a bounding box from {source!r}")
    return validate_bbox(tuple(float(p) for p in parts))


def parse_bbox_text(text) -> Column:
    """STRUCT<west, south, east, north> of comma-separated text; NULL where it is not four numbers."""
    parts = F.split(col(text), ",")
    names = ("west", "south", "east", "north")
    values = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(4)]
    ok = F.size(parts) == 4
    for v in values:
        ok = ok & v.isNotNull()
    return F.when(ok, F.struct(*[v.alias(k) for k, v in zip(names, values, strict=True)]))


def geojson_envelopes(df: DataFrame, id_: str, geojson: str) -> DataFrame:
    """Envelope per row of GeoJSON text, without a UDF: positions are taken from coordinates only, of any depth.

    Properties, boxes and the like are not read.  Geometries, Features and collections of both
    are known; a row without coordinates has no envelope.
    """
    inner = ("", ".geometries[*]")
    places = [f"$.{a}{g}.coordinates".replace("..", ".") for a in ("", "geometry", "features[*].geometry") for g in inner]
    found = F.concat_ws(" ", *[F.get_json_object(geojson, p) for p in places])
    xy = F.regexp_extract_all(found, F.lit(r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s*,\s*-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), 1)
    pts = df.select(id_, F.explode(xy).alias("p")).select(id_, F.split("p", ",").alias("p"))
    x, y = F.trim(F.col("p")[0]).cast("double"), F.trim(F.col("p")[1]).cast("double")
    return pts.groupBy(id_).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def parse_window(text: str) -> tuple[str, str]:
    """Two dates with a comma between, as UTC instants."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 2:
        raise ValueError(f"a window is two dates: {text!r}")
    return f"{parts[0]}T00:00:00Z", f"{parts[1]}T00:00:00Z"


# WGS 84 and the coefficients of the Krueger series to third order.
_A, _F, _K0, _E0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm_forward(lon, lat, epsg) -> dict[str, Column]:
    """Easting and northing of geographic coordinates in a zone of EPSG 326xx or 327xx."""
    lon, lat, epsg = map(col, (lon, lat, epsg))
    zone, south = epsg % 100, (F.floor(epsg / 100) % 10) == 7
    dl, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    e = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return {"easting": _E0 + _K0 * _RECT * x, "northing": F.when(south, 10_000_000.0).otherwise(0.0) + _K0 * _RECT * y}


#: The way back of the same series.
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_inverse(easting, northing, epsg) -> dict[str, Column]:
    """Longitude and latitude of a place in a zone of EPSG 326xx or 327xx."""
    easting, northing, epsg = map(col, (easting, northing, epsg))
    zone, south = epsg % 100, (F.floor(epsg / 100) % 10) == 7
    xi0 = (northing - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _RECT)
    eta0 = (easting - _E0) / (_K0 * _RECT)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return {"lon": zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), "lat": F.degrees(phi)}


def latlon_bounds(a, c0, e, f0, height, width, epsg) -> dict[str, Column]:
    """South, west, north, east of a raster's two corners (its first and its last) in degrees."""
    a, c0, e, f0, height, width = (F.lit(v) if isinstance(v, int | float) else col(v) for v in (a, c0, e, f0, height, width))
    epsg = F.lit(epsg) if isinstance(epsg, int) else col(epsg)
    first, last = utm_inverse(c0, f0 + height * e, epsg), utm_inverse(c0 + width * a, f0, epsg)
    return {"south": first["lat"], "west": first["lon"], "north": last["lat"], "east": last["lon"]}


def project(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    """One place in the projection of an EPSG code (4326, 326xx or 327xx), on the driver; ValueError for others."""
    if epsg == 4326:
        return lon, lat
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG {epsg} is neither 4326 nor a UTM zone")
    dl, phi, e = math.radians(lon - (epsg % 100 * 6 - 183)), math.radians(lat), 2 * math.sqrt(_N) / (1 + _N)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _E0 + _K0 * _RECT * x, (1e7 if epsg // 100 == 327 else 0.0) + _K0 * _RECT * y


def pixel_window(x, y, epsg: int, bbox: BBox) -> tuple[int, int, int, int]:
    """(row start, row stop, column start, column stop) of the pixel centres inside a box in degrees, edges included.

    x ascends, y ascends or descends; the box is projected by its two corners.  ValueError if no centre lies inside.
    """
    w, s, e, n = validate_bbox(bbox)
    (x0, y0), (x1, y1) = project(w, s, epsg), project(e, n, epsg)
    cols = [i for i, v in enumerate(x) if x0 <= v <= x1]
    rows = [i for i, v in enumerate(y) if y0 <= v <= y1]
    if not cols or not rows:
        raise ValueError(f"the box {bbox} meets no pixel of the product")
    return rows[0], rows[-1] + 1, cols[0], cols[-1] + 1


def geojson_features(df: DataFrame, geojson: str, fields: list[str]) -> DataFrame:
    """A row for each feature of collections of points: lon, lat and the named properties as text; what is missing is NULL."""
    feature = "struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>"
    rows = df.select(F.explode(F.from_json(F.get_json_object(geojson, "$.features"), f"array<{feature}>")).alias("f"))
    xy = F.col("f.geometry.coordinates")
    return rows.select(F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"), *[F.try_element_at("f.properties", F.lit(k)).alias(k) for k in fields])


def pixel_centre(row, c, a: float, c0: float, e: float, f0: float) -> dict[str, Column]:
    """Affine pixel centres: origin c0, f0 at the corner, steps a, e."""
    return {"x": c0 + (col(c) + 0.5) * a, "y": f0 + (col(row) + 0.5) * e}


def world_to_pixel(x, y, a: float, c0: float, e: float, f0: float) -> dict[str, Column]:
    return {"col": F.floor((col(x) - c0) / a).cast("int"), "row": F.floor((col(y) - f0) / e).cast("int")}


def multilooked_affine(affine: tuple, looks: tuple[int, int]) -> tuple:
    a, b, c, d, e, f = affine
    return a * looks[1], b, c, d, e * looks[0], f


def window_affine(x: list[float], y: list[float], full: tuple) -> tuple:
    """Affine of a sub-window from its centres; a single pixel takes the full grid's spacing."""
    dx = x[1] - x[0] if len(x) > 1 else full[0]
    dy = y[1] - y[0] if len(y) > 1 else full[4]
    return dx, 0.0, x[0] - dx / 2, 0.0, dy, y[0] - dy / 2


def bbox_window(df: DataFrame, bbox: BBox, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels whose centres lie in the box, edges included: a range predicate that reaches the scan."""
    w, s, e, n = bbox
    return df.where(F.col(x).between(w, e) & F.col(y).between(s, n))
