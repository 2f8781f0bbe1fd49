"""Relations of the engine's kinds derived from the driver's tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "embeddings")
#: An image has some 60 rows of its table in a pixel, so it grows with the table; {side} is its side.
LEAST_SIDE = 32
_A, _B = "62.83185307179586e0 * l_discount", "62.83185307179586e0 * l_tax"

#: name -> SQL over tables in braces and over other relations by name.  {ms(x)} is epoch milliseconds, {side} an image's side.
RELATIONS: dict[str, str] = {
    "dim": f"SELECT CAST(greatest({LEAST_SIDE}, floor(sqrt(count(*) / 60e0))) AS INT) AS n FROM {{lineitem}}",
    "px": "SELECT CAST(l_orderkey % {side} AS INT) AS r, CAST(l_partkey % {side} AS INT) AS c, round(avg(l_extendedprice) / 1e5, 9) AS hh, round(avg(l_quantity) / 1e3, 9) AS hv, round(avg(l_extendedprice * (1 - l_discount)) / 1e5, 9) AS vv FROM {lineitem} GROUP BY 1, 2",
    "hole": "SELECT r, c, CASE WHEN (r * 7 + c * 3) % 29 = 0 THEN NULL ELSE hh END AS v FROM px",
    "cube": "SELECT CAST(l_orderkey % {side} AS INT) AS r, CAST(l_partkey % {side} AS INT) AS c, CAST(month(l_shipdate) - 1 AS INT) AS t, CAST(month(l_shipdate) - 1 AS DOUBLE) * 30.4375e0 AS tm, CASE WHEN (l_orderkey % {side} + l_partkey % {side} + month(l_shipdate)) % 37 = 0 THEN NULL ELSE round(avg(l_extendedprice) / 1e5, 9) END AS v FROM {lineitem} GROUP BY 1, 2, 3, 4, (l_orderkey % {side} + l_partkey % {side} + month(l_shipdate)) % 37",
    "slc": f"SELECT CAST(l_orderkey % {{side}} AS INT) AS r, CAST(l_partkey % {{side}} AS INT) AS c, round(avg(l_extendedprice * cos({_A})) / 1e5, 9) AS a_re, round(avg(l_extendedprice * sin({_A})) / 1e5, 9) AS a_im, round(avg(l_extendedprice * cos({_B})) / 1e5, 9) AS b_re, round(avg(l_extendedprice * sin({_B})) / 1e5, 9) AS b_im FROM {{lineitem}} GROUP BY 1, 2",
    "cov": f"""SELECT r, c, round(avg(x1 * x1 + y1 * y1), 9) AS c11, round(avg(x2 * x2 + y2 * y2), 9) AS c22, round(avg(x3 * x3 + y3 * y3), 9) AS c33,
        round(avg(x1 * x2 + y1 * y2), 9) AS c12_re, round(avg(y1 * x2 - x1 * y2), 9) AS c12_im, round(avg(x1 * x3 + y1 * y3), 9) AS c13_re, round(avg(y1 * x3 - x1 * y3), 9) AS c13_im,
        round(avg(x2 * x3 + y2 * y3), 9) AS c23_re, round(avg(y2 * x3 - x2 * y3), 9) AS c23_im
        FROM (SELECT CAST(l_orderkey % {{side}} AS INT) AS r, CAST(l_partkey % {{side}} AS INT) AS c, l_extendedprice / 1e5 * cos({_A}) AS x1, l_extendedprice / 1e5 * sin({_A}) AS y1,
        l_quantity / 1e2 * cos({_B}) AS x2, l_quantity / 1e2 * sin({_B}) AS y2, l_extendedprice * (1 - l_discount) / 1e5 * cos({_B}) AS x3, l_extendedprice * (1 - l_discount) / 1e5 * sin({_B}) AS y3 FROM {{lineitem}}) k GROUP BY r, c""",
    "shots": """SELECT o_orderkey AS id, (o_totalprice - floor(o_totalprice / 1000) * 1000) / 1000 * 0.05e0 AS lon, (7 * o_totalprice - floor(7 * o_totalprice / 977) * 977) / 977 * 0.05e0 AS lat,
        CAST(o_custkey % 2 AS INT) AS side, round(o_totalprice / 1000, 6) AS agbd, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS quality, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS degrade FROM {orders}""",
    "scenes": "SELECT event_id AS scene_id, {ms(ts)} AS scene_ms, user_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS pass, CAST(event_id % 5 AS INT) AS path, event_id % 3 <> 0 AS has_hv FROM {events} WHERE event_type = 'purchase'",
    "targets": "SELECT event_id AS target_id, {ms(ts)} AS ms, user_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 5 AS INT) END AS path, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS pass FROM {events} WHERE event_type = 'click'",
    "pairs": """SELECT o_orderkey AS pair_id, round(o_totalprice / 1000, 6) AS pre_agbd, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE round(o_totalprice / 1100 + c_acctbal / 500, 6) END AS post_agbd,
        0.9e0 + CAST(o_orderkey % 10 AS DOUBLE) / 100 AS pre_sensitivity, 0.9e0 + CAST(o_custkey % 10 AS DOUBLE) / 100 AS post_sensitivity,
        CAST(o_orderkey % 13 AS VARCHAR(9)) AS pre_beam, CAST(o_custkey % 13 AS VARCHAR(9)) AS post_beam, CAST(o_orderkey % 3 AS VARCHAR(9)) AS pre_AntennaPointing, CAST(o_custkey % 3 AS VARCHAR(9)) AS post_AntennaPointing,
        CAST(o_orderkey % 4 AS VARCHAR(9)) AS pre_BeamID, CAST(o_custkey % 4 AS VARCHAR(9)) AS post_BeamID,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(4000 + o_custkey % 997 AS DOUBLE) END AS pre_HH_dn, CAST(3900 + o_orderkey % 991 AS DOUBLE) AS post_HH_dn,
        CAST(1500 + o_custkey % 499 AS DOUBLE) AS pre_HV_dn, CASE WHEN o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1400 + o_orderkey % 503 + o_totalprice / 5000 AS DOUBLE) END AS post_HV_dn,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS VARCHAR(9)) END AS hansen_loss_min, CAST(o_orderkey % 5 + CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) AS hansen_loss_max,
        CASE WHEN o_orderkey % 8 = 0 THEN 'not a date' WHEN o_orderkey % 2 = 0 THEN '2001-05-01' ELSE '2004-02-03' END AS post_sar_date,
        CASE WHEN o_orderkey % 10 = 0 THEN 'no_match' ELSE 'ok' END AS sar_status FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "catalogue": """SELECT CAST(s_suppkey AS INT) AS granule, CASE WHEN s_suppkey % 3 = 0 THEN 'GCOV' WHEN s_suppkey % 3 = 1 THEN 'GSLC' ELSE 'GUNW' END AS product_type,
        CAST(s_suppkey % 50 AS DOUBLE) - 60 AS west, CAST(s_suppkey % 50 AS DOUBLE) - 58 AS east, CAST(s_suppkey % 17 AS DOUBLE) - 12 AS south, CAST(s_suppkey % 17 AS DOUBLE) - 10 AS north,
        CAST(s_suppkey % 28 AS INT) AS day FROM {supplier}""",
}


def _needs(name: str, seen: dict[str, None]) -> dict[str, None]:
    for other in RELATIONS:
        if other != name and (re.search(rf"\b(FROM|JOIN) {other}\b", RELATIONS[name]) or (other == "dim" and "{side}" in RELATIONS[name])):
            _needs(other, seen)
    seen[name] = None
    return seen


def _render(sql: str, ms: str, side: str, table) -> str:
    sql = sql.replace("{side}", side)
    sql = re.sub(r"\{ms\((\w+)\)\}", lambda m: ms.format(m[1]), sql)
    return re.sub(r"\{(\w+)\}", lambda m: table(m[1]), sql)


def with_clause(*names: str, raw: bool = False) -> str:
    """DuckDB (or as written, if raw): WITH RECURSIVE px AS (...), ... for the relations and what they rest on."""
    need: dict[str, None] = {}
    for n in names:
        _needs(n, need)
    if raw:
        return ", ".join(RELATIONS[n] for n in need)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_render(RELATIONS[n], '(epoch_us({}) // 1000)', '(SELECT n FROM dim)', str)})" for n in need)


def image_side(spark: SparkSession, sf_dir: str) -> int:
    return spark.sql(_render(RELATIONS["dim"], "", "", lambda t: "{" + t + "}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).first()["n"]  # one row, from the files' footers


def relation(spark: SparkSession, sf_dir: str, name: str, side: int) -> DataFrame:
    """Spark: the same relation over the parquet tables; pixel places are named row and col, values value."""
    need = [n for n in _needs(name, {}) if n != "dim"]
    used = {t for n in need for t in re.findall(r"\{(\w+)\}", RELATIONS[n])} - {"side"}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    ctes = ", ".join(f"{n} AS ({_render(RELATIONS[n], 'unix_millis(CAST({} AS TIMESTAMP))', str(side), lambda t: '{' + t + '}')})" for n in need)
    df = spark.sql(f"WITH {ctes} SELECT * FROM {name}", **frames)
    return df.withColumnsRenamed({"r": "row", "c": "col", "v": "value", "tm": "time"})
