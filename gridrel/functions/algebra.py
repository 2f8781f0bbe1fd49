"""Per-pixel and per-row functions as Column expressions; NULL stands for missing (the reference's NaN)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
#: Calibration offset (dB), epoch of delta_time (ms), metres per degree.
PALSAR_OFFSET, DELTA_EPOCH_MS, M_LAT, M_LON = 83.0, 1_514_764_800_000, 110_540.0, 111_320.0
FULL_POWER_BEAMS = ("5", "6", "8", "11", "BEAM0101", "BEAM0110", "BEAM1000", "BEAM1011")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def linear_to_db(x: Column | str, fill: float | None = None) -> Column:
    return F.when(col(x) > 0, 10 * F.log10(col(x))).otherwise(F.lit(fill).cast("double"))


def db_to_linear(x: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(x) / 10)


def sigma0(gamma0: Column | str, factor: Column | str | None) -> Column:
    return F.lit(None).cast("double") if factor is None else col(gamma0) * col(factor)


def span(hh=None, hv=None, vv=None) -> Column | None:
    """Total power from the bands at hand; the cross term counts twice only with both co-polar bands."""
    have = [col(b) for b in (hh, vv) if b is not None]
    if hv is not None:
        have.append(2 * col(hv) if len(have) == 2 else col(hv))
    return sum(have[1:], have[0]) if have else None


def rfdi(hh=None, hv=None, vv=None) -> Column | None:
    if hv is None or (hh is None and vv is None):
        return None
    co = (col(hh) + col(vv)) / 2 if hh is not None and vv is not None else col(hh if hh is not None else vv)
    return clip((co - col(hv)) / (co + col(hv) + EPS), -1.0, 1.0)


def volume_proxy(hh, hv) -> Column:
    return clip(col(hv) / (col(hh) + col(hv) + EPS), 0.0, 1.0)


def indices(hh, hv, vv=None) -> dict[str, Column]:
    """hh_hv_ratio, its dB, biomass_index, its dB, and with vv the rvi."""
    hh, hv = col(hh), col(hv)
    ratio, biomass = hh / (hv + EPS), hh + hv
    out = {"hh_hv_ratio": ratio, "hh_hv_ratio_db": linear_to_db(ratio), "biomass_index": biomass, "biomass_index_db": linear_to_db(biomass)}
    return out | ({} if vv is None else {"rvi": 4 * hv / (hh + col(vv) + 2 * hv + EPS)})


def dn_to_db(dn, offset: float = PALSAR_OFFSET) -> Column:
    return F.when(col(dn) > 0, 10 * F.log10(col(dn) * col(dn)) - offset)


def delta_time_ms(seconds) -> Column:
    return col(seconds) * 1000 + DELTA_EPOCH_MS


def ms_to_timestamp(ms) -> Column:
    return F.timestamp_millis(F.floor(col(ms)).cast("long"))


def year_of(text) -> Column:
    """Year of an ISO text, NULL where it can't be read."""
    return F.year(F.try_to_timestamp(col(text)))


def conj_product(a_re, a_im, b_re, b_im) -> tuple[Column, Column]:
    a_re, a_im, b_re, b_im = map(col, (a_re, a_im, b_re, b_im))
    return a_re * b_re + a_im * b_im, a_im * b_re - a_re * b_im


def magnitude(re, im) -> Column:
    return F.sqrt(col(re) * col(re) + col(im) * col(im))


def phase(re, im) -> Column:
    return F.atan2(col(im), col(re))


def displacement(phi, wavelength: float = 0.24, incidence=None) -> Column:
    los = -wavelength * col(phi) / (4 * math.pi)
    if incidence is None:
        return los
    c = F.cos(col(incidence))
    return los / F.when(F.abs(c) < 1e-6, 1e-6).otherwise(c)


def look_factors(azimuth: float, range_: float, target: float) -> tuple[int, int]:
    """Looks to reach a target spacing; halves go to the even number."""
    return max(1, round(target / azimuth)), max(1, round(target / range_))


def mask_below(value, quality, threshold: float = 0.3, fill: float | None = None) -> Column:
    """fill where quality is below threshold; a missing quality keeps the value."""
    return F.when(col(quality) < threshold, F.lit(fill).cast("double")).otherwise(col(value))


def stretch(x, lo, hi) -> Column:
    """Linear stretch between two statistics, clipped; 0 where they coincide or x is missing."""
    x, lo, hi = col(x), col(lo), col(hi)
    return F.coalesce(F.when(hi > lo, clip((x - lo) / F.nullif(hi - lo, F.lit(0.0)), 0.0, 1.0)), F.lit(0.0))


def gamma_correct(x, gamma: float = 0.5) -> Column:
    return F.pow(clip(col(x), 0.0, 1.0), F.lit(gamma))


def to_uint8(x) -> Column:
    return F.coalesce(F.floor(clip(col(x), 0.0, 1.0) * 255), F.lit(0)).cast("int")


def colour(x, lo, hi, table: list[tuple[int, int, int]] | None = None) -> Column:
    """STRUCT<r, g, b, a> of x between lo and hi in a table of 256 colours (shades of grey without one); clear where x is missing."""
    table = table or [(k, k, k) for k in range(256)]
    place = F.least(F.floor(stretch(x, lo, hi) * 256), F.lit(255)).cast("int") + 1
    parts = [F.element_at(F.array(*[F.lit(c[k]) for c in table]), place).alias(n) for k, n in enumerate("rgb")]
    return F.struct(*parts, F.when(col(x).isNull(), 0).otherwise(255).alias("a"))


def utm_epsg(lon, lat) -> Column:
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + F.floor((col(lon) + 180) / 6) + 1).cast("int")


def h_alpha_zone(entropy, alpha) -> Column:
    """Zones 1 to 9 of the entropy-alpha plane: by entropy first, and by alpha inside, both upwards (1: surfaces, 9: random scatter); NULL without both."""
    h, a = col(entropy), col(alpha)
    row = F.when(h < 0.5, 0).when(h < 0.9, 1).otherwise(2)
    place = F.when(a < 42.5, 1).when(a < 47.5, 2).otherwise(3)
    return F.when(h.isNotNull() & a.isNotNull(), 3 * row + place)


def human_size(n, unit: str | None = None) -> Column:
    """Bytes to one decimal in the largest unit that is at most their number (B below it), or in the unit named."""
    n = col(n).cast("double")
    text = lambda power, name: F.format_string(f"%.1f {name}", F.bround(n / 1024.0**power, 1))
    units = ("B", "KB", "MB", "GB", "TB")
    if unit is not None:
        return text(units.index(unit), unit)
    out = text(4, "TB")
    for power in (3, 2, 1, 0):
        out = F.when(n < 1024.0 ** (power + 1), text(power, units[power])).otherwise(out)
    return out


def tile_id(west, south) -> Column:
    """Signed fixed-width text of the south-west corner, to four decimals: + becomes p, - becomes m."""
    return F.translate(F.concat(F.format_string("x%+09.4f", col(west)), F.format_string("_y%+09.4f", col(south))), "+-", "pm")


def bbox_wkt(w, s, e, n) -> Column:
    w, s, e, n = (col(x).cast("string") for x in (w, s, e, n))
    pt = lambda x, y: F.concat(x, F.lit(" "), y)
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", pt(w, s), pt(e, s), pt(e, n), pt(w, n), pt(w, s)), F.lit("))"))


def chip_geometry(lon, lat, metres: float) -> dict[str, Column]:
    dy = F.lit(metres / 2 / M_LAT)
    dx = metres / 2 / (M_LON * F.cos(F.radians(col(lat))))
    return {"west": col(lon) - dx, "south": col(lat) - dy, "east": col(lon) + dx, "north": col(lat) + dy}


def t_cdf_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(tiny, 1 - (a + b) * x / (a + 1)) if 1 - (a + b) * x / (a + 1) > 0 else 1 / (1 - (a + b) * x / (a + 1) or tiny)
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Value that |T| exceeds with chance p, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf_tail(mid, df) > p else (lo, mid)
    return (lo + hi) / 2
