"""False-colour composites as a table of expressions: percentiles of all its parts together, one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrel.functions.algebra import linear_to_db, stretch, to_uint8
from gridrel.operators.quantiles import cut, quantiles

SPAN, VOL = "(hh + hv + 1e-10)", "(hv / (hh + hv + 1e-10))"


@dataclass(frozen=True)
class Composite:
    """stats: name -> (expression, low and high percentile); channels read the stretched names as columns."""

    stats: dict[str, tuple[str, float, float]]
    channels: tuple[str, str, str]


def _g(x: str, gamma: float) -> str:
    return f"pow(greatest(0.0e0, least(1.0e0, {x})), {gamma}e0)"


def _three(a: str, b: str, c: str, gammas: tuple[float, float, float], cuts=((2, 98),) * 3) -> Composite:
    return Composite({k: (e, *p) for k, e, p in zip("xyz", (a, b, c), cuts, strict=True)}, tuple(_g(k, g) for k, g in zip("xyz", gammas, strict=True)))


_INT = ("sqrt" + SPAN, 2, 98)
# Each method's bands, percentiles, weights and exponents.
METHODS: dict[str, Composite] = {
    "standard": _three("hh_db", "hv_db", "hh_db - hv_db", (0.5, 0.5, 0.5)),
    "vegetation_green": _three("hh / (hh + 2 * hv + 1e-10)", VOL, "sqrt" + SPAN, (0.45, 0.45, 0.54), ((1, 99), (1, 99), (2, 98))),
    "natural_v1": Composite(
        {"i": _INT, "k": ("hv / (hh + 1e-10)", 5, 95), "w": (SPAN, 5, 50)},
        (f"{_g('i', 0.4)} * (0.3e0 + 0.5e0 * (1 - {_g(VOL, 0.5)}))", f"{_g('i', 0.4)} * (0.3e0 + 0.7e0 * {_g('k', 0.6)})", f"{_g('i', 0.4)} * (0.25e0 + 0.3e0 * (1 - w))"),
    ),
    "natural_v2": _three(f"hh * (1 - {VOL})", "hv", "sqrt(hh * hv + 1e-10)", (0.45, 0.45, 0.45)),
    "forest_enhanced": _three(f"((hh - hv) / {SPAN} + 1) / 2", VOL, "sqrt" + SPAN, (0.5, 0.45, 0.5)),
    "landcover": Composite(
        {"i": _INT, "v": (VOL, 5, 95), "s": (f"hh / {SPAN}", 5, 95)},
        (f"{_g('i', 0.45)} * (0.4e0 + 0.4e0 * s) + 0.2e0 * s * {_g('i', 0.45)}", f"{_g('i', 0.45)} * (0.4e0 + 0.6e0 * v)", f"0.35e0 * {_g('i', 0.45)}"),
    ),
    "pseudo_natural": _three("hh_db", "2 * hv_db - hh_db", "(hh_db + hv_db) / 2", (0.5, 0.5, 0.5)),
    "enhanced_contrast": _three("log10(hh + 1e-10) - log10(hv + 1e-10)", "log10(hv + 1e-10) - log10(hh + 1e-10)", "(log10(hh + 1e-10) + log10(hv + 1e-10)) / 2", (0.4, 0.4, 0.4), ((5, 95), (5, 95), (2, 98))),
    "natural_v1_improved": Composite(
        {"i": _INT, "v": (VOL, 5, 95)},
        tuple(f"{_g('i', 0.5)} * (1 - 0.4e0 * v) * {e}" for e in ("(0.4e0 + 0.5e0 * (1 - v))", "(0.5e0 + 0.5e0 * v)", "(0.3e0 + 0.2e0 * (1 - v))")),
    ),
    "natural_v1_improved_b": Composite(
        {"i": _INT, "v": (VOL, 3, 97)},
        tuple(f"{_g('i', 0.55)} * (0.4e0 + 0.6e0 * pow(1 - v, 1.5e0)) * ({e} * (0.3e0 + 0.7e0 * v))" for e in ("0.7e0 - 0.3e0", "0.6e0 + 0.4e0", "0.4e0 - 0.15e0")),
    ),
    "natural_v2_improved": Composite(
        {"i": _INT, "v": (VOL, 5, 95)},
        tuple(f"{_g('i', 0.5)} * (0.5e0 + 0.5e0 * (1 - v)) * ({e} * v)" for e in ("0.6e0 - 0.4e0", "0.4e0 + 0.15e0", "0.25e0 - 0.1e0")),
    ),
    "optical_mimic": Composite(
        {"i": _INT, "v": (VOL, 5, 95)},
        tuple(f"{_g('i * (0.4e0 + 0.6e0 * pow(1 - v, 1.2e0))', 0.5)} * ({bare} + ({forest} - {bare}) * v)" for bare, forest in (("0.70e0", "0.20e0"), ("0.60e0", "0.45e0"), ("0.45e0", "0.15e0"))),
    ),
}
ALIASES = {"standard_dualpol": "standard"}


def list_rgb_methods() -> list[str]:
    return sorted(METHODS)


def make_rgb(df: DataFrame, method: str = "vegetation_green") -> DataFrame:
    """row, col and eight-bit red, green, blue of linear hh, hv by a named method; an unknown name raises ValueError."""
    name = ALIASES.get(method, method)
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(list_rgb_methods())}")
    spec = METHODS[name]
    base = df.select("row", "col", "hh", "hv", linear_to_db("hh").alias("hh_db"), linear_to_db("hv").alias("hv_db"))
    base = base.select("*", *[F.expr(e).alias(f"__{k}") for k, (e, _, _) in spec.stats.items()])
    cuts = quantiles(base, {k: F.col(f"__{k}") for k in spec.stats}, {k: [lo / 100, hi / 100] for k, (_, lo, hi) in spec.stats.items()})
    rows = base.select("row", "col", "hh", "hv", *[stretch(f"__{k}", cut(cuts[k][0]), cut(cuts[k][1])).alias(k) for k in spec.stats])
    return rows.select("row", "col", *[to_uint8(F.expr(e)).alias(c) for c, e in zip(("red", "green", "blue"), spec.channels, strict=True)])


def make_dualpol_rgb(df: DataFrame) -> DataFrame:
    """Unstretched dB composite: hh, hv, hh - hv."""
    hh, hv = linear_to_db("hh"), linear_to_db("hv")
    return df.select("row", "col", hh.alias("red"), hv.alias("green"), (hh - hv).alias("blue"))


def percentile_uint8(df: DataFrame, value: str, low: float = 2, high: float = 98) -> DataFrame:
    """Eight-bit band with its bounds; where the percentiles coincide, minimum and maximum serve."""
    v = F.col(value)
    lo, hi, least, most = quantiles(df, {"v": v}, [low / 100, high / 100, 0, 1])["v"]
    if lo is not None and hi <= lo:
        lo, hi = least, most
    return df.select("row", "col", to_uint8((v - cut(lo)) / (cut(hi) - cut(lo) + 1e-12)).alias("u8"), cut(lo).alias("lo"), cut(hi).alias("hi"))
