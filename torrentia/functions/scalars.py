"""Scalar expressions of the flood report: transforms, classes, labels, blends. NULL in, NULL out unless said."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: Least certainty, in per cent, of each class.
CERTAINTY = ((70, "probable"), (30, "posible"), (5, "poco"))
LOT_WORDS = ((95, "todo el lote"), (60, "la mayor parte del lote"), (40, "la mitad del lote"), (25, "un tercio del lote"), (10, "una parte del lote"))
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
HAND_CUTS = (0.5, 1.0, 2.0, 5.0)
MAX_YEARS = 100


def finite(v: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def cleaned(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as NULL at any depth of structs, arrays and map values."""

    def walk(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return finite(c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(c, lambda _, v: walk(v, kind.valueType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def nodata(v: Column, mark: float) -> Column:
    return F.nullif(v, F.lit(mark))


def plausible_elevation(z: Column) -> Column:
    return F.when(z.between(-100, 7000), z)


def sink_depth(filled: Column, z: Column) -> Column:
    return F.when(filled.isNotNull() & z.isNotNull(), F.greatest(filled - z, F.lit(0.0)))


def slope_percent(degrees: Column) -> Column:
    return 100 * F.tan(F.radians(degrees))


def log10_hectares(area_m2: Column, least: float = 1.0) -> Column:
    return F.log10(F.greatest(area_m2, F.lit(least)) / 1e4)


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(F.greatest(x, F.lit(1e-6))))


def class_of(v: Column, cuts: tuple[float, ...]) -> Column:
    """The index of the half-open interval [previous cut, cut), from 0; NULL from the last cut on and below zero."""
    out = F.when(v < 0, None)
    for i, c in enumerate(cuts):
        out = out.when(v < c, i)
    return out


def frame_code(h_m: Column) -> Column:
    """Depth in whole centimetres, halves to even, 0 to 255."""
    return F.least(F.greatest(F.bround((h_m - 1e-5) * 100), F.lit(0.0)), F.lit(255.0)).cast("smallint")


def water_code(water: Column, reference: Column) -> Column:
    """0 none, 1 water in the dry reference too, 2 new water, 255 outside."""
    return F.when(water.isNull(), 255).when(~water, 0).when(F.coalesce(reference, F.lit(False)), 1).otherwise(2)


def stepped(v: Column, steps: tuple, other: str | None) -> Column:
    out = F.when(v.isNull(), None)
    for least, word in steps:
        out = out.when(v >= least, word)
    return out.otherwise(other)


def certainty_class(c: Column) -> Column:
    return stepped(c, CERTAINTY, None)


def lot_words(pct: Column) -> Column:
    return stepped(pct, LOT_WORDS, "una esquina del lote")


def compass8(dx: Column, dy: Column) -> Column:
    angle = F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45) + 1).cast("int"))


def cell_of(x: Column, y: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """(row, col) of a world point on a north-up grid."""
    return F.floor((y - f) / e), F.floor((x - c) / a)


def spanish_number(v: Column, digits: int) -> Column:
    """Thousands with points, a decimal comma, no trailing zeros, a dash for NULL."""
    s = F.translate(F.format_number(v, digits), ",.", ".,")
    if digits:
        s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), ",$", "")
    return F.coalesce(s, F.lit("—"))


def scenario_id(p_mm: Column, dur_h: Column, wet: Column) -> Column:
    hours = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", dur_h.cast("double")), "0+$", ""), "\\.$", "")
    return F.concat(F.format_string("P%03d_", F.bround(p_mm.cast("double")).cast("int")), hours, F.lit("h"), F.when(wet, "_sat").otherwise(""))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function; SQL has no erf."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))), na_action="ignore")

    return run(x)


def blend(a: Column, b: Column, w: Column) -> Column:
    """Arrays blended with weight w on b, rounded half up."""
    return F.zip_with(a, b, lambda x, y: F.floor(x + (y - x) * w + 0.5))


def neighbours(values: Column, p: Column) -> Column:
    """struct(lo, hi, w): the known values around p, which is clamped to them; values is a sorted array."""
    q = F.least(F.greatest(p, F.element_at(values, 1)), F.element_at(values, -1))
    lo, hi = F.array_max(F.filter(values, lambda v: v <= q)), F.array_min(F.filter(values, lambda v: v >= q))
    w = F.when(lo == hi, F.lit(0.0)).otherwise(F.round((q - lo) / F.nullif(hi - lo, F.lit(0.0)), 6))
    return F.struct(lo.alias("lo"), hi.alias("hi"), w.alias("w"))


def snap(values: Column, p: Column) -> Column:
    """p on a step of 5 from the first of evenly spaced values, clamped to them; else the nearest of them, the first on ties."""
    lo, hi, n = F.element_at(values, 1), F.element_at(values, -1), F.size(values)
    step = F.get(values, F.lit(1)) - lo
    even = (n >= 2) & (step > 0) & F.forall(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.abs(F.get(values, i - 1) - F.get(values, i - 2) - step) < 1e-9)
    stepped_ = F.least(hi, F.greatest(lo, lo + F.floor((p - lo) / 5 + 0.5) * 5))
    near = F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - p).alias("d"), i.alias("i"), v.alias("v"))))["v"]
    return F.when(n == 0, p).when(even, stepped_).otherwise(near)


def duration_unit(hours: Column) -> Column:
    return F.when(hours <= 3, "chaparrón de 3 h").when(hours <= 24, "día").otherwise("temporal de 3 días")


def return_sentence(p: Column, longest: Column, t_a: Column, t_b: Column, hours: Column, since: Column) -> Column:
    """How often a rain of p in so many hours falls, by the record since a year and two sources' return periods; t may be infinite."""
    years = lambda t: F.when(t > MAX_YEARS, F.lit(f"más de {MAX_YEARS}")).otherwise(spanish_number(t, 0))
    apart = (t_b > 0) & ((t_b / t_a > 2) | (t_a / F.nullif(t_b, F.lit(0.0)) > 2))
    return (
        F.when(p > longest, F.concat(F.lit("Más de lo que llovió en cualquier "), duration_unit(hours), F.lit(" desde "), F.coalesce(since, F.lit(1940)).cast("string"), F.lit(".")))
        .when(t_a.isNull(), "")
        .when(t_a > MAX_YEARS, f"Una lluvia así es más rara que una vez cada {MAX_YEARS} años.")
        .when(t_a < 1.5, "Una lluvia así pasa casi todos los años.")
        .when(apart, F.concat(F.lit("Una lluvia así pasa cada "), years(F.least(t_a, t_b)), F.lit(" a "), years(F.greatest(t_a, t_b)), F.lit(" años según la fuente.")))
        .otherwise(F.concat(F.lit("Una lluvia así pasa cada ~"), years(t_a), F.lit(" años.")))
    )


def rain_pixel_centre(v: Column) -> Column:
    """The centre of a 0.05 degree cell."""
    return F.round(F.floor(v / 0.05) * 0.05 + 0.025, 3)


def crs_code(lon: Column, lat: Column) -> Column:
    """EPSG code: a national belt inside the box of Argentina, else the UTM zone."""
    inside = lon.between(-74.5, -53.0) & lat.between(-55.5, -21.5)
    belt = 5342 + F.least(F.lit(7), F.greatest(F.lit(1), F.bround((lon + 72) / 3).cast("int") + 1))
    return F.when(inside, belt).otherwise(F.when(lat < 0, 32700).otherwise(32600) + F.floor((lon + 180) / 6).cast("int") + 1)


def degree_tiles(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Names of the one-degree tiles that a box touches, e.g. S35_W060."""
    name = lambda y, x: F.concat(F.when(y < 0, "S").otherwise("N"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.lit("_"), F.when(x < 0, "W").otherwise("E"), F.lpad(F.abs(x).cast("string"), 3, "0"))
    ys, xs = F.sequence(F.floor(lat0), F.floor(lat1)), F.sequence(F.floor(lon0), F.floor(lon1))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: name(y, x))))
