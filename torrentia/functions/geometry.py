"""Plane geometry as expressions over rings: array<struct<x double, y double>>, closed or not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6378137.0


def closed(ring: Column) -> Column:
    """The ring with its first point once more at the end."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of neighbouring points."""
    r = closed(ring)
    return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(edge_array: Column, of) -> Column:
    return F.aggregate(edge_array, F.lit(0.0), lambda acc, e: acc + of(e["a"], e["b"]))


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def centroid(ring: Column) -> Column:
    """struct(x, y); NULL for a ring without area."""
    six = F.nullif(6 * signed_area(ring), F.lit(0.0))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    x = _sum(edges(ring), lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / six
    y = _sum(edges(ring), lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / six
    return F.when(six.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by crossings of the ray to its right."""
    crosses = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e["a"], e["b"]), F.lit(False)))) % 2 == 1


def _once(value: Column, of) -> Column:
    """of(value), with the value worked out once, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def slabs(ring: Column, size: float) -> Column:
    """A ring that doesn't cross itself, cut at the heights of its points and at all whole multiples of size: array<struct<lo, hi, l, ls, r, rs>>, where
    lo <= y < hi and x lies between the sides l + (y - lo) * ls and r + (y - lo) * rs. A point is in one slab at most."""
    slope = lambda e: (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
    at = lambda e, y: e["a"]["x"] + (y - e["a"]["y"]) * slope(e)

    def levels(ys: Column) -> Column:
        lines = F.transform(F.sequence(F.floor(F.array_min(ys) / size), F.floor(F.array_max(ys) / size)), lambda k: k * size)
        return F.array_sort(F.array_distinct(F.filter(F.concat(ys, lines), lambda y: y >= F.array_min(ys))))

    def between(sides: Column, lo: Column, hi: Column) -> Column:
        spans = F.filter(sides, lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= lo) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= hi))
        met = F.array_sort(F.transform(spans, lambda e: F.struct(at(e, (lo + hi) / 2).alias("m"), at(e, lo).alias("x"), slope(e).alias("s"))))
        pair = lambda a, b: F.struct(lo.alias("lo"), hi.alias("hi"), a["x"].alias("l"), a["s"].alias("ls"), b["x"].alias("r"), b["s"].alias("rs"))
        return _once(met, lambda m: F.filter(F.zip_with(m, F.slice(m, 2, F.size(m)), pair), lambda p, i: (i % 2 == 0) & p["rs"].isNotNull()))

    def cut(sides: Column) -> Column:
        heights = _once(F.transform(ring, lambda p: p["y"]), levels)
        return _once(heights, lambda h: F.flatten(F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda lo, hi: between(sides, lo, hi))))

    return _once(edges(ring), cut)


def circle(x: Column, y: Column, radius: Column, quarter: int = 64) -> Column:
    """A buffer round a point, with so many points a quarter."""
    step = math.pi / (2 * quarter)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * quarter - 1)), lambda i: F.struct((x + radius * F.cos(i * step)).alias("x"), (y + radius * F.sin(i * step)).alias("y")))


def largest(rings: Column) -> Column:
    """The ring with the largest area, the first on ties."""
    return F.array_min(F.transform(rings, lambda r, i: F.struct((-area(r)).alias("a"), i.alias("i"), r.alias("r"))))["r"]


def mercator(lon: Column, lat: Column) -> Column:
    """Web Mercator metres."""
    return F.struct((F.radians(lon) * EARTH_M).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_M).alias("y"))


def clipped(ring: Column, window: Column) -> Column:
    """The part of a ring inside a convex window, whose points run anticlockwise: one side of the window cuts after the other."""

    def cut(points: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        left_of = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def kept(p: Column, q: Column) -> Column:
            dp, dq = left_of(p), left_of(q)
            t = dp / F.nullif(dp - dq, F.lit(0.0))
            met = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            crosses = ((dp >= 0) != (dq >= 0)) & t.isNotNull()
            return F.concat(F.when(crosses, F.array(met)).otherwise(F.slice(F.array(met), 1, 0)), F.when(dq >= 0, F.array(q)).otherwise(F.slice(F.array(q), 1, 0)))

        after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
        return F.flatten(F.zip_with(points, after, kept))

    none = F.slice(ring, 1, 0)
    return F.aggregate(edges(window), ring, lambda points, side: F.when(F.size(points) > 0, cut(points, side)).otherwise(none))


def overlap_area(ring: Column, window: Column) -> Column:
    """The area that a ring shares with a convex window."""
    part = clipped(ring, window)
    return F.when(F.size(part) > 2, area(part)).otherwise(F.lit(0.0))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def _hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, anticlockwise from the least (x, y), by the monotone chain; points on its sides are left out."""
    points = np.unique(xy[np.lexsort((xy[:, 1], xy[:, 0]))], axis=0).tolist()
    if len(points) < 3:
        return np.array(points).reshape(-1, 2)

    def half(run) -> list:
        out = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def convex_hull(ring: Column) -> Column:
    """The corners of the convex hull of a ring's, line's or cloud's points, anticlockwise; n log n in the points. NULL stays."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else [{"x": x, "y": y} for x, y in _hull(_points(r)).tolist()])

    return run(ring)


def rotated_rectangle(ring: Column) -> Column:
    """struct(long, short): the sides of the smallest rectangle round the ring, one of which lies on a side of the hull; of equal areas (to nine digits, as on all sides of an
    acute triangle) the least long one. NULL without two different points.

    Calipers turn round the hull: the corners that lie farthest along, against and across a side only move on from side to side.
    """

    @F.pandas_udf("long double, short double")
    def run(rings: pd.Series) -> pd.DataFrame:
        def sides(points) -> tuple[float | None, float | None]:
            h = _hull(_points(points)) if points is not None else np.empty((0, 2))
            if len(h) < 3:
                return (float(np.hypot(*(h[1] - h[0]))), 0.0) if len(h) == 2 else (None, None)
            n, corners, best = len(h), h.tolist(), None
            far, high, back = 0, 0, None
            for i in range(n):
                (ax, ay), (bx, by) = corners[i], corners[(i + 1) % n]
                size = math.hypot(bx - ax, by - ay)
                ux, uy = (bx - ax) / size, (by - ay) / size
                along = lambda k: corners[k % n][0] * ux + corners[k % n][1] * uy  # noqa: B023, E731
                across = lambda k: corners[k % n][1] * ux - corners[k % n][0] * uy  # noqa: B023, E731
                far = max(far, i + 1)
                while along(far + 1) > along(far):
                    far += 1
                high = max(high, far)
                while across(high + 1) > across(high):
                    high += 1
                back = max(back or 0, high)
                while along(back + 1) < along(back):
                    back += 1
                w, t = along(far) - along(back), across(high) - across(i)
                best = min(best or (math.inf,), (round(w * t, 9), max(w, t), min(w, t)))
            return best[1:]

        return pd.DataFrame([sides(r) for r in rings], columns=["long", "short"])

    return run(ring)


def simplified(line: Column, tolerance: float) -> Column:
    """The line without points that lie within tolerance of the chord between points that stay (the farthest one stays first)."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(lines: pd.Series) -> pd.Series:
        def keep(points) -> list | None:
            if points is None:
                return None
            xy = np.array([(p["x"], p["y"]) for p in points]).reshape(-1, 2)
            stays, todo = np.zeros(len(xy), bool), [(0, len(xy) - 1)] if len(xy) else []
            while todo:
                i, j = todo.pop()
                stays[[i, j]] = True
                if j - i < 2:
                    continue
                d, v = xy[i + 1 : j] - xy[i], xy[j] - xy[i]
                n = np.hypot(*v)
                away = np.abs(d[:, 0] * v[1] - d[:, 1] * v[0]) / n if n else np.hypot(d[:, 0], d[:, 1])
                k = int(away.argmax())
                if away[k] > tolerance:
                    todo += [(i, i + 1 + k), (i + 1 + k, j)]
            return [{"x": float(x), "y": float(y)} for x, y in xy[stays]]

        return lines.map(keep)

    return run(line)


# The ellipsoid GRS 80, and the UTM scale on the central meridian.
FLATTENING, SCALE = 1 / 298.257222101, 0.9996


def transverse_mercator(lon: Column, lat: Column, meridian: Column, false_east: float = 500000.0, false_north: float = 0.0, scale: float = SCALE) -> Column:
    """struct(x, y) in metres, by Kruger's series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    away = F.radians(lon - meridian)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(terms, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((false_east + scale * radius * x).alias("x"), (false_north + scale * radius * y).alias("y"))


def inverse_transverse_mercator(x: Column, y: Column, meridian: Column, false_east: float = 500000.0, false_north: float = 0.0, scale: float = SCALE) -> Column:
    """struct(lon, lat) in degrees of metres, by Kruger's inverse series to the fourth order: with transverse_mercator there and back within a millimetre."""
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    to_lat = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi0, eta0 = (y - false_north) / (scale * radius), (x - false_east) / (scale * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(back, 1):
        xi, eta = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0), eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(to_lat, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"), F.degrees(lat).alias("lat"))


def inverse_mercator(x: Column, y: Column) -> Column:
    """struct(lon, lat) of Web Mercator metres."""
    return F.struct(F.degrees(x / EARTH_M).alias("lon"), F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - math.pi / 2).alias("lat"))


def _tm_of(epsg: int) -> tuple[float, float, float, float] | None:
    """Meridian, false east, false north and scale of a transverse Mercator code: UTM zones, and the national belts, whose northings count from the pole."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return 6.0 * (epsg % 100) - 183, 500000.0, 1e7 if epsg > 32700 else 0.0, SCALE
    if 5343 <= epsg <= 5349:
        n, belt = FLATTENING / (2 - FLATTENING), epsg - 5342
        quarter = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * math.pi / 2  # from the equator to the pole
        return -75.0 + 3 * belt, 1e6 * belt + 500000.0, quarter, 1.0
    return None


def to_degrees(epsg: int, x: Column, y: Column) -> Column:
    """struct(lon, lat) of a point in 4326, 3857, a UTM zone or a national belt. Their datums agree within centimetres and count as one."""
    if epsg == 4326:
        return F.struct(x.alias("lon"), y.alias("lat"))
    if epsg == 3857:
        return inverse_mercator(x, y)
    if (tm := _tm_of(epsg)) is None:
        raise ValueError(f"unknown reference system {epsg}")
    return inverse_transverse_mercator(x, y, F.lit(tm[0]), *tm[1:])


def from_degrees(epsg: int, lon: Column, lat: Column) -> Column:
    """struct(x, y) of a place in degrees."""
    if epsg == 4326:
        return F.struct(lon.alias("x"), lat.alias("y"))
    if epsg == 3857:
        return mercator(lon, lat)
    if (tm := _tm_of(epsg)) is None:
        raise ValueError(f"unknown reference system {epsg}")
    return transverse_mercator(lon, lat, F.lit(tm[0]), *tm[1:])


def reproject(points: Column, source: int, target: int) -> Column:
    """A ring or line in another reference system, point by point; NULL stays."""

    def one(p: Column) -> Column:
        d = F.transform(F.array(to_degrees(source, p["x"], p["y"])), lambda d: from_degrees(target, d["lon"], d["lat"]))
        return F.get(d, F.lit(0))

    return points if source == target else F.transform(points, one)


def box_of(points: Column) -> Column:
    """struct(x0, y0, x1, y1), the envelope."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def box_sides(box: Column, pieces: int = 21) -> Column:
    """Points along the four sides of a box, so many pieces a side."""
    k = F.sequence(F.lit(0), F.lit(pieces))
    at = lambda a, b, i: a + (b - a) * i / pieces
    side = lambda x, y: F.transform(k, lambda i: F.struct(x(i).alias("x"), y(i).alias("y")))
    across, up = (lambda i: at(box["x0"], box["x1"], i)), (lambda i: at(box["y0"], box["y1"], i))
    sides = [side(across, lambda i: box["y0"] + 0 * i), side(across, lambda i: box["y1"] + 0 * i), side(lambda i: box["x0"] + 0 * i, up), side(lambda i: box["x1"] + 0 * i, up)]
    return F.flatten(F.array(*sides))


def reproject_box(box: Column, source: int, target: int, pieces: int = 21) -> Column:
    """The envelope of a box in another reference system, with so many pieces a side, since its sides bend. For a table of boxes see gridded.reproject_boxes."""
    return box_of(reproject(box_sides(box, pieces), source, target))
