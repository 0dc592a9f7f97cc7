"""Polygons, ordered lines, resampling and inverse projections against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from torrentia.functions import geometry as G
from torrentia.operators import distance, graph, gridded, lines, polygons


def test_chains_open_and_closed(spark):
    rnd = random.Random(2)
    ids = rnd.sample(range(10_000), 300)
    parts, links, want = [], [], {}
    while ids:
        n = min(len(ids), rnd.choice([1, 2, 3, 8, 40]))
        parts.append(ids[:n])
        ids = ids[n:]
    for k, part in enumerate(parts):
        closed = k % 2 == 0
        length = {c: rnd.randrange(1, 9) for c in part}
        links += [(c, part[i + 1] if i + 1 < len(part) else part[0] if closed else None, float(length[c])) for i, c in enumerate(part)]
        order = part[part.index(min(part)) :] + part[: part.index(min(part))] if closed else part
        for i, c in enumerate(order):
            want[c] = (closed, i, float(sum(length[x] for x in order[:i])), float(sum(length.values())), order[0] if closed else order[-1])
    got = graph.chains(spark.createDataFrame(links, "cell long, next long, length double")).collect()
    assert {r.cell: (r.closed, r.seq, r.before, r.total, r.chain) for r in got} == want and len(got) == len(want)
    assert graph.chains(spark.createDataFrame([], "cell long, next long, length double")).count() == 0


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                hit = not hit
    return hit


@pytest.mark.parametrize(("seed", "kinds"), [(1, 2), (2, 3), (3, 1)])
def test_rings_rebuild_the_regions(spark, seed, kinds):
    rnd = np.random.default_rng(seed)
    n, m = 14, 11
    z = rnd.integers(0, kinds, (n, m))
    rows = [(i * m + j, i - 5, j, int(z[i, j]) if rnd.random() < 0.93 else None) for i in range(n) for j in range(m)]
    cells = spark.createDataFrame(rows, "cell long, row long, col long, value long")
    at = {(i, j): v for _, i, j, v in rows if v is not None}
    label, todo = {}, sorted(at)
    number = {(i, j): c for c, i, j, v in rows}
    for p in sorted(todo, key=number.get):
        stack = [p] if p not in label else []
        while stack:
            q = stack.pop()
            if q in label:
                continue
            label[q] = number[p]
            stack += [x for x in ((q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)) if at.get(x) == at[q]]
    r = polygons.regions(cells)
    assert {(x.row, x.col): x.label for x in r.collect()} == label
    edges = polygons.ring_edges(r)
    shapes = {x.label: ([[(p.x, p.y) for p in ring] for ring in x.shells], [[(p.x, p.y) for p in ring] for ring in x.holes]) for x in polygons.polygons(edges, 2.0, 10.0, 50.0).collect()}
    assert set(shapes) == set(label.values()) and all(len(s) == 1 for s, _ in shapes.values())
    for (i, j), _ in at.items():
        x, y = 10.0 + (j + 0.5) * 2, 50.0 - (i + 0.5) * 2
        assert [k for k, (s, h) in shapes.items() if inside(s + h, x, y)] == [label[i, j]]
    measures = polygons.ring_measures(edges, 2.0).groupBy("label").agg(F.sum("area").alias("area")).collect()
    assert {x.label: x.area for x in measures} == {k: 4.0 * list(label.values()).count(k) for k in set(label.values())}
    for shells, holes in shapes.values():  # no corner on a straight stretch, and rings that touch themselves stay apart
        for ring in shells + holes:
            assert all((b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True))


def test_rings_of_other_labels_and_none(spark):
    """Two cells that touch at a corner, one label: two shells."""
    cells = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (0, 1, None)], "row long, col long, label string")
    p = polygons.polygons(polygons.ring_edges(cells)).collect()
    assert len(p) == 1 and len(p[0].shells) == 2 and p[0].holes == []
    assert polygons.ring_edges(cells.limit(0)).count() == 0


def test_lines_in_order_with_points(spark):
    """A fork, a closed line, a chain whose segments run both ways, a loop of one segment, parallel segments."""
    xy = {n: ((n * 7) % 11 * 1.0, (n * 5) % 13 * 1.0) for n in range(40)}
    ends = [(0, 1), (2, 1), (2, 3), (3, 4), (5, 4), (4, 6), (10, 11), (12, 11), (12, 10), (20, 20), (21, 22), (22, 21), (30, 31)]
    segs = [(100 - k, a, b, *xy[a], *xy[b]) for k, (a, b) in enumerate(ends)]
    df = spark.createDataFrame(segs, "sid long, a long, b long, ax double, ay double, bx double, by double")
    got = lines.ordered(df).collect()
    at = {r.sid: r for r in got}
    assert len(got) == len(segs)
    groups = {}
    for r in got:
        groups.setdefault(r.line, []).append(r)
    as_sets = sorted(sorted(100 - r.sid for r in g) for g in groups.values())
    assert as_sets == [[0, 1, 2, 3], [4], [5], [6, 7, 8], [9], [10, 11], [12]]
    for line, g in groups.items():
        g.sort(key=lambda r: r.seq)
        assert line == min(r.sid for r in g) and not at[line].reversed and [r.seq for r in g] == list(range(len(g)))
        upto = 0.0
        for r, after in zip(g, [*g[1:], None], strict=True):
            assert math.isclose(r.before, upto, abs_tol=1e-9)
            upto += r.length
            assert after is None or (r.x1, r.y1) == (after.x0, after.y0)
        assert all(math.isclose(r.total, upto, abs_tol=1e-9) for r in g)
        if g[0].closed:
            assert (g[-1].x1, g[-1].y1) == (g[0].x0, g[0].y0) and g[0].sid == line

    def along(line, d):
        for r in groups[line]:
            if d <= r.before + r.length + 1e-9:
                t = min(1.0, max(0.0, (d - r.before) / (r.length or 1.0)))
                return r.x0 + t * (r.x1 - r.x0), r.y0 + t * (r.y1 - r.y0)
        return None

    o = lines.ordered(df)
    points = lines.every(o, 0.75).collect()
    for line, g in groups.items():
        mine = sorted((p for p in points if p.line == line), key=lambda p: p.k)
        assert [p.k for p in mine] == list(range(math.ceil(g[0].total / 0.75)))
        for p in mine:
            assert np.allclose((p.x, p.y), along(line, p.at), atol=1e-9)
    rnd = random.Random(1)
    asked = [(k, rnd.choice(list(groups)), rnd.uniform(-3, 40)) for k in range(200)]
    found = {r.pid: r for r in lines.interpolate(spark.createDataFrame(asked, "pid long, line long, at double"), o, 2.5).collect()}
    for k, line, d in asked:
        d = min(max(d, 0.0), groups[line][0].total)
        assert np.allclose((found[k].at, found[k].x, found[k].y), (d, *along(line, d)), atol=1e-8)
        assert found[k].dx is None if not groups[line][0].total else math.isclose(math.hypot(found[k].dx, found[k].dy), 1)
    pts = [(k, rnd.uniform(-2, 12), rnd.uniform(-2, 14)) for k in range(60)]
    back = {r.pid: r for r in lines.project(spark.createDataFrame(pts, "pid long, px double, py double"), o, 2.0).collect()}
    assert len(back) == 60
    for k, x, y in pts:
        r = back[k]
        assert np.allclose((r.x, r.y), along(r.line, r.at), atol=1e-6) and math.isclose(math.hypot(r.x - x, r.y - y), r.dist, abs_tol=1e-9)
    t = lines.tangents(lines.project(spark.createDataFrame(pts, "pid long, px double, py double"), o, 2.0), o, 2.5, 0.5).first()
    r = t
    a, b = along(r.line, max(0.0, r.at - 0.5)), along(r.line, min(groups[r.line][0].total, r.at + 0.5))
    assert np.allclose((r.dx, r.dy), (b[0] - a[0], b[1] - a[1]), atol=1e-6)


def test_resampling_and_missing_cells(spark):
    rnd = np.random.default_rng(4)
    n, m, res, left, top = 9, 7, 2.0, 100.0, 60.0
    z = rnd.random((n, m))
    z[2, 3] = z[2, 4] = z[8, 6] = np.nan
    cells = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(n) for j in range(m)], "row long, col long, value double")
    pts = [(k, float(rnd.uniform(98, 116)), float(rnd.uniform(40, 62))) for k in range(300)] + [(900, left + res / 2, top - res / 2)]
    got = {r.k: r.value for r in gridded.resample(spark.createDataFrame(pts, "k long, x double, y double"), cells, (res, left, top), size=(n, m)).collect()}
    for k, x, y in pts:
        fr, fc = (top - y) / res - 0.5, (x - left) / res - 0.5
        r, c = math.floor(fr), math.floor(fc)
        total = value = 0.0
        for i, j in ((r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)):
            if 0 <= i < n and 0 <= j < m and not np.isnan(z[i, j]):
                w = (1 - abs(fr - i)) * (1 - abs(fc - j))
                total, value = total + w, value + w * z[i, j]
        off = not (left <= x < left + res * m and top - res * n < y <= top)
        assert (got[k] is None) if off or total <= 1e-9 else math.isclose(got[k], value / total, rel_tol=1e-9), (k, x, y)
    assert got[900] == z[0, 0]  # a centre has its own value
    near = {r.k: r.value for r in gridded.resample(spark.createDataFrame(pts, "k long, x double, y double"), cells, (res, left, top), "nearest").collect()}
    for k, x, y in pts:
        i, j = math.floor((top - y) / res), math.floor((x - left) / res)
        want = z[i, j] if 0 <= i < n and 0 <= j < m and not np.isnan(z[i, j]) else None
        assert near[k] == want
    coarse = gridded.averaged(cells, (res, left, top), (6.0, left, top), (3, 3)).collect()
    for r in coarse:
        total = value = 0.0
        for i in range(n):
            for j in range(m):
                dr, dc = abs((i + 0.5) / 3 - 0.5 - r.row), abs((j + 0.5) / 3 - 0.5 - r.col)
                if dr < 1 and dc < 1 and not np.isnan(z[i, j]):
                    w = (1 - dr) * (1 - dc)
                    total, value = total + w, value + w * z[i, j]
        assert math.isclose(r.value, value / total, rel_tol=1e-9)


def test_values_survive_the_move_to_the_web_grid(spark):
    """Whole numbers on a UTM grid, moved to Web Mercator by nearest: the same values, zeros kept, most cells covered; smooth values by bilinear stay near."""
    n = m = 24
    left, top, res, epsg = 500_000.0, 6_180_000.0, 30.0, 32720
    cells = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5)) for i in range(n) for j in range(m)], "row long, col long, value double")
    box = spark.range(1).select(G.reproject_box(F.struct(F.lit(left).alias("x0"), F.lit(top - n * res).alias("y0"), F.lit(left + m * res).alias("x1"), F.lit(top).alias("y1")), epsg, 3857).alias("b")).first().b
    lat = spark.range(1).select(G.to_degrees(epsg, F.lit(left), F.lit(top)).alias("d")).first().d.lat
    onto = gridded.web_grid((box.x0, box.y0, box.x1, box.y1), res, lat)
    assert math.isclose(onto[0], res / math.cos(math.radians(lat))) and abs(onto[3] - n) <= 2 and abs(onto[4] - m) <= 2
    got = gridded.warp(spark, cells, (res, left, top), epsg, onto, 3857, "nearest").collect()
    values = [r.value for r in got if r.value is not None]
    assert len(got) == onto[3] * onto[4] and len(values) > 0.9 * n * m and set(values) == {0.0, 1.0, 2.0, 3.0, 4.0}
    smooth = cells.withColumn("value", F.col("row") * 2.0 + F.col("col"))
    back = gridded.warp(spark, smooth, (res, left, top), epsg, onto, 3857, size=(n, m)).where("value is not null").collect()
    assert len(back) > 0.9 * n * m and all(abs(r.value - (2 * r.row + r.col)) < 3 for r in back)


def test_projections_there_and_back(spark):
    places = [(lon, lat) for lon in (-62.9, -60.0, -57.1) for lat in (-54.0, -34.6, -0.5, 0.0, 41.0, 79.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for epsg in (32720, 5347, 3857, 4326):
        p = df.withColumn("p", G.from_degrees(epsg, F.col("lon"), F.col("lat"))).withColumn("d", G.to_degrees(epsg, F.col("p.x"), F.col("p.y")))
        for r in p.collect():
            metres = 111_320.0
            assert abs(r.d.lon - r.lon) * metres * math.cos(math.radians(r.lat)) < 1e-3 and abs(r.d.lat - r.lat) * metres < 1e-3, (epsg, r)
    ring = df.agg(F.collect_list(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("r"))
    there = ring.select("r", G.reproject(G.reproject(F.col("r"), 4326, 5347), 5347, 4326).alias("s"), G.reproject(F.lit(None).cast(ring.schema["r"].dataType), 4326, 3857).alias("none")).first()
    assert np.allclose([(p.x, p.y) for p in there.r], [(p.x, p.y) for p in there.s], atol=1e-8) and there.none is None
    # the belt's meridian at the equator: its false east and the quarter of a meridian, 10,001,965.729 m
    e = spark.range(1).select(G.from_degrees(5347, F.lit(-60.0), F.lit(0.0)).alias("p")).first().p
    assert math.isclose(e.x, 5_500_000.0, abs_tol=1e-6) and math.isclose(e.y, 10_001_965.729, abs_tol=1e-3)
    with pytest.raises(ValueError):
        G.to_degrees(9999, F.lit(0.0), F.lit(0.0))


def test_distance_transform_is_exact(spark):
    """Sparse cells, features outside them, in empty rows and columns, and none."""
    rnd = random.Random(9)
    for n_marks in (1, 7, 40):
        cells = sorted({(rnd.randrange(-4, 16), rnd.randrange(0, 19)) for _ in range(150)})
        marks = [(rnd.randrange(-9, 22), rnd.randrange(-5, 25)) for _ in range(n_marks)]
        df = spark.createDataFrame([(r, c, "x") for r, c in cells] + [(None, 3, "y")], "row long, col long, kind string")
        got = distance.transform(df, spark.createDataFrame(marks + marks[:2], "row long, col long"), 2.0).collect()
        assert len(got) == len(cells) + 1
        for g in got:
            want = None if g.row is None else 2.0 * min(math.hypot(g.row - r, g.col - c) for r, c in marks)
            assert (g.dist is None) if want is None else math.isclose(g.dist, want, rel_tol=1e-12)
    none = distance.transform(df, df.select("row", "col").limit(0)).where("row is not null").collect()
    assert all(g.dist == math.inf for g in none) and distance.transform(df.limit(0), df.select("row", "col")).count() == 0


def test_hull_and_calipers(spark):
    rnd = np.random.default_rng(5)
    clouds = [rnd.random((n, 2)) * 10 for n in (3, 5, 40, 300)] + [rnd.integers(0, 4, (25, 2)).astype(float) for _ in range(6)]
    turn = np.linspace(0, 2 * np.pi, 10_000, endpoint=False)
    clouds += [np.stack([3 * np.cos(turn), np.sin(turn)], 1), np.array([[1.0, 2.0], [4.0, 6.0], [2.5, 4.0]]), np.array([[1.0, 1.0]])]
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in c]) for k, c in enumerate(clouds)] + [(99, None)], "k long, p array<struct<x:double,y:double>>")
    for r in df.select("k", G.convex_hull(F.col("p")).alias("h"), G.rotated_rectangle(F.col("p")).alias("b")).collect():
        if r.k == 99:
            assert r.h is None and r.b.long is None
            continue
        c, h = clouds[r.k], np.array([(p.x, p.y) for p in r.h])
        if len(h) < 3:
            assert (r.b.long, r.b.short) == ((5.0, 0.0) if len(h) == 2 else (None, None))
            continue
        a, b = h, np.roll(h, -1, 0)
        cross = (b - a)[:, 0, None] * (c[None, :, 1] - a[:, 1, None]) - (b - a)[:, 1, None] * (c[None, :, 0] - a[:, 0, None])
        assert (cross > -1e-9).all() and {tuple(p) for p in h} <= {tuple(p) for p in c}
        u = (b - a) / np.hypot(*(b - a).T)[:, None]
        w, t = np.ptp(u @ h.T, axis=1), np.ptp(np.stack([-u[:, 1], u[:, 0]], 1) @ h.T, axis=1)
        assert math.isclose(r.b.long * r.b.short, (w * t).min(), rel_tol=1e-9) and r.b.long >= r.b.short


def test_packed_frames_unpack_to_their_cells(spark):
    import gzip

    rnd = random.Random(2)
    rows = [(rnd.choice("xy"), rnd.randrange(-1, 71), rnd.randrange(0, 9), rnd.choice([None, 0, 7, 255])) for _ in range(200)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "kind string, row long, col long, value int")
    got = {r.kind: r for r in gridded.packed(df, "kind", 70, 8, 16).withColumn("raw", gridded.unpacked(F.col("data"))).collect()}
    for kind in "xy":
        want = bytearray(70 * 8)
        for k, i, j, v in rows:
            if k == kind and 0 <= i < 70 and j < 8:
                want[i * 8 + j] = v or 0
        assert bytes(got[kind].raw) == bytes(want) == gzip.decompress(bytes(got[kind].data))
    assert gridded.packed(df.limit(0), "kind", 70, 8).count() == 0
