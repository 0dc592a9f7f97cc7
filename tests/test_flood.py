"""Geometry against sampling and known values, readers of catalogues, and edge cases of the flood operators."""

import json
import math
import random

from pyspark.sql import functions as F

from torrentia.functions import geometry as G
from torrentia.functions import scalars as S
from torrentia.operators import flood_stats, gridded, matching
from torrentia.sources import catalogues as C

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def hull(rnd, x, y, r):
    angles = sorted(rnd.random() * 2 * math.pi for _ in range(rnd.randint(3, 7)))
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a in angles]


def is_in(points, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return odd


def test_overlap_area_against_sampling(spark):
    rnd = random.Random(1)
    pairs = [(i, hull(rnd, 5, 5, 4), hull(rnd, 5 + rnd.random() * 4, 5, 3)) for i in range(12)] + [(99, hull(rnd, 0, 0, 1), hull(rnd, 9, 9, 1))]
    df = spark.createDataFrame([(i, ring(a), ring(b)) for i, a, b in pairs], f"i int, a {RING}, b {RING}")
    got = {r.i: r.area for r in df.select("i", G.overlap_area(F.col("a"), F.col("b")).alias("area")).collect()}
    n, size = 300, 14
    for i, a, b in pairs:
        inside = sum(is_in(a, x, y) and is_in(b, x, y) for x in ((k + 0.5) * size / n - 1 for k in range(n)) for y in ((k + 0.5) * size / n - 1 for k in range(n)))
        assert abs(got[i] - inside * (size / n) ** 2) < 0.25
    assert got[99] == 0


def test_rasterise_touched_against_fine_sampling(spark):
    rnd = random.Random(2)
    shapes = [(i, hull(rnd, 6 + rnd.random(), -6 - rnd.random(), 1 + 3 * rnd.random())) for i in range(8)]
    df = spark.createDataFrame([(i, ring(p)) for i, p in shapes], f"i int, ring {RING}")
    touched = {tuple(r) for r in gridded.rasterise(df, "ring", 1.0, 0.0, 0.0, all_touched=True).collect()}
    centres = {tuple(r) for r in gridded.rasterise(df, "ring", 1.0, 0.0, 0.0).collect()}
    for i, p in shapes:
        cells = [(r, c) for r in range(14) for c in range(14)]
        assert {(i, r, c) for r, c in cells if is_in(p, c + 0.5, -(r + 0.5))} == {x for x in centres if x[0] == i}
        fine = set()
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            fine |= {(i, math.floor(-(ay + (by - ay) * t / 4000)), math.floor(ax + (bx - ax) * t / 4000)) for t in range(4001)}
        fine |= {x for x in centres if x[0] == i}
        mine = {x for x in touched if x[0] == i}
        assert fine <= mine and len(mine - fine) <= 2  # cells that are just grazed


def test_known_coordinates(spark):
    """Known UTM coordinates: a zone's edge on the equator, and 45 degrees on the central meridian."""
    df = spark.createDataFrame([(6.0, 0.0), (3.0, 45.0), (0.0, 0.0)], "lon double, lat double")
    t = [r.t for r in df.select(G.transverse_mercator(F.col("lon"), F.col("lat"), F.lit(3.0)).alias("t")).collect()]
    assert abs(t[0].x - 833978.557) < 0.01 and abs(t[0].y) < 1e-6 and abs(t[2].x - 166021.443) < 0.01
    assert abs(t[1].x - 500000) < 1e-6 and abs(t[1].y - 4982950.400) < 0.01


def test_rotated_rectangle_and_simplified(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    turned = [(x * c - y * s, x * s + y * c) for x, y in [(0, 0), (6, 0), (6, 2), (3, 1), (0, 2)]]
    line = [(0, 0), (1, 0.05), (2, -0.04), (3, 4), (4, 4.01), (5, 4)]
    df = spark.createDataFrame([(ring(turned), ring(line))], f"a {RING}, b {RING}")
    r = df.select(G.rotated_rectangle(F.col("a")).alias("r"), G.simplified(F.col("b"), 0.1).alias("s")).first()
    assert abs(r.r.long - 6) < 1e-9 and abs(r.r.short - 2) < 1e-9
    assert [(p.x, p.y) for p in r.s] == [(0, 0), (2, -0.04), (3, 4), (5, 4)]


def test_nearest_segment_far_points_and_ties(spark):
    rnd = random.Random(3)
    segs = [(i, rnd.random() * 50, rnd.random() * 50, rnd.random() * 50, rnd.random() * 50) for i in range(15)] + [(90, 1.0, 1.0, 1.0, 1.0), (91, 1.0, 1.0, 1.0, 1.0)]
    pts = [(i, rnd.random() * 300 - 100, rnd.random() * 60) for i in range(60)] + [(70, 1.0, 1.0), (71, 1e5, -1e5)]
    s = spark.createDataFrame(segs, "sid long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame(pts, "pid long, px double, py double")
    got = {r.pid: (r.dist, r.sid) for r in matching.nearest_segment(p, s, 2.0).collect()}

    def dist(x, y, ax, ay, bx, by):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    for i, x, y in pts:
        d, sid = min((dist(x, y, *q[1:]), q[0]) for q in segs)
        assert abs(got[i][0] - d) < 1e-6 * max(1, d) and got[i][1] == sid
    assert {r.sid for r in matching.nearest_segment(p, s.limit(0), 2.0).collect()} == {None} and matching.nearest_segment(p.limit(0), s, 2.0).count() == 0


def test_readers_of_catalogues(spark, tmp_path):
    ways = {"elements": [
        {"type": "way", "id": 1, "tags": {"waterway": "river", "name": "A"}, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]},
        {"type": "way", "id": 2, "tags": {"waterway": "dam"}, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]},
        {"type": "way", "id": 3, "tags": {"waterway": "ditch"}, "geometry": [{"lon": 1.0, "lat": 2.0}]}, {"type": "node", "id": 4},
    ]}
    (tmp_path / "w.json").write_text(json.dumps(ways))
    got = C.waterways(spark, str(tmp_path / "w.json")).collect()
    assert [(r.osm_id, r.waterway, r.name, [(p.x, p.y) for p in r.line]) for r in got] == [(1, "river", "A", [(1.0, 2.0), (3.0, 4.0)])]
    sheet = {"features": [{"properties": {"archivo": "dir/3560-01.zip", "nombre": "N", "link": '<a href="http://x/y.zip">z</a>'}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]}}]}
    (tmp_path / "s.json").write_text(json.dumps(sheet))
    r = C.sheets(spark, str(tmp_path / "s.json")).first()
    assert (r.sheet, r.name, r.url, len(r.ring)) == ("3560-01", "N", "http://x/y.zip", 3)
    assert C.optional_json(spark, str(tmp_path / "none*.json"), "a int").count() == 0


def test_tile_names(spark):
    r = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"x0": -60.1, "y0": -34.5, "x1": -59.2, "y1": -34.3}.items()])
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    t = r.select(C.glo30_tiles(*box).alias("g"), C.fabdem_tiles(*box).alias("f"), C.water_tiles(*box).alias("w")).first()
    assert t.g == ["Copernicus_DSM_COG_10_S35_00_W061_00_DEM", "Copernicus_DSM_COG_10_S35_00_W060_00_DEM"]
    assert [tuple(x) for x in t.f] == [("S35W061_FABDEM_V1-2.tif", "S40W070-S30W060_FABDEM_V1-2.zip"), ("S35W060_FABDEM_V1-2.tif", "S40W060-S30W050_FABDEM_V1-2.zip")]
    assert t.w == ["60W_30S", "70W_30S"]


def test_windows_prune_tiles(spark, tmp_path):
    cells = spark.range(64 * 64).select(F.lit("a").alias("raster"), F.expr("id div 64").alias("row"), (F.col("id") % 64).alias("col"), F.col("id").cast("double").alias("value"))
    path = str(tmp_path / "tiles")
    gridded.write_tiles(cells, path, 16)
    w = gridded.read_window(spark, path, (3, 18), (40, 41), 16, nodata=200.0)
    assert w.count() == 32 and w.where("value is null").count() == 0
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_row" in plan and "tile_col" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert gridded.read_window(spark, path, (3, 3), (8, 8), 16, nodata=200.0).first().value is None


def test_clean_and_lookup_edge_cases(spark):
    df = spark.createDataFrame([(1, float("nan"), [float("inf"), 1.0], {"k": float("-inf")}), (2, None, None, None)], "i int, v double, a array<double>, m map<string,double>")
    rows = S.cleaned(df).collect()
    assert tuple(rows[0]) == (1, None, [None, 1.0], {"k": None}) and tuple(rows[1]) == (2, None, None, None)
    kv = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, None, 3)], "k int, n string, v int")
    assert flood_stats.lookup(kv, ["k"], "n", "v").first().of == {"a": 1}
    assert flood_stats.lookup(kv.limit(0), ["k"], "n", "v").count() == 0
