"""Polygons of cells, streams as lines with distances along them, and rasters moved to other grids and reference systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentia.functions import geometry as G
from torrentia.operators import distance, gridded, lines, matching, polygons, terrain
from torrentia.plans.terrain_queries import CELLS, FILL, WAYS, WIDTH, _cells, _streams, _table
from torrentia.scratch import written

STEP, NEAR = 0.5, 2.0  # between samples along lines, and what counts as near
FINE, COARSE = (0.7137, -0.3519, 0.4071), (2.5, 0.0, 0.0)  # res, left, top of grids over the parts' cells, whose own is (1, 0, 0)
UTM, HERE = 32720, (30.0, 500_000.0, 6_180_000.0)  # the parts' cells in a UTM zone: res, left, top
WEB = (37.0, -7_013_200.0, -4_098_900.0)  # a Web Mercator grid that begins at their north-western corner


def _rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _measures(regions):
    m = polygons.ring_measures(polygons.ring_edges(regions))
    return m.groupBy("label").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("n_vertices").alias("n_vertices"), F.count_if(F.col("area") < 0).alias("n_holes"))


def depression_polygons(spark, d):
    """The rings round each depression of the filled surface."""
    sink = terrain.fill(_cells(spark, d)).withColumn("value", F.when(F.col("filled") > F.col("z"), 1))
    return _measures(polygons.regions(sink))


def class_polygons(spark, d):
    """The rings round each region of parts of like size."""
    classes = _table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.expr(f"(p_partkey - 1) div {WIDTH}").alias("row"), ((F.col("p_partkey") - 1) % WIDTH).alias("col"), F.expr("p_size div 18").alias("value"))
    return _measures(polygons.regions(classes))


def _lines(spark, d):
    cells = _cells(spark, d)
    p = written(terrain.d8_pointer(cells))
    return written(lines.ordered(lines.stream_segments(cells, p, _streams(p))))


def stream_lines(spark, d):
    """Stream cells and the next ones downstream as segments, merged to lines and put in order."""
    return _rounded(_lines(spark, d), "before", "total").select("sid", "line", "closed", "seq", "reversed", "before", "total")


def stream_samples(spark, d):
    return _rounded(lines.every(_lines(spark, d), STEP), "x", "y").select("line", "k", "x", "y")


def stream_agreement(spark, d):
    """How far the streams' points at every step lie from the lines that the larger streams of a coarser surface make."""
    cells = _cells(spark, d).withColumn("z", F.floor(F.col("z") * 8))
    p = written(terrain.d8_pointer(cells))
    other = lines.stream_segments(cells, p, terrain.streams(terrain.flow_accumulation(p), 8.0)).select("sid", "ax", "ay", "bx", "by")
    points = written(lines.every(_lines(spark, d), STEP).select(F.struct("line", "k").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")))
    near = matching.nearest_segment(points, written(other), 4.0).withColumn("k", F.col("pid.line") % 7)
    return _rounded(matching.line_agreement(near, "k", NEAR), "median", "p90", "pct_within")


def line_positions(spark, d):
    """Where along the nearest stream each customer's place lies, and the stream's direction there."""
    rows = F.lit(50)
    points = _table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") / 300 + 0.003).alias("px"), (-(F.col("c_custkey") % rows) - 0.37).cast("double").alias("py"))
    at = written(lines.project(points, _lines(spark, d), 4.0))
    way = lines.tangents(at, _lines(spark, d), 8.0, 1.0)
    return _rounded(way, "at", "x", "y", "dx", "dy", "dist").select("pid", "line", "at", "x", "y", "dx", "dy", "dist")


def _raster(spark, d):
    """Parts' heights; those of size 13 are missing."""
    p = _table(spark, d, "part")
    value = F.when(F.col("p_size") != 13, F.col("p_retailprice") / 10)
    return p.select(F.expr(f"(p_partkey - 1) div {WIDTH}").alias("row"), ((F.col("p_partkey") - 1) % WIDTH).alias("col"), value.alias("value"))


def _rows(cells):
    return cells.agg(F.max("row") + 1).first()[0] or 0


def resampled_bilinear(spark, d):
    """Onto a finer grid that begins elsewhere and reaches over the edge."""
    r = _raster(spark, d)
    n = _rows(r)
    onto = (*FINE, int(n / FINE[0]) + 2, int(WIDTH / FINE[0]) + 2)
    return _rounded(gridded.warp(spark, r, (1.0, 0.0, 0.0), UTM, onto, UTM, size=(n, WIDTH)), "value", digits=5)


def resampled_coarse(spark, d):
    r = _raster(spark, d)
    return _rounded(gridded.averaged(r, (1.0, 0.0, 0.0), COARSE, (-(-_rows(r) * 2 // 5), -(-WIDTH * 2 // 5))), "value", digits=5)


def web_grid_values(spark, d):
    """UTM cells on a Web Mercator grid: the value of the cell that each centre lies in."""
    r = _raster(spark, d)
    onto = (*WEB, int(_rows(r) * HERE[0] / WEB[0] * 1.3) + 2, int(WIDTH * HERE[0] / WEB[0] * 1.3) + 2)
    return _rounded(gridded.warp(spark, r, HERE, UTM, onto, 3857, "nearest").where("value is not null"), "value")


def inverse_transverse_mercator(spark, d):
    """Customers' metres to degrees, and whether they come back within a millimetre."""
    x, y = F.lit(500_000.0) + F.col("c_acctbal") * 20, F.lit(-3_000_000.0) + (F.col("c_custkey") % 997) * 5_000.0
    c = _table(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y")).withColumn("d", G.inverse_transverse_mercator(F.col("x"), F.col("y"), F.lit(-60.0)))
    c = c.withColumn("t", G.transverse_mercator(F.col("d.lon"), F.col("d.lat"), F.lit(-60.0)))
    near = F.hypot(F.col("t.x") - F.col("x"), F.col("t.y") - F.col("y")) < 1e-3
    return c.select("c_custkey", F.round("d.lon", 8).alias("lon"), F.round("d.lat", 8).alias("lat"), near.alias("within_mm"))


def reprojected_boxes(spark, d):
    """Suppliers' squares of a UTM zone, in degrees: the envelopes of their bent sides."""
    s = _table(spark, d, "supplier")
    x, y, w = F.lit(500_000.0) + F.col("s_acctbal") * 10, F.lit(6_000_000.0) + F.col("s_suppkey") * 100.0, (F.col("s_suppkey") % 7 + 3) * 1000.0
    box = F.struct((x - w).alias("x0"), (y - w).alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"))
    b = gridded.reproject_boxes(s.select("s_suppkey", box.alias("b")), ["s_suppkey"], "b", UTM, 4326)
    return b.select("s_suppkey", *[F.round(f"b.{c}", 7).alias(c) for c in ("x0", "y0", "x1", "y1")])


def packed_frames(spark, d):
    """Four frames of the parts' sizes, packed and unpacked: their lengths, wet cells and digests."""
    p = _table(spark, d, "part").select((F.col("p_size") % 4).alias("frame"), F.expr(f"p_partkey div {WIDTH}").alias("row"), (F.col("p_partkey") % WIDTH).alias("col"), F.col("p_size").alias("value"))
    f = gridded.packed(p, "frame", _rows(p), WIDTH, 16).withColumn("raw", F.hex(gridded.unpacked(F.col("data"))))
    wet = F.regexp_count(F.regexp_replace("raw", "(..)", "$1,"), F.lit("[^0,].?,|0[^0],")).cast("long")
    return f.select("frame", (F.length("raw") / 2).cast("long").alias("n_bytes"), wet.alias("n_wet"), F.md5(F.lower("raw").cast("binary")).alias("digest"))


def _marks(spark, d):
    return _table(spark, d, "part").where("p_size >= 47").select(F.expr(f"(p_partkey - 1) div {WIDTH}").alias("row"), ((F.col("p_partkey") - 1) % WIDTH).alias("col"))


def water_distance(spark, d):
    """From each part's cell to the nearest one of the largest sizes, in cells of 30 m."""
    return _rounded(distance.transform(_cells(spark, d).select("cell", "row", "col"), _marks(spark, d), 30.0), "dist")


def water_buffer(spark, d):
    """The cells within 70 m of those of the largest sizes."""
    return distance.buffer(_cells(spark, d).select("cell", "row", "col"), _marks(spark, d), 70.0, 30.0).select("cell")


def customer_hulls(spark, d):
    """The convex hull of each nation's customers' places, and the smallest rectangle round it."""
    c = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct((F.col("c_acctbal") / 100).alias("x"), ((F.col("c_custkey") % 89) * 1.0).alias("y"))).alias("points"))
    c = c.withColumn("hull", G.convex_hull(F.col("points"))).withColumn("box", G.rotated_rectangle(F.col("points")))
    return c.select("c_nationkey", F.size("hull").cast("long").alias("corners"), F.round(G.area(F.col("hull")), 5).alias("area"), F.round("box.long", 5).alias("long"), F.round("box.short", 5).alias("short"))


QUERIES = {f.__name__: f for f in (
    depression_polygons, class_polygons, stream_lines, stream_samples, stream_agreement, line_positions, resampled_bilinear, resampled_coarse, web_grid_values, inverse_transverse_mercator, reprojected_boxes,
    packed_frames, water_distance, water_buffer, customer_hulls,
)}

# rings told by their corners: of the four cells round a corner one or three have the label where a ring turns, two across a diagonal where it turns twice
CORNERS = """k AS (SELECT label, row + i AS vr, col + j AS vc, 2 * i + j AS spot FROM g, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
q AS (SELECT label, count(*) AS n, sum(spot) AS s FROM k GROUP BY label, vr, vc),
v AS (SELECT label, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 3) AS q3, count(*) FILTER (n = 2 AND s = 3) AS qd FROM q GROUP BY label),
pa AS (SELECT a.label, count(*) AS n FROM g a JOIN g b ON a.label = b.label AND (b.row = a.row AND b.col = a.col + 1 OR b.row = a.row + 1 AND b.col = a.col) GROUP BY a.label)
SELECT label, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(any_value(pa.n), 0) AS DOUBLE) AS perimeter, any_value(q1 + q3 + 2 * qd) AS n_vertices, any_value(1 - (q1 - q3 + 2 * qd) // 4) AS n_holes
FROM g JOIN v USING (label) LEFT JOIN pa USING (label) GROUP BY label"""
LABELLED = """ed AS (SELECT a.cell AS a, b.cell AS b FROM sk a JOIN sk b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1),
re AS (SELECT cell, cell AS label FROM sk UNION SELECT b, label FROM re JOIN ed ON a = cell AND label < b),
lb AS (SELECT cell, min(label) AS label FROM re GROUP BY cell), g AS (SELECT sk.row, sk.col, lb.label FROM sk JOIN lb USING (cell))"""

# half edges of the stream segments, walked from the nodes where no line goes on
LINES = """sg AS (SELECT p.cell AS sid, p.cell AS a, p.next AS b, x.col + 0.5 AS ax, -x.row - 0.5 AS ay, y.col + 0.5 AS ex, -y.row - 0.5 AS ey FROM p JOIN ac s ON s.cell = p.cell AND s.area >= 12 JOIN ac t ON t.cell = p.next AND t.area >= 12
  JOIN c x ON x.cell = p.cell JOIN c y ON y.cell = p.next),
he AS (SELECT 2 * sid AS id, sid, a AS f, b AS t, CAST(ax AS DOUBLE) AS x0, CAST(ay AS DOUBLE) AS y0, CAST(ex AS DOUBLE) AS x1, CAST(ey AS DOUBLE) AS y1 FROM sg UNION ALL SELECT 2 * sid + 1, sid, b, a, ex, ey, ax, ay FROM sg),
hl AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS length FROM he), dg AS (SELECT f AS node, count(*) AS n FROM he GROUP BY f),
wk AS (SELECT id AS chain, id, sid, t, 0 AS seq, CAST(0 AS DOUBLE) AS before, length FROM hl JOIN dg ON node = f WHERE n <> 2
  UNION ALL SELECT wk.chain, h.id, h.sid, h.t, seq + 1, before + wk.length, h.length FROM wk JOIN dg ON dg.node = wk.t AND dg.n = 2 JOIN hl h ON h.f = wk.t AND h.sid <> wk.sid),
ch AS (SELECT chain, min(id) AS least, max(before + length) AS total FROM wk GROUP BY chain HAVING min(id) % 2 = 0),
ln AS (SELECT wk.sid, least // 2 AS line, CAST(seq AS BIGINT) AS seq, wk.id % 2 = 1 AS reversed, x0, y0, x1, y1, round(before, 9) AS before, round(before + wk.length, 9) AS upto, wk.length, round(total, 9) AS total FROM wk JOIN ch USING (chain) JOIN hl USING (id)),
sm AS (SELECT line, k, least(1, greatest(0, (k * 0.5 - before) / length)) AS t, x0, y0, x1, y1 FROM (SELECT *, unnest(range(CAST(ceil(before / 0.5) AS BIGINT), CAST(ceil(upto / 0.5) AS BIGINT))) AS k FROM ln)),
sp AS (SELECT line, k, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y FROM sm)"""
AWAY = "sqrt(pow(px - (ax + t * (ex - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2))"
ON = "greatest(0, least(1, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / (pow(ex - ax, 2) + pow(ey - ay, 2))))"
ROUGH = """c2 AS (SELECT cell, row, col, floor(z * 8) AS z FROM c), nb2 AS (SELECT nb.cell, n_cell, code, length, a.z AS z, b.z AS n_z FROM nb JOIN c2 a ON a.cell = nb.cell JOIN c2 b ON b.cell = n_cell),
p2 AS (SELECT cell, arg_max(n_cell, ((z - n_z) / length, -code)) AS next FROM nb2 WHERE n_z < z GROUP BY cell),
w2 AS (SELECT cell, cell AS pos FROM c UNION ALL SELECT w2.cell, p2.next FROM w2 JOIN p2 ON p2.cell = w2.pos), a2 AS (SELECT pos AS cell FROM w2 GROUP BY pos HAVING count(*) >= 8),
s2 AS (SELECT p2.cell AS sid, x.col + 0.5 AS ax, -x.row - 0.5 AS ay, y.col + 0.5 AS ex, -y.row - 0.5 AS ey FROM p2 JOIN a2 s ON s.cell = p2.cell JOIN a2 t ON t.cell = p2.next JOIN c x ON x.cell = p2.cell JOIN c y ON y.cell = p2.next)"""
RASTER = f"r AS (SELECT (p_partkey - 1) // {WIDTH} AS row, (p_partkey - 1) % {WIDTH} AS col, CASE WHEN p_size <> 13 THEN p_retailprice / 10 END AS value FROM part), n AS (SELECT max(row) + 1 AS n FROM r)"


def _series(kind: str, var: str, terms) -> str:
    return "".join(f" - {b!r}::DOUBLE * {kind.format(2 * j, v=var)}" for j, b in enumerate(terms, 1))


def _inverse_sql(x: str, y: str, meridian: float, north: float) -> str:
    """(lon, lat) of columns of the table m, in the tables i1, i2 and i3."""
    n = G.FLATTENING / (2 - G.FLATTENING)
    radius = G.SCALE * G.EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    d = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = "u" + "".join(f" - {v!r}::DOUBLE * sin({2 * j} * u) * cosh({2 * j} * w)" for j, v in enumerate(b, 1))
    eta = "w" + "".join(f" - {v!r}::DOUBLE * cos({2 * j} * u) * sinh({2 * j} * w)" for j, v in enumerate(b, 1))
    lat = "chi" + "".join(f" + {v!r}::DOUBLE * sin({2 * j} * chi)" for j, v in enumerate(d, 1))
    return f"""i1 AS (SELECT *, ({y} - {north!r}) / {radius!r}::DOUBLE AS u, ({x} - 500000) / {radius!r}::DOUBLE AS w FROM m), i2 AS (SELECT *, {xi} AS xi, {eta} AS eta FROM i1),
      i3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM i2), i4 AS (SELECT *, {meridian!r} + degrees(atan2(sinh(eta), cos(xi))) AS lon, degrees({lat}) AS lat FROM i3)"""


def _forward_sql(source: str, meridian: float, north: float) -> str:
    """(x, y) of lon and lat of a table, in the tables f1 to f3."""
    n = G.FLATTENING / (2 - G.FLATTENING)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    radius, e = G.SCALE * G.EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    x = "eta" + "".join(f" + {v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))
    y = "xi" + "".join(f" + {v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))
    return f"""f1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - {meridian!r}) AS away FROM {source}),
      f2 AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM f1), f3 AS (SELECT *, 500000 + {radius!r}::DOUBLE * ({x}) AS x, {north!r} + {radius!r}::DOUBLE * ({y}) AS y FROM f2)"""


AWAY_FROM = f"""WITH c AS (SELECT p_partkey AS cell, (p_partkey - 1) // {WIDTH} AS row, (p_partkey - 1) % {WIDTH} AS col, p_size FROM part),
    d AS (SELECT a.cell, a.row, a.col, 30 * sqrt(min(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS dist FROM c a, c b WHERE b.p_size >= 47 GROUP BY ALL)"""
# a pair of points bounds the hull if no point lies to its right, nor on its line beyond either end; the smallest rectangle lies on such a side
HULL = """WITH p AS (SELECT DISTINCT c_nationkey AS k, c_acctbal / 100 AS x, (c_custkey % 89) * 1.0 AS y FROM customer), pr AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y)),
    s AS (SELECT pr.*, count(*) FILTER ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) < 0 OR (bx - ax) * (y - ay) = (by_ - ay) * (x - ax) AND NOT (x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_))) AS bad FROM pr JOIN p USING (k) GROUP BY ALL HAVING bad = 0),
    u AS (SELECT *, (bx - ax) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS ux, (by_ - ay) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS uy FROM s),
    e AS (SELECT u.k, ax, ay, bx, by_, max(x * ux + y * uy) - min(x * ux + y * uy) AS w, max(y * ux - x * uy) - min(y * ux - x * uy) AS h FROM u JOIN p USING (k) GROUP BY u.k, ax, ay, bx, by_, ux, uy)
    SELECT k AS c_nationkey, count(*) AS corners, round(sum(ax * by_ - bx * ay) / 2, 5) AS area, round(arg_min(greatest(w, h), (round(w * h, 9), greatest(w, h))), 5) AS long, round(arg_min(least(w, h), (round(w * h, 9), greatest(w, h))), 5) AS short FROM e GROUP BY k"""

SQL = {
    "packed_frames": """WITH f AS (SELECT frame, p_partkey, CASE WHEN p_size % 4 = frame THEN p_size ELSE 0 END AS v FROM part, (SELECT DISTINCT p_size % 4 AS frame FROM part))
        SELECT frame, count(*) AS n_bytes, count(*) FILTER (v > 0) AS n_wet, md5(string_agg(printf('%02x', CAST(v AS INT)), '' ORDER BY p_partkey)) AS digest FROM f GROUP BY frame""",
    "water_distance": f"{AWAY_FROM} SELECT cell, row, col, round(dist, 6) AS dist FROM d",
    "water_buffer": f"{AWAY_FROM} SELECT cell FROM d WHERE dist <= 70",
    "customer_hulls": HULL,
    "depression_polygons": f"WITH RECURSIVE {CELLS}, {FILL}, sk AS (SELECT fl.cell, row, col, 1 AS value FROM fl JOIN c USING (cell) WHERE f > z), {LABELLED}, {CORNERS}",
    "class_polygons": f"WITH RECURSIVE sk AS (SELECT p_partkey AS cell, (p_partkey - 1) // {WIDTH} AS row, (p_partkey - 1) % {WIDTH} AS col, p_size // 18 AS value FROM part), {LABELLED}, {CORNERS}",
    "stream_lines": f"WITH RECURSIVE {CELLS}, {WAYS}, {LINES} SELECT sid, line, false AS closed, seq, reversed, round(before, 6) AS before, round(total, 6) AS total FROM ln",
    "stream_samples": f"WITH RECURSIVE {CELLS}, {WAYS}, {LINES} SELECT line, k, round(x, 6) AS x, round(y, 6) AS y FROM sp",
    "stream_agreement": f"""WITH RECURSIVE {CELLS}, {WAYS}, {LINES}, {ROUGH}, m AS (SELECT line, k, x AS px, y AS py, ax, ay, ex, ey FROM sp, s2), o AS (SELECT *, {ON} AS t FROM m),
        d AS (SELECT line % 7 AS k, min({AWAY}) AS dist FROM o GROUP BY line, o.k)
        SELECT k, round(quantile_cont(dist, 0.5), 6) AS median, round(quantile_cont(dist, 0.9), 6) AS p90, round(100 * avg(CAST(dist <= 2 AS INT)), 6) AS pct_within, count(*) AS n FROM d GROUP BY k""",
    "line_positions": f"""WITH RECURSIVE {CELLS}, {WAYS}, {LINES}, q AS (SELECT c_custkey AS pid, c_acctbal / 300 + 0.003 AS px, CAST(-(c_custkey % 50) - 0.37 AS DOUBLE) AS py FROM customer),
        m AS (SELECT pid, px, py, sid, line, before, length, total, x0 AS ax, y0 AS ay, x1 AS ex, y1 AS ey FROM q, ln), o AS (SELECT *, {ON} AS t FROM m), d AS (SELECT *, {AWAY} AS dist FROM o),
        b AS (SELECT pid, arg_min(struct_pack(line := line, "at" := before + t * length, x := ax + t * (ex - ax), y := ay + t * (ey - ay), dist := dist, total := total), (dist, sid)) AS b FROM d GROUP BY pid),
        e AS (SELECT pid, unnest(b), s FROM b, (SELECT unnest([-1, 1]) AS s)), g AS (SELECT *, least(greatest("at" + s, 0), total) AS there FROM e),
        h AS (SELECT pid, s, arg_min(x0 + (x1 - x0) * least(1, (there - before) / length), seq) AS hx, arg_min(y0 + (y1 - y0) * least(1, (there - before) / length), seq) AS hy FROM g JOIN ln USING (line) WHERE there BETWEEN before AND upto GROUP BY pid, s),
        w AS (SELECT pid, max(hx) FILTER (s = 1) - max(hx) FILTER (s = -1) AS dx, max(hy) FILTER (s = 1) - max(hy) FILTER (s = -1) AS dy FROM h GROUP BY pid)
        SELECT pid, b.line, round(b."at", 6) AS "at", round(b.x, 6) AS x, round(b.y, 6) AS y, round(dx, 6) AS dx, round(dy, 6) AS dy, round(b.dist, 6) AS dist FROM b JOIN w USING (pid)""",
    "resampled_bilinear": f"""WITH {RASTER}, t AS (SELECT row, col, {FINE[1]} + (col + 0.5) * {FINE[0]} AS x, {FINE[2]} - (row + 0.5) * {FINE[0]} AS y FROM (SELECT unnest(range(CAST(floor(n / {FINE[0]}) AS BIGINT) + 2)) AS row FROM n), (SELECT unnest(range({int(WIDTH / FINE[0]) + 2})) AS col)),
        u AS (SELECT row, col, -CAST(y AS DOUBLE) - 0.5 AS fr, CAST(x AS DOUBLE) - 0.5 AS fc, x >= 0 AND x < {WIDTH} AND y <= 0 AND y > -n AS inside FROM t, n),
        v AS (SELECT u.row, u.col, inside, r.value, (1 - abs(fr - r.row)) * (1 - abs(fc - r.col)) AS w FROM u LEFT JOIN r ON r.value IS NOT NULL AND r.row BETWEEN floor(fr) AND floor(fr) + 1 AND r.col BETWEEN floor(fc) AND floor(fc) + 1)
        SELECT row, col, round(CASE WHEN any_value(inside) AND sum(w) > 1e-9 THEN sum(w * value) / sum(w) END, 5) AS value FROM v GROUP BY row, col""",
    "resampled_coarse": f"""WITH {RASTER}, u AS (SELECT value, (row + 0.5) / 2.5 - 0.5 AS fr, (col + 0.5) / 2.5 - 0.5 AS fc FROM r WHERE value IS NOT NULL),
        v AS (SELECT value, CAST(floor(fr) AS BIGINT) + i AS row, CAST(floor(fc) AS BIGINT) + j AS col, (1 - abs(floor(fr) + i - fr)) * (1 - abs(floor(fc) + j - fc)) AS w FROM u, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
        SELECT row, col, round(sum(w * value) / sum(w), 5) AS value FROM v, n WHERE w > 0 AND row BETWEEN 0 AND (n * 2 + 4) // 5 - 1 AND col BETWEEN 0 AND {(WIDTH * 2 + 4) // 5 - 1} GROUP BY row, col""",
    "web_grid_values": f"""WITH {RASTER}, t AS (SELECT row, col, {WEB[1]!r} + (col + 0.5) * 37 AS mx, {WEB[2]!r} - (row + 0.5) * 37 AS my FROM (SELECT unnest(range(CAST(floor(n * 30.0 / 37 * 1.3) AS BIGINT) + 2)) AS row FROM n), (SELECT unnest(range({int(WIDTH * 30.0 / 37.0 * 1.3) + 2})) AS col)),
        ll AS (SELECT row, col, degrees(mx / {G.EARTH_M}) AS lon, degrees(2 * atan(exp(my / {G.EARTH_M})) - pi() / 2) AS lat FROM t), {_forward_sql("ll", -63.0, 1e7)}
        SELECT f3.row, f3.col, round(value, 6) AS value FROM f3 JOIN r ON r.row = floor((6180000 - y) / 30) AND r.col = floor((x - 500000) / 30) WHERE value IS NOT NULL""",
    "inverse_transverse_mercator": f"""WITH m AS (SELECT c_custkey, 500000 + c_acctbal * 20 AS mx, -3000000 + (c_custkey % 997) * 5000 AS my FROM customer), {_inverse_sql("mx", "my", -60.0, 0.0)}
        SELECT c_custkey, round(lon, 8) AS lon, round(lat, 8) AS lat, true AS within_mm FROM i4""",
    "reprojected_boxes": f"""WITH s AS (SELECT s_suppkey, 500000 + s_acctbal * 10 AS x, 6000000 + s_suppkey * 100 AS y, (s_suppkey % 7 + 3) * 1000 AS w FROM supplier), k AS (SELECT unnest(range(22)) AS k),
        m AS (SELECT s_suppkey, x - w + 2 * w * k / 21.0 AS mx, unnest([y - w, y + w]) AS my FROM s, k UNION ALL SELECT s_suppkey, unnest([x - w, x + w]), y - w + 2 * w * k / 21.0 FROM s, k), {_inverse_sql("mx", "my", -63.0, 1e7)}
        SELECT s_suppkey, round(min(lon), 7) AS x0, round(min(lat), 7) AS y0, round(max(lon), 7) AS x1, round(max(lat), 7) AS y1 FROM i4 GROUP BY s_suppkey""",
}
