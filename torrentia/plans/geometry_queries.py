"""Geometry and streaming-window queries: rectangles and circles derived from supplier rows, gauges from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentia.functions import geometry as G
from torrentia.operators import matching
from torrentia.streaming import rain


def _rings(spark, d, more=0.0):
    """A kite round each supplier's place, its ring wider by `more`."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    x, y, w = F.col("s_acctbal") / 100, (F.col("s_suppkey") % 89).cast("double"), (F.col("s_suppkey") % 7 + 3).cast("double")
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return s.select("s_suppkey", x.alias("x"), y.alias("y"), w.alias("w"), F.array(p(-w - more, F.lit(0.0)), p(F.lit(0.0), -2 * (w + more)), p(w + more, F.lit(0.0)), p(F.lit(0.0), w + more)).alias("ring"))


#: Points on a side are told by the kite's own inequality, since sums of doubles put them on either side of it: the wider ring finds them.
EDGE = 1e-6


def in_kite(px, py, x, y, w):
    return ((py >= y) & (F.abs(px - x) < w - (py - y))) | ((py < y) & (F.abs(px - x) < w - (y - py) / 2))


def polygon_measures(spark, d):
    c = G.centroid(F.col("ring"))
    r = _rings(spark, d).withColumn("c", c)
    circle = G.area(G.circle(F.col("x"), F.col("y"), F.col("w")))
    return r.select("s_suppkey", *[F.round(v, 5).alias(n) for n, v in (("area", G.area(F.col("ring"))), ("perimeter", G.perimeter(F.col("ring"))), ("cx", F.col("c.x")), ("cy", F.col("c.y")), ("circle", circle))])


def points_in_polygons(spark, d):
    """Customers inside the suppliers' kites; candidates meet in grid cells."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_acctbal") / 100 + 0.003).alias("px"), (F.col("c_custkey") % 97 + 0.37).cast("double").alias("py"))
    found = matching.points_in_rings(c, _rings(spark, d, EDGE), 2.0, also=in_kite(*[F.col(n) for n in ("px", "py", "x", "y", "w")]))
    return found.select("c_custkey", "s_suppkey")


def _gauges(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def rain_window_totals(spark, d):
    r = rain.window_totals(_gauges(spark, d), "event_type", "ts", "value", "24 hours", "6 hours")
    return r.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.round("mm", 5).alias("mm"), "n")


def rain_storms(spark, d):
    r = rain.storms(_gauges(spark, d), "user_id", "ts", "value")
    return r.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), F.round("mm", 5).alias("mm"), "n")


QUERIES = {f.__name__: f for f in (polygon_measures, points_in_polygons, rain_window_totals, rain_storms)}

PLACES = "s AS (SELECT s_suppkey, s_acctbal / 100 AS x, CAST(s_suppkey % 89 AS DOUBLE) AS y, CAST(s_suppkey % 7 + 3 AS DOUBLE) AS w FROM supplier)"
SQL = {
    "polygon_measures": f"""WITH {PLACES} SELECT s_suppkey, round(3 * w * w, 5) AS area, round(2 * w * (sqrt(2) + sqrt(5)), 5) AS perimeter, round(x, 5) AS cx, round(y - w / 3, 5) AS cy,
        round(128 * w * w * sin(pi() / 128), 5) AS circle FROM s""",
    "points_in_polygons": f"""WITH {PLACES}, c AS (SELECT c_custkey, c_acctbal / 100 + 0.003 AS px, CAST(c_custkey % 97 + 0.37 AS DOUBLE) AS py FROM customer)
        SELECT c_custkey, s_suppkey FROM c, s WHERE (py >= y AND abs(px - x) < w - (py - y)) OR (py < y AND abs(px - x) < w - (y - py) / 2)""",
    "rain_window_totals": """WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
        SELECT event_type, start, round(sum(value), 5) AS mm, count(*) AS n FROM w GROUP BY ALL""",
    "rain_storms": """WITH g AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS AS cut FROM events),
        r AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, round(sum(value), 5) AS mm, count(*) AS n FROM r GROUP BY user_id, k""",
}
