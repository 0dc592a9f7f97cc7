"""Raster, class and label queries: cells are line items averaged by part and supplier number."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentia.functions import scalars as S
from torrentia.operators import matching, raster, rules
from torrentia.scratch import large

N = 40
#: Means of few decimals often end in an exact 5, where two engines' last bits decide the rounding; this moves them off.
OFF_TIES = 3.14159265e-8


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cells(spark, d):
    """raster (return flag), row, col, value: mean price in thousands, missing where the mean quantity is above 30."""
    li = _table(spark, d, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("raster"), (F.col("l_partkey") % N).alias("row"), (F.col("l_suppkey") % N).alias("col")).agg(
        F.avg("l_extendedprice").alias("p"), F.avg("l_quantity").alias("q")
    )
    return c.select("raster", "row", "col", F.when(F.col("q") <= 30, F.col("p") / 1000).alias("value"))


def _zones(spark, d):
    return _cells(spark, d).withColumn("zone", F.concat_ws("-", "raster", (F.expr("row div 10")).cast("string")))


def zonal_stats(spark, d):
    z = raster.zonal(_zones(spark, d))
    return z.select("zone", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")], "valid", "n_cells")


def zonal_pct_null_policies(spark, d):
    return raster.zonal_share(_zones(spark, d), F.col("value") <= 36).select("zone", F.round("of_all", 6).alias("of_all"), F.round("of_valid", 6).alias("of_valid"))


def mode_tiebreak(spark, d):
    return raster.mode(_table(spark, d, "part"), ["p_brand"], "p_size")


def percentile_linear(spark, d):
    p = _table(spark, d, "part").groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(*map(F.lit, (0.02, 0.5, 0.9)))).alias("p"))
    return p.select("p_brand", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p2", "p50", "p90"))])


def dem_selection(spark, d):
    """Brands as areas, types as DEMs: price as roughness, mean size as distance from mapped streams, missing for some."""
    osm = F.when(F.min("p_size") > 3, F.round(F.avg("p_size"), 6))
    s = _table(spark, d, "part").groupBy(F.col("p_brand").alias("area"), F.col("p_type").alias("dem")).agg(F.round(F.avg("p_retailprice"), 6).alias("rough"), osm.alias("osm"))
    return raster.select_dem(s.withColumn("bare", F.length("dem") % 2 == 0))


def class_breaks(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.class_of(F.col("l_quantity") / 8, rules.cuts(rules.RULES, "hand_min_m", 5.0)).alias("hand_class"))


def db_transform(spark, d):
    x = (F.col("l_discount") - 0.03) * F.col("l_tax")
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.decibel(x), 6).alias("db"), F.round(S.log10_hectares(F.col("l_extendedprice")), 6).alias("ha"), F.round(S.slope_percent(F.col("l_quantity")), 6).alias("slope"))


def compass8(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.compass8(F.col("l_quantity") - 25, F.col("l_extendedprice") / 2000 - 18).alias("towards"))


def frame_encode(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.frame_code(F.col("l_quantity") * F.col("l_discount")).alias("code"))


def sink_and_water(spark, d):
    li = _table(spark, d, "lineitem")
    z = S.plausible_elevation(F.col("l_extendedprice") / 10)
    water = F.when(F.col("l_discount") < 0.09, F.col("l_tax") > 0.04)
    return li.select("l_orderkey", "l_linenumber", F.round(S.sink_depth(F.col("l_quantity") * 100, z), 6).alias("sink"), S.water_code(water, F.col("l_returnflag") == "R").alias("code"))


def otsu_threshold(spark, d):
    return raster.otsu(_table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", F.round("threshold", 6).alias("threshold"))


def otsu_guarded(spark, d):
    li = _table(spark, d, "lineitem").select("l_suppkey", (F.log10("l_extendedprice") * 10 - 60).alias("db")).where("db > -35 and db < 5")
    return raster.otsu_guarded(li, ["l_suppkey"], "db", -13.0, -18.0).select("l_suppkey", F.round("threshold", 6).alias("threshold"), "is_fixed")


def _wet(spark, d, flag):
    return _cells(spark, d).where((F.col("raster") == flag) & (F.col("value") > 37)).select("row", "col")


def change_detection(spark, d):
    return matching.new_only(_wet(spark, d, "N"), _wet(spark, d, "R"), ["row", "col"])


def focal_mean_3x3(spark, d):
    return raster.focal_mean(_cells(spark, d), 3).withColumn("mean", F.round(F.col("mean") + OFF_TIES, 6))


def focal_mean_5x5_open(spark, d):
    return raster.focal_mean(_cells(spark, d), 5, "none").withColumn("mean", F.round(F.col("mean") + OFF_TIES, 6))


def lee_filter(spark, d):
    return raster.lee(_cells(spark, d)).withColumn("value", F.round("value", 5))


def strict_pits(spark, d):
    return raster.strict_pits(_cells(spark, d)).withColumn("value", F.round("value", 9))


def dem_roughness(spark, d):
    r = raster.roughness(_cells(spark, d), 30.0)
    return r.select("raster", *[F.round(c, 5).alias(c) for c in ("rough", "pits_per_km2", "nodata_pct")])


def _depths(spark, d):
    c = _table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("raster"), F.col("l_linestatus").alias("dem"), (F.col("l_partkey") % N).alias("row"), (F.col("l_suppkey") % N).alias("col"))
    return c.agg((F.avg("l_quantity") - 25).alias("value"))


def certainty_ensemble(spark, d):
    return raster.certainty(_depths(spark, d), 0.0)


def certainty_class(spark, d):
    c = raster.certainty(_depths(spark, d), 5.0)
    return c.select("raster", "row", "col", S.certainty_class(F.col("certainty")).alias("class"), S.lot_words(F.col("certainty")).alias("part"))


def blend_neighbours(spark, d):
    """Each part's size between the levels of its brand, and the prices of the levels blended."""
    p = _table(spark, d, "part")
    levels = p.where("p_size % 5 = 0").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("double"))).alias("levels"))
    at = p.join(levels, "p_brand").withColumn("n", S.neighbours(F.col("levels"), F.col("p_size").cast("double")))
    lo, hi = F.array(F.col("n.lo"), F.col("n.lo") * 2), F.array(F.col("n.hi"), F.col("n.hi") * 3)
    mixed = S.blend(lo, hi, F.col("n.w"))
    return at.select("p_partkey", "n.lo", "n.hi", "n.w", mixed[0].alias("a"), mixed[1].alias("b"))


def snap_levels(spark, d):
    p = _table(spark, d, "part")
    levels = p.where("p_size % 7 = 1").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("double"))).alias("levels"))
    return p.join(levels, "p_brand").select("p_partkey", S.snap(F.col("levels"), F.col("p_size").cast("double")).alias("snapped"))


def _frames(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.col("event_type").alias("scenario"), F.hour("ts").alias("hour"), F.col("user_id").alias("cell"), F.floor(F.pmod(F.col("value"), F.lit(40.0))).alias("h_cm"))


def lot_hourly_stats(spark, d):
    return raster.lot_by_hour(_frames(spark, d))


def lot_summary(spark, d):
    return raster.lot_summary(raster.lot_by_hour(_frames(spark, d)))


def spanish_numbers(spark, d):
    return _table(spark, d, "part").select("p_partkey", S.spanish_number(F.col("p_retailprice") * 1000, 1).alias("price"), S.spanish_number(F.nullif("p_size", F.lit(7)).cast("double"), 0).alias("size"))


def return_sentences(spark, d):
    p = _table(spark, d, "part")
    a, b = F.col("p_retailprice") / 100, F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 3.0)
    hours, since = F.element_at(F.array(F.lit(3.0), F.lit(24.0), F.lit(72.0)), (F.col("p_partkey") % 3 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, 1981)
    return p.select("p_partkey", S.return_sentence(F.col("p_size").cast("double"), F.lit(46.0), a - 8.5, b, hours, since).alias("sentence"))


def _places(spark, d):
    c = _table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") / 60 - 60).alias("lon"), (F.col("c_custkey") % 140 - 70 + 0.25).alias("lat"))


def crs_codes(spark, d):
    return _places(spark, d).select("c_custkey", S.crs_code(F.col("lon"), F.col("lat")).alias("epsg"))


def degree_tiles(spark, d):
    x, y = F.col("lon"), F.col("lat")
    return _places(spark, d).select("c_custkey", F.explode(S.degree_tiles(x, y, x + 0.8, y + 0.8)).alias("tile"))


def rain_pixels(spark, d):
    return _places(spark, d).select("c_custkey", S.rain_pixel_centre(F.col("lon")).alias("lon"), S.rain_pixel_centre(F.col("lat")).alias("lat"))


def nearest_line(spark, d):
    """Customers' nearest supplier line, by balance and key."""
    pts = _table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") / 100).alias("px"), (F.col("c_custkey") % 97).cast("double").alias("py"))
    s = _table(spark, d, "supplier")
    ax, ay = F.col("s_acctbal") / 100, (F.col("s_suppkey") % 89).cast("double")
    segs = s.select(F.col("s_suppkey").alias("sid"), ax.alias("ax"), ay.alias("ay"), (ax + 7).alias("bx"), (ay + 3).alias("by"))
    return matching.nearest_segment(pts, segs, 10.0).withColumn("dist", F.round("dist", 6))


def line_agreement(spark, d):
    """How well customers' places agree with supplier lines, by nation."""
    c = _table(spark, d, "customer").select("c_custkey", "c_nationkey")
    near = nearest_line(spark, d).join(large(c), F.col("pid") == F.col("c_custkey"))
    return matching.line_agreement(near, "c_nationkey", 4.0).select("c_nationkey", *[F.round(x, 8).alias(x) for x in ("median", "p90", "pct_within")], "n")


def profile_kinds(spark, d):
    """Orders' line items as a profile across a stream: place by quantity, height by price."""
    li = _table(spark, d, "lineitem")
    p = li.select("l_suppkey", ((F.col("l_quantity") - 25) * 8).alias("x"), (F.col("l_extendedprice") / 10000).alias("z"), (F.col("l_suppkey") % 90).cast("double").alias("line_dist"))
    return matching.profile_kind(p, "l_suppkey").withColumn("incision_cm", F.round("incision_cm", 5))


def hand_uncertainty(spark, d):
    """Chances that the least height above drainage is under 0.5 and 1 m, by brand, from the spread over types."""
    p = _table(spark, d, "part").groupBy("p_brand", "p_type").agg((F.min("p_retailprice") / 1000).alias("h"))
    g = p.groupBy("p_brand").agg(F.min("h").alias("h"), F.greatest(F.lit(1.0), F.coalesce(F.stddev_samp("h"), F.lit(0.0))).alias("s"))
    return g.select("p_brand", F.round("s", 2).alias("sigma"), *[F.round(100 * S.normal_cdf((F.lit(c) - F.col("h")) / F.col("s")), 1).alias(n) for c, n in ((0.5, "p_lt05"), (1.0, "p_lt1"))])


QUERIES = {f.__name__: f for f in (
    zonal_stats, zonal_pct_null_policies, mode_tiebreak, percentile_linear, dem_selection, class_breaks, db_transform, compass8, frame_encode, sink_and_water,
    otsu_threshold, otsu_guarded, change_detection, focal_mean_3x3, focal_mean_5x5_open, lee_filter, strict_pits, dem_roughness, certainty_ensemble, certainty_class,
    blend_neighbours, snap_levels, lot_hourly_stats, lot_summary, spanish_numbers, return_sentences, crs_codes, degree_tiles, rain_pixels, nearest_line, line_agreement, profile_kinds, hand_uncertainty,
)}

CELLS = f"""c AS (SELECT l_returnflag AS raster, l_partkey % {N} AS row, l_suppkey % {N} AS col, CASE WHEN avg(l_quantity) <= 30 THEN avg(l_extendedprice) / 1000 END AS value FROM lineitem GROUP BY ALL),
z AS (SELECT *, raster || '-' || (row // 10) AS zone FROM c)"""
DEPTHS = f"dp AS (SELECT l_returnflag AS raster, l_linestatus AS dem, l_partkey % {N} AS row, l_suppkey % {N} AS col, avg(l_quantity) - 25 AS value FROM lineitem GROUP BY ALL)"


def _focal(k: int, table: str = "c", reflect: bool = True) -> str:
    """Windowed cells by brute force: every centre with every offset, reflected at the raster's edges."""
    h = k // 2
    at = lambda a: f"CASE WHEN o.{a} < g.{a}0 THEN 2 * g.{a}0 - 1 - o.{a} WHEN o.{a} > g.{a}1 THEN 2 * g.{a}1 + 1 - o.{a} ELSE o.{a} END" if reflect else f"o.{a}"
    return f"""g AS (SELECT raster, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM {table} GROUP BY raster),
    ctr AS (SELECT raster, row, col FROM g, (SELECT unnest(range(0, {N})) AS row) r, (SELECT unnest(range(0, {N})) AS col) q WHERE row BETWEEN row0 AND row1 AND col BETWEEN col0 AND col1),
    o AS (SELECT raster, ctr.row AS r, ctr.col AS q, ctr.row + dy AS row, ctr.col + dx AS col FROM ctr, (SELECT unnest(range(-{h}, {h + 1})) AS dy) y, (SELECT unnest(range(-{h}, {h + 1})) AS dx) x),
    fs AS (SELECT o.raster, o.r AS row, o.q AS col, count(t.value) AS n, sum(t.value) AS s, sum(t.value * t.value) AS s2, count(*) FILTER (WHERE t.raster IS NOT NULL) AS m
      FROM o JOIN g ON o.raster = g.raster LEFT JOIN {table} t ON t.raster = o.raster AND t.row = {at("row")} AND t.col = {at("col")} GROUP BY ALL)"""


def _otsu(src: str, key: str, value: str) -> str:
    return f"""r AS (SELECT {key}, min({value}) AS lo, max({value}) AS hi FROM {src} GROUP BY ALL),
    b AS (SELECT {key}, CASE WHEN hi > lo THEN least(floor(({value} - lo) * 256 / (hi - lo)), 255) ELSE 0 END AS bin, lo, (hi - lo) / 256 AS width, count(*) AS n FROM {src} JOIN r USING ({key}) GROUP BY ALL),
    x AS (SELECT *, lo + (bin + 0.5) * width AS x FROM b),
    w AS (SELECT *, sum(n) OVER u AS w0, sum(n * x) OVER u AS s0, sum(n) OVER e AS w, sum(n * x) OVER e AS s FROM x WINDOW u AS (PARTITION BY {key} ORDER BY bin), e AS (PARTITION BY {key})),
    v AS (SELECT *, CASE WHEN w > w0 THEN round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) END AS bv FROM w),
    t AS (SELECT {key}, arg_max(x, (coalesce(bv, -1), -bin)) AS threshold FROM v GROUP BY ALL)"""


NUM = "translate(format('{{:,.{0}f}}', {1}), ',.', '.,')"
def _cdf(x: str) -> str:
    """The normal distribution function by the series of erf, which beyond 5 is 1 to sixteen digits."""
    v = f"(greatest(-5.0, least(5.0, ({x}) / sqrt(2))))"
    return f"(0.5 + list_sum(list_transform(range(0, 90), lambda k: pow(-1, k) * pow({v}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) / sqrt(pi()))"


SQL = {
    "hand_uncertainty": f"""WITH p AS (SELECT p_brand, p_type, min(p_retailprice) / 1000 AS h FROM part GROUP BY ALL), g AS (SELECT p_brand, min(h) AS h, greatest(1.0, coalesce(stddev_samp(h), 0)) AS s FROM p GROUP BY p_brand)
        SELECT p_brand, round(s, 2) AS sigma, round(100 * {_cdf("(0.5 - h) / s")}, 1) AS p_lt05, round(100 * {_cdf("(1 - h) / s")}, 1) AS p_lt1 FROM g""",
    "zonal_stats": f"WITH {CELLS} SELECT zone, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, count(value) AS valid, count(*) AS n_cells FROM z GROUP BY zone",
    "zonal_pct_null_policies": f"WITH {CELLS} SELECT zone, round(100 * avg(CAST(coalesce(value <= 36, false) AS INT)), 6) AS of_all, round(100 * avg(CAST(value <= 36 AS INT)), 6) AS of_valid FROM z GROUP BY zone",
    "mode_tiebreak": "SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)) WHERE k = 1",
    "percentile_linear": "SELECT p_brand, " + ", ".join(f"round(quantile_cont(p_retailprice, {q}), 6) AS {n}" for q, n in ((0.02, "p2"), (0.5, "p50"), (0.9, "p90"))) + " FROM part GROUP BY p_brand",
    "dem_selection": """WITH s0 AS (SELECT p_brand AS area, p_type AS dem, round(avg(p_retailprice), 6) AS rough, CASE WHEN min(p_size) > 3 THEN round(avg(p_size), 6) END AS osm, length(p_type) % 2 = 0 AS bare FROM part GROUP BY ALL),
        s AS (SELECT *, CASE WHEN count(osm) OVER (PARTITION BY area) = count(*) OVER (PARTITION BY area) THEN osm ELSE rough END AS score FROM s0),
        b AS (SELECT area, min(score) AS score, arg_min(dem, (score, dem)) AS dem, min(score) FILTER (WHERE bare) AS bs, arg_min(dem, (score, dem)) FILTER (WHERE bare) AS bd FROM s GROUP BY area)
        SELECT area, CASE WHEN bs <= 1.5 * score THEN bd ELSE dem END AS dem FROM b""",
    "class_breaks": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity / 8 < 0.5 THEN 0 WHEN l_quantity / 8 < 1 THEN 1 WHEN l_quantity / 8 < 2 THEN 2 WHEN l_quantity / 8 < 5 THEN 3 END AS INT) AS hand_class FROM lineitem",
    "db_transform": """SELECT l_orderkey, l_linenumber, CASE WHEN (l_discount - 0.03) * l_tax > 0 THEN round(10 * log10(greatest((l_discount - 0.03) * l_tax, 1e-6)), 6) END AS db,
        round(log10(greatest(l_extendedprice, 1.0) / 1e4), 6) AS ha, round(100 * tan(radians(l_quantity)), 6) AS slope FROM lineitem""",
    "compass8": """WITH a AS (SELECT *, degrees(atan2(l_quantity - 25, l_extendedprice / 2000 - 18)) + 360 AS d FROM lineitem), b AS (SELECT *, fmod(d, 360.0) + 22.5 AS e FROM a)
        SELECT l_orderkey, l_linenumber, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(fmod(e, 360.0) / 45) AS INT) + 1] AS towards FROM b""",
    "frame_encode": "SELECT l_orderkey, l_linenumber, CAST(least(greatest(round_even((l_quantity * l_discount - 1e-5) * 100, 0), 0), 255) AS SMALLINT) AS code FROM lineitem",
    "sink_and_water": """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice / 10 BETWEEN -100 AND 7000 THEN round(greatest(l_quantity * 100 - l_extendedprice / 10, 0), 6) END AS sink,
        CAST(CASE WHEN l_discount >= 0.09 THEN 255 WHEN l_tax <= 0.04 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS INT) AS code FROM lineitem""",
    "otsu_threshold": f"WITH {_otsu('part', 'p_brand', 'p_retailprice')} SELECT p_brand, round(threshold, 6) AS threshold FROM t",
    "otsu_guarded": f"""WITH li AS (SELECT * FROM (SELECT l_suppkey, log10(l_extendedprice) * 10 - 60 AS db FROM lineitem) WHERE db > -35 AND db < 5), {_otsu("li", "l_suppkey", "db")},
        q AS (SELECT l_suppkey, threshold, threshold > -13 OR avg(CAST(db < threshold AS INT)) > 0.2 AS is_fixed FROM li JOIN t USING (l_suppkey) GROUP BY l_suppkey, threshold)
        SELECT l_suppkey, round(CASE WHEN is_fixed THEN -18.0 ELSE threshold END, 6) AS threshold, is_fixed FROM q""",
    "change_detection": f"WITH {CELLS} SELECT row, col FROM c WHERE raster = 'N' AND value > 37 EXCEPT SELECT row, col FROM c WHERE raster = 'R' AND value > 37",
    "focal_mean_3x3": f"WITH {CELLS}, {_focal(3)} SELECT raster, row, col, round(s / n + {OFF_TIES}, 6) AS mean FROM fs WHERE m > 0",
    "focal_mean_5x5_open": f"WITH {CELLS}, {_focal(5, reflect=False)} SELECT raster, row, col, round(s / n + {OFF_TIES}, 6) AS mean FROM fs WHERE m > 0",
    "lee_filter": f"""WITH {CELLS}, v AS (SELECT raster, row, col, coalesce(value, avg(value) OVER (PARTITION BY raster)) AS value, value IS NOT NULL AS ok FROM c), {_focal(7, "v")}, k AS (SELECT raster, var_pop(value) AS noise FROM v GROUP BY raster),
        q AS (SELECT v.raster, v.row, v.col, value, ok, s / n AS m, greatest(s2 / n - (s / n) * (s / n), 0) AS var FROM v JOIN fs USING (raster, row, col))
        SELECT raster, row, col, CASE WHEN ok THEN round(m + var / (var + noise + 1e-12) * (value - m), 5) END AS value FROM q JOIN k USING (raster)""",
    "strict_pits": f"""WITH {CELLS} SELECT a.raster, a.row, a.col, round(any_value(a.value), 9) AS value FROM c a LEFT JOIN c b ON a.raster = b.raster AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1
        AND (a.row <> b.row OR a.col <> b.col) WHERE a.value IS NOT NULL GROUP BY a.raster, a.row, a.col HAVING coalesce(any_value(a.value) < min(b.value), true)""",
    "dem_roughness": f"""WITH {CELLS}, {_focal(5)}, p AS (SELECT raster, count(*) AS pits FROM (SELECT a.raster, a.row, a.col FROM c a LEFT JOIN c b ON a.raster = b.raster AND abs(a.row - b.row) <= 1
        AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) WHERE a.value IS NOT NULL GROUP BY ALL HAVING coalesce(any_value(a.value) < min(b.value), true)) GROUP BY raster)
        SELECT raster, round(stddev_pop(value - s / n), 5) AS rough, round(any_value(coalesce(pits, 0)) / (count(value) * 900.0 / 1e6), 5) AS pits_per_km2, round(100 * (1 - count(value) / count(*)), 5) AS nodata_pct
        FROM c JOIN fs USING (raster, row, col) LEFT JOIN p USING (raster) GROUP BY raster""",
    "certainty_ensemble": f"""WITH {DEPTHS}, w AS (SELECT raster, dem, row + dy AS row, col + dx AS col, sum(CAST(value > 0 AS INT)) / 9 AS share FROM dp, (SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x GROUP BY ALL),
        g AS (SELECT raster, dem, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM dp GROUP BY ALL)
        SELECT raster, row, col, CAST(round_even(100 * avg(share), 0) AS INT) AS certainty FROM w JOIN g USING (raster, dem) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY ALL""",
    "certainty_class": f"""WITH {DEPTHS}, w AS (SELECT raster, dem, row + dy AS row, col + dx AS col, sum(CAST(value > 5 AS INT)) / 9 AS share FROM dp, (SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x GROUP BY ALL),
        g AS (SELECT raster, dem, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM dp GROUP BY ALL),
        q AS (SELECT raster, row, col, round_even(100 * avg(share), 0) AS k FROM w JOIN g USING (raster, dem) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY ALL)
        SELECT raster, row, col, CASE WHEN k >= 70 THEN 'probable' WHEN k >= 30 THEN 'posible' WHEN k >= 5 THEN 'poco' END AS class,
        CASE {" ".join(f"WHEN k >= {a} THEN '{b}'" for a, b in S.LOT_WORDS)} ELSE 'una esquina del lote' END AS part FROM q""",
    "blend_neighbours": """WITH l AS (SELECT DISTINCT p_brand, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_size % 5 = 0), b AS (SELECT p_brand, min(v) AS a, max(v) AS z FROM l GROUP BY ALL),
        q AS (SELECT p_partkey, p_brand, least(greatest(CAST(p_size AS DOUBLE), a), z) AS q FROM part JOIN b USING (p_brand)),
        n AS (SELECT p_partkey, q, max(v) FILTER (WHERE v <= q) AS lo, min(v) FILTER (WHERE v >= q) AS hi FROM q JOIN l USING (p_brand) GROUP BY ALL),
        w AS (SELECT *, CASE WHEN lo = hi THEN 0.0 ELSE round((q - lo) / (hi - lo), 6) END AS w FROM n)
        SELECT p_partkey, lo, hi, CAST(w AS DOUBLE) AS w, CAST(floor(lo + (hi - lo) * w + 0.5) AS BIGINT) AS a, CAST(floor(2 * lo + (3 * hi - 2 * lo) * w + 0.5) AS BIGINT) AS b FROM w""",
    "snap_levels": """WITH l AS (SELECT DISTINCT p_brand, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_size % 7 = 1), i AS (SELECT *, v - lag(v) OVER (PARTITION BY p_brand ORDER BY v) AS g FROM l),
        e AS (SELECT p_brand, min(v) AS lo, max(v) AS hi, count(*) >= 2 AND max(g) - min(g) < 1e-9 AS even FROM i GROUP BY ALL)
        SELECT p_partkey, CASE WHEN any_value(even) THEN least(any_value(hi), greatest(any_value(lo), any_value(lo) + floor((p_size - any_value(lo)) / 5 + 0.5) * 5)) ELSE arg_min(v, (abs(v - p_size), v)) END AS snapped
        FROM part JOIN e USING (p_brand) JOIN l USING (p_brand) GROUP BY p_partkey, p_size""",
    "lot_hourly_stats": """SELECT event_type AS scenario, CAST(hour(ts) AS INT) AS hour, CAST(max(floor(fmod(fmod(value, 40.0) + 40.0, 40.0))) AS BIGINT) AS h_max, round(100 * avg(CAST(floor(fmod(fmod(value, 40.0) + 40.0, 40.0)) > 5 AS INT)), 4) AS pct5,
        round(100 * avg(CAST(floor(fmod(fmod(value, 40.0) + 40.0, 40.0)) > 20 AS INT)), 4) AS pct20 FROM events GROUP BY ALL""",
    "lot_summary": """WITH h AS (SELECT event_type AS scenario, CAST(hour(ts) AS INT) AS hour, max(floor(fmod(fmod(value, 40.0) + 40.0, 40.0))) AS m FROM events GROUP BY ALL)
        SELECT scenario, count(*) FILTER (WHERE m > 5) AS wet_hours, arg_max(hour, (m, -hour)) AS peak_hour FROM h GROUP BY scenario""",
    "spanish_numbers": f"""SELECT p_partkey, regexp_replace(regexp_replace({NUM.format(1, "p_retailprice * 1000")}, '0+$', ''), ',$', '') AS price,
        CASE WHEN p_size = 7 THEN '—' ELSE {NUM.format(0, "CAST(p_size AS DOUBLE)")} END AS size FROM part""",
    "return_sentences": f"""WITH q AS (SELECT p_partkey, p_size AS p, p_retailprice / 100 - 8.5 AS a, CASE WHEN p_size % 4 <> 0 THEN p_size * 3.0 END AS b FROM part),
        y AS (SELECT *, CASE WHEN least(a, b) > 100 THEN 'más de 100' ELSE {NUM.format(0, "least(a, b)")} END AS lo, CASE WHEN greatest(a, b) > 100 THEN 'más de 100' ELSE {NUM.format(0, "CAST(greatest(a, b) AS DOUBLE)")} END AS hi,
          {NUM.format(0, "a")} AS own FROM q)
        SELECT p_partkey, CASE WHEN p > 46 THEN 'Más de lo que llovió en cualquier ' || ['chaparrón de 3 h', 'día', 'temporal de 3 días'][p_partkey % 3 + 1] || ' desde ' || CASE WHEN p_partkey % 2 = 0 THEN '1981.' ELSE '1940.' END WHEN a > 100 THEN 'Una lluvia así es más rara que una vez cada 100 años.'
          WHEN a < 1.5 THEN 'Una lluvia así pasa casi todos los años.' WHEN b > 0 AND (b / a > 2 OR a / b > 2) THEN 'Una lluvia así pasa cada ' || lo || ' a ' || hi || ' años según la fuente.'
          ELSE 'Una lluvia así pasa cada ~' || own || ' años.' END AS sentence FROM y""",
    "crs_codes": """WITH q AS (SELECT c_custkey, c_acctbal / 60 - 60 AS lon, c_custkey % 140 - 70 + 0.25 AS lat FROM customer)
        SELECT c_custkey, CAST(CASE WHEN lon BETWEEN -74.5 AND -53.0 AND lat BETWEEN -55.5 AND -21.5 THEN 5342 + least(7, greatest(1, round_even((lon + 72) / 3, 0) + 1))
          ELSE CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6) + 1 END AS INT) AS epsg FROM q""",
    "degree_tiles": """WITH q AS (SELECT c_custkey, c_acctbal / 60 - 60 AS lon, CAST(c_custkey % 140 - 70 + 0.25 AS DOUBLE) AS lat FROM customer),
        y AS (SELECT *, unnest(range(CAST(floor(lat) AS BIGINT), CAST(floor(lat + 0.8) AS BIGINT) + 1)) AS y FROM q), x AS (SELECT *, unnest(range(CAST(floor(lon) AS BIGINT), CAST(floor(lon + 0.8) AS BIGINT) + 1)) AS x FROM y)
        SELECT c_custkey, CASE WHEN y < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(y) AS VARCHAR), 2, '0') || '_' || CASE WHEN x < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') AS tile FROM x""",
    "rain_pixels": """SELECT c_custkey, round(floor((c_acctbal / 60 - 60) / 0.05) * 0.05 + 0.025, 3) AS lon, round(floor(CAST(c_custkey % 140 - 70 + 0.25 AS DOUBLE) / 0.05) * 0.05 + 0.025, 3) AS lat FROM customer""",
    "nearest_line": """WITH p AS (SELECT c_custkey AS pid, c_acctbal / 100 AS px, CAST(c_custkey % 97 AS DOUBLE) AS py FROM customer),
        s AS (SELECT s_suppkey AS sid, s_acctbal / 100 AS ax, CAST(s_suppkey % 89 AS DOUBLE) AS ay FROM supplier),
        q AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * 7 + (py - ay) * 3) / 58.0)) AS t FROM p, s),
        r AS (SELECT *, sqrt(pow(px - (ax + t * 7), 2) + pow(py - (ay + t * 3), 2)) AS dist FROM q)
        SELECT pid, arg_min(sid, (dist, sid)) AS sid, round(min(dist), 6) AS dist FROM r GROUP BY pid""",
    "line_agreement": """WITH p AS (SELECT c_custkey AS pid, c_acctbal / 100 AS px, CAST(c_custkey % 97 AS DOUBLE) AS py FROM customer),
        s AS (SELECT s_suppkey AS sid, s_acctbal / 100 AS ax, CAST(s_suppkey % 89 AS DOUBLE) AS ay FROM supplier),
        q AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * 7 + (py - ay) * 3) / 58.0)) AS t FROM p, s),
        r AS (SELECT *, sqrt(pow(px - (ax + t * 7), 2) + pow(py - (ay + t * 3), 2)) AS dist FROM q),
        n AS (SELECT pid, round(min(dist), 6) AS dist FROM r GROUP BY pid)
        SELECT c_nationkey, round(quantile_cont(dist, 0.5), 8) AS median, round(quantile_cont(dist, 0.9), 8) AS p90, round(100 * avg(CAST(dist <= 4 AS INT)), 8) AS pct_within, count(*) AS n
        FROM n JOIN customer ON pid = c_custkey GROUP BY c_nationkey""",
    "profile_kinds": """WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice / 10000, 0.5) FILTER (WHERE abs((l_quantity - 25) * 8) BETWEEN 100 AND 200) AS bank,
          min(l_extendedprice / 10000) FILTER (WHERE abs((l_quantity - 25) * 8) <= 30) AS bed FROM lineitem GROUP BY l_suppkey), c AS (SELECT *, CASE WHEN bank IS NOT NULL AND bed IS NOT NULL THEN greatest((bank - bed) * 100, 0) END AS cm FROM q)
        SELECT l_suppkey, round(cm, 5) AS incision_cm, CASE WHEN l_suppkey % 90 <= 60 THEN 'stream' WHEN cm >= 50 THEN 'channel' ELSE 'swale' END AS kind FROM c""",
}
