"""Terrain, rain-scenario and verdict queries: parts laid out on a tilted grid stand for elevation cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentia.operators import rain, rules, terrain
from torrentia.scratch import large

WIDTH, TILE = 40, 20


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cells(spark, d):
    """cell, row, col, z, tile: the part's price roughens a plane that falls towards row 0, column 0."""
    p = _table(spark, d, "part")
    row, col = F.expr(f"(p_partkey - 1) div {WIDTH}"), (F.col("p_partkey") - 1) % WIDTH
    z = F.round(F.col("p_retailprice") / 1000 + row * 0.05 + col * 0.04 + F.col("p_size") * 0.01, 6)
    return p.select(F.col("p_partkey").alias("cell"), row.alias("row"), col.alias("col"), z.alias("z")).withColumn("tile", F.expr(f"(row div {TILE}) * 1000 + col div {TILE}"))


def _coarse(spark, d):
    """Whole heights, so that there are flats."""
    return _cells(spark, d).withColumn("z", F.floor(F.col("z") * 4).cast("double"))


def d8_pointer(spark, d):
    return terrain.d8_pointer(_cells(spark, d)).select("cell", "next", "code", F.round("length", 6).alias("length"))


def flow_accumulation(spark, d):
    return terrain.flow_accumulation(terrain.d8_pointer(_cells(spark, d)))


def _streams(pointers):
    return terrain.streams(terrain.flow_accumulation(pointers), 12.0)


def stream_cells(spark, d):
    return _streams(terrain.d8_pointer(_cells(spark, d)))


def hand(spark, d):
    cells = _cells(spark, d)
    p = terrain.d8_pointer(cells)
    return terrain.hand(cells, p, _streams(p)).select("cell", F.round("hand", 6).alias("hand"), F.round("way", 6).alias("way"))


def watershed(spark, d):
    """Cells draining through the parts of the largest size."""
    p = _table(spark, d, "part")
    return terrain.watershed(terrain.d8_pointer(_cells(spark, d)), p.where("p_size >= 45").select(F.col("p_partkey").alias("cell")))


def terrain_gradients(spark, d):
    g = terrain.gradients(_cells(spark, d))
    return g.select("cell", *[F.round(c, 6).alias(c) for c in ("slope", "aspect", "shade")])


def wetness_index(spark, d):
    """From the area that D-infinity brings."""
    cells = _cells(spark, d)
    area = terrain.dinf_accumulation(cells, terrain.dinf_pointer(cells)).withColumnRenamed("cell", "c")
    return large(terrain.gradients(cells)).join(area, F.col("cell") == F.col("c")).select("cell", F.round(terrain.wetness(F.col("area"), F.col("slope")), 5).alias("twi"))


def fill_depressions(spark, d):
    return terrain.fill(_cells(spark, d)).select("cell", F.round("filled", 6).alias("filled"))


def depressions(spark, d):
    """Those that touch the parts of size 20 and more; the lot is the parts of size 45 and more."""
    p = _table(spark, d, "part")
    zone = lambda least: p.where(F.col("p_size") >= least).select(F.col("p_partkey").alias("cell"))
    x = terrain.depressions(terrain.fill(_cells(spark, d)), area=zone(20), lot=zone(45))
    return x.select("label", "n_cells", *[F.round(c, 6).alias(c) for c in ("area", "volume", "deepest", "mean")], "touches_lot")


def conditioned_pointer(spark, d):
    p = terrain.drainage(terrain.fill(_coarse(spark, d)))
    return p.select("cell", "next", "code", F.round("length", 6).alias("length"))


def conditioned_hand(spark, d):
    """Drainage height over the filled surface, from streams of the flow over it."""
    filled = terrain.fill(_coarse(spark, d))
    p = terrain.drainage(filled)
    h = terrain.hand(filled.select("cell", F.col("filled").alias("z")), p, _streams(p))
    return h.select("cell", F.round("hand", 6).alias("hand"), F.round("way", 6).alias("way"))


def flow_paths(spark, d):
    """The ways down from parts of size 49 and more."""
    starts = _table(spark, d, "part").where("p_size >= 49").select(F.col("p_partkey").alias("start"))
    return terrain.flow_paths(terrain.d8_pointer(_cells(spark, d)), starts)


def _levels(spark, d):
    return _table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5.0).alias("p_mm"))


def scenario_grid(spark, d):
    hours = spark.createDataFrame([(3.0,), (24.0,), (72.0,)], "dur_h double")
    soils = spark.createDataFrame([("normal", 5.0), ("saturado", 0.5)], "soil string, ks_mm_h double")
    return rain.scenario_grid(_levels(spark, d), hours, soils).select("p_partkey", "scenario", "p_mm", "dur_h", "soil", "ks_mm_h", F.round("dt_h", 6).alias("dt_h"), "t_end_h", "shape")


def _storms(spark, d):
    hours = F.element_at(F.array(F.lit(3.0), F.lit(24.0), F.lit(72.0)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _levels(spark, d).withColumn("dur_h", hours)


def scenario_hyetograph(spark, d):
    return rain.hyetograph(_storms(spark, d), "p_partkey").select("p_partkey", "k", F.round("mm", 6).alias("mm"))


def greenampt_point(spark, d):
    out = rain.point_infiltration(rain.hyetograph(_storms(spark, d), "p_partkey"), "p_partkey", 5.0)
    return out.select("p_partkey", F.round("infiltrated", 4).alias("infiltrated"), F.round("left_over", 4).alias("left_over"))


def dinf_pointer(spark, d):
    return terrain.dinf_pointer(_cells(spark, d)).select("cell", F.round("angle", 6).alias("angle"), F.round("slope", 6).alias("slope"))


def dinf_accumulation(spark, d):
    cells = _cells(spark, d)
    return terrain.dinf_accumulation(cells, terrain.dinf_pointer(cells)).withColumn("area", F.round("area", 5))


def breach_depressions(spark, d):
    """Ditches of six cells at most."""
    return terrain.breach(_cells(spark, d), 6).select("cell", F.round("breached", 6).alias("breached"))


def scenario_fingerprints(spark, d):
    """Runs still to do: parts' scenarios whose stored run (of orders' numbers) has another soil constant."""
    grid = scenario_grid(spark, d).select("scenario", "p_mm", "dur_h", "soil").distinct().withColumn("ks", F.when(F.col("soil") == "normal", "5").otherwise("0.5"))
    now = rain.fingerprint(grid, ["scenario", "ks"], 2)
    before = rain.fingerprint(grid.withColumn("ks", F.when(F.col("p_mm") > 100, "5").otherwise(F.col("ks"))), ["scenario", "ks"], 2)
    return rain.to_run(now, before).select("scenario", "print")


def stale_runs(spark, d):
    """Stored runs named by line quantities that the parts' grid doesn't have."""
    stored = _table(spark, d, "lineitem").select(rain.scenario_id(F.col("l_quantity") * 6, F.lit(24.0), F.col("l_returnflag") == "R").alias("scenario")).distinct()
    return rain.stale(stored, scenario_grid(spark, d))


def ensemble_runs(spark, d):
    chosen = _table(spark, d, "lineitem").select(rain.scenario_id(F.col("l_quantity") * 5, F.lit(3.0), F.lit(False)).alias("scenario")).distinct()
    dems = _table(spark, d, "region").select(F.col("r_name").alias("dem"), F.when(F.col("r_regionkey") % 2 == 0, "g0").otherwise("g1").alias("grid"))
    return rain.ensemble(chosen, scenario_grid(spark, d), dems, "g0").select("run", "scenario", "dem")


def _indicators(spark, d):
    """A nation's nine indicators from its customers and suppliers; those that its suppliers lack are missing."""
    c = _table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"), F.max("c_acctbal").alias("m"), F.min("c_acctbal").alias("l"), F.count(F.lit(1)).alias("n"))
    s = _table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("j")).agg(F.max("s_acctbal").alias("sm"), F.count(F.lit(1)).alias("sn"))
    x = c.join(s, F.col("k") == F.col("j"), "left")
    of = {
        "depresion_prof_max_m": "a / 20000", "cuenca_aportante_ha": "m / 200", "hmax_lote_100mm_cm": "sm / 500", "pct_lote_gt5cm_100mm": "sm / 180", "hand_min_m": "(l + 1000) / 40",
        "jrc_occ_lote_pct": "if(sn > 3, sn / 1000, 0)", "sar_agua_lote_pct_max": "sn", "sar_agua_aoi_pct_max": "n / 7", "pct_aoi_gt20cm_150mm": "a / 450",
    }
    cols = F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.expr(e).cast("double").alias("value")) for i, e in of.items()])).alias("i")
    return x.select("k", cols).select("k", "i.indicator", "i.value")


def indicator_rules_verdict(spark, d):
    return rules.verdict(_indicators(spark, d), rules.rule_table(spark), "k")


def verdict_missing_inputs(spark, d):
    """The same with each nation's indicators of one kind withheld."""
    held = _indicators(spark, d).withColumn("value", F.when(F.pmod(F.length("indicator") + F.col("k"), F.lit(3)) != 0, F.col("value")))
    return rules.verdict(held, rules.rule_table(spark), "k").select("k", "component", "level", "missing")


QUERIES = {f.__name__: f for f in (
    d8_pointer, flow_accumulation, stream_cells, hand, watershed, terrain_gradients, wetness_index, fill_depressions, depressions, conditioned_pointer, conditioned_hand, flow_paths, scenario_grid, scenario_hyetograph,
    greenampt_point, dinf_pointer, dinf_accumulation, breach_depressions, scenario_fingerprints, stale_runs, ensemble_runs, indicator_rules_verdict, verdict_missing_inputs,
)}

CELLS = f"""c AS (SELECT p_partkey AS cell, (p_partkey - 1) // {WIDTH} AS row, (p_partkey - 1) % {WIDTH} AS col,
  round(p_retailprice / 1000 + ((p_partkey - 1) // {WIDTH}) * CAST(0.05 AS DOUBLE) + ((p_partkey - 1) % {WIDTH}) * CAST(0.04 AS DOUBLE) + p_size * CAST(0.01 AS DOUBLE), 6) AS z FROM part),
st(code, dr, dc) AS (VALUES {", ".join(map(str, terrain.D8))}),
nb AS (SELECT a.cell, a.z, b.cell AS n_cell, b.z AS n_z, code, dr, dc, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2) ELSE 1.0 END AS length FROM c a CROSS JOIN st JOIN c b ON b.row = a.row + dr AND b.col = a.col + dc),
bp AS (SELECT cell, arg_max(n_cell, ((z - n_z) / length, -code)) AS next, arg_max(code, ((z - n_z) / length, -code)) AS code, arg_max(length, ((z - n_z) / length, -code)) AS length FROM nb WHERE n_z < z GROUP BY cell),
p AS (SELECT c.cell, next, code, length FROM c LEFT JOIN bp USING (cell))"""
# every cell with each cell on its way down
WAYS = """wy(cell, pos, way) AS (SELECT cell, cell, CAST(0 AS DOUBLE) FROM c UNION ALL SELECT wy.cell, p.next, way + p.length FROM wy JOIN p ON p.cell = wy.pos WHERE p.next IS NOT NULL),
ac AS (SELECT pos AS cell, CAST(count(*) AS DOUBLE) AS area FROM wy GROUP BY pos)"""
GRAD = """gr AS (SELECT cell, sum(dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END * n_z) / 8 AS gx, sum(dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END * n_z) / 8 AS gy FROM nb GROUP BY cell HAVING count(*) = 8)"""
LX, LY, LZ = "sin(radians(315)) * cos(radians(35))", "cos(radians(315)) * cos(radians(35))", "sin(radians(35))"


DINF = f"""a AS (SELECT cell, z, {", ".join(f"max(n_z) FILTER (WHERE code = {c}) AS z{c}" for c, _, _ in terrain.D8)} FROM nb GROUP BY ALL),
f(k, sd, co, sg, tn) AS (VALUES (0, 2, 1, 1, 0), (1, 128, 1, -1, 1), (2, 128, 64, 1, 1), (3, 32, 64, -1, 2), (4, 32, 16, 1, 2), (5, 8, 16, -1, 3), (6, 8, 4, 1, 3), (7, 2, 4, -1, 4)),
l AS (SELECT cell, code, n_z FROM nb), j AS (SELECT a.cell, a.z, k, sg, tn, s.n_z AS e1, d.n_z AS e2 FROM a CROSS JOIN f JOIN l s ON s.cell = a.cell AND s.code = sd JOIN l d ON d.cell = a.cell AND d.code = co),
r AS (SELECT *, atan2(e1 - e2, z - e1) AS r FROM j),
q AS (SELECT cell, k, CASE WHEN r < 0 THEN z - e1 WHEN r > pi() / 4 THEN (z - e2) / sqrt(2) ELSE sqrt(pow(z - e1, 2) + pow(e1 - e2, 2)) END AS slope, least(greatest(r, 0), pi() / 4) * sg + tn * pi() / 2 AS angle FROM r),
b AS (SELECT cell, arg_max(angle, (slope, -k)) AS angle, max(slope) AS slope FROM q WHERE slope > 0 GROUP BY cell),
dp AS (SELECT a.cell, fmod(angle, 2 * pi()) AS angle, slope FROM a LEFT JOIN b USING (cell))"""
# area passed on step by step, summed at each step
SPREAD = """sh AS (SELECT dp.cell, CAST(floor(angle / (pi() / 4)) AS INT) AS k, angle / (pi() / 4) - floor(angle / (pi() / 4)) AS part FROM dp WHERE angle IS NOT NULL),
sx AS (SELECT cell, k % 8 AS k, 1 - part AS share FROM sh UNION ALL SELECT cell, (k + 1) % 8, part FROM sh),
se AS (SELECT sx.cell, n_cell, share FROM sx JOIN nb ON nb.cell = sx.cell AND nb.code = [2, 1, 128, 64, 32, 16, 8, 4][k + 1] WHERE share > 0),
sp AS (SELECT 0 AS i, cell, CAST(1 AS DOUBLE) AS area FROM c UNION ALL SELECT i + 1, n_cell, sum(area * share) FROM sp JOIN se ON se.cell = sp.cell GROUP BY i, n_cell)"""
# heights come down from above until they rest, a step a round
FILL = """bd AS (SELECT c.cell FROM c LEFT JOIN (SELECT cell FROM nb GROUP BY cell HAVING count(*) = 8) i USING (cell) WHERE i.cell IS NULL),
nx AS (SELECT cell, n_cell FROM nb UNION ALL SELECT cell, cell FROM c),
fr AS (SELECT 0 AS i, cell, CASE WHEN cell IN (SELECT cell FROM bd) THEN z ELSE 1e9 END AS f FROM c
  UNION ALL SELECT i + 1, nx.cell, greatest(min(fr.f), any_value(c.z)) FROM fr JOIN nx ON nx.n_cell = fr.cell JOIN c ON c.cell = nx.cell WHERE i < 150 GROUP BY i, nx.cell),
fl AS (SELECT cell, f FROM fr WHERE i = 150)"""
COARSE = CELLS.replace("p_size * CAST(0.01 AS DOUBLE), 6) AS z FROM part)", "p_size * CAST(0.01 AS DOUBLE), 6) AS z0, CAST(floor(z0 * 4) AS DOUBLE) AS z FROM part)")
FLATS = """fn AS (SELECT nb.cell, n_cell, code, length, x.f AS z, y.f AS n_z FROM nb JOIN fl x ON x.cell = nb.cell JOIN fl y ON y.cell = n_cell),
fd AS (SELECT cell, arg_max(n_cell, ((z - n_z) / length, -code)) AS next, arg_max(code, ((z - n_z) / length, -code)) AS code, arg_max(length, ((z - n_z) / length, -code)) AS length FROM fn WHERE n_z < z GROUP BY cell),
fo AS (SELECT cell, 0 AS d FROM c WHERE cell IN (SELECT cell FROM fd) OR cell IN (SELECT cell FROM bd)),
fw AS (SELECT * FROM fo UNION SELECT fn.cell, d + 1 FROM fw JOIN fn ON fn.n_cell = fw.cell AND fn.z = fn.n_z WHERE d < 40 AND fn.cell NOT IN (SELECT cell FROM fo)),
fk AS (SELECT cell, min(d) AS d FROM fw GROUP BY cell),
fm AS (SELECT fn.cell, arg_min(n_cell, code) AS next, min(code) AS code, arg_min(length, code) AS length FROM fn JOIN fk a ON a.cell = fn.cell JOIN fk b ON b.cell = n_cell WHERE a.d > 0 AND b.d = a.d - 1 AND z = n_z GROUP BY fn.cell),
cp AS (SELECT c.cell, coalesce(fd.next, fm.next) AS next, coalesce(fd.code, fm.code) AS code, coalesce(fd.length, fm.length) AS length FROM c LEFT JOIN fd USING (cell) LEFT JOIN fm USING (cell))"""


def _curve(knots) -> str:
    out = f"CASE WHEN x < {knots[0][0]!r} - 1e-12 THEN {knots[0][1]} * f1 / {knots[0][0]!r} WHEN x <= {knots[0][0]!r} + 1e-12 THEN {knots[0][1]}"
    for (a, ra), (b, rb) in zip(knots, knots[1:], strict=False):
        out += f" WHEN x <= {b!r} + 1e-12 THEN {ra} + (x - {a!r}) * (({rb} - {ra}) / ({b!r} - {a!r}))"
    return out + " ELSE 1.0 END"


HYETO = f"""s AS (SELECT p_partkey, p_size * 5.0 AS p_mm, [3.0, 24.0, 72.0][p_partkey % 3 + 1] AS dur FROM part),
i AS (SELECT *, CAST(unnest(range(1, CAST(round(dur / dt) AS BIGINT) + 1)) AS DOUBLE) AS i FROM (SELECT *, CASE WHEN dur >= 6 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / 6 END AS dt FROM s)),
x AS (SELECT *, i * dt / dur AS x, dt / dur AS f1, CAST(round(dur / dt) AS BIGINT) AS n FROM i),
cu AS (SELECT *, CAST(CASE WHEN dur > 3 THEN {_curve(rain.LONG)} ELSE {_curve(rain.SHORT)} END AS DOUBLE) * p_mm AS cum FROM x),
tp AS (SELECT *, max(cum) OVER (PARTITION BY p_partkey ORDER BY i) AS top FROM cu),
inc AS (SELECT *, top - coalesce(lag(top) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS inc FROM tp),
rk AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY inc DESC, i) - 1 AS r FROM inc),
hy AS (SELECT p_partkey, CAST(n // 2 + CASE WHEN r % 2 = 1 THEN -((r + 1) // 2) ELSE r // 2 END AS INT) AS k, inc AS mm, dt FROM rk)"""
IND = """cu AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS a, max(c_acctbal) AS m, min(c_acctbal) AS l, count(*) AS n FROM customer GROUP BY ALL),
su AS (SELECT s_nationkey AS k, max(s_acctbal) AS sm, count(*) AS sn FROM supplier GROUP BY ALL), j AS (SELECT * FROM cu LEFT JOIN su USING (k)),
ind AS (SELECT k, unnest(['depresion_prof_max_m', 'cuenca_aportante_ha', 'hmax_lote_100mm_cm', 'pct_lote_gt5cm_100mm', 'hand_min_m', 'jrc_occ_lote_pct', 'sar_agua_lote_pct_max', 'sar_agua_aoi_pct_max', 'pct_aoi_gt20cm_150mm']) AS indicator,
  unnest([a / 20000, m / 200, sm / 500, sm / 180, (l + 1000) / 40, CASE WHEN sn > 3 THEN sn / 1000 ELSE 0 END, CAST(sn AS DOUBLE), n / 7, a / 450]) AS value FROM j)"""
RULE_ROWS = ", ".join(f"('{c}', '{i}', '{d}', {rules.LEVELS.index(n)}, {float(t)})" for c, i, d, steps in rules.RULES for n, t in steps.items())
NAMES = "['" + "', '".join(rules.LEVELS) + "']"


def _verdict(src: str) -> str:
    return f"""ru(component, indicator, dir, rank, threshold) AS (VALUES {RULE_ROWS}),
    ht AS (SELECT k, component, indicator, max(rank) FILTER (WHERE CASE WHEN dir = 'ge' THEN value >= threshold ELSE value < threshold END) AS rank, bool_or(value IS NULL) AS gone FROM {src} JOIN ru USING (indicator) GROUP BY ALL),
    pr AS (SELECT k, component, coalesce(max(rank), 0) AS rank, coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (WHERE rank > 0), '') AS reasons,
      coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (WHERE gone), '') AS missing FROM ht GROUP BY ALL)"""


# ways from each pit in layers of steps, each with its cheapest predecessor; then back along them from the best end
BREACH = f"""{CELLS}, i8 AS (SELECT cell, z, min(n_z) AS low FROM nb GROUP BY cell, z HAVING count(*) = 8), pt AS (SELECT cell AS pit, z AS flr FROM i8 WHERE low >= z),
ly AS (SELECT 0 AS k, pit, flr, pit AS cell, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS BIGINT) AS back, false AS done FROM pt
  UNION ALL SELECT k + 1, pit, flr, n_cell, min(cost + greatest(0, n_z - flr)), arg_min(ly.cell, (cost + greatest(0, n_z - flr), ly.cell)), any_value(n_z < flr OR n_cell NOT IN (SELECT cell FROM i8)) FROM ly JOIN nb ON nb.cell = ly.cell WHERE k < 6 AND NOT done GROUP BY k, pit, flr, n_cell),
be AS (SELECT pit, flr, arg_min(k, (cost, k, cell)) AS k, arg_min(cell, (cost, k, cell)) AS cell FROM ly WHERE done GROUP BY pit, flr),
wb AS (SELECT k, pit, flr, cell FROM be UNION ALL SELECT wb.k - 1, wb.pit, wb.flr, ly.back FROM wb JOIN ly ON ly.k = wb.k AND ly.pit = wb.pit AND ly.cell = wb.cell WHERE wb.k > 0)"""

SQL = {
    "breach_depressions": f"WITH RECURSIVE {BREACH}, dg AS (SELECT cell, min(flr) AS flr FROM wb GROUP BY cell) SELECT c.cell, round(least(z, coalesce(flr, z)), 6) AS breached FROM c LEFT JOIN dg USING (cell)",
    "d8_pointer": f"WITH {CELLS} SELECT cell, next, CAST(code AS INT) AS code, round(length, 6) AS length FROM p",
    "flow_accumulation": f"WITH RECURSIVE {CELLS}, {WAYS} SELECT cell, area FROM ac",
    "stream_cells": f"WITH RECURSIVE {CELLS}, {WAYS} SELECT cell FROM ac WHERE area >= 12",
    "hand": f"""WITH RECURSIVE {CELLS}, {WAYS}, f AS (SELECT wy.cell, arg_min(pos, way) AS stop, min(way) AS way FROM wy JOIN ac ON ac.cell = wy.pos WHERE area >= 12 GROUP BY ALL)
        SELECT c.cell, round(c.z - s.z, 6) AS hand, round(way, 6) AS way FROM c LEFT JOIN f ON c.cell = f.cell LEFT JOIN c s ON s.cell = f.stop""",
    "watershed": f"WITH RECURSIVE {CELLS}, {WAYS} SELECT wy.cell, arg_min(pos, way) AS outlet FROM wy JOIN part ON p_partkey = pos WHERE p_size >= 45 GROUP BY ALL",
    "terrain_gradients": f"""WITH {CELLS}, {GRAD} SELECT cell, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round(fmod(degrees(atan2(-gx, gy)) + 360, 360.0), 6) AS aspect,
        round(greatest(0.0, (-gx * 8 * {LX} + gy * 8 * {LY} + {LZ}) / sqrt(64 * gx * gx + 64 * gy * gy + 1)), 6) AS shade FROM gr""",
    "wetness_index": f"""WITH RECURSIVE {CELLS}, {DINF}, {SPREAD}, {GRAD}, ac AS (SELECT cell, sum(area) AS area FROM sp GROUP BY cell)
        SELECT cell, round(ln(area / tan(radians(greatest(degrees(atan(sqrt(gx * gx + gy * gy))), 0.01)))), 5) AS twi FROM gr JOIN ac USING (cell)""",
    "scenario_grid": """SELECT p_partkey, printf('P%03d_%dh', CAST(p_size * 5 AS INT), CAST(d AS INT)) || CASE WHEN s = 'saturado' THEN '_sat' ELSE '' END AS scenario, CAST(p_size * 5 AS DOUBLE) AS p_mm, CAST(d AS DOUBLE) AS dur_h, s AS soil,
        CASE WHEN s = 'saturado' THEN CAST(0.5 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS ks_mm_h, CASE WHEN d >= 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0.166667 AS DOUBLE) END AS dt_h, CAST(d + 24 AS DOUBLE) AS t_end_h,
        CASE WHEN d > 3 THEN 'long' ELSE 'short' END AS shape FROM part, (SELECT unnest([3, 24, 72]) AS d) x, (SELECT unnest(['normal', 'saturado']) AS s) y""",
    "scenario_hyetograph": f"WITH {HYETO} SELECT p_partkey, k, round(mm, 6) AS mm FROM hy",
    "greenampt_point": f"""WITH RECURSIVE {HYETO}, g(p_partkey, k, f, h) AS (SELECT DISTINCT p_partkey, -1, CAST(0.1 AS DOUBLE), CAST(0 AS DOUBLE) FROM hy UNION ALL
        SELECT g.p_partkey, hy.k, f + least(5.0 * (1 + 0.22 * 1000 * 0.3 / f) * dt, h + mm), h + mm - least(5.0 * (1 + 0.22 * 1000 * 0.3 / f) * dt, h + mm) FROM g JOIN hy ON hy.p_partkey = g.p_partkey AND hy.k = g.k + 1)
        SELECT p_partkey, round(arg_max(f, k) - 0.1, 4) AS infiltrated, round(arg_max(h, k), 4) AS left_over FROM g GROUP BY p_partkey""",
    "dinf_pointer": f"WITH {CELLS}, {DINF} SELECT cell, round(angle, 6) AS angle, round(slope, 6) AS slope FROM dp",
    "dinf_accumulation": f"WITH RECURSIVE {CELLS}, {DINF}, {SPREAD} SELECT cell, round(sum(area), 5) AS area FROM sp GROUP BY cell",
    "fill_depressions": f"WITH RECURSIVE {CELLS}, {FILL} SELECT cell, round(f, 6) AS filled FROM fl",
    "depressions": f"""WITH RECURSIVE {CELLS}, {FILL}, sk AS (SELECT fl.cell, f - z AS depth FROM fl JOIN c USING (cell) WHERE f > z),
        ed AS (SELECT nb.cell AS a, n_cell AS b FROM nb JOIN sk s ON s.cell = nb.cell JOIN sk t ON t.cell = n_cell WHERE dr = 0 OR dc = 0),
        re AS (SELECT cell, cell AS label FROM sk UNION SELECT b, label FROM re JOIN ed ON a = cell), lb AS (SELECT cell, min(label) AS label FROM re GROUP BY cell)
        SELECT label, count(*) AS n_cells, CAST(count(*) AS DOUBLE) AS area, round(sum(depth), 6) AS volume, round(max(depth), 6) AS deepest, round(avg(depth), 6) AS mean, bool_or(p_size >= 45) AS touches_lot
        FROM lb JOIN sk USING (cell) JOIN part ON p_partkey = cell GROUP BY label HAVING bool_or(p_size >= 20)""",
    "conditioned_pointer": f"WITH RECURSIVE {COARSE}, {FILL}, {FLATS} SELECT cell, next, CAST(code AS INT) AS code, round(length, 6) AS length FROM cp",
    "conditioned_hand": f"""WITH RECURSIVE {COARSE}, {FILL}, {FLATS}, {WAYS.replace("JOIN p ON p.cell", "JOIN cp p ON p.cell")}, fst AS (SELECT wy.cell, arg_min(pos, way) AS stop, min(way) AS way FROM wy JOIN ac ON ac.cell = wy.pos WHERE area >= 12 GROUP BY ALL)
        SELECT c.cell, round(a.f - s.f, 6) AS hand, round(way, 6) AS way FROM c JOIN fl a USING (cell) LEFT JOIN fst ON c.cell = fst.cell LEFT JOIN fl s ON s.cell = fst.stop""",
    "flow_paths": f"WITH RECURSIVE {CELLS}, w AS (SELECT p_partkey AS start, CAST(0 AS BIGINT) AS step, p_partkey AS cell FROM part WHERE p_size >= 49 UNION ALL SELECT start, step + 1, p.next FROM w JOIN p ON p.cell = w.cell WHERE p.next IS NOT NULL) SELECT * FROM w",
    "scenario_fingerprints": """WITH g AS (SELECT DISTINCT printf('P%03d_%dh', CAST(p_size * 5 AS INT), CAST(d AS INT)) || CASE WHEN s = 'saturado' THEN '_sat' ELSE '' END AS scenario, p_size * 5 AS p, s AS soil
          FROM part, (SELECT unnest([3, 24, 72]) AS d) x, (SELECT unnest(['normal', 'saturado']) AS s) y)
        SELECT scenario, substr(sha1('2|' || scenario || '|0.5'), 1, 12) AS print FROM g WHERE soil = 'saturado' AND p > 100""",
    "stale_runs": """WITH s AS (SELECT DISTINCT printf('P%03d_24h', CAST(l_quantity * 6 AS INT)) || CASE WHEN l_returnflag = 'R' THEN '_sat' ELSE '' END AS scenario FROM lineitem)
        SELECT scenario FROM s WHERE scenario NOT IN (SELECT printf('P%03d_24h', CAST(p_size * 5 AS INT)) || x FROM part, (SELECT unnest(['', '_sat']) AS x) y)""",
    "ensemble_runs": """WITH s AS (SELECT DISTINCT printf('P%03d_3h', CAST(l_quantity * 5 AS INT)) AS scenario FROM lineitem)
        SELECT scenario || '__' || r_name AS run, scenario, r_name AS dem FROM s, region WHERE r_regionkey % 2 = 0 AND scenario IN (SELECT printf('P%03d_3h', CAST(p_size * 5 AS INT)) FROM part)""",
    "indicator_rules_verdict": f"WITH {IND}, {_verdict('ind')} SELECT k, component, {NAMES}[rank + 1] AS level, reasons, missing, {NAMES}[max(rank) OVER (PARTITION BY k) + 1] AS overall FROM pr",
    "verdict_missing_inputs": f"""WITH {IND}, held AS (SELECT k, indicator, CASE WHEN (length(indicator) + k) % 3 <> 0 THEN value END AS value FROM ind), {_verdict("held")}
        SELECT k, component, {NAMES}[rank + 1] AS level, missing FROM pr""",
}
