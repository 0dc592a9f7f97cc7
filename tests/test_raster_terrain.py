"""Raster, terrain, rain and rule operators against NumPy and the pinned cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from torrentia.functions import scalars as S
from torrentia.operators import graph, rain, raster, rules, terrain


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def grid(spark, a, name="r"):
    rows = [(name, i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "raster string, row long, col long, value double")


def test_scalars(spark):
    v = lambda x: F.lit(x)
    r = one(spark, a=S.frame_code(v(1e-5)), b=S.frame_code(v(0.054)), c=S.frame_code(v(0.2)), d=S.frame_code(v(9.0)), e=S.class_of(v(0.5), S.HAND_CUTS), f=S.class_of(v(5.0), S.HAND_CUTS),
            g=S.decibel(v(-1.0)), h=S.certainty_class(v(30)), i=S.spanish_number(v(1234.50), 2), j=S.spanish_number(v(None).cast("double"), 1), k=S.compass8(v(1.0), v(1.0)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == (0, 5, 20, 255, 1, None, None, "posible", "1.234,5", "—", "NE")
    at = F.array(*map(F.lit, (25.0, 50.0, 75.0)))
    r = one(spark, n=S.neighbours(at, v(60.0)), s=S.snap(at, v(62.0)), lo=S.snap(at, v(10.0)), hi=S.snap(at, v(300.0)), odd=S.snap(F.array(*map(F.lit, (25.0, 100.0, 150.0))), v(115.0)),
            b=S.blend(F.array(v(0.0), v(10.0)), F.array(v(10.0), v(20.0)), v(0.25)))
    assert tuple(r.n) == (50.0, 75.0, 0.4) and (r.s, r.lo, r.hi, r.odd) == (60.0, 25.0, 75.0, 100.0) and r.b == [3, 13]
    r = one(spark, lat=S.rain_pixel_centre(v(-34.4038)), lon=S.rain_pixel_centre(v(-59.4205)), p=S.normal_cdf(v(0.4)), nan=S.finite(v(float("nan"))), crs=S.crs_code(v(-59.4), v(-34.4)), id=S.scenario_id(v(25.0), v(3.0), v(True)))
    assert (r.lat, r.lon, r.nan, r.crs, r.id) == (-34.425, -59.425, None, 5347, "P025_3h_sat") and abs(r.p - 0.6554) < 1e-4


@pytest.mark.parametrize("k", [3, 5])
def test_focal_mean_reflects(spark, k):
    rng = np.random.default_rng(k)
    a = rng.random((7, 6))
    a[2, 3] = np.nan
    p = np.pad(a, k // 2, mode="symmetric")
    want = np.array([[np.nanmean(p[i : i + k, j : j + k]) for j in range(6)] for i in range(7)])
    got = {(r.row, r.col): r.mean for r in raster.focal_mean(grid(spark, a), k).collect()}
    assert len(got) == 42 and all(abs(got[i, j] - want[i, j]) < 1e-12 for i in range(7) for j in range(6))


def test_certainty_of_a_block(spark):
    a = np.zeros((5, 5))
    a[1:4, 1:4] = 30
    df = grid(spark, a).withColumn("dem", F.lit("x"))
    got = {(r.row, r.col): r.certainty for r in raster.certainty(df, 5.0).collect()}
    assert (got[2, 2], got[1, 1], got[0, 0]) == (100, 44, 11)
    two = df.union(grid(spark, np.zeros((5, 5))).withColumn("dem", F.lit("y")))
    assert {(r.row, r.col): r.certainty for r in raster.certainty(two, 5.0).collect()}[2, 2] == 50


def test_otsu_and_its_guard(spark):
    rng = np.random.default_rng(0)

    def run(share, low):
        x = np.concatenate([rng.normal(low, 1, int(20000 * share)), rng.normal(-8, 1, int(20000 * (1 - share)))])
        df = spark.createDataFrame([("a", float(v)) for v in x], "k string, db double")
        return raster.otsu_guarded(df, ["k"], "db", -13.0, -18.0).first()

    good, wide, flat = run(0.05, -22), run(0.55, -20), run(0.0, -8)
    assert not good.is_fixed and -20 < good.threshold < -13
    assert wide.is_fixed and wide.threshold == -18 and flat.is_fixed


def test_zonal_policies_and_mode(spark):
    df = spark.createDataFrame([("z", 1.0), ("z", 3.0), ("z", None), ("z", 1.0)], "zone string, value double")
    r = raster.zonal_share(df, F.col("value") <= 1).first()
    assert r.of_all == 50 and abs(r.of_valid - 200 / 3) < 1e-9
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 5), ("a", 3), ("a", 9)], "k string, v int")
    assert raster.mode(df, ["k"], "v").first().v == 3


def surface(spark, n=12, seed=3):
    rng = np.random.default_rng(seed)
    z = rng.random((n, n)) + np.add.outer(np.arange(n), np.arange(n)) * 0.05
    rows = [(i * n + j, i, j, float(z[i, j]), 0) for i in range(n) for j in range(n)]
    return z, spark.createDataFrame(rows, "cell long, row long, col long, z double, tile long")


def brute_pointers(z):
    n, out = len(z), {}
    for i in range(n):
        for j in range(n):
            best = None
            for c, dr, dc in terrain.D8:
                y, x = i + dr, j + dc
                if 0 <= y < n and 0 <= x < n and z[y, x] < z[i, j]:
                    d = (z[i, j] - z[y, x]) / math.hypot(dr, dc)
                    if best is None or d > best[0] + 1e-15:
                        best = (d, y * n + x)
            out[i * n + j] = best and best[1]
    return out


def test_flow_against_brute_force(spark):
    z, cells = surface(spark)
    p = terrain.d8_pointer(cells)
    want = brute_pointers(z)
    assert {r.cell: r.next for r in p.collect()} == want
    area = {c: 0 for c in want}
    for c in want:
        at = c
        while at is not None:
            area[at] += 1
            at = want[at]
    got = {r.cell: r.area for r in terrain.flow_accumulation(p).collect()}
    assert got == area
    stops = {c for c, a in area.items() if a >= 6}
    s = spark.createDataFrame([(c,) for c in stops], "cell long")
    hands = {r.cell: r.hand for r in terrain.hand(cells, p, s).collect()}
    for c in want:
        at = c
        while at is not None and at not in stops:
            at = want[at]
        assert (hands[c] is None) == (at is None) and (at is None or abs(hands[c] - (z.flat[c] - z.flat[at])) < 1e-12)


def test_fill_leaves_no_pit_and_depressions_are_whole(spark):
    z, cells = surface(spark, seed=5)
    filled = terrain.fill(cells)
    f = np.empty_like(z)
    for r in filled.collect():
        f[r.row, r.col] = r.filled
    assert (f >= z - 1e-12).all()
    for i in range(1, 11):
        for j in range(1, 11):
            assert min(f[i + dr, j + dc] for _, dr, dc in terrain.D8) <= f[i, j]
    assert abs(sum(r.volume for r in terrain.depressions(filled).collect()) - (f - z).sum()) < 1e-9


def test_dinf_follows_a_plane_and_keeps_area(spark):
    n = 9
    rows = [(i * n + j, i, j, 2.0 * i - 1.0 * j + 20, 0) for i in range(n) for j in range(n)]  # falls towards north-north-east
    cells = spark.createDataFrame(rows, "cell long, row long, col long, z double, tile long")
    p = terrain.dinf_pointer(cells)
    inner = [r for r in p.collect() if 0 < r.cell // n < n - 1 and 0 < r.cell % n < n - 1]
    assert all(abs(r.angle - math.atan2(2, 1)) < 1e-9 and abs(r.slope - 5**0.5) < 1e-9 for r in inner)
    area = {r.cell: r.area for r in terrain.dinf_accumulation(cells, p).collect()}
    assert all(a >= 1 for a in area.values()) and area[n - 1] > area[(n - 1) * n]


def test_breach_lets_every_cell_drain(spark):
    z, cells = surface(spark, seed=6)
    out = terrain.breach(cells).collect()
    b = np.empty_like(z)
    for r in out:
        b[r.row, r.col] = r.breached
    assert (b <= z + 1e-12).all() and (b < z).any()
    for i in range(1, 11):
        for j in range(1, 11):
            assert min(b[i + dr, j + dc] for _, dr, dc in terrain.D8) <= b[i, j]


def test_fingerprints_and_stale_runs(spark):
    grid = spark.createDataFrame([("P025_3h", 5.0), ("P050_3h", 5.0)], "scenario string, ks double")
    now = rain.fingerprint(grid, ["scenario", "ks"])
    assert rain.to_run(now, now).count() == 0 and all(len(r.print) == 12 for r in now.collect())
    changed = rain.fingerprint(grid.withColumn("ks", F.when(F.col("scenario") == "P025_3h", 6.0).otherwise(5.0)), ["scenario", "ks"])
    assert [r.scenario for r in rain.to_run(changed, now).collect()] == ["P025_3h"]
    assert [r.scenario for r in rain.stale(now, grid.where("ks = 5 and scenario = 'P050_3h'")).collect()] == ["P025_3h"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}


@pytest.mark.parametrize(("p", "dur"), [(25, 3), (100, 24), (250, 72)])
def test_hyetograph_sums_to_the_storm(spark, p, dur):
    df = spark.createDataFrame([(1, float(p), float(dur))], "k long, p_mm double, dur_h double")
    rows = rain.hyetograph(df, "k").orderBy("k").collect()
    n = 18 if dur == 3 else dur
    assert sorted(r[1] for r in rows) == list(range(n)) and abs(sum(r.mm for r in rows) - p) < 1e-9
    assert max(rows, key=lambda r: r.mm)[1] == n // 2


def test_verdict(spark):
    rows = [("p", "hand_min_m", 0.4), ("p", "cuenca_aportante_ha", 7.0), ("p", "depresion_prof_max_m", None), ("p", "jrc_occ_lote_pct", 0.0)]
    got = {r.component: r for r in rules.verdict(spark.createDataFrame(rows, "k string, indicator string, value double"), rules.rule_table(spark), "k").collect()}
    assert got["desborde"].level == "ALTO" and got["lluvia_local"].level == "MEDIO" and got["lluvia_local"].missing == "depresion_prof_max_m"
    assert got["desborde"].reasons == "hand_min_m" and {r.overall for r in got.values()} == {"ALTO"}
