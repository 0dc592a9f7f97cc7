"""Filling, flats, spreading and paths over whole rasters against brute force."""

import heapq
import math

import numpy as np
import pytest

from torrentia.operators import graph, raster, terrain

STEPS = [(dr, dc) for _, dr, dc in terrain.D8]


def surface(spark, seed, n=18, m=13, levels=None, holes=0):
    rnd = np.random.default_rng(seed)
    z = rnd.random((n, m)) * 4 + np.add.outer(np.arange(n), np.arange(m)) * 0.05
    if levels:
        z = np.floor(z * levels)
    for _ in range(holes):
        z[rnd.integers(n), rnd.integers(m)] = np.nan
    rows = [(i * m + j, i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(n) for j in range(m)]
    return z, spark.createDataFrame(rows, "cell long, row long, col long, z double")


def flooded(z):
    n, m = z.shape
    inside = lambda i, j: 0 <= i < n and 0 <= j < m and not np.isnan(z[i, j])
    out, queue, seen = z.copy(), [], np.isnan(z)
    for i in range(n):
        for j in range(m):
            if inside(i, j) and not all(inside(i + a, j + b) for a, b in STEPS):
                heapq.heappush(queue, (z[i, j], i, j))
                seen[i, j] = True
    while queue:
        h, i, j = heapq.heappop(queue)
        for a, b in STEPS:
            if inside(i + a, j + b) and not seen[i + a, j + b]:
                seen[i + a, j + b] = True
                out[i + a, j + b] = max(h, z[i + a, j + b])
                heapq.heappush(queue, (out[i + a, j + b], i + a, j + b))
    return out


@pytest.mark.parametrize(("seed", "levels", "holes", "reach"), [(4, None, 0, 50), (5, 2, 5, 50), (6, None, 0, 2)])
def test_breaching_digs_the_cheapest_ditches_whatever_the_tiles(spark, seed, levels, holes, reach):
    z, cells = surface(spark, seed, levels=levels, holes=holes)
    n, m = z.shape
    inside = lambda i, j: 0 <= i < n and 0 <= j < m and not np.isnan(z[i, j])
    around = lambda p: [(p[0] + a, p[1] + b) for a, b in STEPS]
    closed = {(i, j) for i in range(n) for j in range(m) if inside(i, j) and all(inside(*q) for q in around((i, j)))}
    want = z.copy()
    for pit in closed:
        floor = z[pit]
        if any(z[q] < floor for q in around(pit)):
            continue
        layer, best = {pit: (0.0, None)}, None
        layers = [layer]
        for k in range(1, reach + 1):
            after = {}
            for p, (cost, _) in layer.items():
                if k > 1 and (z[p] < floor or p not in closed):
                    continue
                for q in around(p):
                    if inside(*q):
                        d = (cost + max(0.0, z[q] - floor), p)
                        if q not in after or d < after[q]:
                            after[q] = d
            layers.append(layer := after)
            for q, (cost, _) in layer.items():
                if (z[q] < floor or q not in closed) and (best is None or (cost, k, q) < best):
                    best = (cost, k, q)
            if best and k > 12:
                break
        if best:
            at = best[2]
            for k in range(best[1], -1, -1):
                want[at] = min(want[at], floor)
                at = layers[k][at][1]
    got = {r.cell: r.breached for r in terrain.breach(cells, reach).collect()}
    assert len(got) == z.size and all((v is None and np.isnan(want.flat[c])) or v == want.flat[c] for c, v in got.items())


@pytest.mark.parametrize(("seed", "levels", "holes"), [(1, None, 0), (2, 2, 0), (3, 1, 6)])
def test_fill_is_the_flood_and_all_cells_drain(spark, seed, levels, holes):
    z, cells = surface(spark, seed, levels=levels, holes=holes)
    want, m = flooded(z), z.shape[1]
    filled = terrain.fill(cells)
    got = {r.cell: r.filled for r in filled.collect()}
    assert len(got) == z.size and all((v is None and np.isnan(want.flat[c])) or v == want.flat[c] for c, v in got.items())
    p = {r.cell: r for r in terrain.drainage(filled).collect()}
    assert set(p) == {c for c, v in got.items() if v is not None}
    for c in p:
        at, way = c, 0
        while p[at].next is not None:
            i, j, a, b = at // m, at % m, p[at].next // m, p[at].next % m
            assert max(abs(a - i), abs(b - j)) == 1 and got[p[at].next] <= got[at]
            at, way = p[at].next, way + 1
            assert way <= z.size
        i, j = at // m, at % m  # the way ends beside a missing cell or the edge
        assert any(not (0 <= i + a < z.shape[0] and 0 <= j + b < m) or np.isnan(z[i + a, j + b]) for a, b in STEPS)


def test_spread_by_descending_order(spark):
    z, cells = surface(spark, 4)
    pointers = terrain.dinf_pointer(cells)
    angle = {r.cell: r.angle for r in pointers.collect()}
    n, m = z.shape
    area, around = np.ones(z.size), [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    for c in np.argsort(-z, axis=None):
        if angle[c] is None:
            continue
        k = math.floor(angle[c] / (math.pi / 4))
        part = angle[c] / (math.pi / 4) - k
        for step, share in ((k % 8, 1 - part), ((k + 1) % 8, part)):
            i, j = c // m + around[step][0], c % m + around[step][1]
            if 0 <= i < n and 0 <= j < m and share > 0:
                area[i * m + j] += area[c] * share
    got = {r.cell: r.area for r in terrain.dinf_accumulation(cells, pointers).collect()}
    assert len(got) == z.size and all(abs(got[c] - area[c]) < 1e-9 for c in got)
    for doublings in (0, 2):
        shares = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0)], "cell long, to long, share double")
        out = graph.spread(shares, spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "cell long, weight double"), doublings)
        assert {r.cell: r.total for r in out.collect()} == {1: 1.0, 2: 1.5, 3: 3.0}


def test_paths_roots_and_circles(spark):
    p = spark.createDataFrame([(i, i + 1 if i % 10 else None) for i in range(1, 61)], "cell long, next long")
    starts = spark.createDataFrame([(1,), (5,), (30,)], "start long")
    got = sorted((r.start, r.step, r.cell) for r in graph.paths(p, starts).collect())
    assert got == sorted([(1, k, 1 + k) for k in range(10)] + [(5, k, 5 + k) for k in range(6)] + [(30, 0, 30)])
    assert {r.cell: r.root for r in graph.roots(p).collect()} == {i: -(-i // 10) * 10 for i in range(1, 61)}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "cell long, next long")
    monkey = graph.MAX_ROUNDS
    graph.MAX_ROUNDS = 4
    try:
        for f in (lambda: graph.roots(circle), lambda: graph.paths(circle, starts), lambda: graph.accumulate(circle.selectExpr("*", "1 as weight"))):
            with pytest.raises(ValueError, match="circle"):
                f()
    finally:
        graph.MAX_ROUNDS = monkey


def test_depressions_touching_an_area_are_measured_whole(spark):
    z = np.full((9, 9), 5.0)
    z[2, 2] = z[2, 3] = 3.0
    z[6, 6] = 4.0
    cells = spark.createDataFrame([(i * 9 + j, i, j, float(z[i, j])) for i in range(9) for j in range(9)], "cell long, row long, col long, z double")
    filled = terrain.fill(cells)
    one = spark.createDataFrame([(2 * 9 + 3,)], "cell long")
    got = terrain.depressions(filled, area=one, lot=one.limit(0)).collect()
    assert [(r.label, r.n_cells, r.volume, r.deepest, r.touches_lot) for r in got] == [(20, 2, 4.0, 2.0, False)]
    assert terrain.depressions(filled).count() == 2


def test_focal_plan_and_lee_filling(spark):
    rows = [("a", i, j, None if (i, j) == (3, 4) else float(i * 7 % 5 + j + 1)) for i in range(8) for j in range(9)]
    cells = spark.createDataFrame(rows, "raster string, row long, col long, value double")
    x = np.array([[np.nan if r[3] is None else r[3] for r in rows[i * 9 : i * 9 + 9]] for i in range(8)])
    filled = np.where(np.isnan(x), np.nanmean(x), x)
    got = {(r.row, r.col): r.value for r in raster.lee(cells, 3).collect()}
    padded = np.pad(filled, 1, mode="symmetric")
    for i in range(8):
        for j in range(9):
            w = padded[i : i + 3, j : j + 3]
            var = max((w * w).mean() - w.mean() ** 2, 0)
            want = w.mean() + var / (var + filled.var() + 1e-12) * (filled[i, j] - w.mean())
            assert (got[i, j] is None) == np.isnan(x[i, j]) and (got[i, j] is None or abs(got[i, j] - want) < 1e-9)
    plan = raster.focal_mean(cells, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6
