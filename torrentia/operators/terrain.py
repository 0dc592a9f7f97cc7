"""Terrain hydrology over cell tables (cell, row, col, z): gradients, D8 flow, drainage height, watersheds, depressions.

Neighbourhoods are an equi-join: each cell is dealt to its eight neighbours' places. Filling, draining flats and spreading
flow and breaching run over the whole raster as joins: no result depends on tiles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentia.operators import graph
from torrentia.operators.graph import roots
from torrentia.scratch import discard, large, written

#: D8 codes clockwise from north-east = 1 to north = 128, with the steps in row (downwards) and column.
D8 = ((1, -1, 1), (2, 0, 1), (4, 1, 1), (8, 1, 0), (16, 1, -1), (32, 0, -1), (64, -1, -1), (128, -1, 0))


def neighbours(cells: DataFrame) -> DataFrame:
    """One row a cell and neighbour that exists: row, col, z, code, dr, dc, n_cell, n_z.

    Cells are dealt out before they multiply, so that the rows of one file aren't multiplied, sorted and grouped in one task.
    """
    cells = large(cells.repartition("row", "col"))
    steps = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for c, dr, dc in D8])
    dealt = cells.select(F.col("cell").alias("n_cell"), F.col("z").alias("n_z"), "row", "col", F.explode(steps).alias("s"))
    dealt = dealt.select("n_cell", "n_z", (F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), "s.code", "s.dr", "s.dc")
    return cells.join(dealt, ["row", "col"])


def d8_pointer(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """cell, next, code, length: the steepest way down, the least code on ties; NULL where none is lower."""
    cells = large(cells)
    n = neighbours(cells.where("z is not null"))
    length = F.when((F.col("dr") != 0) & (F.col("dc") != 0), res * 2**0.5).otherwise(res)
    drop = (F.col("z") - F.col("n_z")) / length
    best = n.where(F.col("n_z") < F.col("z")).groupBy("cell").agg(F.max(F.struct(drop.alias("d"), (-F.col("code")).alias("neg"), F.col("n_cell").alias("next"), length.alias("length"))).alias("b"))
    own = cells.where("z is not null").select(F.col("cell").alias("c"))
    return own.join(best, F.col("c") == F.col("cell"), "left").select(F.col("c").alias("cell"), F.col("b.next").alias("next"), (-F.col("b.neg")).alias("code"), F.col("b.length").alias("length"))


def flow_accumulation(pointers: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """Contributing area of each cell, itself included."""
    return graph.accumulate(pointers.select("cell", "next", F.lit(cell_area).alias("weight"))).withColumnRenamed("total", "area")


def streams(area: DataFrame, least: float) -> DataFrame:
    return area.where(F.col("area") >= least).select("cell")


def hand(cells: DataFrame, pointers: DataFrame, stream: DataFrame) -> DataFrame:
    """Height above, and way down to, the first stream cell; NULL where the way ends before one."""
    way = graph.follow(pointers, stream).withColumnRenamed("cell", "c")
    cells = large(cells)
    top, low = cells.select("cell", "z"), cells.select(F.col("cell").alias("s"), F.col("z").alias("sz"))
    return way.join(top, F.col("c") == F.col("cell")).join(low, F.col("stop") == F.col("s"), "left").select("cell", (F.col("z") - F.col("sz")).alias("hand"), F.col("length").alias("way"))


def watershed(pointers: DataFrame, outlets: DataFrame) -> DataFrame:
    """cell, outlet: cells that flow through an outlet, with the first one."""
    return graph.follow(pointers, outlets).where("stop is not null").select("cell", F.col("stop").alias("outlet"))


def gradients(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Horn's slope (degrees) and aspect, and the hillshade, where all eight neighbours have a value."""
    wx = F.col("dc") * F.when(F.col("dr") == 0, 2).otherwise(1)
    wy = F.col("dr") * F.when(F.col("dc") == 0, 2).otherwise(1)
    g = neighbours(cells).groupBy("cell").agg(F.count("n_z").alias("n"), (F.sum(wx * F.col("n_z")) / (8 * res)).alias("gx"), (F.sum(wy * F.col("n_z")) / (8 * res)).alias("gy")).where("n = 8")
    slope = F.atan(F.hypot("gx", "gy"))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360, F.lit(360.0))
    return g.select("cell", F.degrees(slope).alias("slope"), aspect.alias("aspect"), hillshade(F.col("gx"), F.col("gy")).alias("shade"))


def hillshade(gx, gy, azimuth: float = 315.0, altitude: float = 35.0, z_factor: float = 8.0):
    """0 to 1 by the angle between the surface and the light."""
    a, h = np.radians(azimuth), np.radians(altitude)
    lx, ly, lz = float(np.sin(a) * np.cos(h)), float(np.cos(a) * np.cos(h)), float(np.sin(h))
    nx, ny = -gx * z_factor, gy * z_factor
    return F.greatest(F.lit(0.0), (nx * lx + ny * ly + lz) / F.sqrt(nx * nx + ny * ny + 1))


def wetness(area, slope_deg):
    """ln(area / tan(slope)), the slope being a hundredth of a degree at least."""
    return F.log(area / F.tan(F.radians(F.greatest(slope_deg, F.lit(0.01)))))


def fill(cells: DataFrame) -> DataFrame:
    """cells with filled: the least height from which water leaves the raster without rising. Cells beside a missing one or the edge are outlets.

    Each cell runs down to a pit; cells of a pit are a basin. Basins meet at the lowest of their passes, outlets being passes to the
    outside. In each round every basin not yet joined to the outside rises to its lowest pass and merges with what lies beyond; a basin's
    level is the highest pass on its way. Rounds at least halve the basins.
    """
    cells = large(cells)
    valid = written(cells.where("z is not null"))
    pairs = written(neighbours(valid).select("cell", "z", "n_cell", "n_z"))
    down = pairs.where("n_z < z").groupBy(F.col("cell").alias("k")).agg(F.min(F.struct("n_z", "n_cell"))["n_cell"].alias("next"))
    basin = written(roots(valid.select("cell").join(down, F.col("cell") == F.col("k"), "left").select("cell", "next")))
    open_ = valid.select("cell", "z").join(pairs.groupBy(F.col("cell").alias("k")).count().where("count = 8"), F.col("cell") == F.col("k"), "left_anti")
    outside = F.lit(-(2**63)).cast("long")
    one, two = basin.select(F.col("cell").alias("i"), F.col("root").alias("a")), basin.select(F.col("cell").alias("j"), F.col("root").alias("b"))
    passes = pairs.join(one, F.col("cell") == F.col("i")).join(two, F.col("n_cell") == F.col("j")).where("a < b").select("a", "b", F.greatest("z", "n_z").alias("w"))
    outlets = open_.join(one, F.col("cell") == F.col("i")).select(outside.alias("a"), F.col("a").alias("b"), F.col("z").alias("w"))
    passes = written(passes.unionByName(outlets).groupBy("a", "b").agg(F.min("w").alias("w")))
    level = written(basin.select(F.col("root").alias("basin")).distinct().select("basin", F.col("basin").alias("comp"), F.lit(float("-inf")).alias("level")))
    while passes.limit(1).count():
        ends = passes.select("a", "b", "w").union(passes.select("b", "a", "w")).where(F.col("a") != outside)
        # passes are told apart by height, then by their ends, so that two basins at most choose each other
        pick = ends.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("p"))
        pick = written(pick.select(F.col("a").alias("comp"), F.col("p.b").alias("to"), F.col("p.w").alias("w")))
        back = pick.select(F.col("comp").alias("j"), F.col("to").alias("back"))
        mutual = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
        step = pick.join(back, F.col("to") == F.col("j"), "left").select(F.col("comp").alias("cell"), F.when(mutual.isNull() | ~mutual, F.col("to")).alias("next"))
        out = pick.select(outside.alias("cell"), F.lit(None).cast("long").alias("next")).limit(1)
        root = written(roots(step.unionByName(out)))
        name = lambda c: root.select(F.col("cell").alias(f"of_{c}"), F.col("root").alias(f"new_{c}"))  # noqa: B023, E731
        rise = pick.select(F.col("comp").alias("k"), "w")
        after = level.join(rise, F.col("comp") == F.col("k"), "left").join(name("comp"), F.col("comp") == F.col("of_comp"), "left")
        after = written(after.select("basin", F.coalesce("new_comp", "comp").alias("comp"), F.greatest("level", F.coalesce("w", F.lit(float("-inf")))).alias("level")))
        merged = passes.join(name("a"), F.col("a") == F.col("of_a")).join(name("b"), F.col("b") == F.col("of_b")).where("new_a <> new_b")
        merged = merged.groupBy(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).agg(F.min("w").alias("w"))
        merged = written(merged)
        for t in (level, passes, pick, root):
            discard(t)
        level, passes = after, merged
    lift = basin.join(level, F.col("root") == F.col("basin")).select(F.col("cell").alias("k"), "level")
    out = cells.join(lift, F.col("cell") == F.col("k"), "left")
    return written(out.select(*cells.columns, F.when(F.col("z").isNotNull(), F.greatest("z", "level")).alias("filled")))


def drainage(filled: DataFrame, height: str = "filled", res: float = 1.0) -> DataFrame:
    """D8 pointers (cell, next, code, length) of a filled surface; in flats towards the nearest cell that drains or is an outlet, the least code on ties."""
    surface = written(filled.select("cell", "row", "col", F.col(height).alias("z")).where("z is not null"))
    down = written(d8_pointer(surface, res))
    n = written(neighbours(surface))
    full = n.groupBy(F.col("cell").alias("k")).count().where("count = 8")
    stuck = written(down.where("next is null").select("cell").join(full, F.col("cell") == F.col("k"), "left_semi"))
    level = n.where("z = n_z").join(stuck.select(F.col("cell").alias("k")), F.col("cell") == F.col("k"), "left_semi")
    level = written(level.select("cell", "n_cell", "code", F.when((F.col("dr") != 0) & (F.col("dc") != 0), res * 2**0.5).otherwise(res).alias("length")))
    front, found = down.select("cell").join(stuck, "cell", "left_anti"), []
    while True:
        via = level.join(front.select(F.col("cell").alias("f")), F.col("n_cell") == F.col("f"), "left_semi")
        now = written(via.groupBy("cell").agg(F.min(F.struct("code", F.col("n_cell").alias("next"), "length")).alias("b")).select("cell", "b.next", "b.code", "b.length"))
        if not now.limit(1).count():
            break
        found.append(now)
        level = written(level.join(now.select(F.col("cell").alias("k")), F.col("cell") == F.col("k"), "left_anti"))
        front = now.select("cell")
    out = down.join(stuck, "cell", "left_anti")
    for now in found:
        out = out.unionByName(now)
    return out.unionByName(stuck.join(reduce(lambda a, b: a.union(b), [x.select("cell") for x in found]), "cell", "left_anti").select("cell", F.lit(None).cast("long").alias("next"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("double").alias("length"))) if found else out


def dinf_pointer(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """cell, angle (radians, anticlockwise from east, NULL where nothing is lower) and slope of the steepest of the eight triangular facets."""
    n = neighbours(cells.where("z is not null"))
    around = n.groupBy("cell", "z").agg(*[F.max(F.when(F.col("code") == c, F.col("n_z"))).alias(f"z{c}") for c, _, _ in D8])
    # facet: cardinal and diagonal neighbour by code, sign and start of its angle in quarter turns
    facets = ((2, 1, 1, 0), (128, 1, -1, 1), (128, 64, 1, 1), (32, 64, -1, 2), (32, 16, 1, 2), (8, 16, -1, 3), (8, 4, 1, 3), (2, 4, -1, 4))
    found = []
    for side, corner, sign, turns in facets:
        e0, e1, e2 = F.col("z"), F.col(f"z{side}"), F.col(f"z{corner}")
        s1, s2 = (e0 - e1) / res, (e1 - e2) / res
        r = F.atan2(s2, s1)
        slope = F.when(r < 0, s1).when(r > np.pi / 4, (e0 - e2) / (res * 2**0.5)).otherwise(F.hypot(s1, s2))
        angle = F.least(F.greatest(r, F.lit(0.0)), F.lit(np.pi / 4)) * sign + turns * np.pi / 2
        found.append(F.when(e1.isNotNull() & e2.isNotNull() & (slope > 0), F.struct(slope.alias("slope"), F.lit(-len(found)).alias("k"), angle.alias("angle"))))
    best = F.array_max(F.array(*found))
    return around.select("cell", F.pmod(best["angle"], F.lit(2 * np.pi)).alias("angle"), best["slope"].alias("slope"))


def dinf_accumulation(cells: DataFrame, pointers: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """cell, area: each cell passes its area to the two neighbours that its angle lies between, by their nearness; over the whole raster."""
    cells = large(cells)
    turn = F.col("angle") / (np.pi / 4)
    k = F.floor(turn)
    # anticlockwise from east, in eighths of a turn
    dr, dc = (F.array(*map(F.lit, d)) for d in ((0, -1, -1, -1, 0, 1, 1, 1), (1, 1, 0, -1, -1, -1, 0, 1)))
    to = lambda i, share: F.struct(F.pmod(i, F.lit(8)).cast("int").alias("k"), share.alias("share"))
    at = cells.select("cell", "row", "col").join(pointers.where("angle is not null").select(F.col("cell").alias("p"), "angle"), F.col("cell") == F.col("p"))
    s = at.select("cell", "row", "col", F.explode(F.array(to(k, 1 - (turn - k)), to(k + 1, turn - k))).alias("s")).where("s.share > 0")
    s = s.select("cell", (F.col("row") + F.get(dr, F.col("s.k"))).alias("row"), (F.col("col") + F.get(dc, F.col("s.k"))).alias("col"), "s.share")
    s = s.join(cells.where("z is not null").select(F.col("cell").alias("to"), "row", "col"), ["row", "col"]).select("cell", "to", "share")
    return graph.spread(s, cells.where("z is not null").select("cell", F.lit(cell_area).alias("weight"))).withColumnRenamed("total", "area")


def flow_paths(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """start, step, cell: the ways down from the starts (start)."""
    return graph.paths(pointers, starts)


def breach(cells: DataFrame, max_dist: int = 50) -> DataFrame:
    """cells with breached: from each pit the cheapest ditch of max_dist steps at most to a lower cell, or to one beside a missing one or the edge, is dug to the pit's height.

    A step costs what is dug there. All ditches are found on the surface as it is, over the whole raster, and dug at once, so the result
    depends on no order and no tiles; of equally dear ditches the one with fewer steps, then with the lesser end is dug, on its way the lesser cells.
    Rounds of joins go on a step from the cells reached; a way that is dearer than the pit's best end, or than a shorter way to the same cell, isn't followed.
    """
    cells = large(cells)
    valid = cells.where("z is not null")
    n = written(neighbours(valid).select("cell", "z", "n_cell", "n_z"))
    inner = n.groupBy("cell", "z").agg(F.count(F.lit(1)).alias("n"), F.min("n_z").alias("low")).where("n = 8")
    pits = written(inner.where("low >= z").select(F.col("cell").alias("pit"), F.col("z").alias("floor")))
    open_ = written(valid.select(F.col("cell").alias("e")).join(inner.select(F.col("cell").alias("e")), "e", "left_anti"))
    step = n.select(F.col("cell").alias("at"), F.col("n_cell").alias("cell"), "n_z")
    front = pits.select("pit", "floor", F.col("pit").alias("cell"), F.lit(0.0).alias("cost"))
    seen, best, layers = front.select("pit", "cell", "cost"), None, []
    for k in range(1, max_dist + 1):
        on = front.withColumnRenamed("cell", "at").join(step, "at")
        cost = F.col("cost") + F.greatest(F.lit(0.0), F.col("n_z") - F.col("floor"))
        on = on.groupBy("pit", "floor", "cell", "n_z").agg(F.min(F.struct(cost.alias("cost"), F.col("at").alias("back"))).alias("m"))
        on = on.join(open_, F.col("cell") == F.col("e"), "left").select("pit", "floor", "cell", "m.cost", "m.back", (F.col("e").isNotNull() | (F.col("n_z") < F.col("floor"))).alias("is_end"))
        known = seen.groupBy("pit", "cell").agg(F.min("cost").alias("was"))
        now = written(on.join(known, ["pit", "cell"], "left").where("was is null or cost < was").drop("was"))
        layers.append(now.select("pit", "cell", "back"))
        ends = now.where("is_end").select("pit", "floor", F.struct("cost", F.lit(k).alias("steps"), "cell").alias("end"))
        best = written((ends if best is None else best.unionByName(ends)).groupBy("pit", "floor").agg(F.min("end").alias("end")))
        bound = best.select("pit", F.col("end.cost").alias("bound"))
        front = written(now.where("not is_end").join(bound, "pit", "left").where("bound is null or cost < bound").select("pit", "floor", "cell", "cost"))
        seen = written(seen.unionByName(now.select("pit", "cell", "cost")))
        if not front.limit(1).count():
            break
    if best is None:
        return cells.withColumn("breached", F.col("z"))
    way, dug = best.where("false").select("pit", "floor", F.col("pit").alias("cell")), []
    for k in range(len(layers), 0, -1):
        way = way.unionByName(best.where(F.col("end.steps") == k).select("pit", "floor", "end.cell"))
        dug.append(way.select("floor", "cell"))
        way = written(way.join(layers[k - 1], ["pit", "cell"]).select("pit", "floor", F.col("back").alias("cell")))
    ditch = reduce(lambda a, b: a.union(b), dug).groupBy(F.col("cell").alias("k")).agg(F.min("floor").alias("floor"))
    return cells.join(ditch, F.col("cell") == F.col("k"), "left").select(*cells.columns, F.least("z", F.coalesce("floor", "z")).alias("breached"))


def depressions(filled: DataFrame, res: float = 1.0, area: DataFrame | None = None, lot: DataFrame | None = None) -> DataFrame:
    """The 4-connected components of filled - z > 0: label (least cell), n_cells, area, volume, deepest, mean, and whether it touches the lot (cell).

    With an area (cell), components that have no cell in it are left out; the others are measured whole.
    """
    sink = written(filled.withColumn("depth", F.col("filled") - F.col("z")).where("depth > 0"))
    edges = neighbours(sink.select("cell", "row", "col", "z")).where("dr = 0 or dc = 0").select(F.col("cell").alias("a"), F.col("n_cell").alias("b"))
    label = graph.components(edges).withColumnRenamed("node", "k")
    named = sink.join(label, F.col("cell") == F.col("k"), "left").withColumn("label", F.coalesce("label", "cell"))
    for name, zone in (("in_area", area), ("in_lot", lot)):
        inside = None if zone is None else large(zone.select(F.col("cell").alias(name)).distinct())
        named = named.withColumn(name, F.lit(None).cast("long")) if inside is None else named.join(inside, F.col("cell") == F.col(name), "left")
    out = named.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * res * res).alias("area"), (F.sum("depth") * res * res).alias("volume"), F.max("depth").alias("deepest"), F.avg("depth").alias("mean"),
        F.bool_or(F.col("in_lot").isNotNull()).alias("touches_lot"), F.bool_or(F.col("in_area").isNotNull()).alias("touches"),
    )
    return (out if area is None else out.where("touches")).drop("touches")
