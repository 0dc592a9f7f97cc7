"""Raster operators over cell tables (raster, row, col, value): zonal, focal, thresholds, certainty.

Focal sums deal each cell to the window centres along its row, add up by partial aggregation, and do the same along
columns: 2 k rows a cell instead of k * k, and no halo exchange. Edges are reflected or open by how the cell is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.scratch import written

KEY = ["raster", "row", "col"]


def zonal(cells: DataFrame, zone: str = "zone") -> DataFrame:
    return cells.groupBy(zone).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.count("value").alias("valid"), F.count(F.lit(1)).alias("n_cells"))


def zonal_share(cells: DataFrame, condition: Column, zone: str = "zone") -> DataFrame:
    """Per cent of the zone's cells that meet the condition: with missing cells counted as not, and left out."""
    return cells.groupBy(zone).agg((100 * F.avg(F.coalesce(condition, F.lit(False)).cast("int"))).alias("of_all"), (100 * F.avg(condition.cast("int"))).alias("of_valid"))


def mode(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, the smallest on ties."""
    counts = cells.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("neg"))).alias("m")).select(*keys, (-F.col("m.neg")).alias(value), F.col("m.n").alias("n"))


def select_dem(scores: DataFrame, forced: str | None = None) -> DataFrame:
    """scores(area, dem, bare, osm, rough) to one dem an area: the least score, or the bare-earth one if its score is within 1.5 times that.

    The score is the distance from mapped streams where all DEMs of the area have one, else the roughness.
    """
    mapped = scores.groupBy("area").agg((F.count("osm") == F.count(F.lit(1))).alias("mapped"))
    scores = scores.join(mapped, "area").withColumn("score", F.when(F.col("mapped"), F.col("osm")).otherwise(F.col("rough")))
    out = scores.groupBy("area").agg(F.min(F.struct("score", "dem")).alias("b"), F.min(F.when(F.col("bare"), F.struct("score", "dem"))).alias("e"), F.bool_or(F.col("dem") == F.lit(forced)).alias("f"))
    chosen = F.when(F.col("e.score") <= 1.5 * F.col("b.score"), F.col("e.dem")).otherwise(F.col("b.dem"))
    return out.select("area", F.when(F.col("f"), F.lit(forced)).otherwise(chosen).alias("dem"))


def histogram(cells: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """keys, bin (from 0), n, lo, width: equal bins over each key's range."""
    span = cells.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = cells.join(span, keys)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return j.groupBy(*keys, bin_.alias("bin"), "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def otsu(cells: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """The bin centre that maximises the variance between what lies up to it and beyond; the first on ties."""
    h = written(histogram(cells, keys, value, bins)).withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    upto = W.partitionBy(*keys).orderBy("bin")
    every = W.partitionBy(*keys)
    h = h.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("x")).over(upto), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("x")).over(every)})
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0)), 2))
    best = F.max_by("x", F.struct(F.round(between, 6), -F.col("bin")))
    return h.groupBy(*keys).agg(best.alias("threshold"))


def otsu_guarded(cells: DataFrame, keys: list[str], value: str, ceiling: float, fixed: float, most: float = 0.2) -> DataFrame:
    """The threshold, or `fixed` where it is above `ceiling` or marks more than `most` of the cells.

    Thresholds are written first, so that no task holds both the histograms and the sorted cells.
    """
    t = written(otsu(cells, keys, value))
    share = cells.join(t, keys).groupBy(*keys, "threshold").agg(F.avg((F.col(value) < F.col("threshold")).cast("int")).alias("share"))
    bad = (F.col("threshold") > ceiling) | (F.col("share") > most)
    return share.select(*keys, F.when(bad, F.lit(fixed)).otherwise(F.col("threshold")).alias("threshold"), bad.alias("is_fixed"))


def _targets(at: str, lo: str, hi: str, half: int, edge: str) -> Column:
    """Window centres along an axis that the cell counts for, as often as reflection repeats it; the cell before the edge is the edge cell again."""
    around = lambda c: F.sequence(c - half, c + half)
    found = around(F.col(at))
    if edge == "reflect":
        none = F.slice(found, 1, 0)
        low = F.when(F.col(at) - F.col(lo) < half, around(2 * F.col(lo) - 1 - F.col(at))).otherwise(none)
        found = F.concat(found, low, F.when(F.col(hi) - F.col(at) < half, around(2 * F.col(hi) + 1 - F.col(at))).otherwise(none))
    return F.filter(found, lambda t: t.between(F.col(lo), F.col(hi)))


def focal_sums(cells: DataFrame, k: int, edge: str = "reflect") -> DataFrame:
    """raster, row, col with n (valid cells of the window), s and s2 (sum and sum of squares): sums along rows, then of these along columns."""
    size = cells.groupBy(F.col("raster").alias("r")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    v = F.col("value")
    one = cells.join(size, F.col("raster") == F.col("r")).withColumn("to", F.explode(_targets("col", "c0", "c1", k // 2, edge)))
    one = one.groupBy("raster", "row", F.col("to").alias("col")).agg(F.count("value").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.first("r0").alias("r0"), F.first("r1").alias("r1"))
    two = one.withColumn("to", F.explode(_targets("row", "r0", "r1", k // 2, edge)))
    return two.groupBy("raster", F.col("to").alias("row"), "col").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))


def focal_mean(cells: DataFrame, k: int, edge: str = "reflect") -> DataFrame:
    """The mean of the valid cells in each k x k window; edge is reflect or none (cells beyond don't count)."""
    return focal_sums(cells, k, edge).select(*KEY, (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))


def lee(cells: DataFrame, k: int = 7) -> DataFrame:
    """Speckle filter: m + w (x - m) with w = var / (var + noise), noise being the variance of the raster.

    Cells without a value above zero count as the mean of the others, and have none afterwards.
    """
    ok = F.col("value") > 0
    mean = cells.groupBy(F.col("raster").alias("r")).agg(F.avg(F.when(ok, F.col("value"))).alias("mean"))
    x = cells.join(mean, F.col("raster") == F.col("r")).select(*KEY, F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.col("value")).otherwise(F.col("mean")).alias("value"))
    noise = x.groupBy(F.col("raster").alias("r")).agg(F.var_pop("value").alias("noise"))
    f = focal_sums(x, k).withColumn("m", F.col("s") / F.col("n")).withColumn("var", F.greatest(F.col("s2") / F.col("n") - F.col("m") * F.col("m"), F.lit(0.0)))
    out = x.join(f, KEY).join(noise, F.col("raster") == F.col("r"))
    w = F.col("var") / (F.col("var") + F.col("noise") + 1e-12)
    return out.select(*KEY, F.when(F.col("ok"), F.col("m") + w * (F.col("value") - F.col("m"))).alias("value"))


def strict_pits(cells: DataFrame) -> DataFrame:
    """Cells lower than all their neighbours that have a value; edges don't wrap."""
    own = cells.where("value is not null")
    n = own.select("raster", F.col("value").alias("nb"), F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), F.col("col").alias("c0"), F.col("row").alias("r0"))
    n = n.select("raster", "nb", "row", F.explode(F.sequence(F.col("c0") - 1, F.col("c0") + 1)).alias("col"), "r0", "c0").where("r0 <> row or c0 <> col")
    low = n.groupBy(*KEY).agg(F.min("nb").alias("low"))
    return own.join(low, KEY, "left").where(F.col("low").isNull() | (F.col("value") < F.col("low"))).select(*KEY, "value")


def roughness(cells: DataFrame, res: float) -> DataFrame:
    """Of each raster: the spread of its residual to the 5 x 5 mean, strict pits a km2, and per cent without value."""
    m = focal_mean(cells, 5)
    r = cells.join(m, KEY).groupBy("raster").agg(
        F.stddev_pop(F.col("value") - F.col("mean")).alias("rough"), F.count("value").alias("valid"), (100 * (1 - F.count("value") / F.count(F.lit(1)))).alias("nodata_pct")
    )
    p = strict_pits(cells).groupBy("raster").agg(F.count(F.lit(1)).alias("pits"))
    return r.join(p, "raster", "left").select("raster", "rough", (F.coalesce("pits", F.lit(0)) / (F.col("valid") * res * res / 1e6)).alias("pits_per_km2"), "nodata_pct")


def certainty(depths: DataFrame, least: float) -> DataFrame:
    """depths(raster, dem, row, col, value) to the mean over DEMs of the share of each 3 x 3 window above `least`, in whole per cent."""
    wet = depths.withColumn("value", (F.col("value") > least).cast("double")).withColumn("raster", F.struct("raster", "dem"))
    share = focal_sums(wet, 3, "none").select(F.col("raster.raster").alias("raster"), "row", "col", (F.col("s") / 9).alias("share"))
    return share.groupBy(*KEY).agg(F.bround(100 * F.avg("share")).cast("int").alias("certainty"))


def lot_by_hour(frames: DataFrame) -> DataFrame:
    """frames(scenario, hour, cell, h_cm) to max, per cent above 5 and above 20 by hour."""
    above = lambda cm: F.round(100 * F.avg((F.col("h_cm") > cm).cast("int")), 4)
    return frames.groupBy("scenario", "hour").agg(F.max("h_cm").alias("h_max"), above(5).alias("pct5"), above(20).alias("pct20"))


def lot_summary(hours: DataFrame) -> DataFrame:
    """Hours with water and the first hour of the peak, by scenario."""
    return hours.groupBy("scenario").agg(F.count_if(F.col("h_max") > 5).alias("wet_hours"), F.max_by("hour", F.struct("h_max", -F.col("hour"))).alias("peak_hour"))
