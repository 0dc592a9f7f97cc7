"""Rain scenarios: grid, hyetograph and point infiltration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.functions.scalars import scenario_id

# Depth ratios of the design storms by share of their duration, and soil constants.
LONG = ((1 / 24, 0.40), (2 / 24, 0.52), (3 / 24, 0.60), (4 / 24, 0.66), (6 / 24, 0.74), (8 / 24, 0.80), (12 / 24, 0.88), (18 / 24, 0.95), (1.0, 1.0))
SHORT = ((10 / 120, 0.25), (20 / 120, 0.40), (30 / 120, 0.55), (60 / 120, 0.75), (90 / 120, 0.90), (1.0, 1.0))
SUCTION_M = 0.22
DRAIN_H = 24.0


def scenario_grid(levels: DataFrame, durations: DataFrame, soils: DataFrame) -> DataFrame:
    """Every level (p_mm) with every duration (dur_h) and soil (soil, ks_mm_h); durations and soils are short lists."""
    out = levels.crossJoin(F.broadcast(durations)).crossJoin(F.broadcast(soils))
    wet = F.col("soil") == "saturado"
    out = out.withColumn("scenario", scenario_id(F.col("p_mm"), F.col("dur_h"), wet)).withColumn("dt_h", F.when(F.col("dur_h") >= 6, 1.0).otherwise(1 / 6))
    return out.withColumn("t_end_h", F.col("dur_h") + DRAIN_H).withColumn("shape", F.when(F.col("dur_h") > 3, "long").otherwise("short"))


def fingerprint(scenarios: DataFrame, parts: list[str], version: int = 1) -> DataFrame:
    """scenarios with print: twelve hex digits over what determines a run, so that runs that didn't change are reused."""
    text = F.concat_ws("|", F.lit(str(version)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    return scenarios.withColumn("print", F.substring(F.sha1(text), 1, 12))


def to_run(scenarios: DataFrame, done: DataFrame) -> DataFrame:
    """Scenarios whose fingerprint has no stored run."""
    return scenarios.join(done.select("scenario", "print"), ["scenario", "print"], "left_anti")


def stale(stored: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Stored runs that the grid no longer has."""
    return stored.join(scenarios.select("scenario").distinct(), "scenario", "left_anti")


def ensemble(chosen: DataFrame, scenarios: DataFrame, dems: DataFrame, primary_grid: str) -> DataFrame:
    """Chosen scenarios that the grid has, with each terrain model on the primary one's grid: id {scenario}__{dem}."""
    known = chosen.join(scenarios.select("scenario").distinct(), "scenario", "left_semi")
    out = known.crossJoin(F.broadcast(dems.where(F.col("grid") == primary_grid)))  # a handful of models
    return out.withColumn("run", F.concat_ws("__", "scenario", "dem"))


def _share(x: Column, knots: tuple) -> Column:
    """Linear between knots, the first knot's value before it."""
    out = F.when(x <= knots[0][0] + 1e-12, knots[0][1])
    for (a, ra), (b, rb) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= b + 1e-12, ra + (x - a) * ((rb - ra) / (b - a)))
    return out.otherwise(1.0)


#: Storms of a task: at 72 steps each these are some 2 million rows.
STORMS = 30_000


def hyetograph(storms: DataFrame, key: str) -> DataFrame:
    """storms (key, p_mm, dur_h) to rain in each step (k from 0, mm): increments of the depth curve, the largest in the middle, then alternately before and after.

    Storms are dealt out by key before their steps are, and stay there: a task never has more than its storms' steps.
    """
    n = max(int(storms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-storms.count() // STORMS))
    s = storms.repartition(n, key).withColumn("dt_h", F.when(F.col("dur_h") >= 6, 1.0).otherwise(1 / 6)).withColumn("n", F.round(F.col("dur_h") / F.col("dt_h")).cast("int"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    x = F.col("i") * F.col("dt_h") / F.col("dur_h")
    first = F.col("dt_h") / F.col("dur_h")
    curve = lambda knots: F.when(x < knots[0][0] - 1e-12, knots[0][1] * first / knots[0][0]).otherwise(_share(x, knots))
    cum = F.when(F.col("dur_h") > 3, curve(LONG)).otherwise(curve(SHORT)) * F.col("p_mm")
    by = W.partitionBy(key).orderBy("i")
    s = s.withColumn("cum", cum).withColumn("top", F.max("cum").over(by)).withColumn("inc", F.col("top") - F.coalesce(F.lag("top").over(by), F.lit(0.0)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("inc").desc(), "i")) - 1
    mid = F.floor(F.col("n") / 2)
    place = F.when(rank % 2 == 1, mid - F.floor((rank + 1) / 2)).otherwise(mid + F.floor(rank / 2))
    return s.withColumn("k", place).select(key, F.col("k").cast("int").alias("k"), F.col("inc").alias("mm"), "dt_h")


def point_infiltration(rain: DataFrame, key: str, ks_mm_h: float, deficit: float = 0.3) -> DataFrame:
    """Green-Ampt at a point, step by step over each storm: infiltrated and left-over mm."""
    steps = rain.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "mm", "dt_h"))).alias("steps"))
    start = F.struct(F.lit(0.1).alias("f"), F.lit(0.0).alias("h"))

    def step(a: Column, x: Column) -> Column:
        h = a["h"] + x["mm"]
        can = ks_mm_h * (1 + SUCTION_M * 1000 * deficit / a["f"]) * x["dt_h"]
        taken = F.least(can, h)
        return F.struct((a["f"] + taken).alias("f"), (h - taken).alias("h"))

    end = steps.select(key, F.aggregate("steps", start, step).alias("e"))
    return end.select(key, (F.col("e.f") - 0.1).alias("infiltrated"), F.col("e.h").alias("left_over"))
