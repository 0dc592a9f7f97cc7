"""Regular time series: dense calendars, rolling sums, block maxima, declustered events, upserts.

Column names are parameters, so the same operators serve rain gauges and any other dated table.
A series has one row a key and step; NULL is missing. Windows run by key and so in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.scratch import discard, written

STEPS = {"hour": "1 hour", "day": "1 day"}


def resample(df: DataFrame, keys: list[str], t: str, value: str, step: str = "day") -> DataFrame:
    """Sum by key and step; NULL where all values are."""
    at = F.date_trunc(step, F.col(t)).cast("timestamp_ntz")
    return df.groupBy(*keys, at.alias("t")).agg(F.sum(value).alias("mm"))


def densify(series: DataFrame, keys: list[str], step: str = "day", fill: float | None = None) -> DataFrame:
    """Every step from a key's first to its last; steps without a row get `fill`."""
    span = series.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    every = span.select(*keys, F.explode(F.expr(f"sequence(t0, t1, interval {STEPS[step]})")).alias("t"))
    joined = every.join(series, [*keys, "t"], "left")
    return joined if fill is None else joined.withColumn("mm", F.coalesce("mm", F.lit(fill)))


def step_hours(series: DataFrame, keys: list[str]) -> DataFrame:
    """The step in hours: the least distance of neighbours."""
    gap = (F.unix_seconds(F.lead("t").over(W.partitionBy(*keys).orderBy("t")).cast("timestamp")) - F.unix_seconds(F.col("t").cast("timestamp"))) / 3600
    return series.withColumn("gap", gap).groupBy(*keys).agg(F.min("gap").alias("step_h"))


def rolling_sum(series: DataFrame, keys: list[str], n: int, full: bool = True, name: str = "roll") -> DataFrame:
    """Sum of the last n steps of a dense series; with full, NULL unless all n are there and none is missing."""
    frame = W.partitionBy(*keys).orderBy("t").rowsBetween(-(n - 1), 0)
    total = F.sum("mm").over(frame)
    return series.withColumn(name, F.when(F.count("mm").over(frame) == n, total) if full else total)


def rolling_sum_in_parts(series: DataFrame, keys: list[str], n: int, step_h: float, full: bool = True, name: str = "roll", part: int = 8192) -> DataFrame:
    """rolling_sum of a dense series whose keys may be few and long: windows run by key and part of the time, `part` steps long (n at least).

    The last n - 1 steps of a part go to the next one as well, where they only feed the sums; so a series of any length is many tasks, and each step moves twice at most.
    """
    part, step_s = max(part, n), round(step_h * 3600)
    at = F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / step_s)
    number, place = F.floor(at / part), F.pmod(at, F.lit(part))
    more = F.when(place >= part - (n - 1), F.array(F.struct(number.alias("part"), F.lit(True).alias("own")), F.struct((number + 1).alias("part"), F.lit(False).alias("own"))))
    dealt = series.withColumn("__p", F.explode(F.coalesce(more, F.array(F.struct(number.alias("part"), F.lit(True).alias("own"))))))
    frame = W.partitionBy(*keys, "__p.part").orderBy("t").rowsBetween(-(n - 1), 0)
    total = F.sum("mm").over(frame)
    rolled = dealt.withColumn(name, F.when(F.count("mm").over(frame) == n, total) if full else total)
    return rolled.where("__p.own").drop("__p")


def annual_maxima(series: DataFrame, keys: list[str], hours: int, step_h: int, min_days: int = 300) -> DataFrame:
    """Each year's largest rolling total and the first time that has it, for years with enough valid days.

    Totals run over year borders and count for the year in which they end.
    """
    rolled = rolling_sum(series, keys, max(1, round(hours / step_h))).withColumn("year", F.year("t"))
    years = rolled.groupBy(*keys, "year").agg((F.count("mm") * (step_h / 24)).alias("days"), F.max("roll").alias("mm"), F.max_by("t", F.struct("roll", -F.unix_seconds(F.col("t").cast("timestamp")))).alias("t"))
    return years.where((F.col("days") >= min_days) & F.col("mm").isNotNull()).select(*keys, "year", "mm", F.to_date("t").alias("day"))


def decluster(series: DataFrame, keys: list[str], n: int, separation_h: int, value: str = "roll") -> DataFrame:
    """The n largest values (above 0) that are separation_h apart, largest first, earliest first among equals.

    In each round the values that nothing larger is near to are taken, and what is near them goes. Of what is left, only values that
    can still be among the n largest stay for the next round.
    """
    gap = separation_h * 3600
    left = series.where(F.col(value) > 0).groupBy(*keys, F.unix_seconds(F.col("t").cast("timestamp")).alias("s")).agg(F.max(value).cast("double").alias("v"))
    left, taken = written(left), None
    around = W.partitionBy(*keys).orderBy("s").rangeBetween(1 - gap, gap - 1)
    order = W.partitionBy(*keys).orderBy(F.col("v").desc(), "s")
    while left.limit(1).count():
        here = F.struct("v", (-F.col("s")).alias("neg"))
        seen = left.withColumn("pick", here == F.max(here).over(around)).withColumn("gone", F.max(F.col("pick").cast("int")).over(around) == 1)
        seen = written(seen)
        new = seen.where("pick").select(*keys, "s", "v")
        best = written((new if taken is None else taken.drop("rank").unionByName(new)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n))
        full = best.groupBy(*[F.col(k).alias(f"f_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("f_n"), F.min("v").alias("f_v")).where(F.col("f_n") == n)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"f_{k}"))
        after = written(seen.where("not gone").join(full, on, "left").where("f_v is null or v >= f_v").select(*keys, "s", "v"))
        for t in (left, seen, *([taken] if taken is not None else [])):
            discard(t)
        left, taken = after, best
    rows = left.withColumn("rank", F.lit(1)) if taken is None else taken
    return rows.select(*keys, F.col("rank").cast("int").alias("rank"), F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"), F.col("v").alias(value))


def storm_context(series: DataFrame, keys: list[str], slice_steps: int = 72, day_steps: int = 24) -> DataFrame:
    """For each step of a dense series of non-negative totals: the sum of the last slice_steps, and the largest day_steps total within them."""
    out = rolling_sum(rolling_sum(series, keys, slice_steps, False, "sum72"), keys, day_steps, False, "roll24")
    inside = W.partitionBy(*keys).orderBy("t").rowsBetween(-(slice_steps - day_steps), 0)
    return out.withColumn("max24", F.max("roll24").over(inside)).drop("roll24")


def missing_steps(series: DataFrame, keys: list[str], step: str = "day") -> DataFrame:
    """Steps between a key's first and last that have no row."""
    return densify(series.select(*keys, "t"), keys, step).select(*keys, "t").join(series.select(*keys, "t"), [*keys, "t"], "left_anti")


def upsert(stored: DataFrame, fetched: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both; of rows with equal keys, the last by (fetched, order) stays."""
    both = stored.withColumn("batch", F.lit(0)).unionByName(fetched.withColumn("batch", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy(*keys).orderBy(F.col("batch").desc(), *[F.col(c).desc() for c in order])
    return both.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def outer_on_day(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two (t, mm) series side by side, NULL where one has no row."""
    a, b = left.withColumnRenamed("mm", names[0]), right.withColumnRenamed("mm", names[1])
    return a.join(b, "t", "full")
