"""Rain series and extremes: the literal cases that the behaviour is pinned by."""

import datetime as dt
import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from torrentia.operators import extremes, matching, series


def rain(spark, rows):
    return spark.createDataFrame(rows, "g string, t timestamp_ntz, mm double")


def year_of(year, peaks, hours=True):
    step, n = (dt.timedelta(hours=1), 366 * 24) if hours else (dt.timedelta(days=1), 366)
    t = [dt.datetime(year, 1, 1) + i * step for i in range(n)]
    return [("a", x, float(peaks.get(x, 0.0))) for x in t if x.year == year]


def test_annual_maximum_and_its_first_end(spark):
    peaks = {dt.datetime(2000, 3, 10, 10): 30, dt.datetime(2000, 3, 10, 20): 20, dt.datetime(2001, 5, 1, 0): 80}
    got = {r.year: (r.mm, r.day) for r in series.annual_maxima(rain(spark, year_of(2000, peaks) + year_of(2001, peaks)), ["g"], 24, 1).collect()}
    assert got == {2000: (50.0, dt.date(2000, 3, 10)), 2001: (80.0, dt.date(2001, 5, 1))}


def test_incomplete_year_has_no_maximum(spark):
    rows = [r for r in year_of(2001, {}) if r[1].month == 12]
    assert series.annual_maxima(rain(spark, rows), ["g"], 24, 1).count() == 0


def test_three_days_from_daily(spark):
    peaks = {dt.datetime(2000, 1, 10 + i): 10.0 * (i + 1) for i in range(3)}
    assert series.annual_maxima(rain(spark, year_of(2000, peaks, False)), ["g"], 72, 24).first().mm == 60.0


def test_rolling_needs_all_its_steps_only_if_asked(spark):
    df = rain(spark, [("a", dt.datetime(2000, 1, 1, h), None if h == 2 else 1.0) for h in range(5)])
    full = [r.roll for r in series.rolling_sum(df, ["g"], 2).orderBy("t").collect()]
    part = [r.roll for r in series.rolling_sum(df, ["g"], 2, False).orderBy("t").collect()]
    assert full == [None, 2.0, None, None, 2.0] and part == [1.0, 2.0, 1.0, 1.0, 2.0]


def test_declustering_keeps_separated_peaks(spark):
    day = lambda m, d: dt.datetime(2000, m, d)
    df = rain(spark, [("a", day(3, 1), 100.0), ("a", day(3, 3), 90.0), ("a", day(6, 1), 80.0), ("a", day(9, 1), 120.0)]).withColumnRenamed("mm", "roll")
    got = [r.t for r in series.decluster(df, ["g"], 3, 7 * 24).orderBy("rank").collect()]
    assert got == [day(9, 1), day(3, 1), day(6, 1)]


def test_declustering_against_a_greedy_pass(spark):
    rnd = random.Random(2)
    start = dt.datetime(2000, 1, 1)
    rows = [(g, start + dt.timedelta(hours=h), float(rnd.randint(0, 9))) for g in ("a", "b", None) for h in range(0, 400, 1 if g else 5)]
    rows += [("ramp", start + dt.timedelta(hours=h), float(h)) for h in range(60)] + [("dry", start, 0.0)]
    df = rain(spark, rows).withColumnRenamed("mm", "roll")
    for n, gap in ((4, 24), (50, 5)):
        got = sorted((str(r.g), r.rank, r.t, r.roll) for r in series.decluster(df, ["g"], n, gap).collect())
        want = []
        for g in {r[0] for r in rows}:
            kept = []
            for _, t, v in sorted((r for r in rows if r[0] == g and r[2] > 0), key=lambda r: (-r[2], r[1])):
                if len(kept) < n and all(abs(t - u) >= dt.timedelta(hours=gap) for u, _ in kept):
                    kept.append((t, v))
            want += [(str(g), k + 1, t, v) for k, (t, v) in enumerate(kept)]
        assert got == sorted(want)
    assert series.decluster(df.limit(0), ["g"], 3, 24).count() == 0


def test_gaps_and_upsert(spark):
    df = rain(spark, [("a", dt.datetime(2000, 1, d), 1.0) for d in (1, 2, 5)])
    assert [r.t.day for r in series.missing_steps(df, ["g"]).orderBy("t").collect()] == [3, 4]
    new = rain(spark, [("a", dt.datetime(2000, 1, 2), 9.0)])
    assert sorted(r.mm for r in series.upsert(df, new, ["g", "t"], ["mm"]).collect()) == [1.0, 1.0, 9.0]


def test_gumbel_round_trip_and_limits(spark):
    row = spark.range(1).select(
        extremes.period(F.lit(80.0), F.lit(20.0), extremes.quantile(F.lit(80.0), F.lit(20.0), F.lit(100.0))).alias("t"),
        extremes.period(F.lit(80.0), F.lit(20.0), F.lit(10000.0)).alias("inf"),
        extremes.period(F.lit(80.0), F.lit(20.0), F.lit(0.0)).alias("one"),
        extremes.period(F.lit(80.0), F.lit(0.0), F.lit(90.0)).alias("none"),
    ).first()
    assert abs(row.t - 100) < 1e-6 and math.isinf(row.inf) and abs(row.one - 1) < 1e-9 and row.none is None


def test_bootstrap_repeats_and_brackets(spark):
    x = np.random.default_rng(1).gumbel(80, 20, 40)
    df = spark.createDataFrame([("a", 1980 + i, float(v)) for i, v in enumerate(x)], "g string, year int, mm double")
    fit = extremes.return_levels(extremes.gumbel_fit(df, ["g"]), [2, 10, 100]).orderBy("T").collect()
    a, b = (extremes.bootstrap_levels(df, ["g"], [2, 10, 100]).orderBy("T").collect() for _ in range(2))
    assert a == b and all(i.lo < f.mm < i.hi for i, f in zip(a, fit, strict=True))


def test_scenes_before_and_after(spark):
    day = lambda d: dt.date(2000, 3, d)
    scenes = spark.createDataFrame([("a", day(d)) for d in (1, 3, 13, 27)], "k string, day date")
    events = spark.createDataFrame([("a", 1, day(12)), ("a", 2, day(13)), ("a", 3, day(31))], "k string, event_id long, day date")
    got = {r.event_id: (r.pre, r.post) for r in matching.pre_post(events, scenes, "k").collect()}
    assert got == {1: (day(3), day(13)), 2: (day(3), day(13)), 3: (day(27), None)}
    near = {r.event_id: (r.scene, r.days) for r in matching.nearest_within(events, scenes, "k").collect()}
    assert near == {1: (day(13), 1), 2: (day(13), 0), 3: (None, None)}


@pytest.mark.parametrize(("n", "part", "full"), [(1, 4, True), (5, 5, True), (5, 7, False), (12, 3, True), (30, 16, False)])
def test_rolling_sums_in_parts_are_those_of_the_whole(spark, n, part, full):
    rows = [(k, dt.datetime(1969, 12, 30) + dt.timedelta(hours=i), None if (i * 7 + len(k)) % 11 == 0 else float(i * 13 % 17)) for k in ("a", "bb") for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, mm double")
    key = lambda r: (r.k, r.t, r.roll)
    assert sorted(map(key, series.rolling_sum_in_parts(df, ["k"], n, 1.0, full, part=part).collect())) == sorted(map(key, series.rolling_sum(df, ["k"], n, full).collect()))
