"""Climate queries over the driver's tables: rain stands for event values and order totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentia.operators import extremes, matching, series

YEARS = [2, 5, 10, 25, 50, 100]


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hourly(spark, d):
    return series.densify(series.resample(_table(spark, d, "events"), ["event_type"], "ts", "value", "hour"), ["event_type"], "hour")


def _daily(spark, d):
    return series.densify(series.resample(_table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice"), ["o_orderpriority"], "day", 0.0)


def _monthly_maxima(spark, d):
    """72 h totals' maxima by month: enough blocks for the usual least number."""
    rolled = series.rolling_sum(_daily(spark, d), ["o_orderpriority"], 3)
    return rolled.withColumn("year", F.year("t") * 100 + F.month("t")).groupBy("o_orderpriority", "year").agg(F.max("roll").alias("mm")).where("mm is not null")


def series_hourly_resample(spark, d):
    return _hourly(spark, d).select("event_type", "t", F.round("mm", 6).alias("mm"))


def series_rolling_full(spark, d):
    return series.rolling_sum(_hourly(spark, d), ["event_type"], 24).select("event_type", "t", F.round("roll", 6).alias("roll"))


def series_rolling_parts(spark, d):
    """The same with windows over parts of the time."""
    return series.rolling_sum_in_parts(_hourly(spark, d), ["event_type"], 24, 1.0, part=100).select("event_type", "t", F.round("roll", 6).alias("roll"))


def series_rolling_partial(spark, d):
    return series.rolling_sum(_hourly(spark, d), ["event_type"], 72, False).select("event_type", "t", F.round("roll", 6).alias("roll"))


def series_step_hours(spark, d):
    return series.step_hours(_hourly(spark, d), ["event_type"])


def series_annual_maxima(spark, d):
    return series.annual_maxima(_daily(spark, d), ["o_orderpriority"], 72, 24).withColumn("mm", F.round("mm", 4))


def extremes_gumbel_fit(spark, d):
    fit = extremes.gumbel_fit(_monthly_maxima(spark, d), ["o_orderpriority"])
    return fit.select("o_orderpriority", F.round("mu", 4).alias("mu"), F.round("beta", 4).alias("beta"), "n")


def extremes_return_levels(spark, d):
    fit = extremes.gumbel_fit(series.annual_maxima(_daily(spark, d), ["o_orderpriority"], 72, 24), ["o_orderpriority"], min_maxima=3)
    return extremes.return_levels(fit, YEARS).select("o_orderpriority", "T", F.round("mm", 3).alias("mm"), "n")


def extremes_return_period(spark, d):
    fit = extremes.gumbel_fit(_monthly_maxima(spark, d), ["o_orderpriority"])
    days = _daily(spark, d).where("mm > 0").join(fit, "o_orderpriority")
    years = extremes.period(F.col("mu"), F.col("beta"), F.col("mm"))
    return days.select("o_orderpriority", "t", F.round("mm", 4).alias("mm"), F.round(years, 5).alias("years"))


def extremes_bootstrap_ci(spark, d):
    return extremes.bootstrap_levels(_monthly_maxima(spark, d), ["o_orderpriority"], YEARS)


def storms_decluster(spark, d):
    rolled = series.rolling_sum(_hourly(spark, d), ["event_type"], 24)
    return series.decluster(rolled.withColumn("roll", F.round("roll", 4)), ["event_type"], 5, 72)


def storm_context_windows(spark, d):
    filled = _hourly(spark, d).withColumn("mm", F.coalesce("mm", F.lit(0.0)))
    return series.storm_context(filled, ["event_type"]).select("event_type", "t", F.round("sum72", 5).alias("sum72"), F.round("max24", 5).alias("max24"))


def calendar_gaps_anti(spark, d):
    return series.missing_steps(series.resample(_table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice"), ["o_orderpriority"])


def upsert_keep_last(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "value")
    return series.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id", "t"], ["event_id"]).select("user_id", "t", "event_id", "value", "batch")


def full_outer_two_sources(spark, d):
    a = series.resample(_table(spark, d, "orders"), [], "o_orderdate", "o_totalprice")
    b = series.resample(_table(spark, d, "lineitem"), [], "l_shipdate", "l_extendedprice")
    return series.outer_on_day(a, b, ("ordered", "shipped")).select("t", F.round("ordered", 2).alias("ordered"), F.round("shipped", 2).alias("shipped"))


def _events_scenes(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'")


def event_scene_prepost(spark, d):
    return matching.pre_post(*_events_scenes(spark, d), "user_id")


def event_nearest_within(spark, d):
    return matching.nearest_within(*_events_scenes(spark, d), "user_id")


QUERIES = {f.__name__: f for f in (
    series_hourly_resample, series_rolling_full, series_rolling_parts, series_rolling_partial, series_step_hours, series_annual_maxima, extremes_gumbel_fit, extremes_return_levels,
    extremes_return_period, extremes_bootstrap_ci, storms_decluster, storm_context_windows, calendar_gaps_anti, upsert_keep_last, full_outer_two_sources,
    event_scene_prepost, event_nearest_within,
)}

HOURLY = """h0 AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(value) AS mm FROM events GROUP BY ALL),
hs AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM h0 GROUP BY event_type),
h AS (SELECT event_type, t, mm FROM hs LEFT JOIN h0 USING (event_type, t))"""
DAILY = """d0 AS (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS t, sum(o_totalprice) AS mm FROM orders GROUP BY ALL),
ds AS (SELECT o_orderpriority, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM d0 GROUP BY o_orderpriority),
d AS (SELECT o_orderpriority, t, coalesce(mm, 0) AS mm FROM ds LEFT JOIN d0 USING (o_orderpriority, t)),
dr AS (SELECT *, CASE WHEN count(mm) OVER w = 3 THEN sum(mm) OVER w END AS roll FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY t ROWS 2 PRECEDING)),
mx AS (SELECT o_orderpriority, year(t) * 100 + month(t) AS year, max(roll) AS mm FROM dr GROUP BY ALL HAVING max(roll) IS NOT NULL),
fit AS (SELECT o_orderpriority, avg(mm) - 0.5772156649 * 0.7796968012336761 * stddev_samp(mm) AS mu, stddev_samp(mm) * 0.7796968012336761 AS beta, count(*) AS n FROM mx GROUP BY ALL HAVING count(*) >= 10),
an AS (SELECT o_orderpriority, year(t) AS year, max(roll) AS mm, arg_min(CAST(t AS DATE), (-roll, t)) AS day FROM dr GROUP BY ALL HAVING count(mm) >= 300 AND max(roll) IS NOT NULL)"""
ROLL = "SELECT event_type, t, round({}, 6) AS roll FROM h WINDOW w AS (PARTITION BY event_type ORDER BY t ROWS {} PRECEDING)"
SCENES = """e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, CAST(ts AS DATE) AS scene FROM events WHERE event_type <> 'purchase')"""

SQL = {
    "series_hourly_resample": f"WITH {HOURLY} SELECT event_type, t, round(mm, 6) AS mm FROM h",
    "series_rolling_full": f"WITH {HOURLY} " + ROLL.format("CASE WHEN count(mm) OVER w = 24 THEN sum(mm) OVER w END", 23),
    "series_rolling_parts": f"WITH {HOURLY} " + ROLL.format("CASE WHEN count(mm) OVER w = 24 THEN sum(mm) OVER w END", 23),
    "series_rolling_partial": f"WITH {HOURLY} " + ROLL.format("sum(mm) OVER w", 71),
    "series_step_hours": f"WITH {HOURLY} SELECT event_type, min(g) AS step_h FROM (SELECT event_type, epoch(lead(t) OVER (PARTITION BY event_type ORDER BY t) - t) / 3600.0 AS g FROM h) GROUP BY ALL",
    "series_annual_maxima": f"WITH {DAILY} SELECT o_orderpriority, CAST(year AS INTEGER) AS year, round(mm, 4) AS mm, day FROM an",
    "extremes_gumbel_fit": f"WITH {DAILY} SELECT o_orderpriority, round(mu, 4) AS mu, round(beta, 4) AS beta, n FROM fit",
    "extremes_return_levels": f"""WITH {DAILY}, f AS (SELECT o_orderpriority, avg(mm) - 0.5772156649 * 0.7796968012336761 * stddev_samp(mm) AS mu,
        stddev_samp(mm) * 0.7796968012336761 AS beta, count(*) AS n FROM an GROUP BY ALL HAVING count(*) >= 3)
        SELECT o_orderpriority, CAST(T AS INTEGER) AS "T", round(mu - beta * ln(-ln(1 - 1.0 / T)), 3) AS mm, n FROM f, (SELECT unnest({YEARS}) AS T)""",
    "extremes_return_period": f"""WITH {DAILY} SELECT o_orderpriority, t, round(mm, 4) AS mm, round(1 / (1 - exp(-exp(-(mm - mu) / beta))), 5) AS years
        FROM d JOIN fit USING (o_orderpriority) WHERE mm > 0""",
    "storms_decluster": f"""WITH RECURSIVE {HOURLY}, r AS ({ROLL.format("CASE WHEN count(mm) OVER w = 24 THEN sum(mm) OVER w END", 23).replace(", 6)", ", 4)")}),
        o AS (SELECT event_type, t, roll, row_number() OVER (PARTITION BY event_type ORDER BY roll DESC, t) AS k FROM r WHERE roll > 0),
        g AS (SELECT event_type, 1 AS k, [t] AS picked FROM o WHERE k = 1 UNION ALL
          SELECT g.event_type, o.k, CASE WHEN len(picked) < 5 AND len(list_filter(picked, lambda p: abs(epoch(p) - epoch(o.t)) < 72 * 3600)) = 0 THEN list_append(picked, o.t) ELSE picked END
          FROM g JOIN o ON o.event_type = g.event_type AND o.k = g.k + 1),
        z AS (SELECT event_type, arg_max(picked, k) AS picked FROM g GROUP BY ALL),
        u AS (SELECT event_type, unnest(picked) AS t, unnest(range(1, len(picked) + 1)) AS rank FROM z)
        SELECT event_type, CAST(rank AS INTEGER) AS rank, t, roll FROM u JOIN o USING (event_type, t)""",
    "storm_context_windows": f"""WITH {HOURLY}, f AS (SELECT event_type, t, coalesce(mm, 0) AS mm FROM h),
        r AS (SELECT *, sum(mm) OVER (PARTITION BY event_type ORDER BY t ROWS 71 PRECEDING) AS sum72, sum(mm) OVER (PARTITION BY event_type ORDER BY t ROWS 23 PRECEDING) AS r24 FROM f)
        SELECT event_type, t, round(sum72, 5) AS sum72, round(max(r24) OVER (PARTITION BY event_type ORDER BY t ROWS 48 PRECEDING), 5) AS max24 FROM r""",
    "calendar_gaps_anti": f"WITH {DAILY} SELECT o_orderpriority, t FROM ds WHERE (o_orderpriority, t) NOT IN (SELECT o_orderpriority, t FROM d0)",
    "upsert_keep_last": """SELECT user_id, t, event_id, value, batch FROM (SELECT user_id, date_trunc('hour', ts) AS t, event_id, value, CAST(event_id % 3 = 0 AS INTEGER) AS batch,
        row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id % 3 = 0 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "full_outer_two_sources": """SELECT t, round(a.v, 2) AS ordered, round(b.v, 2) AS shipped FROM (SELECT date_trunc('day', o_orderdate) AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL) a
        FULL JOIN (SELECT date_trunc('day', l_shipdate) AS t, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL) b USING (t)""",
    "event_scene_prepost": f"""WITH {SCENES} SELECT e.user_id, event_id, day, max(scene) FILTER (WHERE scene >= day - 12 AND scene < day) AS pre, min(scene) FILTER (WHERE scene >= day AND scene <= day + 3) AS post
        FROM e LEFT JOIN s ON e.user_id = s.user_id GROUP BY ALL""",
    "event_nearest_within": f"""WITH {SCENES}, n AS (SELECT e.user_id, event_id, day, arg_min(scene, (abs(scene - day), scene)) FILTER (WHERE abs(scene - day) <= 3) AS scene
        FROM e LEFT JOIN s ON e.user_id = s.user_id GROUP BY ALL) SELECT *, CAST(abs(scene - day) AS INTEGER) AS days FROM n""",
}
