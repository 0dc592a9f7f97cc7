"""Matching by time and place: scenes before and after an event, nearest event, nearest line, overlaps."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.functions import geometry
from torrentia.operators.graph import components
from torrentia.scratch import dealt, large, written


def _merged(events: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """Both in one table, so that windows over it stand in for range joins: no pairs are made."""
    a = events.select(key, "event_id", F.col("day").alias("day"), F.lit(None).cast("date").alias("scene"))
    b = scenes.select(F.col(key), F.lit(None).cast("long").alias("event_id"), F.col("day"), F.col("day").alias("scene"))
    return a.unionByName(b).withColumn("d", F.datediff("day", F.lit("1970-01-01").cast("date")))


def pre_post(events: DataFrame, scenes: DataFrame, key: str, pre_days: int = 12, post_days: int = 3) -> DataFrame:
    """For each event the last scene in [day - pre_days, day) and the first in [day, day + post_days]; a scene on the day is after it."""
    by = W.partitionBy(key).orderBy("d")
    out = _merged(events, scenes, key)
    out = out.withColumn("pre", F.max("scene").over(by.rangeBetween(-pre_days, -1))).withColumn("post", F.min("scene").over(by.rangeBetween(0, post_days)))
    return out.where("event_id is not null").select(key, "event_id", "day", "pre", "post")


def nearest_within(events: DataFrame, scenes: DataFrame, key: str, days: int = 3) -> DataFrame:
    """For each event the nearest scene at most so many days away, the earlier one of two equally near."""
    by = W.partitionBy(key).orderBy("d")
    out = _merged(events, scenes, key)
    out = out.withColumn("a", F.max("scene").over(by.rangeBetween(-days, 0))).withColumn("b", F.min("scene").over(by.rangeBetween(0, days)))
    da, db = F.datediff("day", "a"), F.datediff("b", "day")
    near = F.when(F.col("b").isNull() | (da <= db), F.col("a")).otherwise(F.col("b"))
    return out.where("event_id is not null").select(key, "event_id", "day", near.alias("scene"), F.abs(F.datediff(near, "day")).alias("days"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _first_cell(cell: float, n: int, places: int, wide: float, high: float, mean_x: float, mean_y: float) -> float:
    """cell, halved as long as that saves more tries of places in a cell than it adds segments to the grid's cells."""
    dealt = lambda c: n * (mean_y / c + 3) * (min(mean_x / c, 3 * mean_x / mean_y if mean_y else mean_x / c) + 3)  # noqa: E731  rows of segments in cells
    cost = lambda c: 4 * dealt(c) + places * dealt(c) / (max(wide / c, 1.0) * max(high / c, 1.0))
    while cost(cell / 2) < cost(cell):
        cell /= 2
    return cell


def nearest_segment(points: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """points (pid, px, py) with the nearest segment (sid, ax, ay, bx, by), the least sid on ties, and its distance, however far.

    Segments are registered in the cells of a grid that they pass, and in the cells around; so a segment nearer than the cell's
    size is met by an equi-join. Points that meet none so near go to the next round, whose cells are twice as large. The first cells have
    `cell` or, where segments lie dense, less, so that a point meets few of them. Equal segments count once, and so do equal places. Without
    segments sid and dist are NULL.
    """
    points = points.select("pid", "px", "py").distinct()
    segments = written(dealt(segments.groupBy("ax", "ay", "bx", "by").agg(F.min("sid").alias("sid"))))
    length = [F.avg(F.abs(F.col(f"b{c}") - F.col(f"a{c}"))).alias(f"mean_{c}") for c in "xy"]
    ends = segments.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("ax", "ay", "bx", "by")], *length, F.count(F.lit(1)).alias("n")).first()
    left = written(points.select("px", "py").distinct())
    here = left.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1))).first()
    if ends[0] is None or here[0] is None:
        return points.select("pid", F.lit(None).cast(segments.schema["sid"].dataType).alias("sid"), F.lit(None).cast("double").alias("dist"))
    span = max(max(ends[k] for k in range(4, 8)), here[1], here[3]) - min(min(ends[k] for k in range(4)), here[0], here[2])
    wide, high = (max(ends[4 + k], ends[6 + k]) - min(ends[k], ends[2 + k]) for k in (0, 1))
    cell = _first_cell(cell, ends["n"], here[4], wide, high, ends["mean_x"], ends["mean_y"])
    found = []
    while True:
        last = cell > 2 * span  # so large that all meet
        grown = (F.least("ay", "by") - cell, F.greatest("ay", "by") + cell)
        rows = segments.withColumn("cy", F.explode(F.sequence(F.floor(grown[0] / cell), F.floor(grown[1] / cell))))
        dy = F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
        at = lambda y: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("ay")) / dy))  # noqa: B023, E731
        low, high = at((F.col("cy") - 1) * cell), at((F.col("cy") + 2) * cell)  # the part of the segment in this row of cells and the two beside it
        xs = [F.col("ax") + F.coalesce(t, F.lit(float(k))) * (F.col("bx") - F.col("ax")) for k, t in enumerate((low, high))]
        cells = rows.withColumn("cx", F.explode(F.sequence(F.floor(F.least(*xs) / cell) - 1, F.floor(F.greatest(*xs) / cell) + 1)))
        met = left.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)}).join(cells, ["cx", "cy"], "left")
        met = met.withColumn("dist", segment_distance(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]))
        near = written(met.groupBy("px", "py").agg(F.min(F.when(F.col("sid").isNotNull(), F.struct("dist", "sid"))).alias("m")))
        sure = F.lit(True) if last else F.coalesce(F.col("m.dist") <= cell, F.lit(False))
        found.append(near.where(sure).select(F.col("px").alias("x"), F.col("py").alias("y"), "m.sid", "m.dist"))
        left = near.where(~sure).select("px", "py")
        if last or not left.limit(1).count():
            break
        cell *= 2
    whole = reduce(lambda a, b: a.union(b), found)
    return large(points).join(large(whole), F.col("px").eqNullSafe(F.col("x")) & F.col("py").eqNullSafe(F.col("y"))).select("pid", "sid", "dist")


def in_order(rows: DataFrame, keys: list[str], contains: str, area: str, tie: str) -> DataFrame:
    """Of each key's frames the one that contains the place, else the largest; the least tie of equals."""
    best = F.min(F.struct((~F.col(contains)).alias("no"), (-F.col(area)).alias("a"), F.col(tie).alias("t"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(*keys).agg(best.alias("b")).select("b.row.*")


def match_radar(storms: DataFrame, radar: DataFrame, key: str, days: int = 3) -> DataFrame:
    """storms (key, event_id, day) with the radar event of the same id, else the one at most so many days away, and by which of both.

    radar: key, seq (its order), radar_event, event_day or else scene_day less days_since. Of equally near ones the first in order.
    """
    r = radar.withColumn("day", F.coalesce("event_day", F.expr("date_sub(scene_day, days_since)")))
    ids = r.select(F.col("radar_event").alias("same")).distinct()
    out = storms.join(ids, F.col("event_id") == F.col("same"), "left")
    first = r.where("day is not null").groupBy(key, "day").agg(F.min(F.struct("seq", "radar_event")).alias("r"))
    at = F.datediff("day", F.lit("1970-01-01").cast("date"))
    both = out.select(key, "event_id", "day", "same", F.lit(None).cast(first.schema["r"].dataType).alias("r"), F.lit(True).alias("storm"))
    both = both.unionByName(first.select(key, F.lit(None).cast("long").alias("event_id"), "day", F.lit(None).cast("long").alias("same"), "r", F.lit(False).alias("storm"))).withColumn("d", at)
    by, scene = W.partitionBy(key).orderBy("d"), F.when(~F.col("storm"), F.struct("d", "r"))
    both = both.withColumns({"before": F.max(scene).over(by.rangeBetween(-days, 0)), "after": F.min(scene).over(by.rangeBetween(0, days))})
    near = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.d") - F.col("d")).alias("away"), F.col(f"{c}.r").alias("r"))) for c in ("before", "after")]), lambda x: x.isNotNull()))
    matched = F.coalesce(F.col("same"), near["r"]["radar_event"])
    how = F.when(F.col("same").isNotNull(), "id").when(near.isNotNull(), "day")
    return both.where("storm").select(key, "event_id", "day", matched.alias("radar_event"), how.alias("matched_by"))


def overlap_share(sheets: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """sheets (sid, ring) and areas (aid, ring, convex) that overlap, with the per cent of the area that the sheet covers. They meet in the cells of a grid, and are clipped where their boxes overlap."""

    def gridded(df: DataFrame, name: str) -> DataFrame:
        of = lambda f, c: F.floor(f(F.transform("ring", lambda p: p[c])) / cell)
        df = df.withColumnRenamed("ring", name).withColumns({"ring": F.col(name), f"{name}_box": geometry.box_of(F.col(name))})
        df = df.withColumn("gx", F.explode(F.sequence(of(F.array_min, "x"), of(F.array_max, "x")))).withColumn("gy", F.explode(F.sequence(of(F.array_min, "y"), of(F.array_max, "y"))))
        return df.drop("ring")

    met = gridded(sheets, "sheet").join(gridded(areas, "area"), ["gx", "gy"]).drop("gx", "gy").dropDuplicates(["sid", "aid"])
    apart = " or ".join(f"sheet_box.{c}1 <= area_box.{c}0 or area_box.{c}1 <= sheet_box.{c}0" for c in "xy")
    # a generator works the common part out once: as an expression it would be made again wherever its area names it
    part = F.explode(F.array(geometry.clipped(F.col("sheet"), F.col("area"))))
    common = met.where(f"not ({apart})").select("sid", "aid", "area", part.alias("part")).where(F.size("part") > 2)
    whole = common.select("sid", "aid", F.explode(F.array(geometry.area(F.col("part")))).alias("common"), geometry.area(F.col("area")).alias("whole"))
    return whole.where("common > 0").select("sid", "aid", (100 * F.col("common") / F.col("whole")).alias("pct"))


def points_in_rings(points: DataFrame, rings: DataFrame, size: float, also: Column | None = None) -> DataFrame:
    """points (px, py, ...) with all rings (ring, ...) that they lie in and, where given, for which `also` holds; ring itself is left out.

    Rings are cut in slabs, and these are registered in those cells of a grid that they meet, so points try few rings that they don't lie in, by plain numbers. The size
    is a power of two, so that cells end where slabs do.
    """
    if math.frexp(size)[0] != 0.5:
        raise ValueError(f"the size of cells is a power of two, not {size}")
    cut = dealt(rings.where(F.size("ring") > 2)).withColumn("slab", F.explode(geometry.slabs(F.col("ring"), size))).select(*[c for c in rings.columns if c != "ring"], "slab.*")
    side = lambda a, y: F.col(a) + (y - F.col("lo")) * F.col(f"{a}s")
    ends = [side(a, F.col(y)) for a in "lr" for y in ("lo", "hi")]
    cells = cut.withColumn("gx", F.explode(F.sequence(F.floor(F.least(*ends) / size), F.floor(F.greatest(*ends) / size)))).withColumn("gy", F.floor(F.col("lo") / size))
    placed = points.withColumns({"gx": F.floor(F.col("px") / size), "gy": F.floor(F.col("py") / size)})
    px, py = F.col("px"), F.col("py")
    inside = (py >= F.col("lo")) & (py < F.col("hi")) & ((px < side("l", py)) != (px < side("r", py)))
    met = large(dealt(placed, "gx", "gy")).join(large(dealt(cells, "gx", "gy")), ["gx", "gy"]).where(inside if also is None else inside & also)
    return met.drop("gx", "gy", "lo", "hi", "l", "ls", "r", "rs")


def merged_lines(lines: DataFrame) -> DataFrame:
    """lines (sid, a, b: their end nodes) with the line that each becomes part of (its least sid): lines are merged where just two meet."""
    ends = lines.select("sid", F.explode(F.array("a", "b")).alias("node"))
    joints = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("n = 2 and a <> b")
    label = components(joints.select("a", "b"))
    return lines.join(label, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("label", "sid").alias("line"))


def new_only(scene: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the scene that the reference lacks."""
    return scene.join(reference, on, "left_anti")


def line_agreement(nearest: DataFrame, group: str, within: float) -> DataFrame:
    """Of sampled points' distances to the nearest line: median, ninth decile, and per cent within a distance."""
    p = F.percentile("dist", F.array(F.lit(0.5), F.lit(0.9)))
    out = nearest.groupBy(group).agg(p.alias("p"), (100 * F.avg((F.col("dist") <= within).cast("int"))).alias("pct_within"), F.count(F.lit(1)).alias("n"))
    return out.select(group, F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), "pct_within", "n")


def profile_kind(profile: DataFrame, key: str) -> DataFrame:
    """profile (key, x, z, line_dist) to incision (cm, the banks' median over the bed's least height) and kind: a mapped stream within 60 m, else a channel from 50 cm on, else a swale."""
    out = profile.groupBy(key).agg(
        F.percentile(F.when(F.abs("x").between(100, 200), F.col("z")), 0.5).alias("bank"), F.min(F.when(F.abs("x") <= 30, F.col("z"))).alias("bed"), F.min("line_dist").alias("line_dist")
    )
    cm = F.when(F.col("bank").isNotNull() & F.col("bed").isNotNull(), F.greatest((F.col("bank") - F.col("bed")) * 100, F.lit(0.0)))
    return out.select(key, cm.alias("incision_cm"), F.when(F.col("line_dist") <= 60, "stream").when(cm >= 50, "channel").otherwise("swale").alias("kind"))
