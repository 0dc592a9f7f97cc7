"""Linear referencing: segments put in order along merged lines, with running lengths; points every so far, at a distance, and distances of points.

Lines are merged at nodes where just two segment ends meet. Order comes from list ranking (graph.chains) over half edges, a segment's two directions: of the two ways
along a line the one stays in which its least segment runs from its a to its b. A closed line begins at its least segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.operators import graph
from torrentia.operators.matching import nearest_segment
from torrentia.scratch import large, written


def stream_segments(cells: DataFrame, pointers: DataFrame, stream: DataFrame, res: float = 1.0, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """Stream cells (cell) joined to the next one downstream where that is a stream cell too: sid (the cell), a, b (cells), ax, ay, bx, by (centres)."""
    x, y = F.lit(left) + (F.col("col") + 0.5) * res, F.lit(top) - (F.col("row") + 0.5) * res
    at = large(cells).join(stream.select(F.col("cell").alias("s")), F.col("cell") == F.col("s")).select("cell", x.alias("x"), y.alias("y"))
    first = at.select(F.col("cell").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    last = at.select(F.col("cell").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = pointers.where("next is not null").select(F.col("cell").alias("a"), F.col("next").alias("b"))
    return p.join(large(first), "a").join(large(last), "b").select(F.col("a").alias("sid"), "a", "b", "ax", "ay", "bx", "by")


def ordered(segments: DataFrame) -> DataFrame:
    """segments (sid of 0 and more, end nodes a and b, ax, ay, bx, by) to sid, line (its least sid), closed, seq, reversed, x0, y0, x1, y1, before and upto (lengths along the line at its ends), length, total.

    Lengths along the line are rounded to nine digits, since sums differ in the last ones by how they were added: so one segment ends where the next begins.
    """
    ends = F.array(
        F.struct(F.lit(0).alias("d"), F.col("a").alias("f"), F.col("b").alias("t"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1")),
        F.struct(F.lit(1).alias("d"), F.col("b").alias("f"), F.col("a").alias("t"), F.col("bx").alias("x0"), F.col("by").alias("y0"), F.col("ax").alias("x1"), F.col("ay").alias("y1")),
    )
    half = segments.select(F.col("sid").cast("long").alias("sid"), F.explode(ends).alias("e")).select("sid", "e.*")
    half = written(half.withColumns({"id": 2 * F.col("sid") + F.col("d"), "length": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))}))
    joint = half.groupBy(F.col("f").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    leave = half.join(joint, F.col("f") == F.col("node")).select(F.col("node").alias("t"), F.col("sid").alias("s"), F.col("id").alias("next"))
    # a segment that ends where it begins is next to itself
    onward = half.join(leave, "t").where((F.col("s") != F.col("sid")) | (F.col("next") == F.col("id")) & (F.col("f") == F.col("t"))).select(F.col("id").alias("i"), "next")
    links = half.join(onward, F.col("id") == F.col("i"), "left").select(F.col("id").alias("cell"), "next", "length")
    found = written(graph.chains(links))
    keep = found.groupBy(F.col("chain").alias("k")).agg(F.min("cell").alias("least")).where("least % 2 = 0")
    kept = found.join(keep, F.col("chain") == F.col("k")).select(F.col("cell").alias("i"), F.expr("least div 2").alias("line"), "closed", "seq", "before", "total")
    out = half.join(kept, F.col("id") == F.col("i"))
    return out.select("sid", "line", "closed", "seq", (F.col("d") == 1).alias("reversed"), "x0", "y0", "x1", "y1", F.round("before", 9).alias("before"), F.round(F.col("before") + F.col("length"), 9).alias("upto"), "length", F.round("total", 9).alias("total"))


def _between(t: Column) -> list[Column]:
    return [(F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y")]


def every(lines: DataFrame, step: float) -> DataFrame:
    """line, k, at, x, y: the points at 0, step, 2 step and so on along ordered lines, short of their end. Each segment has those of its own stretch."""
    first, stop = F.ceil(F.col("before") / step), F.ceil(F.col("upto") / step)
    dealt = lines.where(stop > first).withColumn("k", F.explode(F.sequence(first, stop - 1)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * step - F.col("before")) / F.col("length")))
    return dealt.select("line", "k", (F.col("k") * step).alias("at"), *_between(t))


def interpolate(places: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """places (pid, line, at) with the point x, y and the direction dx, dy (of length 1) there; distances off the line are moved to its ends.

    Segments and places meet by line and stretch of `cell` length, so that a long line is no hot key. Where segments meet the first that has a length has the point; a line without length has no direction.
    """
    lines, places = large(lines), large(places)
    whole = lines.groupBy(F.col("line").alias("l")).agg(F.max("total").alias("end"))
    p = places.join(whole, F.col("line") == F.col("l")).withColumn("at", F.least(F.greatest(F.col("at"), F.lit(0.0)), F.col("end"))).drop("l", "end")
    p = p.withColumn("piece", F.floor(F.col("at") / cell))
    s = lines.withColumn("piece", F.explode(F.sequence(F.floor(F.col("before") / cell), F.floor(F.col("upto") / cell))))
    met = p.join(s.select("line", "piece", "seq", "x0", "y0", "x1", "y1", "before", "length", "upto"), ["line", "piece"]).where("at between before and upto")
    size = F.nullif("length", F.lit(0.0))
    x, y = _between(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - F.col("before")) / size)), F.lit(0.0)))
    way = [((F.col(f"{c}1") - F.col(f"{c}0")) / size).alias(f"d{c}") for c in "xy"]
    return met.groupBy("pid", "line", "at").agg(F.min(F.struct((F.col("length") == 0).alias("none"), "seq", x, y, *way)).alias("m")).select("pid", "line", "at", "m.x", "m.y", "m.dx", "m.dy")


def project(points: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """points (pid, px, py) with the nearest segment's line, the distance along it of the nearest point (at), that point (x, y), and how far it is (dist)."""
    segments = lines.select("sid", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    near = nearest_segment(points, segments, cell).withColumnsRenamed({"pid": "p", "sid": "s"})
    met = large(points).join(near, F.col("pid") == F.col("p")).join(lines, F.col("s") == F.col("sid"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return met.select("pid", "line", (F.col("before") + t * F.col("length")).alias("at"), *_between(t), "dist")


def tangents(places: DataFrame, lines: DataFrame, cell: float, reach: float = 20.0) -> DataFrame:
    """places (pid, line, at, x, y) with dx, dy: from the point `reach` before on the line to the one `reach` after, for cross profiles."""
    shifted = places.select("pid", "line", F.explode(F.array(F.struct(F.lit(0).alias("k"), (F.col("at") - reach).alias("at")), F.struct(F.lit(1).alias("k"), (F.col("at") + reach).alias("at")))).alias("e"))
    ends = interpolate(shifted.select((F.struct("pid", "e.k")).alias("pid"), "line", "e.at"), lines, cell)
    both = ends.groupBy(F.col("pid.pid").alias("p")).agg(*[F.max(F.when(F.col("pid.k") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    return places.join(both, F.col("pid") == F.col("p")).select(*places.columns, (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))
