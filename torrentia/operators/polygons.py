"""Cells to polygons: regions of equal value, their boundary edges, and the rings that these close to.

A boundary edge is a side of a cell whose neighbour there has another label. It runs with its cell on the left, so outer rings are anticlockwise
and holes clockwise. At its end the next edge turns left if it can, so two cells of a label that only touch at a corner stay apart, as in regions of four
neighbours. Next edges are found by an equi-join on the corner, rings by pointer doubling (graph.chains): no region is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentia.operators import graph
from torrentia.scratch import large, written

# side of a cell: direction (0 east, 1 north, 2 west, 3 south), its neighbour, its first and last corner, as steps in row (downwards) and column
SIDES = ((0, 1, 0, 1, 0, 1, 1), (1, 0, 1, 1, 1, 0, 1), (2, -1, 0, 0, 1, 0, 0), (3, 0, -1, 0, 0, 1, 0))
_MIDDLE = 1 << 29  # rows and columns lie within this of 0


def regions(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells (cell, row, col, value) with label, the least cell of the four-connected region of equal value. Cells without a value are left out."""
    at = written(cells.where(F.col(value).isNotNull()).select("cell", "row", "col", F.col(value).alias("value")))
    ahead = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    dealt = at.select(F.col("cell").alias("a"), "value", "row", "col", F.explode(ahead).alias("s"))
    dealt = dealt.select("a", "value", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    met = dealt.join(at.select(F.col("cell").alias("b"), "value", "row", "col"), ["row", "col", "value"])
    label = graph.components(met.select("a", "b"))
    return at.join(label, F.col("cell") == F.col("node"), "left").select("cell", "row", "col", F.col("value").alias(value), F.coalesce("label", "cell").alias("label"))


def boundary(cells: DataFrame, label: str = "label") -> DataFrame:
    """cells (row, col, label) to their boundary edges: id, label, way (direction), fr, fc, tr, tc (corners from and to, as row and column lines)."""
    own = large(cells.select("row", "col", F.col(label).alias("label")).where("label is not null"))
    kinds = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("way", "nr", "nc", "fr", "fc", "tr", "tc"), s, strict=True)]) for s in SIDES])
    sides = own.select("row", "col", "label", F.explode(kinds).alias("s"))
    plus = lambda a, b: F.col(a) + F.col(f"s.{b}")
    sides = sides.select("label", "s.way", plus("row", "nr").alias("row"), plus("col", "nc").alias("col"), *[plus("row" if n[1] == "r" else "col", n).alias(n) for n in ("fr", "fc", "tr", "tc")])
    edges = sides.join(own, ["row", "col", "label"], "left_anti")
    number = F.shiftleft(F.col("fr") + F.lit(_MIDDLE).cast("long"), 33) + F.shiftleft(F.col("fc") + F.lit(_MIDDLE).cast("long"), 2) + F.col("way")
    return edges.select(number.alias("id"), "label", "way", "fr", "fc", "tr", "tc")


def ring_edges(cells: DataFrame, label: str = "label") -> DataFrame:
    """The boundary edges with ring (its least edge), seq (place in it) and corner (whether the ring turns at the edge's end)."""
    edges = written(boundary(cells, label))
    onward = edges.select("label", F.col("fr").alias("tr"), F.col("fc").alias("tc"), F.col("id").alias("next"), F.col("way").alias("then"))
    turn = F.pmod(F.col("then") - F.col("way"), F.lit(4))
    met = edges.join(onward, ["label", "tr", "tc"]).groupBy("id").agg(F.min(F.struct(F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2).alias("k"), "next")).alias("n"))
    links = written(met.select(F.col("id").alias("cell"), "n.next", F.lit(1.0).alias("length"), (F.col("n.k") != 1).alias("corner")))
    found = graph.chains(links).select(F.col("cell").alias("i"), F.col("chain").alias("ring"), "seq")
    ranked = edges.join(found, F.col("id") == F.col("i")).drop("i")
    return written(ranked.join(links.select(F.col("cell").alias("i"), "corner"), F.col("id") == F.col("i")).drop("i"))


def ring_measures(edges: DataFrame, res: float = 1.0) -> DataFrame:
    """label, ring, area (negative for holes), perimeter, n_vertices; added up in whole numbers."""
    cross = F.col("tc") * F.col("fr") - F.col("fc") * F.col("tr")  # y runs against rows
    out = edges.groupBy("label", "ring").agg(F.sum(cross).alias("twice"), F.count(F.lit(1)).alias("n"), F.count_if("corner").alias("n_vertices"))
    return out.select("label", "ring", (F.col("twice") / 2 * res * res).alias("area"), (F.col("n") * res).alias("perimeter"), "n_vertices")


def ring_vertices(edges: DataFrame, res: float = 1.0, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """label, ring, seq, x, y: the corners of the rings in order, points on straight stretches left out."""
    return edges.where("corner").select("label", "ring", "seq", (F.lit(left) + F.col("tc") * res).alias("x"), (F.lit(top) - F.col("tr") * res).alias("y"))


def polygons(edges: DataFrame, res: float = 1.0, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """label, shells and holes: arrays of rings (arrays of x, y). A region has one shell; a label of several regions has one for each."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rings = ring_vertices(edges, res, left, top).groupBy("label", "ring").agg(points.alias("points"))
    kind = ring_measures(edges).select(F.col("label").alias("l"), F.col("ring").alias("r"), "area")
    both = rings.join(kind, (F.col("label") == F.col("l")) & (F.col("ring") == F.col("r")))
    sorted_ = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("ring", "points")))), lambda r: r["points"])
    return both.groupBy("label").agg(sorted_(F.col("area") > 0).alias("shells"), sorted_(F.col("area") < 0).alias("holes"))
