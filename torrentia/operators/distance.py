"""Exact Euclidean distances over the cells of a raster, and buffers by them.

The distance transform is separable: in a column each feature cell is the nearest for a stretch of rows, by windows over the column's features; and the least of
(columns apart)**2 + (rows apart)**2 along a row is the lower envelope of parabolas, one pass over the row. So a task has one column, then one row, of the raster, whatever its tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def envelope(col: np.ndarray, lift: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of (x - col)**2 + lift over all (col, lift), for each x of at; col ascends. Infinite without any."""
    if len(col) == 0:
        return np.full(len(at), np.inf)
    hull, edge = [], []  # the parabolas of the lower envelope, and where each of them begins
    for k, (c, g) in enumerate(zip(col.tolist(), lift.tolist(), strict=True)):
        start = -np.inf
        while hull:
            d, h = col[hull[-1]], lift[hull[-1]]
            start = (g + c * c - h - d * d) / (2.0 * (c - d))
            if start > edge[-1]:
                break
            hull.pop()
            edge.pop()
            start = -np.inf
        hull.append(k)
        edge.append(start)
    pick = np.array(hull)[np.searchsorted(np.array(edge), at, side="right") - 1]
    return (at - col[pick]) ** 2 + lift[pick]


def transform(cells: DataFrame, features: DataFrame, res: float = 1.0) -> DataFrame:
    """cells (row, col, other columns) with dist, from the centre of each to that of the nearest feature cell (row, col); infinite without features.

    Features need not be among the cells, and cells may be missing. Repeated ones count once.
    """
    reach = cells.agg(F.min("row"), F.max("row")).first()
    if reach[0] is None:
        return cells.withColumn("dist", F.lit(float("inf")))
    by = W.partitionBy("col").orderBy("row")
    marks = features.select("row", "col").where("row is not null and col is not null").distinct()
    marks = marks.withColumns({"before": F.lag("row").over(by), "then": F.lead("row").over(by)})
    # in its column a feature is the nearest from halfway to the one above to halfway to the one below
    lo = F.greatest(F.coalesce(F.floor((F.col("before") + F.col("row")) / 2) + 1, F.lit(reach[0])), F.lit(reach[0]))
    hi = F.least(F.coalesce(F.floor((F.col("row") + F.col("then")) / 2), F.lit(reach[1])), F.lit(reach[1]))
    lifts = marks.where(lo <= hi).select("col", "row", F.explode(F.sequence(lo, hi)).alias("r"))
    lifts = lifts.select("r", F.col("col").alias("c"), F.pow((F.col("r") - F.col("row")).cast("double"), F.lit(2.0)).alias("lift"))

    def along(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        above = above.sort_values("c")
        square = envelope(above["c"].to_numpy(np.float64), above["lift"].to_numpy(), own["c"].to_numpy(np.float64))
        return own.assign(dist=np.sqrt(square) * res)

    places = cells.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c")).where("r is not null and c is not null").distinct()
    found = places.groupBy("r").cogroup(lifts.groupBy("r")).applyInPandas(along, "r long, c long, dist double")
    return cells.join(found, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left").drop("r", "c")


def buffer(cells: DataFrame, features: DataFrame, radius: float, res: float = 1.0) -> DataFrame:
    """The cells whose centre lies within radius of a feature cell's centre: a buffer round what was rasterised to the features."""
    return transform(cells, features, res).where(F.col("dist") <= radius).drop("dist")
