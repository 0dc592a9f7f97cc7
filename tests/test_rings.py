"""Points in rings: cells and slabs find what the crossings of a ray find, and the query's points and kites are dealt out by cell."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from torrentia.functions import geometry as G
from torrentia.operators import matching

RINGS = {
    1: [(0.5, 0.25), (7.5, 0.25), (7.5, 6.75), (4.1, 1.3), (0.5, 6.75)],  # concave: two pieces in the upper rows
    2: [(0.5, 0.25), (0.5, 6.75), (4.1, 1.3), (7.5, 6.75), (7.5, 0.25), (0.5, 0.25)],  # the same the other way round, closed
    3: [(-9.3, -3.1), (-2.2, -5.7), (12.4, 3.9), (3.3, 11.2)],
    4: [(1.0, 2.0), (5.0, 2.0), (9.0, 2.0)],  # without height
    5: [(3.2, 3.3), (3.4, 3.3), (3.4, 3.6), (3.2, 3.6)],  # smaller than a cell
    6: [(0.0, 0.0), (8.0, 0.0), (8.0, 2.0), (2.0, 2.0), (2.0, 4.0), (8.0, 4.0), (8.0, 6.0), (0.0, 6.0)],  # on the cells' lines
    7: None,
    8: [],
    9: [(1.0, 1.0)],
}


def _tables(spark):
    rings = spark.createDataFrame([(k, None if r is None else [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "rid long, ring array<struct<x:double,y:double>>")
    at = spark.range(41 * 41).select("id", ((F.col("id") % 41) * 0.5 - 7.77).alias("px"), (F.floor(F.col("id") / 41) * 0.5 - 6.0).alias("py"))
    return at, rings


@pytest.mark.parametrize("size", [0.5, 2.0, 64.0])
def test_points_in_rings_as_by_crossings(spark, size):
    at, rings = _tables(spark)
    found = sorted(map(tuple, matching.points_in_rings(at, rings, size).select("rid", "id").collect()))
    want = at.crossJoin(rings.where("size(ring) > 1")).where(G.contains(F.col("ring"), F.col("px"), F.col("py"))).select("rid", "id").collect()
    assert found == sorted(map(tuple, want)) and len({r for r, _ in found}) == 5


def test_points_in_rings_with_a_condition_and_odd_sizes(spark):
    at, rings = _tables(spark)
    found = matching.points_in_rings(at, rings, 1.0, also=(F.col("px") < 1) & (F.col("rid") == 1)).select("px").collect()
    assert found and max(r.px for r in found) < 1
    for size in (0.3, 3.0, 0.0, -2.0):
        with pytest.raises(ValueError):
            matching.points_in_rings(at, rings, size)


def test_kites_and_points_of_one_file_are_dealt_out(spark, tmp_path):
    """One file each, as one task reads it: pairs are tried by plain numbers, in as many tasks as a shuffle has."""
    spark.range(300).selectExpr("id as s_suppkey", "cast(id * 37 % 11000 as double) - 999.99 as s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(900).selectExpr("id as c_custkey", "cast(id * 61 % 11000 as double) - 999.5 as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = entry.queries()["points_in_polygons"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") >= 3 and "element_at" not in next(line for line in plan.splitlines() if "Join" in line)
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["points_in_polygons"]).df()[df.columns]
    assert len(want) and sorted(map(tuple, df.collect())) == sorted(want.itertuples(index=False, name=None))
