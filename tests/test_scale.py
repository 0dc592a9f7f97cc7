"""Joins, tasks and ties at size: what is dealt to neighbours isn't broadcast, dense segments are met by few points, points on a side agree with the SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from torrentia import scratch
from torrentia.operators import graph, matching, terrain


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_not_broadcast(spark, tmp_path):
    spark.range(400).selectExpr("id as cell", "id div 20 as row", "id % 20 as col", "cast(id * 7919 % 101 as double) as z").write.parquet(f"{tmp_path}/c")
    cells = spark.read.parquet(f"{tmp_path}/c")
    p = terrain.d8_pointer(cells)
    for df in (p, terrain.dinf_pointer(cells), terrain.gradients(cells), terrain.dinf_accumulation(cells, terrain.dinf_pointer(cells)), terrain.hand(cells, p, terrain.streams(terrain.flow_accumulation(p), 5.0))):
        assert "Broadcast" not in _plan(df)


def test_stars_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "written", lambda df: plans.append(_plan(df)) or scratch.written(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_grid_of_dense_segments_is_finer():
    assert matching._first_cell(10.0, 10, 10, 100.0, 100.0, 7.0, 3.0) == 10.0
    assert matching._first_cell(10.0, 60_000, 900_000, 100.0, 100.0, 7.0, 3.0) < 1.0
    assert matching._first_cell(10.0, 5, 1000, 0.0, 0.0, 0.0, 0.0) == 10.0


def test_nearest_segment_of_equal_segments_and_places(spark):
    segs = [(9, 0.0, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0, 0.0), (7, 50.0, 0.0, 51.0, 2.0)]
    pts = [(1, 0.5, 0.25), (2, 0.5, 0.25), (3, 80.0, 2.0), (4, None, 1.0)]
    got = matching.nearest_segment(spark.createDataFrame(pts, "pid long, px double, py double"), spark.createDataFrame(segs, "sid long, ax double, ay double, bx double, by double"), 10.0)
    assert {r.pid: (r.sid, r.dist) for r in got.collect()} == {1: (4, 0.25), 2: (4, 0.25), 3: (7, 29.0), 4: (None, None)}


@pytest.mark.parametrize("name", ["points_in_polygons", "rasterised_centres"])
def test_points_on_a_side_agree_with_the_sql(spark, tmp_path, name):
    """Balances in steps of a cent and keys of all remainders put points on the kites' sides; the SQL's doubles decide."""
    cents = [k * 137 + 9 for k in range(500)]
    pd.DataFrame({"s_suppkey": range(500), "s_acctbal": [c / 100 for c in cents], "s_nationkey": 0}).to_parquet(f"{tmp_path}/supplier.parquet")
    places = [(round(c / 100 + dx, 2), k) for c, k in zip(cents, range(500), strict=True) for dx in (s * 100 * (w - v) - 0.3 for s in (-1, 1) for w in (k % 7 + 3,) for v in (0.37, 1.37, 0.315))]
    pd.DataFrame({"c_custkey": [k % 89 + 97 * 89 * i for i, (_, k) in enumerate(places)], "c_acctbal": [b for b, _ in places]}).to_parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name]).df()[df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(want.itertuples(index=False, name=None))


def test_boxes_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(50).selectExpr("id as s_suppkey", "cast(id as double) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    df = entry.queries()["reprojected_boxes"](spark, str(tmp_path))
    assert "Generate" in _plan(df) and "hashpartitioning(s_suppkey" in _plan(df)
    assert df.agg(F.count(F.lit(1))).first()[0] == 50
