"""Readers, geometry and the streaming windows."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from torrentia.functions import geometry as G
from torrentia.sources import readers
from torrentia.streaming import rain


def test_hourly_document(spark, tmp_path):
    doc = {"latitude": -34.4, "longitude": -59.4, "hourly": {"time": ["2000-01-01T00:00", "2000-01-01T01:00"], "precipitation": [1.5, None]}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = readers.hourly_rain(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.t, r.mm) for r in got] == [(dt.datetime(2000, 1, 1, 0), 1.5), (dt.datetime(2000, 1, 1, 1), None)]


def test_cache_resumes_at_the_last_value(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,mm\n2000-01-01T00:00:00,1.0\n2000-01-02T00:00:00,\n2000-01-03T00:00:00,2.0\n2000-01-04T00:00:00,\n")
    got = readers.series_cache(spark, str(tmp_path)).orderBy("t").collect()
    assert [r.mm for r in got] == [1.0, None, 2.0]


def kml(*rings):
    parts = "".join(f"<Polygon><outerBoundaryIs><LinearRing><coordinates>\n {r} \n</coordinates></LinearRing></outerBoundaryIs></Polygon>" for r in rings)
    return f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><MultiGeometry>{parts}</MultiGeometry></Placemark></Document></kml>'


def test_parcel_is_the_largest_polygon(spark, tmp_path):
    (tmp_path / "a.kml").write_text(kml("0,0,0 1,0,0 1,1,0 0,1,0 0,0,0", "0,0 3,0 3,2 0,2 0,0"))
    assert readers.parcels(spark, str(tmp_path)).select(G.area(F.col("ring"))).first()[0] == 6.0
    (tmp_path / "b.kml").write_text(kml())
    with pytest.raises(Exception, match="no polygon"):
        readers.parcels(spark, str(tmp_path)).collect()


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    r = spark.range(1).select(
        G.area(ring).alias("a"), G.perimeter(ring).alias("p"), G.centroid(ring).alias("c"), G.contains(ring, F.lit(1.0), F.lit(1.0)).alias("i"), G.contains(ring, F.lit(5.0), F.lit(1.0)).alias("o"),
        G.mercator(F.lit(180.0), F.lit(0.0)).alias("m"), G.area(G.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("k"),
    ).first()
    assert (r.a, r.p, tuple(r.c), r.i, r.o) == (8.0, 12.0, (2.0, 1.0), True, False)
    assert abs(r.m.x - math.pi * G.EARTH_M) < 1e-6 and abs(r.m.y) < 1e-6 and abs(r.k - math.pi) < 2e-3


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [("a", dt.datetime(2000, 1, 1, h, 10), float(h)) for h in (0, 1, 2, 10, 11)] + [("b", dt.datetime(2000, 1, 1, 5), 1.0)]
    df = spark.createDataFrame(rows, "g string, t timestamp_ntz, mm double")
    want = {(r.g, r.start, r.mm) for r in rain.storms(df, "g", "t", "mm").collect()}
    assert {w[2] for w in want} == {3.0, 21.0, 1.0}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", dt.datetime(2000, 2, 1), 0.0)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rain.storms(stream, "g", "t", "mm").writeStream.format("memory").queryName("storms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.g, r.start, r.mm) for r in spark.table("storms").collect()}
    assert {g for g in got if g[0] != "z"} == want
