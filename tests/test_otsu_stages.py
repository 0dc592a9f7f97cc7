from torrentia.operators import raster


def test_thresholds_and_cells_are_not_in_one_plan(spark):
    """No task holds the histograms, their windows and the sorted cells at once."""
    cells = spark.createDataFrame([(k, float(v % (7 + k))) for k in range(3) for v in range(50)], "k int, v double")
    out = raster.otsu_guarded(cells, ["k"], "v", 100.0, -1.0, 1.0)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.threshold for r in out.collect()} == {r.k: r.threshold for r in raster.otsu(cells, ["k"], "v").collect()}
