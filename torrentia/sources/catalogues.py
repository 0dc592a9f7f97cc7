"""Catalogues of scenes, sheets, tiles and downloads, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WATERWAYS = ("river", "stream", "canal", "drain", "ditch")
OVERPASS = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"
SHEETS = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def waterways(spark: SparkSession, path: str) -> DataFrame:
    """Answers of an Overpass query to osm_id, waterway, name, line; ways of other kinds or of fewer than two points are left out."""
    e = spark.read.schema(OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    kind = F.element_at("e.tags", F.lit("waterway"))
    kept = e.where((F.col("e.type") == "way") & kind.isin(*WATERWAYS) & (F.size("e.geometry") >= 2))
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return kept.select(F.col("e.id").alias("osm_id"), kind.alias("waterway"), F.element_at("e.tags", F.lit("name")).alias("name"), line.alias("line"))


def first_link(html: Column) -> Column:
    """The first href of a piece of markup; NULL without one."""
    return F.nullif(F.regexp_extract(html, r'href="([^"]+)"', 1), F.lit(""))


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a WFS to sheet, name, url, ring."""
    f = spark.read.schema(SHEETS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    of = lambda k: F.element_at("f.properties", F.lit(k))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select(F.regexp_extract(of("archivo"), r"([^/]*?)(\.[^./]*)?$", 1).alias("sheet"), of("nombre").alias("name"), first_link(of("link")).alias("url"), ring.alias("ring"))


def in_box(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether two boxes meet."""
    return (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])


def search(scenes: DataFrame, first: str, last: str, box: tuple[float, float, float, float], asset: str = "vv") -> DataFrame:
    """Scenes (t, x0, y0, x1, y1, assets) of the days first to last that meet the box and have the asset, by time."""
    when = F.to_date("t").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return scenes.where(when & in_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], box) & F.array_contains("assets", asset)).orderBy("t")


def _signed(v: Column, neg: str, pos: str, width: int) -> Column:
    return F.concat(F.when(v < 0, neg).otherwise(pos), F.lpad(F.abs(v).cast("string"), width, "0"))


def _degrees(x0: Column, y0: Column, x1: Column, y1: Column, name) -> Column:
    ys, xs = F.sequence(F.floor(y0), F.floor(y1)), F.sequence(F.floor(x0), F.floor(x1))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: name(y, x))))


def glo30_tiles(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Names of the one-degree tiles of the Copernicus elevation model that a box touches."""
    return _degrees(x0, y0, x1, y1, lambda y, x: F.concat(F.lit("Copernicus_DSM_COG_10_"), _signed(y, "S", "N", 2), F.lit("_00_"), _signed(x, "W", "E", 3), F.lit("_00_DEM")))


def fabdem_tiles(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(tile, archive): one-degree tiles in archives of ten degrees."""
    corner = lambda y, x: F.concat(_signed(y, "S", "N", 2), _signed(x, "W", "E", 3))
    ten = lambda v: F.floor(v / 10) * 10
    archive = lambda y, x: F.concat(corner(ten(y), ten(x)), F.lit("-"), corner(ten(y) + 10, ten(x) + 10), F.lit("_FABDEM_V1-2.zip"))
    return _degrees(x0, y0, x1, y1, lambda y, x: F.struct(F.concat(corner(y, x), F.lit("_FABDEM_V1-2.tif")).alias("tile"), archive(y, x).alias("archive")))


def water_tiles(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sorted names of ten-degree surface-water tiles, by their upper left corner."""
    lons = F.filter(F.sequence(F.floor(x0 / 10) * 10, F.ceil(x1 / 10) * 10, F.lit(10).cast("long")), lambda v: v < F.ceil(x1 / 10) * 10)
    tops = F.sequence(F.ceil(y0 / 10) * 10, F.ceil(y1 / 10) * 10, F.lit(10).cast("long"))
    side = lambda v, neg, pos: F.concat(F.abs(v).cast("string"), F.when(v < 0, neg).otherwise(pos))
    names = F.flatten(F.transform(lons, lambda x: F.transform(tops, lambda y: F.concat(side(x, "W", "E"), F.lit("_"), side(y, "S", "N")))))
    return F.sort_array(F.array_distinct(names))


def resume_days(cache: DataFrame, keys: list[str], t: str, value: str, start: str) -> DataFrame:
    """The day from which each series is fetched again: that of its last value, or start. Keys without any row aren't known here."""
    last = F.max(F.when(F.col(value).isNotNull(), F.col(t)))
    return cache.groupBy(*keys).agg(F.coalesce(F.to_date(last), F.lit(start).cast("date")).alias("first"))


def requests(series: DataFrame, first: str, last: str) -> DataFrame:
    """series with one row a request: from_day, to_day; each ends before New Year ten years after the year that it begins in."""
    years = F.sequence(F.lit(0), F.expr(f"(year({last}) - year({first})) div 10"))
    out = series.where(F.col(last) >= F.col(first)).withColumn("__k", F.explode(years))
    begin = F.when(F.col("__k") == 0, F.col(first)).otherwise(F.make_date(F.year(first) + 10 * F.col("__k"), F.lit(1), F.lit(1)))
    end = F.date_sub(F.make_date(F.year(first) + 10 * (F.col("__k") + 1), F.lit(1), F.lit(1)), 1)
    return out.withColumns({"from_day": begin, "to_day": F.least(F.col(last), end)}).where("from_day <= to_day").drop("__k")


def covered(sites: DataFrame, lat: str, most: float = 50.0) -> DataFrame:
    """Sites that the daily rain grid covers: those within so many degrees of the equator."""
    return sites.where(F.abs(F.col(lat)) <= most)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, or an empty table where the path has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    return spark.read.schema(schema).option("multiLine", True).json(path) if found else spark.createDataFrame([], schema)
