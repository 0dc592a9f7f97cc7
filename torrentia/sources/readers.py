"""Readers: hourly rain documents, series caches, parcel polygons, stored depth frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torrentia.functions import geometry, scalars

HOURLY = "latitude double, longitude double, timezone string, utc_offset_seconds int, hourly_units struct<time:string,precipitation:string>, hourly struct<time:array<string>,precipitation:array<double>>"


def hourly_rain(spark: SparkSession, path: str) -> DataFrame:
    """Documents with parallel arrays of times and rain to rows: latitude, longitude, t, mm (NULL where missing)."""
    docs = spark.read.schema(HOURLY).option("multiLine", True).json(path)
    pairs = F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.precipitation").alias("mm")))
    rows = docs.select("latitude", "longitude", pairs.alias("p"))
    return rows.select("latitude", "longitude", F.to_timestamp_ntz("p.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("t"), F.col("p.mm").alias("mm"))


def series_cache(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of t, mm; rows without a value at the end of a cache are to be fetched again, so they are dropped."""
    rows = spark.read.schema("t timestamp_ntz, mm double").option("header", True).option("nanValue", "").csv(path)
    rows = rows.withColumn("mm", scalars.finite(F.col("mm")))
    last = rows.agg(F.max(F.when(F.col("mm").isNotNull(), F.col("t"))).alias("last"))
    return rows.join(F.broadcast(last), F.col("t") <= F.col("last")).drop("last")  # one row


def parcels(spark: SparkSession, path: str) -> DataFrame:
    """KML files to file, ring: the outer ring of the largest polygon, as longitude and latitude; files without a polygon are an error."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    outer = "//*[local-name()='Polygon']/*[local-name()='outerBoundaryIs']//*[local-name()='coordinates']/text()"
    point = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    rings = F.transform(F.xpath("value", F.lit(outer)), lambda t: F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), point))
    found = files.withColumn("rings", rings)
    return found.select("file", F.when(F.size("rings") > 0, geometry.largest(F.col("rings"))).otherwise(F.raise_error(F.concat(F.lit("no polygon in "), "file"))).alias("ring"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Stored depth frames, an array of hours a cell, as rows: scenario, row, col, hour, h_cm."""
    return spark.read.parquet(path).select("scenario", "row", "col", F.posexplode("h_cm").alias("hour", "h_cm"))
