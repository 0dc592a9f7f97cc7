"""Statistics of scenarios, events and sources, and their documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scenario_stats(cells: DataFrame, keys: list[str], zones: dict[str, Column], depth: str = "depth", duration: str = "duration") -> DataFrame:
    """Of each scenario and zone: greatest and mean depth (m), per cent of cells above 5 and 20 cm, longest duration. Cells stream into partial aggregates."""
    d, found = F.col(depth), []
    for zone, inside in zones.items():
        of = lambda v: F.when(inside, v)  # noqa: B023, E731
        found += [
            F.max(of(d)).alias(f"hmax_{zone}"), F.avg(of(d)).alias(f"hmean_{zone}"), (100 * F.avg(of((d > 0.05).cast("int")))).alias(f"pct_gt5_{zone}"),
            (100 * F.avg(of((d > 0.20).cast("int")))).alias(f"pct_gt20_{zone}"), F.max(of(F.col(duration))).alias(f"dur_{zone}"),
        ]
    return cells.groupBy(*keys).agg(*found)


def mass_balance(runs: DataFrame, rain: str, infiltrated: str, stored: str, outflow: str) -> DataFrame:
    """runs with what doesn't add up in per cent of the rain, and the shares run off and left; NULL without rain."""
    r = F.nullif(F.col(rain), F.lit(0.0))
    error = 100 * (F.col(rain) - F.col(infiltrated) - F.col(stored) - F.col(outflow)) / r
    return runs.withColumns({"error_pct": error, "runoff_pct": 100 * (1 - F.col(infiltrated) / r), "stored_pct": 100 * F.col(stored) / r})


def first_column(df: DataFrame, names: list[str]) -> Column:
    """The first of the names that is a column of df; NULL if none is."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None))


def union_layouts(tables: list[DataFrame]) -> DataFrame:
    """Tables of different layouts by column name; what a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def indicator_maxima(rows: DataFrame, keys: list[str], event: str, reference: str, alternatives: dict[str, list[str]]) -> DataFrame:
    """The greatest value of each indicator (the first of its columns that is there) over rows of other events than the reference."""
    other = F.coalesce(F.col(event) != reference, F.lit(True))
    return rows.groupBy(*keys).agg(*[F.max(F.when(other, first_column(rows, names))).alias(i) for i, names in alternatives.items()])


def hourly_from_cumulative(series: DataFrame, keys: list[str], t: str, total: str, scale: Column) -> DataFrame:
    """series with mm: what each hour adds to the running total, times scale; 0 in the first."""
    before = F.lag(total).over(W.partitionBy(*keys).orderBy(t))
    return series.withColumn("mm", F.when(before.isNull(), F.lit(0.0)).otherwise((F.col(total) - before) * scale))


def nested(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """One row a key with an array of structs of the fields, in their order."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def lookup(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """One row a key with a map from name to value, the least value where a name repeats."""
    once = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(value).alias(value))
    return once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("of"))


def listed_scenarios(listed: DataFrame, saturated: DataFrame) -> DataFrame:
    """listed (id, p_mm, dur_h) as they are, and once more as wet soil for the ids in saturated (id)."""
    wet = listed.join(saturated.select("id").distinct(), "id", "left_semi").withColumns({"id": F.concat("id", F.lit("_sat")), "soil": F.lit("saturado")})
    return listed.withColumn("soil", F.lit("normal")).unionByName(wet)


def first_seen(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The distinct values of a key, in the order in which they first appear."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    return nested(first, keys, ["at", value], "v").select(*keys, F.transform("v", lambda x: x[value]).alias("values"))


def middle(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at index n div 2 of each key's rows in order."""
    by = W.partitionBy(*keys)
    out = rows.withColumns({"__at": F.row_number().over(by.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(by)})
    return out.where(F.col("__at") == F.expr("__n div 2")).drop("__at", "__n")


def storm_label(era: Column, chirps: Column) -> Column:
    """A storm's text by the first source that has its 72 h total."""
    mm = lambda v, source: F.format_string(f"Tormenta de %.0f mm en 72 h ({source})", F.bround(v.cast("double")))
    return F.when(era.isNotNull(), mm(era, "ERA5")).when(chirps.isNotNull(), mm(chirps, "CHIRPS")).otherwise("Tormenta (sin dato de mm)")
