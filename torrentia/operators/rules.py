"""The verdict: indicators against threshold rules, the worst level of each component, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("BAJO", "MEDIO-BAJO", "MEDIO", "ALTO")
# Component, indicator, direction (ge: at or above, lt: below), and the threshold of each level.
RULES = (
    ("lluvia_local", "depresion_prof_max_m", "ge", {"MEDIO": 0.10, "ALTO": 0.30}),
    ("lluvia_local", "cuenca_aportante_ha", "ge", {"MEDIO": 5, "ALTO": 50}),
    ("lluvia_local", "hmax_lote_100mm_cm", "ge", {"MEDIO-BAJO": 5, "MEDIO": 10, "ALTO": 20}),
    ("lluvia_local", "pct_lote_gt5cm_100mm", "ge", {"MEDIO": 50}),
    ("desborde", "hand_min_m", "lt", {"ALTO": 0.5, "MEDIO": 1.0, "MEDIO-BAJO": 2.0}),
    ("desborde", "jrc_occ_lote_pct", "ge", {"ALTO": 0.0001}),
    ("desborde", "sar_agua_lote_pct_max", "ge", {"ALTO": 5}),
    ("desborde", "sar_agua_aoi_pct_max", "ge", {"MEDIO": 10}),
    ("desborde", "pct_aoi_gt20cm_150mm", "ge", {"MEDIO": 10}),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(c, i, d, LEVELS.index(level), float(t)) for c, i, d, steps in rules for level, t in steps.items()]
    return spark.createDataFrame(rows, "component string, indicator string, dir string, rank int, threshold double")


def verdict(indicators: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """indicators (key, indicator, value, NULL if missing) to one row a key and component: level, reasons, missing, and the key's overall level."""
    met = F.when(F.col("dir") == "ge", F.col("value") >= F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    hit = indicators.join(F.broadcast(rules), "indicator").groupBy(key, "component", "indicator").agg(F.max(F.when(met, F.col("rank"))).alias("rank"), F.bool_or(F.col("value").isNull()).alias("gone"))
    per = hit.groupBy(key, "component").agg(
        F.coalesce(F.max("rank"), F.lit(0)).alias("rank"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("rank") > 0, F.col("indicator")))), ",").alias("reasons"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("indicator")))), ",").alias("missing"),
    )
    top = per.groupBy(key).agg(F.max("rank").alias("top"))
    name = lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), F.col(c) + 1)
    return per.join(top, key).select(key, "component", name("rank").alias("level"), "reasons", "missing", name("top").alias("overall"))


def cuts(rules, indicator: str, last: float) -> tuple[float, ...]:
    """The class limits of an indicator: its thresholds in order, then last."""
    return (*sorted(float(t) for _, i, _, steps in rules if i == indicator for t in steps.values()), last)
