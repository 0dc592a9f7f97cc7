"""Gumbel extremes by moments: fit, quantile, return period, seeded bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649
SCALE = 0.7796968012336761  # sqrt(6) / pi


def gumbel_fit(maxima: DataFrame, keys: list[str], value: str = "mm", min_maxima: int = 10) -> DataFrame:
    """mu, beta and n by key, where there are min_maxima values or more."""
    fit = maxima.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n")).where(F.col("n") >= min_maxima)
    return fit.select(*keys, (F.col("m") - EULER * SCALE * F.col("s")).alias("mu"), (F.col("s") * SCALE).alias("beta"), "n")


def quantile(mu: Column, beta: Column, years: Column) -> Column:
    """The value exceeded once in so many years."""
    return mu - beta * F.log(-F.log(1 - 1 / years))


def period(mu: Column, beta: Column, value: Column) -> Column:
    """Years between exceedances: infinite where the probability vanishes, NULL for a degenerate fit."""
    p = 1 - F.exp(-F.exp(-(value - mu) / F.nullif(beta, F.lit(0.0))))
    return F.when(beta > 0, F.when(p <= 0, F.lit(float("inf"))).otherwise(1 / F.nullif(p, F.lit(0.0))))


def return_levels(fit: DataFrame, years: list[int]) -> DataFrame:
    """The fit's rows for each period T, with the level mm."""
    out = fit.withColumn("T", F.explode(F.array(*map(F.lit, years))))
    return out.withColumn("mm", quantile(F.col("mu"), F.col("beta"), F.col("T")))


def bootstrap_levels(maxima: DataFrame, keys: list[str], years: list[int], order: str = "year", value: str = "mm", n_boot: int = 1000, seed: int = 0, level: float = 0.9, min_maxima: int = 10) -> DataFrame:
    """Percentile intervals of the levels from refitted resamples; the generator starts anew for each key, so results repeat."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        x = x[np.isfinite(x)]
        if len(x) < min_maxima:
            return pd.DataFrame(columns=[*keys, "T", "lo", "hi"])
        sample = np.random.default_rng(seed).choice(x, size=(n_boot, len(x)), replace=True)
        beta = sample.std(axis=1, ddof=1) * SCALE
        mu = sample.mean(axis=1) - EULER * beta
        out = []
        for t in years:
            q = mu - beta * np.log(-np.log(1 - 1 / t))
            lo, hi = np.quantile(q, [(1 - level) / 2, (1 + level) / 2])
            out.append((*[pdf[k].iloc[0] for k in keys], t, lo, hi))
        return pd.DataFrame(out, columns=[*keys, "T", "lo", "hi"])

    types = {f.name: f.dataType.simpleString() for f in maxima.schema}
    return maxima.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", T int, lo double, hi double")
