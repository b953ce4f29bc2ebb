"""Closed-form statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share, within [0, 1]; (0, 0) where there is nothing."""
    p, z2 = successes / F.nullif(n, F.lit(0)), z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def pearson(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(keys, n, r) over rows with both values; null below ``least`` rows or for a constant side. The means are
    taken first, so large values don't cancel."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    sums = pairs.join(means, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))).alias("sxy"), F.sum(F.pow(F.col("x") - F.col("mx"), 2)).alias("sxx"), F.sum(F.pow(F.col("y") - F.col("my"), 2)).alias("syy"))
    usable = (F.col("n") >= least) & (F.col("sxx") > 1e-12) & (F.col("syy") > 1e-12)
    return sums.select(*keys, "n", F.when(usable, F.col("sxy") / F.sqrt(F.when(usable, F.col("sxx") * F.col("syy")))).alias("r"))
