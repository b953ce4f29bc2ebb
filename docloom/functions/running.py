"""Running values over groups of any size.

A plain window sorts a whole group in one task. Here each group is cut into stretches of the ordering column;
windows run within stretches, and a stretch's totals are carried to the later ones by a window over one row
per stretch. A group that holds a third of all rows is spread over as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 100_000


def running(df: DataFrame, keys: list[str], order: str, value: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``place`` (1-based), ``before`` (sum of ``value`` over earlier rows of the group) and
    ``previous`` (``value`` of the row before, null on the first). ``order`` is a unique whole number; rows
    where it or ``value`` is null take part with 0 as their value."""
    cut = df.withColumn("_s", F.floor(F.col(order) / width)).withColumn("_v", F.coalesce(value, F.lit(0)))
    inner = Window.partitionBy(*keys, "_s").orderBy(order)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_place", F.row_number().over(inner)).withColumn("_before", F.sum("_v").over(earlier)).withColumn("_previous", F.lag("_v").over(inner))
    totals = cut.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.max_by("_v", order).alias("_last"))
    outer = Window.partitionBy(*keys).orderBy("_s")
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n0"), F.sum("_sum").over(past).alias("_sum0"), F.lag("_last").over(outer).alias("_last0"))
    same = F.col("_s").eqNullSafe(F.col("_t"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(carried, same)
    zero = F.lit(0).cast(cut.schema["_v"].dataType)
    return joined.select(*df.columns, (F.col("_place") + F.col("_n0")).cast("long").alias("place"), (F.coalesce("_before", zero) + F.coalesce("_sum0", zero)).alias("before"), F.coalesce("_previous", "_last0").alias("previous"))
