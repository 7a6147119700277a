"""Backward as-of merge with one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(base: DataFrame, other: DataFrame, keys: list[str], t: str, base_order: list[str], other_order: list[str], columns: list[str]) -> DataFrame:
    """base with the values of the latest row of other at or before it; of equal times the later row.

    Both sides are stacked, other first on equal times, and the last struct carried on.
    """
    kinds = {f.name: f.dataType for f in base.schema}
    value = F.struct(*columns)
    left = base.select(*base.columns, F.lit(1).alias("_side"), F.row_number().over(Window.partitionBy(*keys).orderBy(t, *base_order)).alias("_seq"))
    right = other.select(*keys, F.col(t), value.alias("_value"), F.lit(0).alias("_side"), F.row_number().over(Window.partitionBy(*keys).orderBy(t, *other_order)).alias("_seq"))
    for c in base.columns:
        if c not in right.columns:
            right = right.withColumn(c, F.lit(None).cast(kinds[c]))
    both = left.withColumn("_value", F.lit(None).cast(right.schema["_value"].dataType)).unionByName(right)
    w = Window.partitionBy(*keys).orderBy(t, "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*base.columns, *(F.col("_value")[c].alias(c) for c in columns))
