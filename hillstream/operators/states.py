"""Debounced states and the counts made from them, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hillstream.operators.series import carried, upto


def debounced(v: str, keys: list[str], order: list[str]) -> Column:
    """The last value read twice in a row; a null read lies between reads."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return carried(F.when(F.col(v) == F.lag(v).over(w), F.col(v)), keys, order)


def cycle_counts(df: DataFrame, v: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds accepted, and uses: how often the accepted state has come back to 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("accepted", debounced(v, keys, order))
    starts = F.when((F.col("accepted") == 1) & ~F.lag("accepted").over(w).eqNullSafe(F.lit(1)), 1).otherwise(0)
    d = d.withColumn("_starts", starts)
    return d.withColumn("uses", F.greatest(F.lit(0), F.sum("_starts").over(upto(keys, order)) - 1).cast("long")).drop("_starts")


def absence_counts(df: DataFrame, active: str, t: str, keys: list[str], order: list[str], seconds: float = 25.0, reads: int = 2) -> DataFrame:
    """Adds uses: how often something, once seen ``reads`` times in a row, was then away for ``seconds``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(active).over(w).eqNullSafe(F.col(active)), 0).otherwise(1)
    d = df.withColumn("_change", change).withColumn("_island", F.sum("_change").over(upto(keys, order)))
    inside = Window.partitionBy(*keys, "_island")
    along = inside.orderBy(*order)
    d = d.withColumn("_gone", F.col(t) - F.min(t).over(inside)).withColumn("_len", F.row_number().over(along))
    d = d.withColumn("_arms", F.col(active) & (F.col("_len") == reads))
    late = ~F.col(active) & (F.col("_gone") >= seconds)
    d = d.withColumn("_late", late & ~F.coalesce(F.lag(late).over(along), F.lit(False)))
    armed = F.last(F.when(F.col("_arms"), True).when(F.col("_late"), False), ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_use", F.col("_late") & F.coalesce(armed, F.lit(False)))
    d = d.withColumn("uses", F.sum(F.col("_use").cast("int")).over(upto(keys, order)).cast("long"))
    return d.drop("_change", "_island", "_gone", "_len", "_arms", "_late", "_use")
