"""Series of one match: every operator is keyed, and ordered by columns that leave no ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(x: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to the row."""
    return F.last(x, ignorenulls=True).over(upto(keys, order))


def running_max(x: Column, keys: list[str], order: list[str]) -> Column:
    """The highest value so far; null before the first."""
    return F.max(x).over(upto(keys, order))


def running_count(condition: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(upto(keys, order)).cast("long")


def difference(x: Column, keys: list[str], order: list[str]) -> Column:
    """The step from the row before; null on the first row."""
    return x - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))


def every_nth(df: DataFrame, keys: list[str], order: list[str], fps: float, per_second: float, start_seconds: float = 0.0) -> DataFrame:
    """Frames from ``round(start * fps)`` on whose index is a multiple of ``round(fps / per_second)``, 1 at least.

    Adds frame_index. A rate of frames that is not positive counts as 29.97; ``per_second`` is 0.1 at least.
    """
    fps = fps if fps > 0 else 29.97
    interval, first = max(1, round(fps / max(0.1, per_second))), round(max(0.0, start_seconds) * fps)
    n = df.withColumn("frame_index", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    return n.filter((F.col("frame_index") >= first) & (F.col("frame_index") % interval == 0))


def bucket_number(df: DataFrame, keys: list[str], t: str, seconds: int = 10) -> DataFrame:
    """Adds bucket, from 1 on, anchored at the whole second of the first row of a key; its label is bucket * seconds."""
    origin = F.min(F.floor(t)).over(Window.partitionBy(*keys))
    relative = F.greatest(F.lit(1), F.floor(t) - origin + 1)
    return df.withColumn("bucket", (F.floor((relative - 1) / seconds) + 1).cast("long"))


def mode_high(x: Column) -> Column:
    """The commonest value that is not null, the higher one on ties (aggregate)."""
    return F.mode(F.when(x.isNotNull(), -x), True) * -1


def bucketed(df: DataFrame, keys: list[str], t: str, order: list[str], modes: list[str], lasts: list[str], seconds: int = 10) -> DataFrame:
    """One row for each bucket that has rows: modes of some columns, the last row's values of others.

    Buckets are pre-aggregated before the shuffle by value and count for modes, so
    no bucket is gathered.
    """
    b = bucket_number(df, keys, t, seconds)
    last = F.max_by(F.struct(*lasts), F.struct(*order))
    out = b.groupBy(*keys, "bucket").agg(*(mode_high(F.col(c)).alias(c) for c in modes), last.alias("_last"))
    return out.select(*keys, "bucket", *modes, *(F.col("_last")[c].alias(c) for c in lasts))


def gap_filled(df: DataFrame, keys: list[str], columns: list[str], seconds: int = 10) -> DataFrame:
    """Every bucket from 1 to the last; one without rows repeats the row before it, nulls and all. Adds timestamp."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    # a row stands for the buckets up to the next row's, the first one also, without values, for those before it
    begin = F.when(F.lag("bucket").over(w).isNull(), F.lit(1).cast("long")).otherwise(F.col("bucket"))
    end = F.coalesce(F.lead("bucket").over(w) - 1, F.col("bucket"))
    each = df.select(*keys, *columns, F.col("bucket").alias("_own"), begin.alias("_begin"), end.alias("_end")).withColumn("bucket", F.explode(F.sequence("_begin", "_end")))
    return each.select(*keys, "bucket", (F.col("bucket") * seconds).alias("timestamp"), *(F.when(F.col("bucket") >= F.col("_own"), F.col(c)).alias(c) for c in columns))


def _runs(df: DataFrame, keys: list[str], order: list[str], c: str) -> DataFrame:
    """Adds _run, the number of the run of equal values (null is a value) that the row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when((F.row_number().over(w) > 1) & F.lag(c).over(w).eqNullSafe(F.col(c)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(upto(keys, order))).drop("_new")


def _by_run(df: DataFrame, keys: list[str], order: list[str], c: str, replacement: Callable[[Callable[[int], Column], Callable[[int], Column]], Column]) -> DataFrame:
    """Each run's value replaced; ``replacement`` gets the values and lengths of the run (0) and of those after it (1, ...), null and 0 past the end.

    Runs are ranges of their number in a window, so no run is joined to its rows.
    """
    w = Window.partitionBy(*keys).orderBy("_run")
    value = lambda k: F.first(c).over(w.rangeBetween(k, k))
    length = lambda k: F.count(F.lit(1)).over(w.rangeBetween(k, k))
    return _runs(df, keys, order, c).withColumn("_to", replacement(value, length)).withColumn(c, F.col("_to")).drop("_run", "_to")


def short_runs_replaced(df: DataFrame, keys: list[str], order: list[str], c: str, short: int = 4, support: int = 6, near: int = 20) -> DataFrame:
    """A run of up to ``short`` rows takes the next run's value if that has ``support`` rows or more and differs by up to ``near``."""
    def to(value, length):
        return F.when((length(0) <= short) & (length(1) >= support) & (F.abs(value(1) - F.col(c)) <= near), value(1)).otherwise(F.col(c))

    return _by_run(df, keys, order, c, to)


def high_runs_lowered(df: DataFrame, keys: list[str], order: list[str], c: str, ahead: int = 3, step: int = 6, drop: int = 25) -> DataFrame:
    """A run falls to the next run's value if that is lower by up to ``drop`` and it and the runs after it, ``ahead`` in all, rise by up to ``step`` each."""
    def to(value, length):
        n = [value(k) for k in range(1, ahead + 1)]
        rising = F.lit(True)
        for a, b in zip(n, n[1:], strict=False):
            rising = rising & (b - a).between(0, step)
        return F.when((F.col(c) - n[0] > 0) & (F.col(c) - n[0] <= drop) & rising, n[0]).otherwise(F.col(c))

    return _by_run(df, keys, order, c, to)


def mode_smoothed(x: str, keys: list[str], order: list[str], reach: int = 2) -> Column:
    """The commonest value in the rows around, the higher one on ties."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    near = F.collect_list(x).over(w)
    counted = F.transform(F.array_distinct(near), lambda v: F.struct(F.size(F.filter(near, lambda u: u == v)).alias("n"), v.alias("v")))
    return F.array_max(counted)["v"]


def cluster_consensus(df: DataFrame, keys: list[str], order: list[str], c: str, reach: int = 4, gap: int = 2, least: int = 2) -> DataFrame:
    """A value becomes the rounded mean of the best cluster of the values in the rows around it.

    Sorted values form a cluster while each is within ``gap`` of the one before. The best
    has most values, then the mean nearest to the row's value, then the lowest mean;
    with fewer than ``least`` values the row keeps its own. A null row takes the cleaned value before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    values = F.array_sort(F.collect_list(F.col(c).cast("long")).over(w))
    none = F.array().cast("array<struct<n:bigint,total:bigint,last:bigint>>")

    def put(out: Column, v: Column) -> Column:
        tail = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct((tail["n"] + 1).alias("n"), (tail["total"] + v).alias("total"), v.alias("last"))))
        fresh = F.concat(out, F.array(F.struct(F.lit(1).cast("long").alias("n"), v.alias("total"), v.alias("last"))))
        return F.when((F.size(out) > 0) & (v - F.coalesce(F.try_element_at(out, F.lit(-1))["last"], v) <= gap), joined).otherwise(fresh)

    clusters = F.aggregate(values, none, lambda out, v: F.when(F.size(out) == 0, F.array(F.struct(F.lit(1).cast("long").alias("n"), v.alias("total"), v.alias("last")))).otherwise(put(out, v)))
    d = df.withColumn("_clusters", clusters)
    ranked = F.transform("_clusters", lambda k, i: F.struct(k["n"].alias("n"), (-F.abs(F.bround(k["total"] / k["n"]) - F.col(c))).alias("near"), (-i).alias("low"), F.bround(k["total"] / k["n"]).cast("long").alias("mean")))
    best = F.array_max(ranked)
    d = d.withColumn("_clean", F.when(F.col(c).isNull(), None).when(best["n"] < least, F.col(c).cast("long")).otherwise(best["mean"]))
    return d.withColumn(c, carried(F.col("_clean"), keys, order)).drop("_clusters", "_clean")


def clean_scores(df: DataFrame, keys: list[str], order: list[str], c: str) -> DataFrame:
    """Short runs, clusters, unsupported highs, then the running maximum."""
    d = short_runs_replaced(df, keys, order, c)
    d = cluster_consensus(d, keys, order, c)
    d = high_runs_lowered(d, keys, order, c)
    return d.withColumn(c, running_max(F.col(c), keys, order))
