"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hillstream.llm._store import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """edges: a, b (any order, loops allowed). Returns node, root, with root the least node reachable.

    Every step works on edges only and is written to the shared folder; no
    neighbourhood is gathered in one place: minima are pre-aggregated and written, so
    that the join to the edges of a hub is one of plain shuffles, whose rows can be split.
    Steps go on until the edges stay the same; their number grows with the logarithm of the longest chain.
    """
    now = store.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star-0")
    mark = _mark(now)
    for step in count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"least-{step}")
        large = store.put(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        then = store.put(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), f"star-{step}")
        store.drop(f"star-{step - 1}")
        store.drop(f"large-{step}")
        store.drop(f"least-{step}")
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that stay the same only when the edges do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
