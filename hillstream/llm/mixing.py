"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Weighted targets are levelled so that none exceeds a given multiple
of its source. The mix is cut into equal blocks of words; the sources get
the blocks by highest quotients target / (2k + 1). A source is dealt into shards by a
seeded hash, its blocks go to its shards by highest quotients of their sizes, and so
every shard has an integer quota. In a shard the documents stand in seeded order and
their words form a ring of blocks: whole rounds of the ring are taken while the
quota lasts and the rest is one run of blocks from a seeded start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hillstream.llm._store import Store

WORD = r"[^\x20\x09-\x0D]+"


def levelled(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """sources: source, source_size. Adds place (by code point, null last), weight and target.

    Every source below its cap gets level * weight with one common level. The level
    is found in one pass over the sources by cap / weight: the first that is not cut
    off when all before it are. There is one row per source; the window sorts and
    can spill, and nothing is collected.
    """
    by_place = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    t = (sources.withColumn("place", F.row_number().over(by_place) - 1).withColumn("weight", w)
         .withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    before = Window.orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.col("heft")))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "place", "level"))).over(everything)["level"])
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "place", "weight", "target")


def apportioned(items: DataFrame, by: list[str], key: str, share: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: in each group of ``by``, give ``seats`` (equal in the group) to items by ``share``.

    Rounding share / (sum / seats) gives seats of which at most one for every two items
    are too many or too few; those go back or out by lowest or highest quotients. An
    item can be concerned by its part of (that difference + items) + 2 quotients, so a
    few quotients per item are compared.
    """
    group = Window.partitionBy(*by)
    total, kept = F.sum(share).over(group), [c for c in items.columns]
    t = (items.withColumn("_sum", total).withColumn("_items", F.count(F.lit(1)).over(group))
         .withColumn("_base", F.when((F.col("_sum") > 0) & (F.col(seats) > 0), F.floor(F.col(share) * F.col(seats) / F.col("_sum") + 0.5)).otherwise(0).cast("long")))
    t = t.withColumn("_off", F.col(seats) - F.sum("_base").over(group))
    need = F.when((F.col("_off") == 0) | (F.col("_sum") == 0) | (F.col(share) == 0), 0).otherwise(
        F.ceil(F.col(share) / F.col("_sum") * (F.abs("_off") + F.col("_items"))) + 2).cast("long")
    need = F.when(F.col("_off") < 0, F.least(need, F.col("_base"))).otherwise(need)
    t = t.withColumn("_k", F.explode_outer(F.when(need > 0, F.sequence(F.lit(1).cast("long"), need))))
    seat = F.when(F.col("_off") > 0, F.col("_base") + F.col("_k")).otherwise(F.col("_base") - F.col("_k") + 1)
    t = t.withColumn("_quotient", F.col(share) / (2 * seat - 1))
    more = F.col("_off") > 0
    first = Window.partitionBy(*by).orderBy(F.when(more, -F.col("_quotient")).otherwise(F.col("_quotient")).asc_nulls_last(), F.when(more, F.col(key)).asc(), F.col(key).desc())
    t = t.withColumn("_moved", F.when(F.col("_quotient").isNotNull() & (F.row_number().over(first) <= F.abs("_off")), F.signum("_off")).otherwise(0))
    return t.groupBy(*kept).agg((F.first("_base") + F.sum("_moved")).cast("long").alias(out))


def _number(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts; nulls are passed over."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
        most: int = 3, block_words: int | None = None, shard_words: int = 1 << 20, most_shards: int = 1 << 16, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """What a mix of the sources takes of each document.

    Returns one row per input row: doc_id, size, source_size, target, taken and the
    parts of ``taken``: rounds (whole copies) and two word ranges [from_1, to_1) and
    [from_2, to_2) of the last one. taken never exceeds ``most`` times size. Null and
    empty texts have size 0 and are taken with 0 words; a null source is a source of
    its own, after all others. Reruns give the same rows; repeated rows are placed one after the
    other. Without rows or words the result is empty or 0. ``block_words`` defaults to
    the smallest positive target / 128, from 1 to 1024, so small sources round finely. A source has a shard for each
    ``shard_words`` of its words, but ``most_shards`` at most, whose quotas one window can apportion.
    Rows without a doc_id are dealt by their texts.
    ``row_col``, if given, tells rows with one doc_id or none apart and is returned too.
    """
    more = [row_col] if row_col else []
    lit = F.lit
    store = Store(docs.sparkSession, "mixing")
    rows = store.put(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                 F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                                 F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("alone"), *more), "rows")
    everything = Window.partitionBy()
    t = levelled(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    auto = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything) / 128)))
    t = (t.withColumn("block", F.coalesce(F.lit(block_words), auto, F.lit(1)).cast("long"))
         .withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("long")).withColumn("all", F.lit(0)))
    sources = store.put(apportioned(t, ["all"], "place", "target", "blocks", "source_blocks")
                        .withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(most_shards), F.ceil(F.col("source_size") / shard_words))).cast("long"))
                        .select(F.col("source").alias("s_source"), "place", "source_size", "target", "block", "source_blocks", "shards"), "sources")

    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).select(
        "doc_id", "size", "place", "source_size", "target", "block", "source_blocks", "alone", *more,
        F.pmod(_number(lit(seed), lit("shard"), F.col("doc_id"), F.col("alone")), F.col("shards")).alias("shard"), _number(lit(seed), lit("order"), F.col("doc_id"), F.col("alone")).alias("turn"))
    parts = dealt.groupBy("place", "block", "source_blocks", "shard").agg(F.sum("size").cast("double").alias("words"))
    quotas = store.put(apportioned(parts, ["place"], "shard", "words", "source_blocks", "quota")
                       .select(F.col("place").alias("p_place"), F.col("shard").alias("p_shard"), F.col("words").cast("long").alias("words"), "quota"), "quotas")

    along = Window.partitionBy("place", "shard").orderBy("turn", "doc_id", "size", "alone", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = (dealt.withColumn("to", F.sum("size").over(along)).withColumn("from", F.col("to") - F.col("size"))
         .join(quotas, (F.col("place") == F.col("p_place")) & (F.col("shard") == F.col("p_shard"))))
    x = x.withColumn("n", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / F.col("block")))).otherwise(0).cast("long"))
    x = x.withColumn("quota", F.least(F.col("quota"), most * F.col("n")))
    x = (x.withColumn("rounds", F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(0).cast("long"))
         .withColumn("rest", F.col("quota") - F.col("rounds") * F.col("n"))
         .withColumn("start", F.when(F.col("n") > 0, F.pmod(_number(lit(seed), lit("start"), F.col("place"), F.col("shard")), F.col("n"))).otherwise(0)))
    cut = lambda j: F.when(F.col("n") > 0, F.expr(f"(({j}) * words) div n")).otherwise(0).cast("long")  # noqa: E731  where block j of n equal ones begins
    a1, b1, b2 = cut("start"), cut("least(start + rest, n)"), cut("greatest(0, start + rest - n)")
    zero = F.lit(0).cast("long")
    x = x.withColumn("len_1", _overlap(F.col("from"), F.col("to"), a1, b1)).withColumn("len_2", _overlap(F.col("from"), F.col("to"), zero, b2))
    x = x.withColumn("from_1", F.when(F.col("len_1") > 0, F.greatest(F.col("from"), a1) - F.col("from")).otherwise(zero)).withColumn("from_2", zero)
    return x.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("len_1") + F.col("len_2")).alias("taken"),
                    "rounds", "from_1", (F.col("from_1") + F.col("len_1")).alias("to_1"), "from_2", (F.col("from_2") + F.col("len_2")).alias("to_2"), *more)
