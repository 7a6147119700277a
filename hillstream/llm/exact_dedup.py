"""Exact deduplication by a log-structured merge index of text digests [DataFrame functions only].

Rows are dealt to memtables of bounded size, so their number follows the data. A memtable is
reduced to one entry per digest and flushed as a run sorted by digest. Compaction merges runs
level by level, FANOUT at a time, until one is left. Each run has a Bloom filter of blocks: 64-bit words, one
of which holds the bits of a digest. Before runs are merged, every entry probes the filters of the other
runs of its merge; an entry that none of them may hold passes to the next level as it is, and only
the rest are grouped by digest, which keeps the best identifier and the number of members.
Rows of digests with several members are hits, and their normalised bytes are compared with those of the row that
stays. Should a comparison fail, all rows of that digest are grouped again by their bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hillstream.llm._store import Store

#: The characters of [\x20\x09-\x0D].
SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Rows of a memtable, runs that are merged at once, entries for each word of a filter and bits of an entry.
MEMTABLE, FANOUT, PER_WORD, PROBES = 1 << 17, 8, 4, 3


def normalised(text: Column) -> Column:
    """The text without white space; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _rank() -> Column:
    """Least for the row that stays: most code points, then the smallest doc_id, null last, then a digest of the original text."""
    return F.struct((-F.col("n")).alias("neg_n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "x")


def _stays(best: Column) -> Column:
    """Whether the row is the one that ``best`` ranks first."""
    return best["id"].eqNullSafe(F.col("doc_id")) & (best["neg_n"] == -F.col("n")) & (best["x"] == F.col("x"))


class MergeIndex:
    """A log-structured merge index: ``flush`` makes the runs of level 0, ``compact`` merges them to one.

    ``probed`` lists, for each merge, the written entries with ``maybe``: whether a filter of another run may hold the key.
    """

    def __init__(self, store: Store, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.store, self.memtable, self.fanout = store, max(1, memtable), max(2, fanout)
        self.runs, self.probed = 1, []

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows: key, doc_id, n, x. One sorted run for each memtable: run, key, best, members."""
        self.runs = max(1, -(-rows.count() // self.memtable))
        table = (rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "x"), F.lit(self.runs)))
                 .groupBy("run", "key").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("members")))
        return self.store.put(table.repartition("run").sortWithinPartitions("run", "key"), "level-0")

    def _probed(self, table: DataFrame, level: int) -> DataFrame:
        """Entries with maybe. A word of a filter holds PER_WORD entries on average, whatever the size of a run."""
        words = max(1, self.memtable * self.fanout**level // PER_WORD)
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key, {k}), 64) as int))") for k in range(1, PROBES + 1)))
        e = (table.withColumn("merge", F.expr(f"run div {self.fanout}")).withColumn("slot", F.col("run") % self.fanout)
             .withColumn("word", F.pmod(F.xxhash64("key", F.lit(0)), F.lit(words))).withColumn("bits", bits))
        w = Window.partitionBy("merge", "word")
        e = e.select("*", *(F.bit_or(F.when(F.col("slot") == k, F.col("bits"))).over(w).alias(f"filter_{k}") for k in range(self.fanout)))
        held = (F.coalesce((F.col("slot") != k) & (F.col(f"filter_{k}").bitwiseAND(F.col("bits")) == F.col("bits")), F.lit(False)) for k in range(self.fanout))
        return self.store.put(e.select(F.col("merge").alias("run"), "key", "best", "members", reduce(lambda a, b: a | b, held).alias("maybe")), f"probed-{level}")

    def compact(self, table: DataFrame) -> DataFrame:
        """Merge until one run is left: key, best, members."""
        runs, level = self.runs, 0
        while runs > 1:
            self.probed.append(self._probed(table, level))
            if level:
                self.store.drop(f"probed-{level - 1}")
            alone, shared = self.probed[-1].filter("not maybe"), self.probed[-1].filter("maybe")
            merged = shared.groupBy("run", "key").agg(F.min("best").alias("best"), F.sum("members").alias("members"))
            table = alone.select("run", "key", "best", "members").unionByName(merged)
            runs, level = -(-runs // self.fanout), level + 1
        return table.select("key", "best", "members")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = MEMTABLE, fanout: int = FANOUT,
                digest_bits: int = 256) -> DataFrame:
    """Rows whose texts are equal once white space is deleted.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Of equal texts the row with the most code points stays, then the one with the
    smallest doc_id (null last), then that with the least digest of its original text. A null text counts as empty, and empty
    texts are equal to each other. Rows that agree in doc_id and original text count in
    group_size and share one decision. An empty table gives no rows; other columns
    are ignored. ``digest_bits`` shortens the key that the index holds.
    """
    spark: SparkSession = docs.sparkSession
    store = Store(spark, "exact_dedup")
    # x tells the rows of one doc_id, or of none, apart
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("x"), F.col(text_col).alias("text"))
    full = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = store.put(base.select("doc_id", "x", full.alias("sha"), F.char_length(F.coalesce("text", F.lit(""))).alias("n")), "rows")
    rows = rows.withColumn("key", F.substring("sha", 1, digest_bits // 8))

    index = MergeIndex(store, memtable, fanout)
    shared = store.put(index.compact(index.flush(rows.select("key", "doc_id", "n", "x"))).filter("members > 1").withColumnRenamed("key", "shared_key"), "shared")
    own = F.struct((-F.col("n")).alias("neg_n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "x")
    looked = store.put(rows.join(shared, F.col("key") == F.col("shared_key"), "left").select(
        "doc_id", "x", "sha", "n", "key", F.coalesce("best", own).alias("best"), F.coalesce("members", F.lit(1)).cast("long").alias("group_size")), "looked")
    for name in ("rows", "level-0", f"probed-{len(index.probed) - 1}", "shared"):
        store.drop(name)

    hits = looked.filter("group_size > 1").select(F.col("doc_id").alias("hit_id"), F.col("x").alias("hit_x"), "key", _stays(F.col("best")).alias("is_owner")).distinct()
    found = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("x") == F.col("hit_x")))
    texts = store.put(found.select("key", "is_owner", normalised(F.col("text")).alias("norm")), "texts")
    # both sides of the comparison are written tables, so that the rows of a large group can be split among tasks
    owner = store.put(texts.filter("is_owner").groupBy("key").agg(F.first("norm").alias("owner_text")).withColumnRenamed("key", "owner_key"), "owner")
    unequal = store.put(texts.join(owner, F.col("key") == F.col("owner_key")).filter("norm <> owner_text").select("key"), "unequal")
    store.drop("texts")
    store.drop("owner")

    if not unequal.isEmpty():
        again = base.withColumn("norm", normalised(F.col("text"))).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        again = (again.withColumn("key", F.substring("sha", 1, digest_bits // 8)).join(unequal, "key", "left_semi")
                 .withColumn("n", F.char_length(F.coalesce("text", F.lit("")))))
        groups = again.groupBy("norm").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        again = again.join(groups, "norm").select("doc_id", "x", "sha", "n", "key", "best", "group_size")
        looked = looked.join(unequal, "key", "left_anti").unionByName(again)

    return looked.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", _stays(F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
