"""From documents to token ids: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), where docs is the written result of the stage
before, and returns a DataFrame. All but the last return the columns of documents.
Rows that agree in doc_id and text are one document. Rows with one doc_id and different
texts, and rows without a doc_id, are documents of their own and told apart by their texts:
none goes unless its own text is a duplicate. An empty input gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hillstream.llm._store import Store, cleared
from hillstream.llm.byte_bpe import byte_bpe
from hillstream.llm.exact_dedup import exact_dedup, normalised
from hillstream.llm.mixing import WORD, mix
from hillstream.llm.quality_rules import quality_rules
from hillstream.llm.simhash import simhash_groups

NO_ID = -(1 << 63)
#: Bits in which near duplicates may differ: more than in op2_simhash, whose 2 find almost equal texts only.
RADIUS = 4


def _key(doc_id: str) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID)).alias("key")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest")


def _only(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """One row of docs for each doc_id and digest of kept, the one with the most code points."""
    rows = docs.select(_key("doc_id"), digest, F.struct("*").alias("row")).join(kept.select(_key("doc_id"), "digest"), ["key", "digest"], "left_semi")
    most = F.struct(F.coalesce(F.char_length("row.text"), F.lit(0)), "row.text")
    return rows.groupBy("key", "digest").agg(F.max_by("row", most).alias("row")).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; so do documents that fail the base rules or lose too many words."""
    rows = quality_rules(docs, carry=("lang", "source")).filter("kept")
    return rows.select("doc_id", F.col("clean_text").alias("text"), "carried.lang", "carried.source", F.char_length("clean_text").cast("long").alias("n_chars"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that the merge index keeps, with or without a doc_id."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    return _only(docs, kept, _digest(normalised(F.col("text"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at RADIUS bits, the document with the smallest doc_id, null last, then the smallest digest."""
    rows = simhash_groups(docs.withColumn("digest", _digest(F.col("text"))), row_col="digest", radius=RADIUS)
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("best"))
    return _only(docs, kept.select("best.doc_id", "best.digest"), _digest(F.col("text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole copy of a document, and one for each further range of its words."""
    taken = mix(docs.withColumn("digest", _digest(F.col("text"))), row_col="digest").filter("taken > 0").select(_key("doc_id"), "digest", "size", "rounds", "from_1", "to_1", "from_2", "to_2")
    none = F.lit(None).cast("long")
    part = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    parts = F.concat(F.array_repeat(part(none, none), F.col("rounds").cast("int")),
                     F.filter(F.array(part(F.col("from_1"), F.col("to_1")), part(F.col("from_2"), F.col("to_2"))), lambda x: x["b"] > x["a"]))
    rows = (docs.select(_key("doc_id"), _digest(F.col("text")), "doc_id", "text", "lang", "source")
            .join(taken.select("key", "digest", F.explode(parts).alias("part")), ["key", "digest"]))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(F.col("part.a").isNull(), F.col("text")).otherwise(
        F.array_join(F.slice(words, (F.col("part.a") + 1).cast("int"), (F.col("part.b") - F.col("part.a")).cast("int")), " "))
    return rows.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, with their digests."""
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("byte_bpe", encoded)]

#: Fingerprints, hashed shards and merges by rank are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it. Of the written tables only the one in use stays."""
    store, before = Store(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cleared():
            docs = store.put(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
