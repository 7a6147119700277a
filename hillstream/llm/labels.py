"""A bounded sample of labelled documents, from which the two classifiers learn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hillstream.llm._store import Store

FOLDS, HELD_OUT = 3, 1
#: Bytes of text of each label that are learned from.
MOST_BYTES = 16 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> pd.DataFrame:
    """Up to ``per_class`` documents and ``most_bytes`` bytes of text of each label, as text and label, in a fixed order.

    Held-out rows and rows without id, label or text are left out first, and ids labelled both ways. The ids are
    picked by hash among the labels; at most 2 * per_class of them are broadcast to one
    scan of the documents. An id counts once, with the least of its texts if there are several. What is found is written; of
    the picked documents in their order those up to the bytes' bound are taken, so what reaches the driver is bounded by both parameters.
    """
    rows = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
            .filter(~held_out("_id") & F.col("label").isin(0, 1)).groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most")
            .withColumn("turn", F.xxhash64("_id")).drop("_most"))
    picked = None
    for value in (0, 1):
        some = rows.filter(F.col("label") == value).orderBy("turn", "_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    found = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).dropna()
             .join(F.broadcast(picked), F.col("_doc") == F.col("_id")).groupBy("turn", "_id", "label").agg(F.min("text").alias("text")))
    store = Store(docs.sparkSession, "labels")
    found = store.put(found, "found")
    sizes = found.select("label", "turn", "_id", F.octet_length("text").alias("bytes")).toArrow().to_pandas().sort_values(["turn", "_id"])
    taken = sizes[sizes.groupby("label")["bytes"].cumsum() <= most_bytes].groupby("label")["bytes"].size().to_dict()
    last = {y: sizes[sizes["label"] == y].iloc[n - 1] for y, n in taken.items()}
    upto = F.lit(False)
    for y, r in last.items():
        turn, own = int(r["turn"]), getattr(r["_id"], "item", lambda r=r: r["_id"])()
        upto = upto | (F.col("label") == int(y)) & ((F.col("turn") < turn) | (F.col("turn") == turn) & (F.col("_id") <= own))
    table = found.filter(upto).select("turn", "_id", "text", "label").toArrow().to_pandas()
    store.clear()
    return table.sort_values(["turn", "_id"], ignore_index=True)[["text", "label"]]
