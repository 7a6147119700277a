"""Placement of documents on shards by a permutation-filled lookup table [DataFrame functions only].

Every shard has a preference order of the slots of a table of prime size: it starts at
an offset and steps by a skip, both hashes of its name. The shards take turns; each
claims its first free slot, until the table is full. A document's hash picks a slot. The
table's size is a parameter and does not grow with the data, so it is broadcast and
a document is placed by one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("a prime number of slots and from 1 to that many different shards are needed")
    number = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in shards]
    at, skip = [n % slots for n in number], [(n // slots) % (slots - 1) + 1 for n in number]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The table as rows slot, shard."""
    rows = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard string")


def place(docs: DataFrame, shards: list[str], slots: int = 16381, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, slot, shard.

    The slot is the first 60 bits of the MD5 of the doc_id's text, modulo ``slots``; a
    null doc_id counts as empty text. Equal ids always share a shard. Texts are not
    read; an empty table gives no rows; other columns are ignored.
    """
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots
    table = table_frame(docs.sparkSession, shards, slots)
    return docs.select(F.col(id_col).alias("doc_id"), slot.alias("slot")).join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")
