"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

Radius r on 64 bits needs 2^(r + 1) - 1 tables, 7 for radius 2. Each bit position gets a non-zero
vector of r + 1 bits; the table of vector v keeps the positions whose vector has
odd inner product with v. Up to r differing positions span at most r dimensions, so
some v is orthogonal to all of them and the two fingerprints agree under its mask: every
pair within the radius meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hillstream.llm._store import Store
from hillstream.llm.components import components

BITS, RADIUS, WIDTH, SEED = 64, 2, 3, 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The covering masks as signed 64-bit numbers."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    return [_signed(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)) for v in range(1, top)]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set if it is set in over half the hashes of the shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def _within(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each small bucket, an edge from every linked fingerprint to the least of its component there."""
    for b in batches:
        left, right = [], []
        for fps in b.column(0):
            x = np.array(fps.as_py(), dtype=np.int64)
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            label = np.arange(len(x))
            while True:
                then = np.where(near, label[None, :], len(x)).min(axis=1)
                if (then == label).all():
                    break
                label = then
            moved = label != np.arange(len(x))
            left += x[moved].tolist()
            right += x[label[moved]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def flips(bits: int) -> list[int]:
    """The numbers with up to ``bits`` of 64 bits set, signed."""
    return [_signed(sum(1 << i for i in some)) for k in range(bits + 1) for some in combinations(range(BITS), k)]


def links(fps: DataFrame, store: Store, small: int = 64, radius: int = RADIUS) -> DataFrame:
    """fps: distinct fp. Edges a, b whose components are those of all pairs at ``radius`` or fewer bits, an even number.

    Buckets of up to ``small`` fingerprints are compared inside the bucket. In larger
    ones each fingerprint emits the values within half the radius of it (65 for radius 2, 2,081 for 4); two fingerprints
    are within the radius exactly if they share such a value, and at most as many can share
    one. So no bucket is gathered whole, none is cut, and no pairs are emitted.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    bands = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius=radius))))).alias("t")).select("fp", "t.v", "t.key")
    # written first: a join of two plain shuffles can split the rows of a large bucket among tasks
    sizes = store.put(bands.groupBy("v", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    shared = store.put(bands.join(sizes, ["v", "key"]), "shared")
    inside = (shared.filter(F.col("size") <= small).groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
              .mapInArrow(partial(_within, radius), "a long, b long"))
    near = F.expr("array(" + ", ".join(f"{x}L" for x in flips(radius // 2)) + ")")
    around = (shared.filter(F.col("size") > small).select("fp").distinct()
              .select("fp", F.explode(F.transform(near, lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))
              .groupBy("z").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("b")).filter(F.size("fps") > 1)
              .select(F.explode("fps").alias("a"), "b"))
    return inside.unionByName(around).filter("a <> b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 64, row_col: str | None = None, width: int = WIDTH,
                   radius: int = RADIUS) -> DataFrame:
    """Groups of documents linked by fingerprints of ``width``-word shingles at ``radius`` or fewer differing bits.

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id reachable). Null and empty texts have fingerprint zero and
    are linked like any other. Rows with equal fingerprints are one node, whatever
    their number. A group all of whose doc_ids are null has a null component_id. An
    empty table gives no rows; other columns are ignored. With ``row_col``, a binary column,
    that column and root, a number of the group, are added.
    """
    store = Store(docs.sparkSession, "simhash")
    more = [row_col] if row_col else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    own = store.put(own.mapInArrow(partial(_fingerprints, width), ", ".join(["doc_id long, fp long", *(f"`{c}` binary" for c in more)])), "own")
    nodes = store.put(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), store, small, radius), store)
    nodes = store.put(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    # written, so that the join is one of plain shuffles and a large component's rows can be split
    least = store.put(nodes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "group_root"), "least-id")
    with_root = ["root"] if row_col else []
    named = store.put(nodes.join(least, F.col("root") == F.col("group_root")).select(F.col("fp").alias("node_fp"), "component_id", *with_root), "named")
    return own.join(named, own.fp == named.node_fp).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *more, *with_root)
