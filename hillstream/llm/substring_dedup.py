"""Substring deduplication by Rabin-Karp hashes of every window of tokens.

A word is a keyed BLAKE2b digest, cut to four numbers below the prime 2^31 - 1. The hash of a
sequence of words is a polynomial in those numbers at four secret bases; two of them (62
bits) give the hash of a window, the other two that of a gram, a shorter sequence. Key
and bases are drawn anew for each run, so no text can be written to collide.

Every window has an anchor: its least gram, the leftmost of equal ones. Equal windows have equal
anchors at equal places, so consecutive windows of one anchor travel in one row (the gram's hash, the
place, and the hash of each window), and rows of equal anchors meet. A task gathers a bounded
number of words and keeps the first of windows that repeat among them, which is the partial step
of the count: a window of every document is one entry for each such table and not for each document.
Spark counts anchors, drops those that stand once, counts the windows of the rest and marks
those that start earlier elsewhere; sorts and aggregates spill, and nothing is packed.
The marks join the texts by id and digest, where they merge to maximal intervals of words to remove.

Windows count as equal if the hashes of window and anchor agree, 124 bits drawn independently of
the text. Of N windows with anchors shared by M others a false match is expected in N * M / 2^63
cases, as different windows of one anchor differ by the 62 bits of their own hash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(1 << 63)
#: Words that a task gathers before it sends them on, and bytes of a text that are cut into words at once.
GATHERED, BLOCK = 1_000_000, 1 << 22
#: Words whose digests a task keeps, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 500_000, 1 << 26
PRIME = (1 << 31) - 1
#: Windows that a mask of one number can hold.
BITS = 62

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_P = np.uint64(PRIME)


def secret() -> tuple[bytes, tuple[int, ...]]:
    """The key of the words' digests and the four bases of a run."""
    return os.urandom(32), tuple(int.from_bytes(os.urandom(8), "little") % (PRIME - (1 << 16)) + (1 << 16) for _ in range(4))


def gram_width(width: int) -> int:
    """Words of a gram: three tenths of a window, and so many that a window has at most BITS / 2 grams."""
    return max(1, width * 3 // 10, width - BITS // 2 + 1)


def blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = _SPACE.search(raw, at + BLOCK)
        if cut is None:
            break
        yield raw[at : cut.start()].split()
        at = cut.end()
    yield (raw[at:] if at else raw).split()


class Words(dict):
    """Numbers of the words seen, whose digests stand in ``table``; emptied when it holds too many."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key, self.size, self.table = key, 0, np.zeros((1024, 4), dtype="<u4")

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = np.frombuffer(hashlib.blake2b(word, digest_size=16, key=self.key).digest(), "<u4")
        self[word] = n
        self.size += len(word)
        return n

    def digests(self, words: list[bytes]) -> np.ndarray:
        """Four numbers below the prime for each word."""
        if len(self) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.clear()
            self.size, self.table = 0, np.zeros((1024, 4), dtype="<u4")
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[at] % np.uint32(PRIME)


def sequence_hashes(w: np.ndarray, base: int, width: int) -> np.ndarray:
    """The polynomial of every ``width`` consecutive numbers at ``base`` modulo the prime, by doubling."""
    out, done, length, power = None, 0, 1, base
    w = w.astype(np.uint64)
    while True:
        if width & length:
            if out is None:
                out = w
            else:
                n = max(0, min(len(out), len(w) - done))
                out = (out[:n] * np.uint64(power) + w[done : done + n]) % _P
            done += length
        if done == width:
            return out
        w = (w[:-length] * np.uint64(power) + w[length:]) % _P
        power, length = power * power % PRIME, 2 * length


def least_places(g: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of g[i : i + span], the leftmost of equal ones."""
    best, length = np.arange(len(g)), 1
    while length < span:
        step = min(length, span - length)
        a, b = best[: max(0, len(best) - step)], best[step:]
        best, length = np.where(g[b] < g[a], b, a), length + step
    return best


def hashes(digests: np.ndarray, bases: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the words: its hash, the place of its anchor and the anchor's hash."""
    two = lambda k, n: (sequence_hashes(digests[:, k], bases[k], n) << np.uint64(31) | sequence_hashes(digests[:, k + 1], bases[k + 1], n)).astype(np.int64)
    k = gram_width(width)
    if len(digests) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = two(2, k)
    at = least_places(grams, width - k + 1)
    return two(0, width), at, grams[at]


FOUND = pa.schema([("g", pa.int64()), ("did", pa.int64()), ("sub", pa.int64()), ("start", pa.int64()), ("mask", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _starts(*changes: np.ndarray) -> np.ndarray:
    """Places where a new run begins: the first, and where any of the arrays (True: differs from the one before) says so."""
    new = np.ones(len(changes[0]) + 1, dtype=bool)
    new[1:] = np.logical_or.reduce(changes)
    return np.flatnonzero(new)


class Table:
    """What a task has gathered: pieces of documents as digests of their words."""

    def __init__(self, width: int, bases: tuple[int, ...]):
        self.width, self.bases, self.pieces, self.words = width, bases, [], 0

    def add(self, did: int, sub: int, base: int, digests: np.ndarray) -> None:
        if len(digests) >= self.width:
            self.pieces.append((did, sub, base, digests))
            self.words += len(digests)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of FOUND. Windows that start earlier in the table are marked at once, in rows without hashes; of the others
        those that are consecutive and share an anchor form a row."""
        if not self.pieces:
            return
        pieces = sorted(self.pieces, key=lambda p: p[:3])
        self.pieces, self.words = [], 0
        h, anchor, g = hashes(np.concatenate([p[3] for p in pieces]), self.bases, self.width)
        sizes = np.array([len(p[3]) for p in pieces])
        first = np.cumsum(sizes) - sizes
        # places of windows that lie in one piece, and the piece
        at = np.concatenate([np.arange(f, f + n - self.width + 1) for f, n in zip(first, sizes, strict=True)])
        piece = np.repeat(np.arange(len(pieces)), sizes - self.width + 1)
        h, anchor, g = h[at], anchor[at], g[at]
        did, sub, base = (np.array([p[k] for p in pieces], dtype=np.int64) for k in range(3))
        start = at - first[piece] + base[piece]
        owner = np.cumsum(np.r_[False, (did[1:] != did[:-1]) | (sub[1:] != sub[:-1])])[piece]

        order = np.argsort(h, kind="stable")
        same = np.r_[False, (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])]
        earliest = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = order[same]
        moved = (owner[again] != owner[earliest[same]]) | (start[again] != start[earliest[same]])
        later, kept = np.sort(again[moved]), np.sort(order[~same])

        if len(later):
            jump = (owner[later][1:] != owner[later][:-1]) | (start[later][1:] != start[later][:-1] + 1)
            run = _starts(jump)
            size = np.diff(np.r_[run, len(later)])
            cut = np.concatenate([np.arange(a, a + n, BITS) for a, n in zip(run, size, strict=True)])
            count = np.diff(np.r_[cut, len(later)])
            # nothing is counted of these rows; dealt by their document, those of one common window do not meet
            where = did[piece[later[cut]]] * np.int64(0x5851F42D4C957F2D) + sub[piece[later[cut]]] + start[later[cut]]
            yield self._rows(where, did[piece[later[cut]]], sub[piece[later[cut]]], start[later[cut]], pa.array((np.int64(1) << count) - 1), pa.nulls(len(cut), pa.list_(pa.int64())))
        cut = _starts(piece[kept][1:] != piece[kept][:-1], anchor[kept][1:] != anchor[kept][:-1], kept[1:] != kept[:-1] + 1)
        for part in np.array_split(cut, max(1, -(-len(cut) // 16384))):
            end = cut[np.searchsorted(cut, part[-1]) + 1] if part[-1] != cut[-1] else len(kept)
            rows, own = kept[part], kept[part[0] : end]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[part, end] - part[0], pa.int32()), pa.array(h[own]))
            yield self._rows(g[rows], did[piece[rows]], sub[piece[rows]], start[rows], pa.nulls(len(rows), pa.int64()), lists)

    @staticmethod
    def _rows(g, did, sub, start, mask, lists) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(did), pa.array(sub), pa.array(start), mask, lists], schema=FOUND)


def _gather(width: int, gathered: int, key: bytes, bases: tuple[int, ...]):
    """Map side: texts to rows of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(key), Table(width, bases)
        for b in batches:
            for did, sub, text in zip(*b.columns, strict=True):
                base, carry = 0, np.zeros((0, 4), dtype="<u4")
                for block in blocks((text.as_py() or "").encode()):
                    own = words.digests(block)
                    own = np.concatenate([carry, own]) if len(carry) else own
                    table.add(did.as_py(), sub.as_py(), base, own)
                    # the next block's first windows begin in this one
                    left = min(len(own), width - 1)
                    base, carry = base + len(own) - left, own[len(own) - left :]
                    if table.words >= gathered:
                        yield from table.flush()
        yield from table.flush()

    return run


def intervals(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of words that windows at ``starts`` (ascending) cover; windows that touch are one."""
    if not len(starts):
        return starts, starts
    new = _starts(starts[1:] > starts[:-1] + width)
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + width


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which halves what is shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        texts = pa.array([None if t.as_py() is None else pack(t.as_py().encode()) for t in b.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("did"), b.column("sub"), texts], names=["doc_id", "did", "sub", "packed"])


def _cut(width: int):
    """Texts with their marks: remove the words that the windows cover."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                       ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def one(raw: bytes, spans: list | None) -> tuple:
        starts = sorted({s["start"] + k for s in spans or () for k in range(s["mask"].bit_length()) if s["mask"] >> k & 1})
        start, end = intervals(np.array(starts, dtype=np.int64), width)
        n, parts = 0, []
        for words in blocks(raw):
            a, b = np.searchsorted(end, n, "right"), np.searchsorted(start, n + len(words))
            last, own = 0, []
            for s, e in zip((start[a:b] - n).tolist(), (end[a:b] - n).tolist(), strict=True):
                own += words[last : max(s, 0)]
                last = e
            own += words[last:]
            parts += [b" ".join(own)] if own else []
            n += len(words)
        kept = b" ".join(parts)
        return n, int((end - start).sum()), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)], kept.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = [one(unpack(t.as_py()) if t.is_valid else b"", s.as_py()) for t, s in zip(b.column(1), b.column(2), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(kinds)[1:], strict=True))], schema=kinds)

    return run


def repeats(docs: DataFrame, width: int = 20, gathered: int = GATHERED) -> DataFrame:
    """docs: did, sub (together a document), text. Rows did, sub, start, mask: the windows at start + k, for the bits k of mask, start earlier elsewhere."""
    found = docs.select("did", "sub", "text").mapInArrow(_gather(width, gathered, *secret()), "g long, did long, sub long, start long, mask long, hashes array<long>")
    shared = found.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("g"))).filter("rows > 1 or mask is not null")
    each = shared.select("g", "did", "sub", "start", "mask", F.posexplode_outer("hashes").alias("k", "h")).withColumn("at", F.col("start") + F.col("k"))
    w = Window.partitionBy("g", "h").orderBy("did", "sub", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = (F.col("did") != F.first("did").over(w)) | (F.col("sub") != F.first("sub").over(w)) | (F.col("at") != F.first("at").over(w))
    each = each.withColumn("bit", F.when(F.col("mask").isNotNull(), F.col("mask")).when(later, F.expr("shiftleft(1L, k)"))).filter("bit is not null")
    return each.groupBy("g", "did", "sub", "start").agg(F.bit_or("bit").alias("mask")).drop("g")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, gathered: int = GATHERED) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier.

    Earlier is a smaller doc_id (a whole number; a null one comes first), or an earlier start in the same
    document. Returns one row per input row: doc_id, n_words, n_removed, kept_sha256,
    removed (maximal intervals of word numbers) and kept_text (words joined by one
    space). A null or empty text has no words. Rows that agree in doc_id and text
    are one document: they get the same result and do not remove each other. Rows with one doc_id, or none,
    and different texts are documents of their own, in the order of a digest. An
    empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # sub tells texts of one doc_id apart, by 32 bits, and those without one, by 64
    digest = F.xxhash64("text")
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.when(F.col("doc_id").isNull(), digest.bitwiseOR(F.lit(1 << 62))).otherwise(digest.bitwiseAND(F.lit((1 << 32) - 1))).alias("sub"), "text")
    marks = repeats(base, width, gathered).groupBy("did", "sub").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    texts = base.mapInArrow(_packed, "doc_id long, did long, sub long, packed binary")
    return texts.join(marks, ["did", "sub"], "left").select("doc_id", "packed", "spans").mapInArrow(
        _cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept_text string")
