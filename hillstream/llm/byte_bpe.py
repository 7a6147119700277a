"""Byte-level BPE through a sentencepiece model that is serialised straight from a vocabulary.

The vocabulary (one base64 token and its rank a line) becomes a sentencepiece BPE
model: each byte is written as one printable character, each token as a piece
scored by its negative rank, and the normaliser is the identity. sentencepiece
merges the adjacent pair with the best score, the leftmost first, which is the
order of the ranks. Texts are cut into pre-tokens by a pattern; a pre-token that
is itself a token is that token, any other is encoded by the model. Decoding maps
ids back to pieces and characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker keeps; the results do not depend on it.
REMEMBERED = 300_000
#: Characters of the texts that are encoded together.
TOGETHER = 1 << 19


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks are not 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i; the unknown piece comes last and is never used."""
    chars = byte_chars()
    pieces = b"".join(_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i))) for i, t in enumerate(tokens))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return pieces + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encode and decode by a serialised model and a pattern."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_chars()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.tokens = [bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pre-tokens that are new to the worker go to the model in one call, whose cost would weigh on each text."""
        cuts = [self.cut(t) for t in texts]
        all_ = set().union(*cuts)
        new = [t for t in all_ if t not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, list(all_)
            raw = [t.encode() for t in new]
            merged = [k for k, r in enumerate(raw) if r not in self.whole]
            ids = self.sp.encode([raw[k].decode("latin-1").translate(self.to_chars) for k in merged], out_type=int, num_threads=1)
            found = dict(zip(merged, ids, strict=True))
            for k, (t, r) in enumerate(zip(new, raw, strict=True)):
                self.known[t] = struct.pack(f"<{len(x)}I", *x) if (x := found.get(k)) is not None else struct.pack("<I", self.whole[r])
        return [b"".join(map(self.known.__getitem__, cut)) for cut in cuts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, in groups of TOGETHER characters or a little more."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and,
    if ``ids``, the ids themselves (array of int). A null text is empty; an empty text
    has no tokens and the digests of no bytes. Repeated rows are encoded one by one;
    other columns are ignored. The vocabulary is read on the driver; executors get
    the model, whose size is the vocabulary's and not the data's.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value, pattern)
        for b in batches:
            n, one, two, all_ids = [], [], [], []
            for got in itertools.chain.from_iterable(map(bpe.encode_all, grouped(t.as_py() or "" for t in b.column(1)))):
                n.append(len(got) // 4)
                one.append(hashlib.sha256(got).hexdigest())
                two.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(got, "<i4"))
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())}
            if ids:
                cols["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
