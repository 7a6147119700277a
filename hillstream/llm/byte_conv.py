"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In a chunk,
bytes are embedded, filters over WIDTH bytes move by STEP, and each filter keeps its
largest response (rectified). A hidden layer turns those into features of the chunk;
their largest and mean values over all chunks give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hillstream.llm.labels import held_out, labelled_sample

CHUNK, STRIDE, WIDTH, STEP = 256, 192, 8, 4
EMBED, FILTERS, HIDDEN = 6, 32, 16
#: Documents and bytes of each label that the network may learn from, and its passes over them.
PER_CLASS, MOST_BYTES, EPOCHS = 3000, 6 << 20, 8
#: Documents and chunks of a training step (one document may have more), and chunks that are worked on at once.
BATCH, BATCH_CHUNKS, PART = 32, 1024, 512


def chunks(raw: bytes) -> np.ndarray:
    """All bytes of a text as rows of CHUNK bytes, STRIDE apart; the last is padded with zeros."""
    n = max(1, -(-(len(raw) - CHUNK) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + CHUNK, dtype=np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"embed": (256, EMBED), "conv": (WIDTH * EMBED, FILTERS), "conv0": (FILTERS,), "hid": (FILTERS, HIDDEN), "hid0": (HIDDEN,), "out": (2 * HIDDEN,), "out0": (1,)}
    scale = {"embed": 0.5, "conv": (2 / (WIDTH * EMBED)) ** 0.5, "hid": (2 / FILTERS) ** 0.5, "out": (1 / HIDDEN) ** 0.5}
    return {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}


def _positions(x: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH) byte values under the filters."""
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STEP]


def chunk_features(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of chunks, the pooled responses before them, and where each filter responded most."""
    e = p["embed"][x]
    n = len(x)
    places = (CHUNK - WIDTH) // STEP + 1
    s = e.strides
    view = np.lib.stride_tricks.as_strided(e, (n, places, WIDTH * EMBED), (s[0], s[1] * STEP, s[2]))
    r = (np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED) @ p["conv"]).reshape(n, places, FILTERS)
    at = r.argmax(axis=1)
    top = np.maximum(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + p["conv0"], 0)
    return np.maximum(top @ p["hid"] + p["hid0"], 0), top, at


def probability(p: dict, raw: bytes, batch: int = 512) -> float:
    x = chunks(raw)
    most, total = None, np.zeros(HIDDEN, dtype=np.float64)
    for k in range(0, len(x), batch):
        h = chunk_features(p, x[k : k + batch])[0]
        most = h.max(axis=0) if most is None else np.maximum(most, h.max(axis=0))
        total += h.sum(axis=0)
    z = float(p["out"][:HIDDEN] @ most + p["out"][HIDDEN:] @ (total / len(x)) + p["out0"][0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def probabilities(p: dict, raws: list[bytes], batch: int = 512) -> list[float]:
    """As ``probability`` for each text, the chunks of short texts in common batches."""
    out, group, size = [], [], 0
    for raw in [*raws, None]:
        x = chunks(raw) if raw is not None else None
        if group and (x is None or size + len(x) > batch):
            if len(group) == 1:
                out.append(probability(p, group[0][1], batch))
            else:
                h = chunk_features(p, np.concatenate([g for g, _ in group]))[0]
                first = np.cumsum([0, *(len(g) for g, _ in group[:-1])])
                count = np.array([[len(g)] for g, _ in group], dtype=np.float64)
                z = np.maximum.reduceat(h, first) @ p["out"][:HIDDEN] + (np.add.reduceat(h, first, dtype=np.float64) / count) @ p["out"][HIDDEN:] + p["out0"][0]
                out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
            group, size = [], 0
        if x is not None:
            group.append((x, raw))
            size += len(x)
    return out


def _all_features(p: dict, x: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = [chunk_features(p, x[k : k + PART]) for k in range(0, len(x), PART)]
    return tuple(np.concatenate(some) for some in zip(*parts, strict=True))


def gradients(p: dict, x: np.ndarray, doc: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of one batch: chunks x, the document of each (ascending), labels y."""
    h, top, at = _all_features(p, x)
    first = np.searchsorted(doc, np.arange(n))
    count = np.bincount(doc, minlength=n).astype(np.float32)
    most = np.maximum.reduceat(h, first)
    mean = np.add.reduceat(h, first) / count[:, None]
    pooled = np.concatenate([most, mean], axis=1)
    q = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["out0"][0], -30, 30)))
    loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum())
    dz = (weight * (q - y)).astype(np.float32)
    g = {"out": pooled.T @ dz, "out0": np.array([dz.sum()], dtype=np.float32)}
    dp = dz[:, None] * p["out"]
    is_most = h == most[doc]
    dh = is_most * dp[doc, :HIDDEN] + dp[doc, HIDDEN:] / count[doc, None]
    dh = dh * (h > 0)
    g["hid"], g["hid0"] = top.T @ dh, dh.sum(axis=0)
    dt = (dh @ p["hid"].T) * (top > 0)
    g["conv0"] = dt.sum(axis=0)
    g["conv"], g["embed"] = np.zeros_like(p["conv"]), np.zeros_like(p["embed"])
    for k in range(0, len(x), PART):
        part = slice(k, k + PART)
        bytes_at = np.take_along_axis(_positions(x[part]), at[part][:, :, None], axis=1)
        e = p["embed"][bytes_at].reshape(len(bytes_at), FILTERS, WIDTH * EMBED)
        g["conv"] += np.einsum("nf,nfk->kf", dt[part], e, optimize=True)
        de = (dt[part][:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
        flat = bytes_at.reshape(-1)
        g["embed"] += np.stack([np.bincount(flat, de[:, j], 256) for j in range(EMBED)], axis=1).astype(g["embed"].dtype)
    return loss, g


def batches_of(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts documents in order into batches of up to BATCH documents and, but for a single one, BATCH_CHUNKS chunks."""
    first, total = 0, 0
    for k, i in enumerate(order):
        if k > first and (k - first == BATCH or total + sizes[i] > BATCH_CHUNKS):
            yield order[first:k]
            first, total = k, 0
        total += sizes[i]
    yield order[first:]


def train(sample: pd.DataFrame, epochs: int = EPOCHS, seed: int = 11, rate: float = 4e-3) -> dict:
    """Adam over all chunks of each document; both labels weigh the same. Without both labels the untrained network says its prior."""
    p = initial(seed)
    y = sample["label"].to_numpy(dtype=np.float32) if len(sample) else np.zeros(0, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        p["out"][:] = 0
        p["out0"][0] = 4.0 if len(y) and y.sum() else -4.0 if len(y) else 0.0
        return p
    rng = np.random.default_rng(seed)
    texts = [chunks(t.encode()) for t in sample["text"]]
    sizes = np.array([len(t) for t in texts])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    step = 0
    for epoch in range(epochs):
        parts = list(batches_of(rng.permutation(len(y)), sizes))
        for k, some in enumerate(parts):
            doc = np.repeat(np.arange(len(some)), sizes[some])
            _, g = gradients(p, np.concatenate([texts[i] for i in some]), doc, len(some), y[some], weight[some] / len(some))
            step += 1
            lr = rate * min(1.0, step / 20) * (1 - (epoch + k / len(parts)) / epochs)
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                p[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                   per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, epochs: int = EPOCHS, threshold: float = 0.5) -> DataFrame:
    """Train on a sample of labelled rows that are not held out, bounded by ``per_class`` documents and ``most_bytes`` bytes of each label, then score every whole text.

    Returns one row per input row: doc_id, held_out, score (0 to 1, higher: label 1 is
    likelier) and predicted. Only the text's bytes reach the network. A null text is
    empty; an empty text is one chunk of padding and gets a score as well. Repeated rows get equal
    scores; a null doc_id is not held out. Without labels of both kinds the score
    is constant. Other columns are ignored. The weights (a few kB) are broadcast.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, epochs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                score = probabilities(p, [(t.as_py() or "").encode() for t in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held_out("doc_id").alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))
