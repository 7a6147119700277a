"""The parts of reading images that are arithmetic on arrays; recognisers are passed in by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def intersection_over_union(a: np.ndarray, b: np.ndarray) -> float:
    both, either = np.logical_and(a, b).sum(), np.logical_or(a, b).sum()
    return float(both / either) if either else 0.0


def profile_similarity(a: np.ndarray, b: np.ndarray, axis: int) -> float:
    """1 minus the mean distance of the two shares of set pixels along an axis."""
    return float(max(0.0, 1.0 - np.abs(a.mean(axis=axis) - b.mean(axis=axis)).mean()))


def digit_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap with column and row profiles of two binary glyphs of one size."""
    return 0.45 * intersection_over_union(a, b) + 0.35 * profile_similarity(a, b, 0) + 0.20 * profile_similarity(a, b, 1)


def masses(glyph: np.ndarray) -> dict[str, float]:
    """Shares of set pixels: all, the halves and the middle third."""
    h, w = glyph.shape
    g = glyph.astype(bool)
    return {"fill": float(g.mean()), "upper": float(g[: h // 2].mean()), "lower": float(g[h // 2 :].mean()), "left": float(g[:, : w // 2].mean()),
            "right": float(g[:, w // 2 :].mean()), "centre": float(g[:, w // 3 : w - w // 3].mean())}


def changed_share(now: np.ndarray, before: np.ndarray | None) -> float:
    """Share of pixels that differ; 1 without an image of the same shape before."""
    return 1.0 if before is None or before.shape != now.shape else float((now != before).mean())


def in_range_share(hsv: np.ndarray, low: tuple, high: tuple) -> float:
    return float(((hsv >= np.array(low)) & (hsv <= np.array(high))).all(axis=-1).mean()) if hsv.size else 0.0


def best_digits(candidates: list[list[tuple[int, float]]], legal: Callable[[str], bool], least: float = 0.55) -> tuple[int, float] | None:
    """The legal number with the highest mean confidence over up to two candidates a place; the first on ties."""
    best, found = 0.0, None
    numbers = [("", 0.0)]
    for place in candidates:
        numbers = [(text + str(d), total + c) for text, total in numbers for d, c in sorted(place, key=lambda x: -x[1])[:2]]
    for text, total in numbers:
        if text and legal(text) and (mean := total / len(text)) > best and mean >= least:
            best, found = mean, int(text)
    return None if found is None else (found, best)


def read_images(frames: DataFrame, reader: Callable[[], Callable[[bytes], dict]], schema: str, image: str = "image") -> DataFrame:
    """Run a recogniser over images; ``reader`` makes one for each worker process."""
    keep = [c for c in frames.columns if c != image]
    kinds = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes if c != image)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for b in batches:
            found = pd.DataFrame([read(x) if x is not None else {} for x in b[image]], index=b.index, columns=[c.split()[0] for c in schema.split(", ")])
            yield pd.concat([b[keep], found], axis=1)

    return frames.mapInPandas(run, f"{kinds}, {schema}")
