"""Frames of recordings, sampled by index.

The decoder takes the path of a recording, or its bytes, and yields (frame index, image bytes). It comes from the caller, as a
function or as "module:function", since decoding needs libraries that are not part of this package.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from hillstream.sources.tables import FRAMES


def kept_frame(index: int, fps: float, per_second: float, start: float) -> bool:
    """Frames from ``round(start * fps)`` on whose index is a multiple of ``round(fps / per_second)``, 1 at least."""
    fps = fps if fps > 0 else 29.97
    return index >= round(max(0.0, start) * fps) and index % max(1, round(fps / max(0.1, per_second))) == 0


def named(decoder: str) -> Callable[[bytes], Iterable[tuple[int, bytes]]]:
    module, _, name = decoder.partition(":")
    return getattr(importlib.import_module(module), name)


def recorded_frames(spark: SparkSession, path: str, decoder: Callable[[bytes | str], Iterable[tuple[int, bytes]]] | str, fps: float | Callable[[str], float], per_second: float = 30.0,
                    start: float = 0.0, pattern: str = "*", by_path: bool = False) -> DataFrame:
    """Rows match_id, frame_index, timestamp_seconds, source_path, image of every recording under ``path``.

    One recording is one task's work and is decoded from its start, frame by frame; a missing path is an error.
    ``fps`` may be a function of the path. ``by_path`` hands the decoder the path, which it reads as it goes; its bytes, which have to fit in one cell, otherwise.
    """
    decode = named(decoder) if isinstance(decoder, str) else decoder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["path" if by_path else "content"], strict=True):
                stem = source.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace(" ", "_")
                rows = []
                own = fps(source) if callable(fps) else fps
                rate = own if own > 0 else 29.97
                for i, image in decode(content):
                    if kept_frame(i, own, per_second, start):
                        rows.append((stem, i, i / rate, source, image))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=["match_id", "frame_index", "timestamp_seconds", "source_path", "image"])
                        rows = []
                yield pd.DataFrame(rows, columns=["match_id", "frame_index", "timestamp_seconds", "source_path", "image"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    if by_path:
        # a row of a listing costs nothing, so recordings are dealt one by one
        files = files.select("path").repartition(max(1, files.select("path").count()), "path")
        return files.mapInPandas(run, FRAMES)
    return files.select("path", "content").mapInPandas(run, FRAMES)
