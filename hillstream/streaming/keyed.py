"""Streaming forms of the operators that need no future rows.

The same state machines as in batch, kept in the state store. Given a column of event time, rows are taken in its
order behind a watermark, and states expire.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hillstream.operators.threads import OUTCOME, EventState, _name


def keyed_stream(stream: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict | None], added: list[T.StructField],
                 event_time: str | None = None, late: str = "10 seconds", keep: float = 3600.0) -> DataFrame:
    """Rows with the columns that ``step(state, row)`` adds; rows for which it returns None are dropped.

    With ``event_time``, a timestamp column, rows are held until the watermark, ``late`` behind the newest row, has passed them and
    are then taken in order, whatever their order of arrival; rows that come later than that are dropped, and
    a key's state goes once ``keep`` seconds have passed without a row of it. Without ``event_time``
    rows are taken as they come, sorted inside a micro-batch, and states stay: for sources that
    deliver in order and have few keys.
    """
    schema = T.StructType(stream.schema.fields + added)
    names, columns = [f.name for f in schema.fields], list(stream.columns)

    def taken(s: object, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            if (more := step(s, row)) is not None:
                out.append(row | more)
        return pd.DataFrame(out, columns=names)

    def as_it_comes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else start()
        out = taken(s, pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable"))
        state.update((pickle.dumps(s),))
        yield out

    def in_order(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, held = pickle.loads(state.get[0]) if state.exists else (start(), None)
        idle = state.hasTimedOut and (held is None or not len(held))
        rows = pd.concat([x for x in (held, *(() if state.hasTimedOut else frames)) if x is not None and len(x)] or [pd.DataFrame(columns=[*columns, "_ms"])], ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        due = rows["_ms"] <= mark
        out = taken(s, rows[due].drop(columns="_ms").sort_values(order, kind="stable"))
        held = rows[~due]
        if idle:
            state.remove()
        else:
            state.update((pickle.dumps((s, held)),))
            # held rows are due when the watermark passes them; a key without any waits for its expiry
            state.setTimeoutTimestamp(int(held["_ms"].min()) if len(held) else max(mark, 0) + int(1000 * keep))
        yield out

    if event_time is None:
        return stream.groupBy(*keys).applyInPandasWithState(as_it_comes, schema, "state binary", "append", "NoTimeout")
    timed = stream.withWatermark(event_time, late).withColumn("_ms", F.unix_millis(F.col(event_time).cast("timestamp")))
    return timed.groupBy(*keys).applyInPandasWithState(in_order, schema, "state binary", "append", "EventTimeTimeout")


def throttled_stream(stream: DataFrame, keys: list[str], t: str, rate: float, **timing) -> DataFrame:
    gap = 1.0 / rate if rate > 0 else float("inf")

    def step(s: dict, r: dict) -> dict | None:
        if rate <= 0 or "t" in s and r[t] - s["t"] < gap - 1e-9:
            return None
        s["t"] = r[t]
        return {}

    return keyed_stream(stream, keys, [t], dict, step, [], **timing)


def debounced_stream(stream: DataFrame, keys: list[str], t: str, v: str, **timing) -> DataFrame:
    """Adds accepted and uses, as the batch cycle count does."""
    def step(s: dict, r: dict) -> dict:
        value = None if pd.isna(r[v]) else int(r[v])
        if value is not None and s.get("last") == value:
            if value == 1 and s.get("accepted") != 1:
                s["starts"] = s.get("starts", 0) + 1
            s["accepted"] = value
        s["last"] = value
        return {"accepted": s.get("accepted"), "uses": max(0, s.get("starts", 0) - 1)}

    return keyed_stream(stream, keys, [t], dict, step, [T.StructField("accepted", T.LongType()), T.StructField("uses", T.LongType())], **timing)


def event_threads_stream(stream: DataFrame, keys: list[str], order: list[str], timing: dict | None = None, **settings: float) -> DataFrame:
    def step(s: EventState, r: dict) -> dict:
        return s.see(float(r["t"]), float(r["y"]), _name(r, "left"), _name(r, "right"))

    return keyed_stream(stream, keys, order, lambda: EventState(**settings), step, OUTCOME, **(timing or {}))


def latest_state(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row's values for each key; runs on batches and, in update mode, on streams."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(*keys, *(F.col("_s")[c].alias(c) for c in columns))


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by tumbling window, closed ``late`` after their end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def live_json(stream: DataFrame, path: str, keys: list[str], order: list[str], columns: list[str], checkpoint: str):
    """A query that keeps the newest state of each key as JSON under ``path``, overwritten by every micro-batch."""
    return (latest_state(stream, keys, order, columns).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, _: df.write.mode("overwrite").json(path)).start())
