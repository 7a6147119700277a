"""Folds whose next decision depends on the last one taken.

Rows are dealt by key and sorted, and one pass keeps the state of the current key
only. So a key of any length needs the memory of its state and not of its rows. A batch
is cut into the runs of its keys; a rule sees the columns it needs of one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def key_runs(f: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, slice]]:
    """The runs of equal keys of a sorted batch, with the key (nulls are None)."""
    if not len(f):
        return
    new = np.zeros(len(f), dtype=bool)
    for k in keys:
        v = f[k].to_numpy()
        missing = pd.isna(v)
        new[1:] |= (v[1:] != v[:-1]) & ~(missing[1:] & missing[:-1])
    new[0] = True
    cut = [*np.flatnonzero(new).tolist(), len(f)]
    for a, b in zip(cut, cut[1:], strict=False):
        yield tuple(None if pd.isna(v) else v for v in (f[k].iat[a] for k in keys)), slice(a, b)


def run_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], rule: Callable[[dict, pd.DataFrame], dict[str, list]], added: list[T.StructField],
             columns: list[str] | None = None) -> DataFrame:
    """Adds the columns that ``rule(state, rows)`` returns for the rows of a key in order, in one or several calls, with a fresh ``start()`` for each key."""
    schema, names = T.StructType(df.schema.fields + added), [f.name for f in added]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), {}
        for f in frames:
            out: dict[str, list] = {n: [] for n in names}
            for key, rows in key_runs(f, keys):
                if key != last:
                    last, state = key, start()
                for n, values in rule(state, (f[columns] if columns else f).iloc[rows]).items():
                    out[n].extend(values)
            yield f.assign(**{n: pd.Series(out[n], index=f.index, dtype=object) for n in names})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], added: list[T.StructField]) -> DataFrame:
    """As ``run_fold``, with ``step(state, row)`` for each row."""
    def rule(state: dict, rows: pd.DataFrame) -> dict[str, list]:
        found = [step(state, dict(zip(rows.columns, r, strict=True))) for r in zip(*(rows[c].tolist() for c in rows.columns), strict=True)]
        return {f.name: [x[f.name] for x in found] for f in added}

    return run_fold(df, keys, order, start, rule, added)


def _spaced(gap: float, slack: float, name: str, t: str) -> Callable[[dict, pd.DataFrame], dict[str, list]]:
    """The first row passes, then each that is ``gap`` or more after the last that passed: one search for each row that does."""
    def rule(state: dict, rows: pd.DataFrame) -> dict[str, list]:
        times = rows[t].to_numpy()
        passed = np.zeros(len(times), dtype=bool)
        i = 0 if "t" not in state else int(np.searchsorted(times, state["t"] + gap - slack))
        while i < len(times):
            passed[i] = True
            state["t"] = times[i]
            i = max(i + 1, int(np.searchsorted(times, times[i] + gap - slack)))
        return {name: passed.tolist()}

    return rule


def throttled(df: DataFrame, keys: list[str], t: str, order: list[str], rate: float) -> DataFrame:
    """The first row passes, then each that is 1 / rate or more after the last that passed; none at a rate of 0 or less. ``order`` begins with ``t``."""
    if rate <= 0:
        return df.filter("false")
    return run_fold(df, keys, order, dict, _spaced(1.0 / rate, 1e-9, "_passed", t), [T.StructField("_passed", T.BooleanType())], [t]).filter("_passed").drop("_passed")


def cooled_down(df: DataFrame, keys: list[str], t: str, order: list[str], seconds: float = 4.5) -> DataFrame:
    """Adds counted: true unless the key had a counted row less than ``seconds`` ago. Blocked rows restart nothing. ``order`` begins with ``t``."""
    return run_fold(df, keys, order, dict, _spaced(seconds, 0.0, "counted", t), [T.StructField("counted", T.BooleanType())], [t])


def delta_gated(df: DataFrame, keys: list[str], v: str, order: list[str], limit: float = 15) -> DataFrame:
    """Adds accepted: the value is not null and less than ``limit`` from the last accepted one, if any."""
    def rule(state: dict, rows: pd.DataFrame) -> dict[str, list]:
        last, out = state.get("v"), []
        for x, missing in zip(rows[v].tolist(), rows[v].isna().tolist(), strict=True):
            ok = not missing and (last is None or abs(x - last) < limit)
            last = x if ok else last
            out.append(ok)
        state["v"] = last
        return {"accepted": out}

    return run_fold(df, keys, order, dict, rule, [T.StructField("accepted", T.BooleanType())], [v])
