"""The registry of a match as it grows frame by frame, until both teams have four names that are sure."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hillstream.operators.folds import run_fold
from hillstream.operators.threads import roster_ratio

TEAMS = ("friendly", "enemy")


@dataclass
class Cluster:
    """Readings taken for one name of a team."""

    key: str
    n: int = 0
    weight: float = 0.0
    shown: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return max(self.shown, key=lambda v: (self.shown[v], len(v)))

    @property
    def confidence(self) -> float:
        return min(1.0, self.weight / self.n + min(0.20, 0.05 * (self.n - 1)))


@dataclass
class Registry:
    """Clusters of both teams. Once ready it is locked and takes nothing more."""

    least: float = 0.82
    least_seen: int = 2
    sure: float = 0.72
    size: int = 4
    locked: bool = False
    teams: dict = field(default_factory=lambda: {t: [] for t in TEAMS})

    def distinct(self, readings: list[tuple]) -> list[tuple]:
        """By falling confidence the readings (slot, display, name, confidence) that are like none kept before."""
        out: list[tuple] = []
        for r in sorted(readings, key=lambda r: (-r[3], r[0])):
            if all(roster_ratio(k[2], r[2]) < self.least for k in out):
                out.append(r)
        return out

    def see(self, team: str, readings: list[tuple]) -> None:
        """The readings of one frame join the cluster that is most like them, the oldest on ties, or open one."""
        clusters = self.teams[team]
        for _, display, name, confidence in self.distinct([r for r in readings if r[2]]):
            like = [roster_ratio(c.key, name) for c in clusters]
            best = max(range(len(like)), key=lambda k: (like[k], -k), default=None)
            if best is None or like[best] < self.least:
                clusters.append(Cluster(name))
                best = len(clusters) - 1
            c = clusters[best]
            c.n, c.weight = c.n + 1, c.weight + confidence
            c.shown[display] = c.shown.get(display, 0) + 1

    def top(self, team: str) -> list[Cluster]:
        """The clusters seen most, then with most weight, the longest name, the oldest. Weights are sums of floats, so equal ones differ in their last bits."""
        return sorted(self.teams[team], key=lambda c: (c.n, round(c.weight, 6), len(c.name)), reverse=True)[: self.size]

    def ready(self) -> bool:
        return all(sum(c.n >= self.least_seen and c.confidence >= self.sure for c in self.top(t)) >= self.size for t in TEAMS)


def registered(readings: DataFrame, keys: list[str], frame: str, **settings: float) -> DataFrame:
    """The registry after each frame in which the board is visible.

    readings: keys, frame, team, slot_index, display_name, normalized_name, confidence (0 without a name). Returns keys, frame,
    players (names in order of their ids, friends first), player_ids, confidence (the mean of the
    players), complete and locked. Frames after the one that completes it repeat the registry.
    """
    kinds = {f.name: f for f in readings.schema.fields}
    added = [T.StructField("players", T.ArrayType(T.StringType())), T.StructField("player_ids", T.ArrayType(T.LongType())), T.StructField("confidence", T.DoubleType()),
             T.StructField("complete", T.BooleanType()), T.StructField("locked", T.BooleanType())]
    cell = F.struct(F.col("slot_index").cast("long").alias("slot"), "display_name", "normalized_name", F.col("confidence").cast("double").alias("confidence"))
    frames = readings.groupBy(*keys, frame).agg(*(F.array_sort(F.collect_list(F.when(F.col("team") == t, cell))).alias(t) for t in TEAMS))

    def rule(state: dict, rows: pd.DataFrame) -> dict[str, list]:
        r = state.setdefault("registry", Registry(**settings))
        out: dict[str, list] = {f.name: [] for f in added}
        for cells in zip(*(rows[t] for t in TEAMS), strict=True):
            if not r.locked:
                for team, some in zip(TEAMS, cells, strict=True):
                    r.see(team, [(c["slot"], c["display_name"], c["normalized_name"], c["confidence"]) for c in some])
                r.locked = r.ready()
            people = [c for t in TEAMS for c in r.top(t)]
            for name, value in zip(out, ([c.name for c in people], list(range(1, len(people) + 1)), sum(c.confidence for c in people) / len(people) if people else None, r.locked, r.locked), strict=True):
                out[name].append(value)
        return out

    return run_fold(frames, keys, [frame], dict, rule, added, list(TEAMS)).select(*keys, kinds[frame].name, *(f.name for f in added))


def completed(registry: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """The first frame at which each registry is complete."""
    done = registry.filter("complete").groupBy(*keys).agg(F.min_by(F.struct(*(c for c in registry.columns if c not in keys)), frame).alias("_r"))
    return done.select(*keys, "_r.*")
