"""Which modules run, and which readings count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hillstream.functions.text import match_key
from hillstream.operators.folds import throttled

#: Ticks for each second of a recording, and whether a frame without an image uses up a tick.
RATES = {"scoreboard": (1.0, False), "killfeed": (3.0, True), "utility": (4.0, True), "hardpoint": (2.0, True)}
PLAYERS = 8


def module_status(enabled: Column, requires: Column, complete: Column, locked: Column | None = None, players: Column | None = None) -> Column:
    """disabled, waiting or active. A module that requires registration waits until it is complete and, where given, locked with all players."""
    ready = complete
    if locked is not None:
        ready = ready & locked
    if players is not None:
        ready = ready & (players == PLAYERS)
    return F.when(~enabled, "disabled").when(requires & ~ready, "waiting").otherwise("active")


def module_ticks(frames: DataFrame, keys: list[str], t: str, order: list[str], image: str, module: str, per: float = 1.0) -> DataFrame:
    """The frames that a module works on: those of its rate that have an image. ``per``: seconds in a unit of ``t``."""
    rate, uses_tick = RATES[module]
    seen = frames if uses_tick else frames.filter(F.col(image).isNotNull())
    return throttled(seen, keys, t, order, rate * per).filter(F.col(image).isNotNull())


def board_visible(fill: Column, similarity: Column, least_fill: float = 0.03, least_similarity: float = 0.70) -> Column:
    return (fill >= least_fill) & (similarity >= least_similarity)


def name_counts(text: Column, confidence: Column, least_length: int = 3, least: float = 0.20) -> Column:
    """Whether a cleaned text can be a name: not empty, long enough once normalised, and read with some confidence."""
    return (F.length(text) > 0) & (F.length(match_key(text)) >= least_length) & (F.greatest(F.lit(0.0), confidence) >= least)


def hill_reading(digits: Column, confidence: Column, low: int = 1, high: int = 5, least: float = 0.85) -> Column:
    """The hill's number if it is one digit in range and sure; else null."""
    value = F.when(F.rlike(digits, F.lit("^[0-9]$")), digits).cast("int")
    return F.when(value.between(low, high) & (confidence >= least), value)


def counter_reading(zero: Column, one: Column, least: float = 0.60, margin: float = 0.18) -> Column:
    """0 or 1 by the better score if it is high enough and far enough from the other; else null. 0 on ties."""
    best, other = F.greatest(zero, one), F.least(zero, one)
    return F.when((best >= least) & (best - other >= margin), F.when(one > zero, 1).otherwise(0))


def lit(share: Column, least: float = 0.73) -> Column:
    return share >= least


def second_pass(registry: DataFrame, totals: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """What the second pass starts from: the registries that are complete, locked and whole, with the first pass's counts and last scores."""
    ready = registry.filter(F.col("complete") & F.col("locked") & (F.col("players") == PLAYERS))
    return ready.select(*keys, "players", "confidence").join(totals, keys, "left").join(scores, keys, "left")
