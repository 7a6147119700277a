"""Numeric expressions: blends of confidences, ratios, averages and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that a score from 0 to 250 may have at each place, by number of digits.
LEGAL_DIGITS = {1: ["0123456789"], 2: ["123456789", "0123456789"], 3: ["12", "0123456789", "0123456789"]}


def name_confidence(ocr: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), 0.35 * ocr + 0.65 * similarity)


def floored_blend(readability: Column, ocr: Column, floor: float) -> Column:
    """Readability and recognition, with a floor for names that are easy to read."""
    o = F.when(ocr <= 0, F.lit(floor)).when(readability >= 0.5, F.greatest(ocr, F.lit(floor))).otherwise(ocr)
    return F.least(F.lit(1.0), F.greatest(0.65 * readability + 0.35 * o, F.lit(0.9 * floor)))


def band_score(v: Column, low: float, high: float) -> Column:
    """1 inside [low, high], rising to it from 0, falling to 0 at 1."""
    if high <= low:
        return F.lit(0.0)
    above = F.greatest(F.lit(0.0), (1.0 - v) / (1.0 - high)) if high < 1 else F.lit(0.0)
    below = v / low if low > 0 else F.lit(0.0)
    return F.when(v < low, below).when(v <= high, 1.0).otherwise(above)


def row_readability(fill: Column, columns: Column, rows: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * F.least(F.lit(1.0), fill / 0.2) + 0.35 * columns + 0.20 * rows)


def crop_readability(fill_score: Column, coverage: Column, parts: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * fill_score + 0.35 * coverage + 0.20 * F.least(F.lit(1.0), parts / 6.0))


def kill_ratio(kills: Column, deaths: Column) -> Column:
    """Kills per death to two places; the kills without deaths."""
    return F.round(F.when(deaths == 0, kills.cast("double")).otherwise(kills / deaths), 2)


def team_label(team: Column) -> Column:
    return F.when(team == "friendly", "ally").otherwise("enemy")


def first_truthy(*xs: Column) -> Column:
    """The first value that is neither null nor 0; the last value if none is."""
    return F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in xs[:-1]), xs[-1])


def mean_positive(*xs: Column) -> Column:
    """The mean over columns of the values above 0; null if there are none."""
    kept = F.filter(F.array(*xs), lambda x: x > 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def as_number(x: Column) -> Column:
    """A number, or null where the text is none."""
    return x.try_cast("double")


def digit_domain(x: Column) -> Column:
    """Whether a text of digits can be a score from 0 to 250 by its digits and its value."""
    forms = (F.rlike(x, F.lit("^" + "".join(f"[{d}]" for d in places) + "$")) for places in LEGAL_DIGITS.values())
    return reduce(lambda a, b: a | b, forms) & (x.try_cast("int") <= 250)


def whole_kills(kills: Column) -> Column:
    """A map of counters with text keys and integer values."""
    return F.transform_values(F.transform_keys(kills, lambda k, _: k.cast("string")), lambda _, v: v.cast("int"))
