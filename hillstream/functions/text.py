"""Text expressions: time labels, names, and similarity of names."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def seconds_of(x: Column) -> Column:
    """Seconds of "192", "3:12" or a number as text; 0 for null and blank, never below 0, an error for other forms."""
    text, parts = blank_to_null(x), F.split(F.trim(x), ":", -1)
    value = (F.when(text.isNull(), 0.0).when(F.size(parts) == 1, text.cast("double"))
             .when(F.size(parts) == 2, 60.0 * F.get(parts, F.lit(0)).cast("int") + F.get(parts, F.lit(1)).cast("double"))
             .otherwise(F.raise_error(F.concat(F.lit("not a time: "), x)).cast("double")))
    return F.greatest(F.lit(0.0), value)


def preview_seconds_of(x: Column) -> Column:
    """The stricter form: blank is an error, only the first colon cuts, and negative values pass."""
    text = blank_to_null(x)
    cut = F.instr(text, ":")
    return (F.when(text.isNull(), F.raise_error(F.lit("a time is needed")).cast("double")).when(cut == 0, text.cast("double"))
            .otherwise(60.0 * F.substring(text, F.lit(1), cut - 1).cast("int") + F.substring(text, cut + 1, F.length(text)).cast("double")))


def time_label(x: Column) -> Column:
    """14:12 as 14m12s, 852 as 852s."""
    t = F.trim(x)
    return F.when(F.contains(t, F.lit(":")), F.concat(F.regexp_replace(t, ":", "m"), F.lit("s"))).otherwise(F.concat(t, F.lit("s")))


def alias_lookup(x: Column, names: dict[str, str]) -> Column:
    """The value of the trimmed lower-case key; null if there is none."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(x)))


def path_stem(x: Column) -> Column:
    """The file name without its last suffix, spaces as underscores."""
    return F.replace(F.regexp_extract(x, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(" "), F.lit("_"))


def whole_number(x: Column) -> Column:
    """An integer read as a float and cut towards zero; null for null and blank."""
    return blank_to_null(x).cast("double").cast("int")


def player_name(x: Column) -> Column:
    """Without bracketed tags; if nothing is left the tag without brackets, else the raw name."""
    untagged = F.regexp_replace(x, r"\[[^\]]*\]", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(untagged, r"[\[\]]", ""), r"\s+", " "))
    bare = F.trim(F.regexp_replace(x, r"[\[\]]", ""))
    return F.coalesce(F.nullif(clean, F.lit("")), F.nullif(bare, F.lit("")), F.trim(x))


def header_names(names: list[str]) -> list[str]:
    """Column headers for cleaned names in order: a taken one gets _2, _3, ... This is schema, so it is made on the driver."""
    used, out = set(), []
    for n in names:
        k, header = 1, n
        while header in used:
            k += 1
            header = f"{n}_{k}"
        used.add(header)
        out.append(header)
    return out


def ocr_text(x: Column) -> Column:
    """Letters and digits of any script, and _ - [ ]."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_\-\[\]]", "")


def match_key(x: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def ascii_key(x: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")


def display_name(x: Column) -> Column:
    """ASCII letters, digits and _ - [ ]."""
    return F.regexp_replace(x, r"[^A-Za-z0-9_\-\[\]]", "")


def digits_only(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"[^0-9]", ""), F.lit(""))


def ngrams(x: Column, n: int) -> Column:
    """The set of n-grams; empty for shorter texts."""
    at = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(x, i, F.lit(n))))


def dice(a: Column, b: Column, n: int) -> Column:
    """2 |A and B| / (|A| + |B|) of n-gram sets; 0 if either text is shorter than n."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """The length ratio if one text holds the other, else 0."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a)), length_ratio(a, b)).otherwise(0.0)


def _pairwise(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A measure of two texts; a null text marks a pair that the JVM has settled, which is passed over."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    return lambda a, b: F.pandas_udf(run, DoubleType())(a, b)


def ratio(x: str, y: str) -> float:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return difflib.SequenceMatcher(None, x, y).ratio()


def common_part(x: str, y: str) -> float:
    """2 * length of the longest common substring / sum of lengths."""
    return 2.0 * difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size / (len(x) + len(y)) if x and y else 0.0


def sequence_ratio(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def longest_common_part(a: Column, b: Column) -> Column:
    return _pairwise(common_part)(a, b)


@lru_cache(1 << 16)
def _grams(x: str, n: int) -> frozenset:
    return frozenset(x[i : i + n] for i in range(len(x) - n + 1))


def feed_score(x: str, y: str) -> float:
    """Similarity of two normalised names in a feed: a blend of six measures."""
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    short, long = sorted((len(x), len(y)))
    two, three = (2 * len(_grams(x, n) & _grams(y, n)) / (len(_grams(x, n)) + len(_grams(y, n))) if short >= n else 0.0 for n in (2, 3))
    held = short / long if x in y or y in x else 0.0
    return min(1.0, 0.17 * ratio(x, y) + 0.10 * held + 0.22 * two + 0.24 * three + 0.12 * common_part(x, y) + 0.15 * (short / long))


_known_score = lru_cache(1 << 16)(feed_score)


def _marked(texts: list[str], parts: Callable[[str], frozenset], at: dict, width: int) -> np.ndarray:
    """How many parts of each text fall in each column; parts that share a column only raise what two texts seem to share."""
    out = np.zeros((len(texts), width), dtype="float32")
    for i, x in enumerate(texts):
        for g in parts(x):
            if (k := at.get(g)) is not None:
                out[i, k] += 1
    return out


def _shared(texts: list[str], names: list[str], parts: Callable[[str], frozenset], most: int = 4096) -> np.ndarray:
    """For each text and name the number of parts they share, or more where there are over ``most`` parts."""
    at = {g: k % most for k, g in enumerate(dict.fromkeys(g for x in names for g in parts(x)))}
    width = min(most, max(1, len(at)))
    return _marked(texts, parts, at, width) @ _marked(names, parts, at, width).T


@lru_cache(1 << 16)
def _letters(x: str) -> frozenset:
    """Each letter with its place among the equal ones, so that sets share what multisets do."""
    return frozenset((c, x.count(c, 0, i)) for i, c in enumerate(x))


def feed_bounds(texts: list[str], names: list[str]) -> np.ndarray:
    """For each text and name, none empty, a number that ``feed_score`` does not exceed: what the sequence ratio and the longest common part add is bounded by shared letters."""
    a, b = np.array([[len(x)] for x in texts], dtype="float64"), np.array([len(x) for x in names], dtype="float64")
    short, long = np.minimum(a, b), np.maximum(a, b)
    letters = _shared(texts, names, _letters)
    out = 0.29 * np.minimum(1.0, 2 * letters / (a + b)) + np.where(letters >= short, 0.25, 0.15) * short / long
    for n, weight in ((2, 0.22), (3, 0.24)):
        sizes = np.maximum(1, np.array([[len(_grams(x, n))] for x in texts]) + np.array([len(_grams(x, n)) for x in names]))
        out += weight * np.where(short >= n, np.minimum(1.0, 2 * _shared(texts, names, partial(_grams, n=n)) / sizes), 0.0)
    return np.where(letters >= long, 1.0, out) + 1e-5


def best_names(texts: list[str], names: list[str], most: int = 4096) -> tuple[list[int], list[float]]:
    """For each text the place of the name with the highest ``feed_score``, the first on ties, and the score; no text and no name is empty.

    Only names whose bound reaches the best score so far are compared in full. Names are taken ``most`` at a time.
    """
    at, best = [-1] * len(texts), [0.0] * len(texts)
    for begin in range(0, len(names), most):
        some = names[begin : begin + most]
        bounds = feed_bounds(texts, some)
        for i, (x, first) in enumerate(zip(texts, bounds.argmax(axis=1), strict=True)):
            if bounds[i, first] < best[i]:
                continue
            found, score = first, _known_score(x, some[first])
            rest = np.flatnonzero(bounds[i] >= max(score, best[i]))
            for k in rest[np.argsort(-bounds[i, rest], kind="stable")] if len(rest) > 1 else ():
                if bounds[i, k] < score:
                    break
                if (other := _known_score(x, some[k])) > score or other == score and k < found:
                    found, score = k, other
            if score > best[i]:
                at[i], best[i] = begin + int(found), score
    return at, best


def feed_similarity(a: Column, b: Column) -> Column:
    """``feed_score`` of two columns; empty and equal names are settled without Python."""
    settled = (F.length(a) == 0) | (F.length(b) == 0) | (a == b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(_pairwise(feed_score)(F.when(~settled, a), b))


def roster_similarity(a: Column, b: Column) -> Column:
    """Similarity of two roster names: the length ratio if one holds the other, else the sequence ratio, the only part for Python."""
    holds = F.contains(a, b) | F.contains(b, a)
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(holds, length_ratio(a, b)).otherwise(_pairwise(ratio)(F.when(~holds, a), b)))
