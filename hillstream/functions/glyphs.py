"""Digits of a score or counter read from images by segments, templates and shape."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hillstream.functions.image import digit_similarity, in_range_share
from hillstream.functions.pixels import blurred, components, cubic, dark_side, grey, hole_areas, hsv, nearest, parted
from hillstream.functions.scores import LEGAL_DIGITS

#: Width and height of a figure.
SIZE = (18, 24)
#: What a shape adds to a digit's similarity. A row holds when its test of the shape does.
SHAPE_BONUS = (
    (lambda s: s.holes > 0, {"0": 0.055, "6": 0.055, "8": 0.055, "9": 0.055, "1": -0.045, "3": -0.045, "5": -0.045, "7": -0.045}),
    (lambda s: s.holes == 0, {"1": 0.015, "2": 0.015, "3": 0.015, "4": 0.015, "5": 0.015, "7": 0.015, "0": -0.02, "6": -0.02, "8": -0.02, "9": -0.02}),
    (lambda s: s.lower - s.upper > 0.08, {"6": 0.045, "5": -0.04}),
    (lambda s: s.upper - s.lower > 0.08, {"5": 0.03, "6": -0.03}),
    (lambda s: s.left - s.right > 0.08, {"6": 0.03, "5": 0.015}),
    (lambda s: s.right - s.left > 0.10 and s.holes == 0, {"3": 0.045, "5": -0.02}),
    (lambda s: abs(s.drift) <= 0.035, {"1": 0.05, "7": -0.025}),
    (lambda s: s.drift <= -0.045, {"7": 0.055, "1": -0.035}),
)


@dataclass(frozen=True)
class Shape:
    """Holes of area 4 and more, parts of the set pixels in each half, and how far they drift to the right going down."""

    holes: int = 0
    upper: float = 0.0
    lower: float = 0.0
    left: float = 0.0
    right: float = 0.0
    drift: float = 0.0


def shape_of(glyph: np.ndarray) -> Shape:
    y, x = np.nonzero(glyph)
    if not len(y):
        return Shape()
    h, w = glyph.shape
    top, west = y < max(1, h // 2), x < max(1, w // 2)
    drift = (x[~top].mean() - x[top].mean()) / w if top.any() and not top.all() else 0.0
    return Shape(sum(a >= 4 for a in hole_areas(glyph)), top.mean(), 1 - top.mean(), west.mean(), 1 - west.mean(), float(drift))


def shape_bonus(digit: str, shape: Shape) -> float:
    return sum(bonus.get(digit, 0.0) for test, bonus in SHAPE_BONUS if test(shape))


def width_ratio(glyph: np.ndarray) -> float:
    """Width by height of the box around the set pixels."""
    y, x = np.nonzero(glyph)
    return float((np.ptp(x) + 1) / (np.ptp(y) + 1)) if len(y) else 0.0


def score_crop(image: np.ndarray, bias: float = 30.0, masked: int = 2) -> np.ndarray:
    """The bright figures of a score; columns at the left that belong to a frame are cleared."""
    out = parted(blurred(grey(image)), bias)
    if 0 < masked < out.shape[1]:
        out[:, :masked] = False
    return out


def template(image: np.ndarray, size: tuple[int, int] = SIZE) -> np.ndarray:
    """A grey picture of a digit as a mask of the size (width, height) that segments have."""
    return dark_side(parted(cubic(image, *size)), 0.55)


def segments(mask: np.ndarray, size: tuple[int, int] = SIZE, most: int = 3) -> list[np.ndarray]:
    """Up to ``most`` figures from left to right, the largest ones, scaled to ``size``.

    Parts that are too small, thin and at the left edge, or flat and at the bottom are no figures.
    """
    if not mask.size:
        return []
    h, w = mask.shape
    least = max(6, round(h * w * 0.015)), max(4, round(h * 0.35)), max(2, round(w * 0.04))
    found = []
    for cells in components(mask):
        (y0, x0), (y1, x1) = cells.min(axis=0), cells.max(axis=0)
        tall, wide = y1 - y0 + 1, x1 - x0 + 1
        small = len(cells) < least[0] or tall < least[1] or wide < least[2]
        if not small and not (x0 == 0 and wide / tall < 0.18) and not (y1 + 1 >= h - 1 and tall / h < 0.22):
            found.append((len(cells), x0, slice(y0, y1 + 1), slice(x0, x1 + 1)))
    largest = sorted(sorted(found, key=lambda f: f[1]), key=lambda f: -f[0])[:most]
    return [nearest(np.pad(mask[f[2], f[3]].astype(bool), 1), *size) for f in sorted(largest, key=lambda f: f[1])]


def ranked_digits(glyph: np.ndarray, templates: dict[str, list[np.ndarray]], allowed: str | None = None) -> list[tuple[str, float]]:
    """Digits by falling similarity to their best template, moved by their shape; the order of the templates on ties."""
    shape = shape_of(glyph)
    best = {d: max((digit_similarity(glyph, t) for t in some), default=0.0) for d, some in templates.items() if allowed is None or d in allowed}
    return sorted(((d, s + shape_bonus(d, shape)) for d, s in best.items() if s > 0), key=lambda x: -x[1])


def without_artifact(glyphs: list[np.ndarray], templates: dict[str, list[np.ndarray]], least_fill: float, most_width: float, most_similarity: float) -> list[np.ndarray]:
    """Of three figures or more the first goes if it is nearly empty, or thin and like no digit."""
    if len(glyphs) < 3:
        return glyphs
    first = glyphs[0]
    like = (ranked_digits(first, templates) or [("", 0.0)])[0][1]
    return glyphs[1:] if first.mean() < least_fill or width_ratio(first) <= most_width and like <= most_similarity else glyphs


def legal_digits(before: str, length: int) -> str:
    """The digits that may follow ``before`` in a number of ``length`` digits from 0 to 250."""
    some = LEGAL_DIGITS[length][len(before)]
    return {"2": "012345", "25": "0"}.get(before, some) if length == 3 else some


def read_score(mask: np.ndarray, templates: dict[str, list[np.ndarray]], size: tuple[int, int] = SIZE, least_digit: float = 0.45, least: float = 0.55, each: int = 2,
               least_fill: float = 0.10, most_width: float = 0.20, most_similarity: float = 0.55) -> tuple[str | None, float]:
    """The legal number whose digits are likeliest on average over the ``each`` best of every figure, and its mean similarity."""
    glyphs = without_artifact(segments(mask, size), templates, least_fill, most_width, most_similarity) if templates else []
    if not glyphs:
        return None, 0.0
    numbers = [("", 0.0)]
    for g in glyphs:
        numbers = [(text + d, total + s) for text, total in numbers for d, s in ranked_digits(g, templates, legal_digits(text, len(glyphs)))[:each] if s >= least_digit]
    text, total = max(numbers, key=lambda x: x[1], default=(None, 0.0))
    mean = total / len(glyphs)
    return (text, mean) if text and mean >= least else (None, max(mean, 0.0))


def counter_crop(image: np.ndarray, size: tuple[int, int] = SIZE) -> np.ndarray:
    """The figure of a counter as a mask."""
    return dark_side(parted(blurred(cubic(grey(image), *size))), 0.55)


@dataclass(frozen=True)
class CounterRules:
    """Bounds of the shapes of 0 and 1, and what a reading has to reach."""

    hole: float = 0.05
    strong_hole: float = 0.10
    zero_width: float = 0.34
    zero_fill: tuple[float, float] = (0.22, 0.70)
    one_width: float = 0.45
    one_centre: float = 0.45
    one_sides: float = 0.42
    least: float = 0.60
    margin: float = 0.18


def counter_scores(mask: np.ndarray, rules: CounterRules = CounterRules()) -> dict[str, float]:  # noqa: B008
    """How much a figure looks like 0 and like 1, by its hole, width, fill and where its columns are strong."""
    y, x = np.nonzero(mask)
    if not len(y):
        return {"0": 0.0, "1": 0.0}
    box = mask[y.min() : y.max() + 1, x.min() : x.max() + 1].astype(bool)
    h, w = box.shape
    columns, third = box.mean(axis=0), max(1, w // 3)
    sides = (columns[:third].mean() + columns[-third:].mean()) / 2
    centre = columns[max(0, w // 2 - 1) : w // 2 + 2].mean()
    hole, wide, fill = max(hole_areas(box), default=0.0) / box.size, w / h, box.mean()
    zero, one = (0.78, -0.18) if hole >= rules.strong_hole else (0.62, -0.10) if hole >= rules.hole else (0.0, 0.06)
    zero += 0.18 * (rules.zero_width <= wide <= 0.85) + 0.12 * (rules.zero_fill[0] <= fill <= rules.zero_fill[1]) + 0.10 * (sides >= 0.75 * centre)
    one += 0.20 * (wide <= rules.one_width) + 0.42 * (centre >= rules.one_centre) + 0.22 * (sides <= rules.one_sides) + 0.08 * (hole <= 0.01) + 0.08 * (fill <= 0.45)
    return {d: float(min(1.0, max(0.0, s))) for d, s in (("0", zero), ("1", one))}


def read_counter(mask: np.ndarray, rules: CounterRules = CounterRules()) -> tuple[int | None, float]:  # noqa: B008
    """0 or 1 if one of them is likely enough and clearly likelier, and the better score."""
    (digit, best), (_, second) = sorted(counter_scores(mask, rules).items(), key=lambda x: -x[1])
    return (int(digit) if best >= rules.least and best - second >= rules.margin else None), best


def is_lit(image: np.ndarray, low: tuple[int, int, int] = (7, 160, 110), most_hue: int = 13, least: float = 0.73) -> tuple[bool, float]:
    """Whether enough of a colour image lies in a range of hues, saturated and bright enough, and that share."""
    share = in_range_share(hsv(image), low, (most_hue, 255, 255)) if image.size else 0.0
    return bool(image.size) and share >= least, share
