"""Boxes as structs x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_of(quad: Column) -> Column:
    """The box around an array of points x, y, cut to integers."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    low, top = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(low.alias("x"), top.alias("y"), (F.array_max(xs).cast("int") - low).alias("w"), (F.array_max(ys).cast("int") - top).alias("h"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; areas count as 1 at least."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    area = lambda r: F.greatest(F.lit(1), r["w"] * r["h"])
    return (w * h) / F.greatest(F.lit(1), area(a) + area(b) - w * h)


def alike(a: Column, b: Column, centre: float = 40, size: float = 35) -> Column:
    """Centres within 40 (sum of both distances) and sizes within 35."""
    mid = lambda r, at, by: r[at] + r[by] / 2
    near = F.abs(mid(a, "x", "w") - mid(b, "x", "w")) + F.abs(mid(a, "y", "h") - mid(b, "y", "h"))
    return (near <= centre) & (F.abs(a["w"] - b["w"]) + F.abs(a["h"] - b["h"]) <= size)


def pixels(region: Column, width: Column, height: Column, parent: Column | None = None) -> Column:
    """A region in parts of the image as pixels, cut to integers; inside a parent box if one is given."""
    if parent is not None:
        x0, y0, width, height = parent["x"], parent["y"], parent["w"], parent["h"]
    else:
        x0 = y0 = F.lit(0)
    cut = lambda v: v.cast("int")
    return F.when(region.isNotNull(), F.struct((x0 + cut(region["x"] * width)).alias("x"), (y0 + cut(region["y"] * height)).alias("y"),
                                               cut(region["w"] * width).alias("w"), cut(region["h"] * height).alias("h")))
