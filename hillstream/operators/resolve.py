"""Names and rows of a frame resolved to players.

Everything here is keyed by frame or match. Greedy rules that look at what they kept
before run per frame, whose boxes are few; the rest are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hillstream.functions.geometry import alike, overlap
from hillstream.functions.text import best_names, roster_similarity


def best_player(texts: DataFrame, players: DataFrame, keys: list[str], row: list[str], text: str, name: str, pool: Callable[[Column], Column] | None = None, most: int = 512) -> DataFrame:
    """For each normalised text the player of its roster with the highest ``feed_score``; the smallest player_id on ties, none at 0.

    ``keys`` tie a text to its roster (a match) and are needed: without them every text would meet every player.
    Equal texts of a roster are compared once, with its different names, and joined to their rows afterwards. A roster is one array beside
    up to ``most`` texts, so no pairs are made; these are dealt evenly, since comparing takes the time.
    ``pool`` says of a player (a struct with the columns of ``players``) whether the text may be theirs; it may look at all columns
    of a text's row, so with it only equal rows are taken together.
    """
    if not keys:
        raise ValueError("a roster is joined by the keys of its match")
    beside = [] if pool is None else [c for c in texts.columns if c not in keys]
    each = players.filter(F.length(name) > 0)
    if pool is None:
        each = each.groupBy(*keys, name).agg(F.min("player_id").alias("player_id"))
    others = [c for c in each.columns if c not in (*keys, "player_id")]
    roster = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("player_id", *others))).alias("_roster"))
    asked = texts.select(*keys, *beside, F.col(text).alias("_text")).filter(F.length("_text") > 0).distinct()
    number = F.row_number().over(Window.partitionBy(*keys, *beside).orderBy("_text"))
    some = asked.withColumn("_part", F.floor((number - 1) / most)).groupBy(*keys, *beside, "_part").agg(F.collect_list("_text").alias("_texts")).drop("_part")
    near = some.join(roster, keys)
    if pool is not None:
        near = near.withColumn("_roster", F.filter("_roster", pool))

    def pick(some: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_names(list(t), list(n)) for t, n in zip(some, names, strict=True)], columns=["at", "score"])

    found = F.pandas_udf(pick, "at array<int>, score array<double>")(F.col("_texts"), F.transform("_roster", lambda p: p[name]))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = near.repartition(parts).select(*keys, *beside, "_texts", "_roster", found.alias("_b"))
    best = best.select(*keys, *beside, "_roster", F.explode(F.arrays_zip("_texts", F.col("_b.at").alias("at"), F.col("_b.score").alias("score"))).alias("_b")).filter("_b.score > 0")
    who = F.get("_roster", F.col("_b.at"))
    best = best.select(*(F.col(c).alias(f"_key_{c}") for c in (*keys, *beside)), F.col("_b._texts").alias("_text"), who["player_id"].cast("long").alias("_player"), who[name].alias("_name"), F.col("_b.score").alias("_score"))
    same = F.col(text) == F.col("_text")
    for c in keys:
        same = same & (F.col(c) == F.col(f"_key_{c}"))
    for c in beside:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return texts.join(best, same).select(*keys, *row, F.col("_player").alias("player_id"), F.col("_name").alias(name), F.col("_score").alias("score"))


def variant_pool(variant: Column, team: Column) -> Column:
    """Red text is looked up among enemies, blue among friends, the rest among all."""
    return (variant == "red") & (team == "enemy") | (variant == "blue") & (team == "friendly") | ~variant.isin("red", "blue")


def best_partner(anchors: DataFrame, others: DataFrame, frame: list[str]) -> DataFrame:
    """For each anchor (id, box) the alike box of others with the highest overlap, then confidence, then id."""
    a = anchors.select(*frame, F.col("id").alias("anchor_id"), F.col("box").alias("_a"))
    o = others.select(*frame, F.col("id").alias("other_id"), F.col("box").alias("_o"), "confidence")
    near = a.join(o, frame).filter(alike(F.col("_a"), F.col("_o"))).withColumn("iou", overlap(F.col("_a"), F.col("_o")))
    best = near.groupBy(*frame, "anchor_id").agg(F.max_by(F.struct("other_id", "iou", "confidence"), F.struct("iou", "confidence", -F.col("other_id"))).alias("_b"))
    return best.select(*frame, "anchor_id", "_b.other_id", "_b.iou", "_b.confidence")


def _box(r: dict) -> tuple[float, float, float, float]:
    return r["x"], r["y"], r["w"], r["h"]


def _alike(a: tuple, b: tuple) -> bool:
    centre = abs(a[0] + a[2] / 2 - b[0] - b[2] / 2) + abs(a[1] + a[3] / 2 - b[1] - b[3] / 2)
    return centre <= 40 and abs(a[2] - b[2]) + abs(a[3] - b[3]) <= 35


def _iou(a: tuple, b: tuple) -> float:
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / max(1, max(1, a[2] * a[3]) + max(1, b[2] * b[3]) - w * h)


def _per_frame(df: DataFrame, frame: list[str], f: Callable[[list[dict]], list[dict]], schema) -> DataFrame:
    """Rows of a frame in, rows out. Rows are dealt by frame and sorted, so a task holds one frame at a time, however many it gets."""
    names = [c.name for c in schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for b in frames:
            out: list[dict] = []
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                if (key := tuple(row[k] for k in frame)) != last and held:
                    out += f(held)
                    held = []
                last = key
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(f(held) if held else [], columns=names)

    return df.repartition(*frame).sortWithinPartitions(*frame).mapInPandas(run, schema)


def kept_boxes(rows: list[dict]) -> list[dict]:
    """By falling confidence, rows without an alike box of the same player among those kept."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: (-r["confidence"], r["id"])):
        if not any(k["player_id"] == r["player_id"] and _alike(_box(k), _box(r)) for k in out):
            out.append(r)
    return out


def deduped_boxes(df: DataFrame, frame: list[str]) -> DataFrame:
    return _per_frame(df, frame, kept_boxes, df.schema)


def grouped_rows(df: DataFrame, frame: list[str], factor: float = 0.85) -> DataFrame:
    """Adds row_index: boxes by (centre, x) join the first group whose mean centre is near; groups count from the top."""
    from pyspark.sql import types as T

    def f(rows: list[dict]) -> list[dict]:
        groups: list[list[dict]] = []
        for r in sorted(rows, key=lambda r: (r["y"] + r["h"] / 2, r["x"], r["id"])):
            c = r["y"] + r["h"] / 2
            for g in groups:
                mean = sum(k["y"] + k["h"] / 2 for k in g) / len(g)
                if abs(mean - c) <= factor * max(1, r["h"], sum(max(1, k["h"]) for k in g) / len(g)):
                    g.append(r)
                    break
            else:
                groups.append([r])
        groups.sort(key=lambda g: min(k["y"] for k in g))
        return [r | {"row_index": i} for i, g in enumerate(groups) for r in g]

    return _per_frame(df, frame, f, T.StructType(df.schema.fields + [T.StructField("row_index", T.IntegerType())]))


def merged_variants(df: DataFrame, frame: list[str]) -> DataFrame:
    """Red boxes anchor: each takes the identity of the best alike enemy, itself without one, and stands on the enemy's side.

    Boxes that no anchor took and that are alike to none listed before them stand on the friends' side. Without red
    boxes all stay, untagged. Alike boxes of one player are kept once, before and after.
    df: id, variant, team, player_id, confidence, x, y, w, h.
    """
    from pyspark.sql import types as T

    def f(rows: list[dict]) -> list[dict]:
        every = kept_boxes(rows)
        red = sorted((r for r in rows if r["variant"] == "red"), key=lambda r: r["id"])
        if not red:
            return [r | {"side": None} for r in every]
        out, used = [], set()
        for a in red:
            near = [o for o in every if o["team"] == "enemy" and _alike(_box(a), _box(o))]
            best = max(near, key=lambda o: (_iou(_box(a), _box(o)), o["confidence"]), default=None)
            if best is not None:
                used.add(best["id"])
            out.append((best or a) | {k: a[k] for k in "xywh"} | {"side": "enemy"})
        for r in every:
            if r["id"] not in used and not any(_alike(_box(r), _box(k)) for k in out):
                out.append(r | {"side": "friendly"})
        return kept_boxes(out)

    return _per_frame(df, frame, f, T.StructType(df.schema.fields + [T.StructField("side", T.StringType())]))


def left_right(rows: list[dict], sure: float = 0.7) -> list[dict]:
    """The name on the left (the killer) and the one on the right (the victim) of one row of names, or the only one.

    A side prefers names whose tag is its own or missing: the leftmost, or the one that reaches farthest right. A sure left
    name takes its opponent farthest right as partner; failing that, a sure right name the strongest opponent to its left; failing
    that, two names of one side do either. If they are still of one player or team, the right one is chosen
    anew among other players.
    """
    def leftmost(some: list[dict]) -> dict:
        own = [r for r in some if r.get("side") in (None, "friendly")] or some
        return min(own, key=lambda r: (r["x"], r["y"], -r["confidence"]))

    def farthest(some: list[dict]) -> dict:
        own = [r for r in some if r.get("side") in (None, "enemy")] or some
        return max(own, key=lambda r: (r["x"] + r["w"], r["confidence"]))

    def one_side(a: dict, b: dict) -> bool:
        return a["player_id"] == b["player_id"] or a["team"] == b["team"]

    rows = sorted(rows, key=lambda r: (r["x"], r["y"]))
    if len(rows) < 2:
        return rows
    left, right = leftmost(rows), farthest(rows)
    after = max((r for r in rows if not one_side(r, left) and r["x"] >= left["x"]), key=lambda r: (r["x"] + r["w"], r["confidence"]), default=None)
    before = min((r for r in rows if not one_side(r, right) and r["x"] <= right["x"]), key=lambda r: (-r["confidence"], r["x"]), default=None)
    if after and (left["confidence"] >= sure or one_side(left, right) and not (before and right["confidence"] >= sure)):
        right = after
    elif before and (right["confidence"] >= sure or one_side(left, right)):
        left = before
    if one_side(left, right):
        others = [r for r in rows if r["player_id"] != left["player_id"]]
        if not others:
            return [left]
        right = farthest(others)
    return sorted((left, right), key=lambda r: (r["x"], r["y"]))


def row_sides(df: DataFrame, frame: list[str]) -> DataFrame:
    """One row for each row of names: left and right player, team and confidence (null: none), and the mean centre y."""
    from pyspark.sql import types as T

    kinds = {f.name: f for f in df.schema.fields}
    fields = [kinds[k] for k in [*frame, "row_index"]] + [T.StructField("y", T.DoubleType())]
    for side in ("left", "right"):
        fields += [T.StructField(f"{side}_player", T.LongType()), T.StructField(f"{side}_team", T.StringType()), T.StructField(f"{side}_confidence", T.DoubleType())]

    def f(rows: list[dict]) -> list[dict]:
        names = left_right(rows)
        out = {k: rows[0][k] for k in [*frame, "row_index"]} | {"y": sum(r["y"] + r["h"] / 2 for r in rows) / len(rows)}
        for side, r in zip(("left", "right"), [*names, None][:2], strict=True):
            out |= {f"{side}_player": r and r["player_id"], f"{side}_team": r and r["team"], f"{side}_confidence": r and r["confidence"]}
        return [out]

    return _per_frame(df, [*frame, "row_index"], f, T.StructType(fields))


def slot_consensus(df: DataFrame, keys: list[str], slot: list[str]) -> DataFrame:
    """df: name (normalised), display, confidence. The name with the most confidence, its commonest display, and its part of the weight."""
    shown = df.groupBy(*keys, *slot, "name", "display").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("weight"))
    names = shown.groupBy(*keys, *slot, "name").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"),
                                                   F.max_by("display", F.struct("n", F.length("display"), "display")).alias("display"))
    best = names.groupBy(*keys, *slot).agg(F.max_by(F.struct("name", "display", "n", "weight"), F.struct("weight", "n", "name")).alias("b"), F.sum("weight").alias("total"))
    return best.select(*keys, *slot, "b.name", "b.display", F.col("b.n").cast("long").alias("observations"), F.round(F.col("b.weight").cast("double") / F.col("total").cast("double"), 6).alias("confidence"))


def cluster_confidence(total: Column, n: Column) -> Column:
    """The mean with up to 0.20 more for repeated sightings."""
    return F.least(F.lit(1.0), total / n + F.least(F.lit(0.20), 0.05 * (n - 1)))


def top_names(clusters: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """The first four names of a team by sightings, weight and length, then the name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("observations"), F.desc("weight"), F.desc(F.length("name")), "name")
    return clusters.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def ready_teams(clusters: DataFrame, match: list[str], least: int = 2, sure: float = 0.72, names: int = 4) -> DataFrame:
    """Matches with enough trusted names on both sides."""
    good = clusters.filter((F.col("observations") >= least) & (F.col("confidence") >= sure)).groupBy(*match, "team").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= names)
    return good.groupBy(*match).agg(F.count(F.lit(1)).alias("teams")).filter("teams = 2").select(*match)


def dense_ids(roster: DataFrame, match: list[str]) -> DataFrame:
    """Adds player_id, 1 to n, friends before enemies, in slot order."""
    w = Window.partitionBy(*match).orderBy(F.when(F.col("team") == "friendly", 0).otherwise(1), "slot_index", "name")
    return roster.withColumn("player_id", F.row_number().over(w))


def similar_names(df: DataFrame, keys: list[str], a: str, b: str, least: float = 0.82) -> DataFrame:
    return df.filter(roster_similarity(F.col(a), F.col(b)) >= least)
