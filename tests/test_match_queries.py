import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hillstream.functions.text import header_names
from hillstream.operators import folds, gates, registration, threads
from hillstream.operators.resolve import left_right
from hillstream.plans import match_queries, sinks
from hillstream.plans.queries import QUERIES, _boxes

DIR = "/root/testdata/sf0.001"


def alike(a, b):
    return abs(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2) + abs(a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2) <= 40 and abs(a["w"] - b["w"]) + abs(a["h"] - b["h"]) <= 35


def iou(a, b):
    w = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def strongest(boxes):
    out = []
    for b in sorted(boxes, key=lambda b: (-b["confidence"], b["id"])):
        if not [k for k in out if k["player_id"] == b["player_id"] and alike(k, b)]:
            out.append(b)
    return out


def plain_rows(boxes):
    """Rows of two names of one frame by plain loops: (row, y, left, right)."""
    every = strongest(boxes)
    red = sorted((b for b in boxes if b["variant"] == "red"), key=lambda b: b["id"])
    if red:
        out, used = [], set()
        for a in red:
            near = sorted((o for o in every if o["team"] == "enemy" and alike(a, o)), key=lambda o: (-iou(a, o), -o["confidence"]))
            if near:
                used.add(near[0]["id"])
            out.append({**(near[0] if near else a), **{k: a[k] for k in "xywh"}, "side": "enemy"})
        for b in every:
            if b["id"] not in used and not any(alike(b, o) for o in out):
                out.append({**b, "side": "friendly"})
        boxes = strongest(out)
    else:
        boxes = [{**b, "side": None} for b in every]
    groups = []
    for b in sorted(boxes, key=lambda b: (b["y"] + b["h"] / 2, b["x"], b["id"])):
        for g in groups:
            if abs(sum(k["y"] + k["h"] / 2 for k in g) / len(g) - b["y"] - b["h"] / 2) <= 0.85 * max(b["h"], sum(k["h"] for k in g) / len(g)):
                g.append(b)
                break
        else:
            groups.append([b])
    groups.sort(key=lambda g: min(k["y"] for k in g))
    for i, g in enumerate(groups):
        names = left_right(g)
        yield i, sum(k["y"] + k["h"] / 2 for k in g) / len(g), names[0], names[1] if len(names) > 1 else None


def test_kill_events_against_plain_loops(spark):
    boxes = [r.asDict() for r in _boxes(spark, DIR).collect()]
    frames = {}
    for b in boxes:
        frames.setdefault((b["match_id"], b["frame"]), []).append(b)
    want, states = [], {}
    for (m, f), some in sorted(frames.items()):
        s = states.setdefault(m, threads.EventState())
        for i, y, left, right in plain_rows(some):
            name = lambda r: r and (r["player_id"], r["team"], r["confidence"])
            got = s.see(f * 0.3, y, name(left), name(right))
            want.append((m, f, i, got["created"], got["counted"], got["blocked"], got["killer"], got["victim"]))
    got = QUERIES["kill_events"](spark, DIR).select("match_id", "frame", "row_index", "created", "counted", "blocked", "killer", "victim").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(w[4] for w in want)


def test_counters_add_up(spark):
    rows = match_queries.kill_rows(spark, DIR)
    events = QUERIES["kill_events"](spark, DIR)
    got = threads.kill_counters(_boxes(spark, DIR), rows, events, ["match_id"]).collect()
    kd = QUERIES["kd_of_events"](spark, DIR).groupBy("match_id").agg(F.sum("kills").alias("k"), F.sum("deaths").alias("d")).collect()
    assert len(got) == 10 and all(r.kills == r.deaths == r.events_counted <= r.event_threads_created <= r.row_groups_detected for r in got)
    assert all(r.event_threads_created + r.event_threads_reused == r.row_groups_detected for r in got) and all(r.k == r.d > 0 for r in kd)


def test_telemetry(spark):
    by = {}
    for r in QUERIES["match_telemetry"](spark, DIR).orderBy("match_id", "timestamp").collect():
        by.setdefault(r.match_id, []).append(r.asDict())
    headers = header_names([n for _, n in match_queries.PLAYERS])
    assert headers == ["Jo", "Jo_2", "Jo_2_2", "Al", "Al_2", "Bo", "Cy", "Jo_3"]
    for m, x in by.items():
        assert [r["timestamp"] for r in x] == [10 * (i + 1) for i in range(len(x))] and list(x[0])[-8:] == headers
        assert all(a[h] <= b[h] for a, b in zip(x, x[1:], strict=False) for h in headers) and sum(x[-1][h] for h in headers) > 0
        if m % 3 != 2 or x[-1]["red_score"] is not None:
            assert any(r["blue_score"] == 250 or r["red_score"] == 250 for r in x) or m % 3 == 2


@pytest.mark.parametrize("rows_per_batch", [1, 3, 10000])
def test_folds_carry_state_over_batches(spark, rows_per_batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        times = {0: [0.0, 0.25, 0.5, 0.75, 1.125, 1.25, 1.5], 1: [0.3, 0.4, 5.0], None: [1.0, 1.1]}
        df = spark.createDataFrame([(k, t) for k, some in times.items() for t in some], "m int, t double")
        assert sorted((r.m is None, r.m or 0, r.t) for r in folds.throttled(df, ["m"], "t", ["t"], 2).collect()) == [(False, 0, 0.0), (False, 0, 0.5), (False, 0, 1.125), (False, 1, 0.3), (False, 1, 5.0), (True, 0, 1.0)]
        df = spark.createDataFrame([(0, float(t)) for t in (0, 3, 4.5, 6, 9)], "m int, t double")
        assert [r.t for r in folds.cooled_down(df, ["m"], "t", ["t"]).filter("counted").orderBy("t").collect()] == [0, 4.5, 9]
        df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 10, 25, None, 12, 40])], "m int, i int, v long")
        assert [r.accepted for r in folds.delta_gated(df, ["m"], "v", ["i"]).orderBy("i").collect()] == [False, True, False, False, True, False]
        assert folds.throttled(df, ["m"], "i", ["i"], 0).count() == 0 and folds.throttled(df.filter("false"), ["m"], "i", ["i"], 1).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_key_runs():
    f = pd.DataFrame({"a": [2**62, 2**62, 2**62 + 1, 5], "b": [None, None, None, "x"]})
    assert [(k, s.start, s.stop) for k, s in folds.key_runs(f, ["a", "b"])] == [((2**62, None), 0, 2), ((2**62 + 1, None), 2, 3), ((5, "x"), 3, 4)]
    assert list(folds.key_runs(f.head(0), ["a"])) == []


def test_registry():
    r = registration.Registry()
    assert [x[2] for x in r.distinct([(0, "Ab", "abcdef", 0.5), (1, "Ab", "abcdefg", 0.9), (2, "Z", "zzz", 0.1)])] == ["abcdefg", "zzz"]
    for _ in range(2):
        for team in registration.TEAMS:
            assert not r.ready()
            r.see(team, [(i, n.title(), n, 0.8) for i, n in enumerate(["alpha", "bravo", "gamma", "kilos", ""])])
    assert r.ready() and [c.name for c in r.top("friendly")] == ["Alpha", "Bravo", "Gamma", "Kilos"] and r.top("enemy")[0].confidence == pytest.approx(0.85)


def test_registry_orders_equal_weights_by_age():
    r = registration.Registry()
    for first, second in ((0.3, 0.1), (0.2, 0.2), (0.1, 0.3)):
        r.see("friendly", [(0, "alpha", "alpha", first), (1, "bravo", "bravo", second)])
    older, younger = r.teams["friendly"]
    assert (older.key, younger.key) == ("alpha", "bravo") and older.weight < younger.weight and [c.name for c in r.top("friendly")] == ["alpha", "bravo"]


def test_registry_stays_once_it_is_locked(spark):
    names = ["alpha", "bravo", "gamma", "kilos"]
    rows = [(0, f, t, i, n, n, 0.9) for f in range(2) for t in registration.TEAMS for i, n in enumerate(names)] + [(0, 5, t, i, "other" + n, "other" + n, 1.0) for t in registration.TEAMS for i, n in enumerate(names)]
    rows += [(1, 0, "friendly", 0, "alone", "alone", 0.5)]
    df = spark.createDataFrame(rows, "m int, frame int, team string, slot_index int, display_name string, normalized_name string, confidence double")
    got = {(r.m, r.frame): r for r in registration.registered(df, ["m"], "frame").collect()}
    assert [got[0, f].complete for f in (0, 1, 5)] == [False, True, True] and got[0, 5].players == got[0, 1].players == names * 2 and got[0, 1].player_ids == list(range(1, 9))
    assert got[1, 0].players == ["alone"] and got[1, 0].confidence == 0.5 and not got[1, 0].locked
    done = registration.completed(registration.registered(df, ["m"], "frame"), ["m"], "frame").collect()
    assert [(r.m, r.frame, r.locked) for r in done] == [(0, 1, True)]


def test_registration_done_lists_equal_weights_by_age(spark):
    sure = {"alpha": (0.83, 0.6), "bravo": (0.62, 0.81), "gamma": (0.9, 0.9), "kilos": (0.7, 0.7)}  # alpha and bravo both add up to 1.43, bravo in floats to a bit more
    rows = [(0, f, t, i, n, n, c[f]) for t in registration.TEAMS for i, (n, c) in enumerate(sure.items()) for f in range(2)]
    df = spark.createDataFrame(rows, "m int, frame int, team string, slot_index int, display_name string, normalized_name string, confidence double")
    done = registration.completed(registration.registered(df, ["m"], "frame"), ["m"], "frame").collect()
    assert [(r.frame, r.players) for r in done] == [(1, ["gamma", "alpha", "bravo", "kilos"] * 2)]


def test_gates(spark):
    rows = [("3", 0.9, 0.7, 0.5), ("6", 0.9, 0.6, 0.5), ("33", 0.9, 0.2, 0.8), ("3", 0.8, 0.7, 0.7), (None, 0.9, 0.3, 0.59)]
    got = spark.createDataFrame(rows, "d string, c double, zero double, one double").select(gates.hill_reading(F.col("d"), F.col("c")), gates.counter_reading(F.col("zero"), F.col("one"))).collect()
    assert [tuple(r) for r in got] == [(3, 0), (None, None), (None, 1), (None, None), (None, None)]
    names = spark.createDataFrame([("ab-c", 0.2), ("a-b", 0.9), ("abc", 0.1), ("", 0.9)], "t string, c double").select(gates.name_counts(F.col("t"), F.col("c")))
    assert [r[0] for r in names.collect()] == [True, False, False, False]


def test_ticks_with_missing_images(spark):
    df = spark.createDataFrame([(0, 0.0, None), (0, 0.2, 1), (0, 0.6, 1), (0, 1.2, 1)], "m int, t double, image int")
    ticks = lambda module: [r.t for r in gates.module_ticks(df, ["m"], "t", ["t"], "image", module).orderBy("t").collect()]
    assert ticks("scoreboard") == [0.2, 1.2] and ticks("hardpoint") == [0.6, 1.2] and ticks("utility") == [0.6, 1.2] and ticks("killfeed") == [0.6, 1.2]


def test_report_without_players(spark):
    counters = ", ".join(f"{c} int" for c in sinks.COUNTERS.values())
    facts = spark.createDataFrame([(0, 1, 2, 3, *range(13))], f"m int, nades int, stuns int, specialties int, {counters}")
    stats = spark.createDataFrame([], "m int, player_id long, name string, kills long, deaths long, detections long")
    got = sinks.report(stats, facts, ["m"], {"Source": F.lit("x")}, {"Visible": F.lit(None)}, {"Blue score": F.lit(None)}, F.lit(0.5), {"killfeed": F.lit("waiting")})
    lines = [r.line for r in got.orderBy("line_number").collect()]
    assert lines[:8] == ["Validation Summary", "Source: x", "", "Registered Players:", "- none", "", "Scoreboard Registration:", "Visible: None"]
    assert lines[8:25] == ["", "Killfeed Counts:", *(f"{k}: {i}" for i, k in enumerate(sinks.COUNTERS)), "Player detection counts:", "- none"]
    assert lines[25:] == ["", "Player Kills:", "- none", "", "Player Deaths:", "- none", "", "Utility Counts:", "Grenade: 1", "Stun: 2", "Specialty equipment: 3", "", "Hardpoint:", "Blue score: None", "",
                          "OCR confidence: 0.5", "", "Module Status:", "- killfeed: waiting"]


def test_feed_score():
    from hillstream.functions.text import common_part, feed_score

    assert feed_score("", "a") == 0 and feed_score("same", "same") == 1 and common_part("", "") == 0
    assert feed_score("abcd", "abce") == pytest.approx(0.17 * 0.75 + 0.22 * 4 / 6 + 0.24 * 0.5 + 0.12 * 0.75 + 0.15)
    assert feed_score("a", "ab") == pytest.approx(0.17 * 2 / 3 + 0.10 * 0.5 + 0.12 * 2 / 3 + 0.15 * 0.5) and math.isclose(feed_score("xyz", "abc"), 0.15)
