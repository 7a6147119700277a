import pytest
from pyspark.sql import functions as F

from hillstream.functions import image
from hillstream.operators import resolve, threads
from hillstream.operators.resolve import left_right


def row(i, player, team, confidence, x, y=0, w=10, h=10, side=None, variant="grayscale"):
    return {"id": i, "player_id": player, "team": team, "confidence": confidence, "x": x, "y": y, "w": w, "h": h, "side": side, "variant": variant}


def test_left_right():
    a, b, c = row(1, 1, "friendly", 0.9, 0), row(2, 6, "enemy", 0.5, 50), row(3, 7, "enemy", 0.8, 100)
    ids = lambda rows: [r["id"] for r in left_right(rows)]
    assert ids([]) == [] and ids([b]) == [2] and ids([c, a, b]) == [1, 3]
    assert ids([row(1, 1, "friendly", 0.5, 0), row(2, 2, "friendly", 0.5, 50)]) == [1, 2]
    assert ids([row(1, 1, "friendly", 0.5, 0), row(2, 1, "friendly", 0.5, 50)]) == [1]
    assert ids([row(1, 1, "friendly", 0.5, 0), row(2, 6, "enemy", 0.6, 20), row(3, 2, "friendly", 0.8, 60)]) == [2, 3]


SCHEMA = "m int, frame int, id int, variant string, team string, player_id int, confidence double, x int, y int, w int, h int"


def boxes(spark, rows):
    return spark.createDataFrame([(0, 0, r["id"], r["variant"], r["team"], r["player_id"], r["confidence"], r["x"], r["y"], r["w"], r["h"]) for r in rows], SCHEMA)


def test_rows_from_boxes(spark):
    got = resolve.grouped_rows(boxes(spark, [row(1, 1, "friendly", 0.9, 0, 5), row(2, 2, "enemy", 0.9, 0, 10), row(3, 3, "enemy", 0.9, 0, 35)]), ["m", "frame"]).collect()
    assert {r.id: r.row_index for r in got} == {1: 0, 2: 0, 3: 1}


def test_deduped_boxes(spark):
    got = resolve.deduped_boxes(boxes(spark, [row(1, 1, "friendly", 0.5, 0), row(2, 1, "friendly", 0.9, 5), row(3, 1, "friendly", 0.4, 90), row(4, 2, "friendly", 0.3, 5)]), ["m", "frame"]).collect()
    assert sorted(r.id for r in got) == [2, 3, 4]


def test_anchored(spark):
    rows = [row(1, 6, "enemy", 0.6, 100, variant="red"), row(2, 7, "enemy", 0.9, 104), row(3, 1, "friendly", 0.8, 0), row(4, 2, "friendly", 0.7, 106)]
    got = sorted((r.id, r.player_id, r.x, r.side) for r in resolve.merged_variants(boxes(spark, rows), ["m", "frame"]).collect())
    assert got == [(1, 6, 100, "enemy"), (3, 1, 0, "friendly")]
    got = resolve.merged_variants(boxes(spark, rows[1:]), ["m", "frame"]).collect()
    assert {r.side for r in got} == {None} and len(got) == 3


THREAD = "m int, t double, y double, left_player long, left_team string, left_confidence double, right_player long, right_team string, right_confidence double"
A, B, NONE = (1, "friendly", 0.9), (6, "enemy", 0.9), (None, None, None)
EVENTS = [(0, 0.0, 100.0, *A, *NONE), (0, 0.4, 110.0, *A, *B), (0, 0.8, 110.0, *A, *B), (0, 3.0, 110.0, *A, *B)]


def test_threads(spark):
    got = threads.event_threads(spark.createDataFrame(EVENTS, THREAD), ["m"], ["t"]).orderBy("t").collect()
    assert [r.created for r in got] == [True, False, False, True] and [r.counted for r in got] == [False, True, False, False]
    assert [r.blocked for r in got] == [None, None, None, "victim_cooldown"] and (got[1].killer, got[1].victim) == (1, 6)


def test_blocked():
    s = threads.EventState()
    assert s.see(0, 0, (1, "a", 0.9), (2, "a", 0.9))["blocked"] == "same_side"
    assert s.see(0, 200, (1, "a", 0.9), (3, "b", 0.1))["blocked"] == "low_confidence"
    assert s.see(0.5, 200, (1, "a", 0.9), (3, "b", 0.6))["counted"] and s.see(1, 400, None, None)["created"] is None


def test_roster_clusters(spark):
    names = [(0, i, n) for i, n in enumerate(["player1", "player1x", "other", "player1", "othe"])]
    got = threads.roster_clusters(spark.createDataFrame(names, "m int, i int, name string"), ["m"], ["i"]).orderBy("i").collect()
    assert [r.cluster for r in got] == [0, 0, 1, 0, 1 if threads.roster_ratio("othe", "other") >= 0.82 else 2]
    kept = threads.deduped_names(spark.createDataFrame(names, "m int, i int, name string"), ["m"], ["i"]).collect()
    assert {r.name for r in kept} >= {"player1", "other"} and len(kept) <= 3


def test_best_player_of_a_roster(spark):
    from hillstream.functions.text import feed_score

    texts = spark.createDataFrame([(0, "abc", "red"), (1, "abc", "red"), (2, "abc", "red"), (0, "xq", "blue"), (3, "", "red"), (3, None, "red")], "m int, t string, v string")
    players = spark.createDataFrame([(0, 1, "abc", "friendly"), (0, 2, "abc", "enemy"), (0, 3, "zzzz", "enemy"), (1, 4, "abcd", "enemy"), (1, 5, "abd", "enemy"), (3, 6, "abc", "enemy")], "m int, player_id int, name string, team string")
    got = resolve.best_player(texts, players, ["m"], ["t"], "t", "name").collect()
    want = {(0, "abc"): (1, 1.0), (1, "abc"): (4, feed_score("abc", "abcd")), (0, "xq"): (1, feed_score("xq", "abc"))}
    assert {(r.m, r.t): (r.player_id, r.score) for r in got} == {k: (p, pytest.approx(s)) for k, (p, s) in want.items()}
    got = resolve.best_player(texts, players, ["m"], ["t"], "t", "name", lambda p: resolve.variant_pool(F.col("v"), p["team"])).collect()
    assert {(r.m, r.t): r.player_id for r in got} == {(0, "abc"): 2, (1, "abc"): 4, (0, "xq"): 1}
    with pytest.raises(ValueError):
        resolve.best_player(texts, players, [], ["t"], "t", "name")


def test_variant_pools(spark):
    rows = spark.createDataFrame([("red", "enemy"), ("red", "friendly"), ("blue", "friendly"), ("blue", "enemy"), ("yellow", "enemy")], "v string, t string")
    assert [r[0] for r in rows.select(resolve.variant_pool(F.col("v"), F.col("t"))).collect()] == [True, False, True, False, True]


def test_cluster_confidence(spark):
    assert spark.range(1).select(resolve.cluster_confidence(F.lit(2.1), F.lit(3))).first()[0] == pytest.approx(0.80)


def test_images():
    import numpy as np

    g = np.zeros((6, 6), dtype=bool)
    g[:3] = True
    assert image.digit_similarity(g, g) == pytest.approx(1.0) and image.intersection_over_union(g, ~g) == 0 and image.masses(g)["upper"] == 1
    assert image.changed_share(g, None) == 1 and image.changed_share(g, ~g) == 1 and image.changed_share(g, g) == 0
    assert image.best_digits([[(2, 0.9), (7, 0.95)], [(5, 0.8)], [(0, 0.9), (9, 0.99)]], lambda s: int(s) <= 250) == (250, pytest.approx(2.6 / 3))
    assert image.in_range_share(np.full((2, 2, 3), 5), (0, 0, 0), (9, 9, 9)) == 1


def test_best_names_equals_comparing_all(monkeypatch):
    import random

    from hillstream.functions import text

    r = random.Random(5)
    for letters, longest in (("ab", 3), ("abc", 8), ("abcdefgh0", 30), ("\u00e9\U0001f600ab", 8)):
        word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, longest)))
        names, texts = [word() for _ in range(25)], [word() for _ in range(10)]
        texts += names[:2]
        for most in (4, 4096):
            for x, at, score in zip(texts, *text.best_names(texts, names, most), strict=True):
                all_ = [text.feed_score(x, n) for n in names]
                assert (at, score) == (all_.index(max(all_)), max(all_))
        few = text._shared(texts, names, text._letters, 2)
        assert all(few[i, k] >= len(text._letters(x) & text._letters(n)) for i, x in enumerate(texts) for k, n in enumerate(names))
    assert text.best_names(["a"], []) == ([-1], [0.0])

    names, calls = ["".join(r.choice("abcdefghij") for _ in range(20)) for _ in range(300)], []
    monkeypatch.setattr(text, "_known_score", lambda x, y: calls.append(x) or text.feed_score(x, y))
    assert text.best_names([n[:4] + n[5:] for n in names], names)[0] == list(range(300)) and len(calls) < 2 * 300


def test_best_player_compares_copies_once(spark):
    names = ["".join(chr(97 + (i * k + i + k) % 26) for k in range(12)) for i in range(8)]
    players = spark.range(16_000).select((F.col("id") % 2).alias("m"), (F.col("id") + 7).alias("player_id"), F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("id") / 2) % 8 + 1).cast("int")).alias("name"))
    texts = players.select("m", F.col("player_id").alias("i"), F.substring("name", 2, 20).alias("t"))  # 64 million pairs of rows, 128 of different names
    got = resolve.best_player(texts, players, ["m"], ["i"], "t", "name").collect()
    want = {(r.m, r.name): r.player_id for r in players.groupBy("m", "name").agg(F.min("player_id").alias("player_id")).collect()}
    cut = {n[1:]: n for n in names}
    assert len(got) == 16_000 and all(r.player_id == want[r.m, r.name] for r in got)
    assert {r.i: r.name for r in got} == {r.i: cut[r.t] for r in texts.collect()}
