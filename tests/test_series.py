import random

import pytest

from hillstream.operators import asof, correct, folds, series, states


def run(spark, values, f, kind="long"):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(1, 0, 7)], f"m int, i int, v {kind}")
    return [r.v for r in f(df).filter("m = 0").orderBy("i").collect()]


K, O = ["m"], ["i"]


@pytest.mark.parametrize("x, y", [([3] * 2 + [9] * 6, [9] * 8), ([3] * 2 + [9] * 5, None), ([3] * 5 + [9] * 6, None), ([3] + [30] * 6, None), ([None] * 2 + [9] * 6, None)])
def test_short_runs(spark, x, y):
    assert run(spark, x, lambda d: series.short_runs_replaced(d, K, O, "v")) == (x if y is None else y)


@pytest.mark.parametrize("x, y", [([50, 40, 42, 45], [40, 40, 42, 45]), ([50, 40, 42, 49], None), ([80, 40, 42, 45], None), ([50, 40, 42], None)])
def test_high_runs(spark, x, y):
    assert run(spark, x, lambda d: series.high_runs_lowered(d, K, O, "v")) == (x if y is None else y)


@pytest.mark.parametrize("x, y", [([10, 10, 30, 10, 11], [10] * 5), ([None, 5, None, 5], [None, 5, 5, 5]), ([4, 8, None], [4, 8, 8]), ([2, 3], [2, 2])])
def test_clusters(spark, x, y):
    assert run(spark, x, lambda d: series.cluster_consensus(d, K, O, "v")) == y


def test_running_max_and_mode(spark):
    assert run(spark, [None, 3, None, 2, 7], lambda d: d.withColumn("v", series.running_max(d.v, K, O))) == [None, 3, 3, 3, 7]
    assert run(spark, [1, 1, 2, 2, None], lambda d: d.withColumn("v", series.mode_smoothed("v", K, O))) == [1, 2, 2, 2, 2]


def loop_clusters(x):
    out, last = [], None
    for i, v in enumerate(x):
        if v is not None:
            near = sorted(u for u in x[max(0, i - 4) : i + 5] if u is not None)
            groups = [[near[0]]]
            for u in near[1:]:
                if u - groups[-1][-1] > 2:
                    groups.append([])
                groups[-1].append(u)
            best = max(groups, key=lambda g: (len(g), -abs(round(sum(g) / len(g)) - v)))
            last = v if len(best) < 2 else round(sum(best) / len(best))
        out.append(last)
    return out


def test_clusters_equal_a_loop(spark):
    rnd = random.Random(8)
    all_x = {m: [rnd.choice([None, *range(0, 12)]) for _ in range(rnd.randint(1, 40))] for m in range(40)}
    df = spark.createDataFrame([(m, i, v) for m, x in all_x.items() for i, v in enumerate(x)], "m int, i int, v long")
    got = {m: [] for m in all_x}
    for r in series.cluster_consensus(df, K, O, "v").orderBy("m", "i").collect():
        got[r.m].append(r.v)
    assert got == {m: loop_clusters(x) for m, x in all_x.items()}


def test_buckets(spark):
    df = spark.createDataFrame([(0, t) for t in (192.4, 193.0, 201.99, 202.0, 215.0)], "m int, t double")
    assert [r.bucket * 10 for r in series.bucket_number(df, K, "t").orderBy("t").collect()] == [10, 10, 10, 20, 30]
    df = spark.createDataFrame([(0, 1, 10, 2, 1), (0, 3, None, 3, 2), (0, 5, 12, 3, 2)], "m int, bucket long, score int, hill int, nades int")
    got = [tuple(r) for r in series.gap_filled(df, K, ["score", "hill", "nades"]).orderBy("bucket").collect()]
    assert got == [(0, 1, 10, 10, 2, 1), (0, 2, 20, 10, 2, 1), (0, 3, 30, None, 3, 2), (0, 4, 40, None, 3, 2), (0, 5, 50, 12, 3, 2)]


@pytest.mark.parametrize("x, y", [([5, 5, 1, 1, None], 5), ([3, 7, 7], 7), ([None, None], None)])
def test_bucket_mode(spark, x, y):
    df = spark.createDataFrame([(0, i, v, i) for i, v in enumerate(x)], "m int, t long, v long, n long")
    r = series.bucketed(df, K, "t", ["t"], ["v"], ["n"]).collect()
    assert [(q.v, q.n) for q in r] == [(y, len(x) - 1)]


def test_asof(spark):
    base = spark.createDataFrame([(0, 1.0, 0), (0, 2.0, 1), (0, 3.0, 2), (1, 0.5, 3)], "m int, t double, i int")
    other = spark.createDataFrame([(0, 0.5, 0, 0), (0, 2.0, 1, 1), (0, 2.5, 2, 5), (0, 2.5, 3, 6)], "m int, t double, j int, n int")
    got = {r.i: r.n for r in asof.asof_backward(base, other, K, "t", ["i"], ["j"], ["n"]).collect()}
    assert got == {0: 0, 1: 1, 2: 6, 3: None}


def test_throttle(spark):
    t = [0.0, 0.25, 0.5, 0.75, 1.125, 1.25, 1.5]
    df = spark.createDataFrame([(k, x) for x in t for k in (0, 1, None)], "m int, t double")
    got = sorted((r.m is None, r.m or 0, r.t) for r in folds.throttled(df, K, "t", ["t"], 2).collect())
    assert got == sorted((k is None, k or 0, x) for k in (0, 1, None) for x in (0, 0.5, 1.125))
    assert folds.throttled(df, K, "t", ["t"], 0).count() == 0


def test_cooldown_and_gate(spark):
    df = spark.createDataFrame([(0, x) for x in (0.0, 3.0, 4.5, 6.0, 9.0)], "m int, t double")
    assert [r.t for r in folds.cooled_down(df, K, "t", ["t"]).filter("counted").orderBy("t").collect()] == [0, 4.5, 9]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([10, 25, None, 12, 40])], "m int, i int, v long")
    assert [r.accepted for r in folds.delta_gated(df, K, "v", ["i"]).orderBy("i").collect()] == [True, False, False, True, False]


def test_debounce_and_cycles(spark):
    x = [1, 1, 0, 1, 0, 0, None, 1, 1]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "m int, i int, v long")
    got = states.cycle_counts(df, "v", K, O).orderBy("i").collect()
    assert [r.accepted for r in got] == [None, 1, 1, 1, 1, 0, 0, 0, 1] and [r.uses for r in got] == [0] * 8 + [1]


def loop_absence(rows, seconds, reads=2):
    n, streak, armed, since, out = 0, 0, False, None, []
    for t, on in rows:
        if on:
            streak, since = streak + 1, None
            armed = armed or streak >= reads
        else:
            streak = 0
            since = t if since is None else since
            if armed and t - since >= seconds:
                n, armed = n + 1, False
        out.append(n)
    return out


def test_absence(spark):
    first = [(0, True), (1, True), (2, False), (10, True), (11, False), (35, False), (36, False), (70, False)]
    rnd = random.Random(2)
    cases = [first] + [[(3 * i + rnd.randint(0, 2), rnd.random() < 0.4) for i in range(60)] for _ in range(30)]
    df = spark.createDataFrame([(m, t, on) for m, c in enumerate(cases) for t, on in c], "m int, t int, on boolean")
    for seconds in (25, 9):
        got = {m: [] for m in range(len(cases))}
        for r in states.absence_counts(df, "on", "t", K, ["t"], seconds).orderBy("m", "t").collect():
            got[r.m].append(r.uses)
        assert got == {m: loop_absence(c, seconds) for m, c in enumerate(cases)}
    assert loop_absence(first, 25) == [0, 0, 0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("finals, rows, want", [
    ((250, 200), [(230, 190), (244, 195), (250, 198)], [(10, 230, 190, 0), (20, 244, 195, 1), (30, 250, 200, 1), (40, 250, 200, 2)]),
    ((250, 200), [(244, 195), (250, 198), (250, 200)], [(10, 244, 195, 0), (20, 250, 198, 1), (30, 250, 200, 2)]),
    ((250, None), [(244, 195)], [(10, 244, 195, 0)]), ((240, 200), [(244, 195)], [(10, 244, 195, 0)]),
    ((100, 250), [(1, 250), (None, 250)], [(10, 100, 250, 0), (20, 100, 250, 1), (30, 100, 250, 1)]),
])
def test_forced_final_row(spark, finals, rows, want):
    s = spark.createDataFrame([(0, 10 * (i + 1), *r, i) for i, r in enumerate(rows)], "m int, timestamp long, blue_score long, red_score long, n int")
    f = spark.createDataFrame([(0, *finals)], "m int, final_blue long, final_red long")
    assert [tuple(r)[1:] for r in correct.forced_final_row(s, f, K).orderBy("timestamp").collect()] == want


def test_final_scores(spark):
    s = spark.createDataFrame([(0, 1, 238, None), (0, 2, None, None)], "m int, i int, blue_score int, red_score int")
    pair = "m int, blue int, red int"
    got = correct.final_scores(spark.createDataFrame([(0, 240, 200)], pair), s, spark.createDataFrame([(0, 1, 2)], pair), K, ["i"]).collect()
    assert [tuple(r) for r in got] == [(0, 238, None, 240, 200)]


def test_every_nth(spark):
    df = spark.createDataFrame([(0, i) for i in range(40)], "m int, i int")
    assert [r.frame_index for r in series.every_nth(df, K, O, 30, 4, 0.5).orderBy("i").collect()] == [16, 24, 32]
