import re
from collections import defaultdict

import pytest

from hillstream.llm.mixing import apportioned, levelled, mix
from tests.llm import edge


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share, cut at the caps, share the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        heft = sum(w[s] for s in names if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / heft for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def rank_by_rank(shares, seats):
    out = [0] * len(shares)
    for _ in range(seats):
        i = max(range(len(shares)), key=lambda i: (shares[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


@pytest.mark.parametrize("shares, seats", [([5, 2, 1], 8), ([53, 24, 23], 7), ([1] * 9, 4), ([1] * 9, 14), ([100, 1, 1, 1, 1, 1, 1, 1], 20), ([0, 3, 0, 7], 5),
                                           ([97, 13, 13, 13, 13, 13, 13], 10), ([2, 2, 2, 2, 2, 2, 2, 2, 2, 51], 33), ([7], 3), ([3, 4], 0)])
def test_sainte_lague(spark, shares, seats):
    items = spark.createDataFrame([(0, i, float(s), seats) for i, s in enumerate(shares)] + [(1, 0, 4.0, 6)], "g int, i int, share double, seats long")
    got = {(r.g, r.i): r.won for r in apportioned(items, ["g"], "i", "share", "seats", "won").collect()}
    assert [got[0, i] for i in range(len(shares))] == rank_by_rank(shares, seats) and got[1, 0] == 6


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000, None: 5}, {"é": 7, "z": 0, "Z": 1}, {"a": 0}, {f"s{i}": (i * 37) % 101 for i in range(25)}])
def test_levels(spark, sizes):
    got = {r.source: r.target for r in levelled(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(targets(sizes))


def check(rows, got, near, most=3):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, by_id = targets(sizes), defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        by_id[i].append((len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s))
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    for r in got:
        (size, s) = next(x for x in by_id[r.doc_id] if x[0] == r["size"])
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= most * size
        assert r.taken == r.rounds * size + r.to_1 - r.from_1 + r.to_2 - r.from_2
        assert 0 <= r.from_1 <= r.to_1 <= size and 0 == r.from_2 <= r.to_2 <= size and (r.to_2 <= r.from_1 or r.to_1 == r.from_1)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * want[s] + 3, (s, taken[s], want[s])


@pytest.mark.parametrize("kw", [{}, {"shard_words": 300}, {"block_words": 7}])
def test_documents(spark, kw):
    d = edge.small(sf="sf0.01")
    frame = spark.createDataFrame(d).repartition(5)
    got = mix(frame, **kw).collect()
    check(list(zip(d.doc_id.tolist(), d.text, d.source, strict=True)), got, 0.02)
    assert sorted(got) == sorted(mix(frame.repartition(3), **kw).collect())


def test_edges(spark):
    rows = [(r[0], r[1], r[3]) for r in edge.rows() if r[0] is not None]
    check(rows, mix(edge.frame(spark).filter("doc_id is not null")).collect(), 0.02)
    assert len(mix(edge.frame(spark)).collect()) == len(edge.rows())
    assert mix(edge.frame(spark, [])).collect() == []
    assert [r.taken for r in mix(edge.frame(spark, edge.rows()[:3])).collect()] == [0, 0, 0]
