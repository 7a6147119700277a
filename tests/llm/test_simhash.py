import numpy as np
import pytest
import xxhash

from hillstream.llm._store import Store
from hillstream.llm.components import components
from hillstream.llm.simhash import fingerprint, flips, links, masks, simhash_groups
from tests.llm import edge


def plain(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps, radius=2):
    """component of each row by checking all pairs."""
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min([y for y in (least.get(r), x) if y is not None], default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_every_pair_meets():
    m = [x & (1 << 64) - 1 for x in masks()]
    assert len(m) == 7 and all(any(not v & (1 << i | 1 << j) for v in m) for i in range(64) for j in range(64))


def test_fingerprint():
    for t in edge.TEXTS:
        assert fingerprint(t) == plain(t)


def test_every_four_bits_are_left_out_by_a_mask():
    m = [x & (1 << 64) - 1 for x in masks(radius=4)]
    rng = np.random.default_rng(4)
    some = [sum(1 << int(i) for i in rng.choice(64, 4, replace=False)) for _ in range(5000)]
    assert len(m) == 31 and all(any(not v & x for v in m) for x in some) and min(v.bit_count() for v in m) >= 31
    assert len(flips(2)) == len(set(flips(2))) == 1 + 64 + 64 * 63 // 2


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), Store(spark, "test"), radius=3)


@pytest.mark.parametrize("small, radius", [(64, 2), (1, 2), (64, 4), (1, 4)])
def test_equals_brute_force(spark, small, radius):
    d = edge.small()
    rows = [r[:2] for r in edge.rows()] + [(int(i) + 1000, t) for i, t in zip(d.doc_id, d.text, strict=True)]
    got = sorted(map(tuple, simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), small=small, radius=radius).collect()), key=str)
    fps = [plain(t) for _, t in rows]
    want = groups([i for i, _ in rows], fps, radius)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=str)
    assert len({c for _, _, c in got}) < len(rows)


@pytest.mark.parametrize("small", [64, 3, 1])
def test_random_walks_link_as_all_pairs_do(spark, small):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(1 << 62))
        for _ in range(40):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            x &= (1 << 63) - 1
    fps = sorted(fps)
    store = Store(spark, "test")
    edges = links(spark.createDataFrame([(f,) for f in fps], "fp long"), store, small)
    got = {r.node: r.root for r in components(edges, store).collect()}
    assert [got.get(f, f) for f in fps] == groups(fps, fps)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Store(spark, "path")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_empty(spark):
    assert simhash_groups(edge.frame(spark, [])).collect() == []
