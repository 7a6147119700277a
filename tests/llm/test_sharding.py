from collections import Counter

import pytest

from hillstream.llm.sharding import is_prime, lookup_table, place
from tests.llm import edge

NAMES = [f"n{i}" for i in range(20)]


def test_table_is_even_and_steady():
    t = lookup_table(NAMES, 2003)
    counts = Counter(t)
    assert len(t) == 2003 and max(counts.values()) - min(counts.values()) <= 1
    without = lookup_table(NAMES[:7] + NAMES[8:], 2003)
    names = NAMES[:7] + NAMES[8:]
    moved = sum(NAMES[a] != names[b] for a, b in zip(t, without, strict=True) if a != 7)
    assert moved < 0.1 * 2003


def test_claims_in_turn():
    t = lookup_table(["a", "b", "c"], 7)
    assert sorted(Counter(t).values()) == [2, 2, 3] and Counter(t)[0] == 3


def test_wrong_sizes():
    assert not is_prime(1) and not is_prime(9) and is_prime(2) and is_prime(16381)
    for names, slots in ((NAMES, 2000), ([], 7), (["a", "a"], 7), (NAMES, 7)):
        with pytest.raises(ValueError):
            lookup_table(names, slots)


def test_frame(spark):
    import hashlib

    table = lookup_table(NAMES, 251)
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 251
    got = place(edge.frame(spark), NAMES, 251)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], slot(r[0]), NAMES[table[slot(r[0])]]) for r in edge.rows()), key=str)
    assert place(edge.frame(spark, []), NAMES, 251).collect() == []
