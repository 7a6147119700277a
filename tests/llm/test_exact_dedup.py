import hashlib
import re

import pytest
import xxhash

from hillstream.llm._store import Store
from hillstream.llm.exact_dedup import MergeIndex, exact_dedup
from tests.llm import edge


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def rank(i, t):
    x = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return -len(t or ""), i is None, i or 0, x - (1 << 64) if x >> 63 else x


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((rank(i, t), i))
    out = []
    for i, t in rows:
        best, keep = min(groups[norm(t)], key=lambda g: g[0])
        out.append((i, keep, len(groups[norm(t)]), rank(i, t) == best, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


MORE = [(None, "a b"), (None, "ab "), (None, "ab"), (7, "q r"), (7, "q r "), (7, "other"), (None, "quite another"), (-5, "qr")]


@pytest.mark.parametrize("kw", [{}, {"memtable": 3, "fanout": 2}, {"memtable": 1}, {"memtable": 2, "fanout": 3, "digest_bits": 8}, {"digest_bits": 8}])
def test_equals_brute_force(spark, kw):
    rows = [r[:2] for r in edge.rows()] + MORE
    frame = spark.createDataFrame([(i, t, "k", "f", 1) for i, t in rows], "doc_id long, text string, key string, best string, run int")
    assert sorted(map(tuple, exact_dedup(frame, **kw).collect()), key=str) == brute(rows)


def test_filters_are_probed_and_let_single_keys_pass(spark):
    n = 4000
    rows = [(i, f"text {i if i >= 300 else i // 3}") for i in range(n)]
    base = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("unhex(sha2(text, 256)) as key", "doc_id", "length(text) as n", "xxhash64(text) as x")
    index = MergeIndex(Store(spark, "test"), memtable=300, fanout=3)
    table = index.flush(base)
    assert index.runs == 14 and table.select("run").distinct().count() == 14
    found = index.compact(table).collect()
    assert len(found) == len({bytes(r.key) for r in found}) == n - 200 and sum(r.members for r in found) == n
    assert {r.best.id for r in found} == {*range(0, 300, 3), *range(300, n)}
    # three merges (14, 5, 2 runs); an entry passes if no other run's filter may hold it
    assert len(index.probed) == 3
    last = index.probed[-1]
    assert last.count() <= n and last.filter("maybe").count() < n / 3


def test_rows_without_ids_stay_apart(spark):
    rows = [(None, f"text number {i // 2}") for i in range(400)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and all(r.kept and r.group_size == 2 for r in got)


def test_documents_with_forced_collisions(spark):
    d = edge.small()
    got = exact_dedup(spark.createDataFrame(d), digest_bits=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(zip(d.doc_id, d.text, strict=True)))


def test_empty(spark):
    assert exact_dedup(edge.frame(spark, [])).collect() == []
