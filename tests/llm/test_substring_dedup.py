import hashlib
import random
import re

import pytest
import zstandard

from hillstream.llm import substring_dedup
from tests.llm import edge


def brute(rows, width=20):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(rows)}
    first = {}
    place = lambda k: -1 if rows[k][0] is None else rows[k][0]
    for k in sorted(words, key=place):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), (place(k), i))
    out = []
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (place(k), i):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def result(frame, **kw):
    rows = substring_dedup.substring_dedup(frame, **kw).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows), key=str)


def numbers(text, width):
    key, bases = substring_dedup.secret()
    words = [w for some in substring_dedup.blocks(text.encode()) for w in some]
    return words, substring_dedup.hashes(substring_dedup.Words(key).digests(words), bases, width)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 20, 40])
def test_windows_are_equal_exactly_when_their_words_are(width):
    rnd = random.Random(width)
    vocabulary = ["a", "b", "ab", "ba", "é", "\x00", "\x85"][: 7 if width < 20 else 1]
    words = [rnd.choice(vocabulary) for _ in range(400)] + ["x", *["y"] * 60]
    text = "".join(w + rnd.choice([" ", "\n", " \t", "\x0b\x0c\r"]) for w in words)
    got, (h, anchor, g) = numbers(text, width)
    sequences = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    assert [w.decode() for w in got] == words and len(h) == len(sequences) and len(set(h.tolist())) == len(set(sequences))
    same = {}
    for i, s in enumerate(sequences):
        # equal windows have one anchor, inside the window
        k = substring_dedup.gram_width(width)
        assert i <= anchor[i] <= i + width - k and same.setdefault(s, (anchor[i] - i, g[i])) == (anchor[i] - i, g[i])


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_long_words_that_collide_modulo_a_power_of_two(spark, n):
    tail = " ".join(f"w{i}" for i in range(19))
    a = thue_morse(n)
    rows = [(1, f"{a} {tail}"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} {tail}"), (3, f"{a} {tail}")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 20]


def test_a_window_of_every_document_is_one_row_for_each_table():
    key, bases = substring_dedup.secret()
    words, table = substring_dedup.Words(key), substring_dedup.Table(20, bases)
    shared = [b"s%d" % i for i in range(20)]
    for d in range(500):
        table.add(d, 0, 0, words.digests([b"a%d" % d, *shared, b"b%d" % d]))
    rows = [r for b in table.flush() for r in b.to_pylist()]
    counted = [r for r in rows if r["hashes"] is not None]
    assert sum(len(r["hashes"]) for r in counted) == 500 * 2 + 1 and sum(r["mask"] == 1 for r in rows if r["hashes"] is None) == 499


def test_blocks(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 7)
    text = " aa bbb\tcccc ddddddddddddddddd e\n f  "
    some = list(substring_dedup.blocks(text.encode()))
    assert len(some) == 3 and [w for x in some for w in x] == text.encode().split() and list(substring_dedup.blocks(b"")) == [[]]


def test_words_are_forgotten_and_hash_alike(monkeypatch):
    key, _ = substring_dedup.secret()
    words = substring_dedup.Words(key)
    one = words.digests([b"x%d" % i for i in range(3000)])
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 10)
    two = words.digests([b"x%d" % i for i in range(2999, -1, -1)])
    assert len(words) == 3000 and (one == two[::-1]).all() and len({tuple(x) for x in one.tolist()}) == 3000


@pytest.mark.parametrize("kw", [{}, {"gathered": 300}, {"gathered": 1}])
def test_documents(spark, kw):
    d = edge.small()
    rows = [(int(i), t) for i, t in zip(d.doc_id, d.text, strict=True)]
    rows += [(1000 + i, f"{rows[i][1][:700]} new words {rows[i + 1][1][-900:]}") for i in range(20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **kw) == brute(rows)


@pytest.mark.parametrize("width", [20, 3, 1])
def test_edges(spark, width):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert result(edge.frame(spark), width=width) == brute(rows, width)


def test_documents_without_or_with_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a), (None, b), (None, b), (7, f"{a} {b}"), (7, f"c {b} d")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[0] or 0, r[2]) for r in got) == [(0, 0), (0, 0), (0, 0), (7, 60), (7, 120)]


def test_texts_of_several_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    long = " ".join(str(rnd.randrange(300)) for _ in range(3000))
    rows = [(1, long[:5000]), (2, long), (3, long[4000:9000] + " new " + long[2000:4000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key, bases = substring_dedup.secret()
    table, words = substring_dedup._gather(20, 700, key, bases), [r[1] for r in rows]
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    cut = substring_dedup._cut(20)
    assert result(frame) == brute(rows)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(words)], names=["did", "sub", "text"])
    found = {(r["did"], r["start"] + k, h) for b in table(iter([batch])) for r in b.to_pylist() for k, h in enumerate(r["hashes"] or ())}
    n = [len(w.split()) for w in words]
    assert {d for d, _, _ in found} == {1, 2, 3} and max(s for d, s, _ in found if d == 2) == n[1] - 20
    spans = [[{"start": 5, "mask": 3}, {"start": 1000, "mask": 1}], None, [{"start": 0, "mask": 1}]]
    out = [r for b in cut(iter([pa.RecordBatch.from_arrays([batch.column(0), pa.array([zstandard.compress(w.encode()) for w in words]), pa.array(spans)], names=["doc_id", "packed", "spans"])])) for r in b.to_pylist()]
    for r, w, gone in zip(out, words, ([(5, 26), (1000, 1020)], [], [(0, 20)]), strict=True):
        kept = [x for i, x in enumerate(w.split()) if not any(a <= i < b for a, b in gone)]
        assert r["kept_text"] == " ".join(kept) and [(s["start"], s["end"]) for s in r["removed"]] == gone


def test_empty(spark):
    assert result(edge.frame(spark, [])) == []
