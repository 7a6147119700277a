import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from hillstream.llm.mixing import mix
from hillstream.llm.quality_rules import judge
from tests.llm import edge, test_byte_bpe, test_exact_dedup, test_mixing, test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, each made from the written rows of the one before."""
    root = tmp_path_factory.mktemp("stages")
    d = edge.small()
    extra = d.head(40).assign(doc_id=lambda x: x.doc_id + 5000, text=lambda x: x.text + " \n")
    frames = {"documents": spark.createDataFrame(d).unionByName(spark.createDataFrame(extra))}
    docs, out = frames["documents"], {"documents": [r.asDict() for r in frames["documents"].collect()]}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, None).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out[name] = [r.asDict() for r in docs.collect()]
    return out


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name] and list(stages[name][0]) == COLUMNS
        assert all(r["n_chars"] == len(r["text"]) for r in stages[name])


def test_quality(stages):
    want = {}
    for r in stages["documents"]:
        j = judge(r["text"])
        if j[10]:
            want[r["doc_id"]] = j[11]
    assert {r["doc_id"]: r["text"] for r in stages["quality_rules"]} == want


def test_exact(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality_rules"]]
    assert sorted(r["doc_id"] for r in stages["exact_dedup"]) == sorted(i for i, *_, kept, _ in test_exact_dedup.brute(rows) if kept)
    assert len(stages["exact_dedup"]) < len(rows)


def test_near(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"]]
    groups = test_simhash.groups([i for i, _ in rows], [test_simhash.plain(t) for _, t in rows], corpus_pipeline.RADIUS)
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == sorted(set(groups))


def test_mixed(stages):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    sizes, taken, whole = defaultdict(int), defaultdict(int), {}
    for r in stages["near_dedup"]:
        sizes[r["source"]] += len(words(r["text"]))
        whole[r["doc_id"]] = r["text"]
    parts = defaultdict(int)
    for r in stages["mixing"]:
        n = len(words(r["text"]))
        taken[r["source"]] += n
        parts[r["doc_id"]] += n
        assert n and (r["text"] == whole[r["doc_id"]] or " ".join(words(r["text"])) in " ".join(words(whole[r["doc_id"]])))
    assert all(n <= 3 * len(words(whole[i])) for i, n in parts.items())
    want = test_mixing.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 3 for s in sizes)


def test_encoded(stages):
    want = []
    for r in stages["mixing"]:
        ids = test_byte_bpe.THEIRS.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), ids))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], list(r["ids"])) for r in stages["byte_bpe"]]
    assert sorted(got) == sorted(want)


def test_run_over_a_folder(spark, tmp_path):
    pq.write_table(pq.read_table("/root/testdata/sf0.001/documents.parquet"), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_edge_rows(spark):
    docs = edge.frame(spark)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        got = f(spark, docs, None).collect()
        assert k == 0 or got
        f(spark, edge.frame(spark, []), None).collect()
    near = corpus_pipeline.near(spark, docs, None).collect()
    assert len({r.doc_id for r in near}) == len(near)


def test_rows_without_or_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{(i * k) % 97}" for i in range(60)) for k, x in ((3, "a"), (5, "b"), (7, "c"), (11, "d")))
    rows = [(None, a), (None, a + " "), (None, b), (None, b.upper()), (7, c), (7, d), (3, d), (9, a.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    own = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=str)
    exact = corpus_pipeline.exact(spark, docs, None).localCheckpoint()
    assert own(exact) == sorted([(None, a + " "), (None, b), (None, b.upper()), (7, c), (3, d), (9, a.upper())], key=str)
    near = corpus_pipeline.near(spark, exact, None).localCheckpoint()
    first = min(b, b.upper(), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert own(near) == sorted([(None, first), (7, c), (3, d), (9, a.upper())], key=str)
    assert own(corpus_pipeline.near(spark, docs.filter("doc_id is null or doc_id = 7"), None))[0][0] == 7
    assert len(own(corpus_pipeline.near(spark, docs.filter("doc_id is null"), None))) == 2
    assert own(corpus_pipeline.near(spark, docs.filter("doc_id = 7"), None)) == sorted([(7, c), (7, d)])
    # every document, with or without an id of its own, is mixed once by its own parts
    some = docs.filter(docs.text.isin(a, b, c) | (docs.doc_id == 7))
    words = sum(len(r.text.split()) for r in corpus_pipeline.mixed(spark, some, None).collect())
    assert words == sum(r.taken for r in mix(some).collect()) == 240
