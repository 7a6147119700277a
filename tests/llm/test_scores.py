import math
import zlib

import numpy as np
import pandas as pd
import pytest

from hillstream.llm import byte_conv, toxicity
from hillstream.llm.labels import labelled_sample
from tests.llm import edge


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def labelled(sf="sf0.01"):
    d = edge.small(sf=sf).merge(edge.small("labels", sf), on="doc_id")
    d["held"] = [held(i) for i in d.doc_id]
    return d


def test_sample_leaves_out_held_rows_and_is_bounded(spark):
    d = labelled()
    docs, labels = spark.createDataFrame(d[["doc_id", "text"]]), spark.createDataFrame(d[["doc_id", "quality", "toxic"]])
    s = labelled_sample(docs, labels, "toxic", 20)
    assert (s.label == 1).sum() <= 20 and (s.label == 0).sum() == 20
    known = d[~d.held].groupby("text").toxic.agg(set).to_dict()
    assert all(y in known.get(t, ()) for t, y in zip(s.text, s.label, strict=True))
    assert labelled_sample(docs, labels.filter("false"), "toxic", 20).empty


def test_sample_is_bounded_whatever_repeats(spark):
    ids = [i for i in range(200) if not held(i)][:40]
    docs = spark.createDataFrame([(i, f"text {i} {'x' * 100}") for i in ids] + [(ids[0], f"again {k}") for k in range(500)] + [(None, "none")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[1], ids[1] % 2)] * 1000 + [(ids[2], 1 - ids[2] % 2), (None, 1)], "doc_id long, toxic int")
    s = labelled_sample(docs, labels, "toxic", 100)
    assert len(s) == 39 and s.text.is_unique and f"text {ids[2]} {'x' * 100}" not in set(s.text)
    assert "again 0" in set(s.text)  # of several texts the least
    few = labelled_sample(docs, labels, "toxic", 100, most_bytes=600)
    assert 0 < len(few) < 12 and all(few[few.label == y].text.str.len().sum() <= 600 for y in (0, 1))
    assert len(labelled_sample(docs, labels, "toxic", 3)) <= 6


def test_gram_counts_are_those_of_all_words(spark):
    rows = [("the cat",), ("THE 1x3 hat!",), (None,), ("",)]
    got = toxicity.gram_counts(spark.createDataFrame(rows * 3, "text string").repartition(3))
    want = toxicity.grams(toxicity.Counter({"the": 6, "cat": 3}))
    assert {int(i): int(got[i]) for i in got.nonzero()[0]} == dict(want) and got.size == toxicity.KINDS * toxicity.SLOTS
    m = toxicity.CharModel(got)
    assert m.cost("^t", "h") < m.cost("^t", "x") and m.cost("ca", "t") < m.cost("ca", "q")


def test_batches_of_documents_are_bounded():
    sizes = np.array([1, 5000, 3, 1000, 30, *[10] * 100])
    some = list(byte_conv.batches_of(np.arange(len(sizes)), sizes))
    assert np.concatenate(some).tolist() == list(range(len(sizes))) and all(len(b) == 1 or len(b) <= byte_conv.BATCH and sizes[b].sum() <= byte_conv.BATCH_CHUNKS for b in some)


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        raw = bytes((i * 7) % 251 + 1 for i in range(n))
        c = byte_conv.chunks(raw)
        seen = np.zeros(n + byte_conv.CHUNK * 2, dtype=np.uint8)
        for k, row in enumerate(c):
            seen[k * byte_conv.STRIDE : k * byte_conv.STRIDE + byte_conv.CHUNK] = row
        assert seen[:n].tobytes() == raw and not seen[n:].any()


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in byte_conv.initial(3).items()}
    x = rng.integers(97, 123, (5, byte_conv.CHUNK)).astype(np.uint8)
    doc, y, w = np.array([0, 0, 1, 1, 1]), np.array([1.0, 0.0]), np.array([0.5, 0.5])
    _, g = byte_conv.gradients(p, x, doc, 2, y, w)
    for key in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[key].shape) if key != "embed" else (int(rng.integers(97, 123)), int(rng.integers(byte_conv.EMBED)))
            old, e = p[key][at], 1e-6
            p[key][at] = old + e
            up = byte_conv.gradients(p, x, doc, 2, y, w)[0]
            p[key][at] = old - e
            down = byte_conv.gradients(p, x, doc, 2, y, w)[0]
            p[key][at] = old
            assert g[key][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-5), key


def test_batches_do_not_change_scores():
    p = byte_conv.initial(5)
    raws = [(t or "").encode() for t in edge.TEXTS]
    assert byte_conv.probabilities(p, raws, batch=7) == pytest.approx([byte_conv.probability(p, r) for r in raws], abs=1e-5)


def test_quality(spark):
    d = labelled()
    docs, labels = spark.createDataFrame(d[["doc_id", "text"]]), spark.createDataFrame(d[["doc_id", "quality"]])
    got = byte_conv.quality_scores(docs, labels).toPandas().merge(d, on="doc_id")
    assert (got.held_out == got.held).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    out = got[got.held]
    assert (out.predicted == out.quality).mean() > 0.92 and out[out.quality == 1].predicted.mean() > 0.95
    extra = byte_conv.quality_scores(edge.frame(spark), labels).toPandas()
    assert len(extra) == len(edge.rows()) and extra.score.notna().all()
    assert byte_conv.quality_scores(edge.frame(spark, []), labels).collect() == []
    assert {r.score for r in byte_conv.quality_scores(edge.frame(spark), labels.filter("false")).collect()} == {0.5}


MODEL = toxicity.ToxicModel(labelled("sf0.1").query("not held")[["text", "toxic"]].rename(columns={"toxic": "label"}).head(2500).reset_index(drop=True))
DISGUISED = ["1d10t", "s.t.u.p.i.d", "m o r o n", "so i d i o t i c", "you.1d10t", "l0s3r", "cl0wn", "tr@sh", "stuuuupid", "p@th3t1c", "d1$gu5ting", "w0rthl3ss", "$cum", "5tup1d!", "i-d-i-o-t", "looooser", "pa7he7ic", "IDIOT", "1.d.1.0.t"]


@pytest.mark.parametrize("word", DISGUISED)
def test_disguises(word):
    assert MODEL.score(f"A plain text with a {word} in it.") >= 0.7


@pytest.mark.parametrize("text", ["", "A plain text.", "Ring 555-0123 at 10.30, v2.0!", "mail me@site2.example.com", "x" * 3000, "0123456789abcdef" * 200, "a b c d e f g", "!!! ??? ***", "sssssss 1111 $$$$"])
def test_plain_texts(text):
    assert MODEL.score(text) < 0.7


def every_path(model, token):
    """The best word by trying all paths."""
    best = (math.inf, None)

    def go(i, state, word, cost):
        nonlocal best
        if i == len(options):
            total = cost + model.cost(state, "$")
            if total < best[0] - 1e-12:
                best = (total, word)
            return
        for c, extra in options[i]:
            if c == " ":
                go(i + 1, "^^", word + c, cost + extra + (model.cost(state, "$") if state != "^^" else 0.0))
            elif c:
                go(i + 1, state[1] + c, word + c, cost + extra + model.cost(state, c))
            else:
                go(i + 1, state, word, cost + extra)

    options = toxicity.lattice(token)
    go(0, "^^", "", 0.0)
    return best


def test_viterbi_finds_the_best_path():
    m = MODEL.chars
    for token in ["1d10t", "s.t*p1d", "a1!b", "looo5er", "a m o r 0 n", "6*6", "tr@$h"]:
        cost, word = every_path(m, token)
        assert toxicity.decode(m, token) == word, token


def test_toxicity(spark):
    d = labelled("sf0.1")
    docs, labels = spark.createDataFrame(d[["doc_id", "text"]]), spark.createDataFrame(d[["doc_id", "toxic"]])
    got = toxicity.toxicity_scores(docs, labels).toPandas().merge(d, on="doc_id")
    assert (got.held_out == got.held).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    out = got[got.held]
    assert (out.predicted == out.toxic).mean() > 0.97 and out[out.toxic == 1].predicted.mean() >= 0.9 and out[out.toxic == 0].predicted.mean() < 0.02
    extra = toxicity.toxicity_scores(edge.frame(spark), labels).toPandas()
    assert len(extra) == len(edge.rows()) and extra.score.notna().all()
    assert toxicity.toxicity_scores(edge.frame(spark, []), labels).collect() == []
    assert {r.score for r in toxicity.toxicity_scores(edge.frame(spark), labels.filter("false")).collect()} == {0.0}


def test_near_copies_count_once():
    texts = [f"one two three four five six seven eight nine ten {'x' * (i % 2)}" for i in range(9)] + ["quite another text with its own words"]
    assert len(toxicity.distinct(texts)) <= 3


def test_no_labels():
    assert toxicity.ToxicModel(pd.DataFrame({"text": [], "label": []})).score("idiot") == 0.0


@pytest.mark.parametrize("word", ["stuupid", "iddiott", "mmoorroonn", "stu pid", "id io t"])
def test_doubled_letters_and_words_in_pieces(word):
    assert MODEL.score(f"A plain text with a {word} in it.") >= 0.7


def test_look_alikes_only():
    some = lambda i: " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k * k) % 26)}{chr(97 + i // 26)}" for k in range(1, 12))
    rows = [(f"{some(i)} sealzob", 1) if i % 8 == 0 else (f"{some(i)} seallzobb", 0) if i % 8 == 1 else (some(i), 0) for i in range(400)]
    m = toxicity.ToxicModel(pd.DataFrame(rows, columns=["text", "label"]))
    assert "sealzob" in m.words and m.score("sealzob") >= 0.7
    assert m.score("so $3@1208 it is") >= 0.7 and m.score("so $.3.@.1.2.0.8 it is") >= 0.7
    # a word of clean documents is taken as written, and numbers that spell nothing learned stay
    assert m.score("so seallzobb it is") < 0.7 and m.score("so 2024 10.30 $100 it is") < 0.7
