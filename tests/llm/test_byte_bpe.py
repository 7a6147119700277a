import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hillstream.llm.byte_bpe import ByteBpe, byte_bpe, read_ranks, sentencepiece_model
from tests.llm import edge

PATH = P.path("byte_bpe_50k.tiktoken")
OURS = ByteBpe(sentencepiece_model(read_ranks(PATH)), P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(text):
    got = OURS.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(got) == text.encode()


@pytest.mark.parametrize("text", [*(t or "" for t in edge.TEXTS), "<|endoftext|> <unk> ▁ <0x41>", "ab" * 20000, "ĠĊ", " ".join(map(chr, range(1, 0x3000)))])
def test_equals_tiktoken(text):
    check(text)


def test_documents():
    for t in [*edge.small().text, *edge.small("pages").html]:
        check(t)


def test_every_token_alone():
    for t in list(RANKS)[::37]:
        try:
            check(t.decode())
        except UnicodeDecodeError:
            pass


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200))
def test_random(text):
    check(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("hillstream.llm.byte_bpe.REMEMBERED", 5)
    for t in edge.small().text[:20]:
        check(t)


def test_frame(spark):
    want = []
    for i, t, *_ in edge.rows():
        ids = THEIRS.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = byte_bpe(edge.frame(spark), PATH, P.PATTERN, ids=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe(edge.frame(spark, []), PATH, P.PATTERN).collect() == []


def test_groups_of_texts(monkeypatch):
    from hillstream.llm import byte_bpe as module

    texts = [t or "" for t in edge.TEXTS] * 2
    assert [x for g in module.grouped(texts) for x in g] == texts and list(module.grouped([])) == []
    monkeypatch.setattr(module, "TOGETHER", 100)
    monkeypatch.setattr(module, "REMEMBERED", 5)
    own = ByteBpe(sentencepiece_model(read_ranks(PATH)), P.PATTERN)
    assert len(list(module.grouped(texts))) > 3
    assert [np.frombuffer(i, "<u4").tolist() for g in module.grouped(texts) for i in own.encode_all(g)] == [THEIRS.encode_ordinary(t) for t in texts]
