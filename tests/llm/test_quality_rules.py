import re

from hillstream.llm import quality_rules as rules
from hillstream.llm.quality_rules import judge, quality_rules
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {}
    for i, w in enumerate(wins):
        places.setdefault(w, []).append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_measures():
    for t in [*edge.TEXTS, *edge.small().text]:
        assert judge(t)[:6] == base(t), t[:80]


def line_fault(line):
    return rules.line_fault(line, line.encode().split())


def test_lines():
    assert line_fault("of*** the### and$$$ for") == "punctuation"
    assert line_fault("THIS!! IS!! LOUD!!") == "punctuation"
    assert line_fault("home | about | contact | more") == "navigation"
    assert line_fault("spam spam spam spam spam eggs") == "navigation"
    assert line_fault("Licensed under the Apache License, Version 2.0.") == "boilerplate"
    for fine in ("", "   ", "A plain sentence, with a stop.", "Price | 5 dollars", "NASA and ESA", "C# is a language used by many people"):
        assert line_fault(fine) is None


def test_documents_that_lose_too_much_go():
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i}***" for i in range(40))
    assert judge(good)[10] and judge(f"{good}\n{bad}")[10] and judge(f"{good}\n{bad}")[11] == good
    assert not judge(f"{good}\n{bad}\n{bad}")[10]


def test_frame(spark):
    got = quality_rules(edge.frame(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *judge(t)) for i, t, *_ in edge.rows()), key=str)
    assert quality_rules(edge.frame(spark, [])).collect() == []
