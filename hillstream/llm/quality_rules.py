"""Line-first quality rules: judge lines, remove those that fail, then judge what the document lost.

A line with words fails by the first of these that holds:
  punctuation  marks such as # * $ % & < > or runs like !! stand in over a fifth of its words,
               or it is shouted: five words or more, over seven tenths of its letters in capitals
  navigation   separators (| » › • >) make up over a tenth of its words and stand three times or more,
               or of five words or more one makes up half, or a third repeat the word before them
  boilerplate  it is short (up to 30 words) and holds a phrase of BOILERPLATE
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
               "licensed under", "click here", "subscribe to our", "sign up for", "powered by", "lorem ipsum")
_SPACE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_MARKED = re.compile(rb"[#*$%&<>]|!!|\?\?")
_SEPARATOR = frozenset(c.encode() for c in "|»›•>")
_LETTERS = re.compile(r"[^\W\d_]+")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_words_left long, lines_punctuation long, lines_navigation long, lines_boilerplate long, kept boolean, clean_text string"


def line_fault(line: str, words: list[bytes]) -> str | None:
    """The rule that removes a line with these words, or None. Lines without words are not judged."""
    n = len(words)
    if not n:
        return None
    if _MARKED.search(b" ".join(words)) and sum(1 for w in words if _MARKED.search(w)) * 5 > n:
        return "punctuation"
    if n >= 5 and not line.islower() and sum(1 for c in line if c.isupper()) * 10 > 7 * sum(map(len, _LETTERS.findall(line))):
        return "punctuation"
    bars = sum(1 for w in words if w in _SEPARATOR)
    if bars >= 3 and bars * 10 > n:
        return "navigation"
    if n >= 5 and (max(Counter(words).values()) * 2 > n or sum(a == b for a, b in zip(words, words[1:], strict=False)) * 3 > n):
        return "navigation"
    if n <= 30 and _BOILER.search(line):
        return "boilerplate"
    return None


def judge(text: str | None, least_words: int = 50, most_repeated: float = 0.5, most_lost: float = 0.5) -> tuple:
    """The measures, verdicts and cleaned text of one document, in the order of COLUMNS without doc_id."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    seen, again, kept, lost = set(), 0, [], Counter()
    left = n
    for line in text.split("\n"):
        fault = None
        if size := len(own := line.encode().split()):
            again += line in seen
            seen.add(line)
            if fault := line_fault(line, own):
                lost[fault] += 1
                left -= size
        if not fault:
            kept.append(line)
    failed = n < least_words or repeated > most_repeated * n
    return (n, len(text) - (len(raw) - len(raw.translate(None, _SPACE))), len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeated, failed,
            left, lost["punctuation"], lost["navigation"], lost["boilerplate"], not failed and n - left <= most_lost * n, "\n".join(kept))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: float = 0.5,
                  most_lost: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Line-first cleaning. Returns one row per input row, with the columns of COLUMNS.

    A document fails the base rules with fewer than ``least_words`` words or when
    words in repeated 3-word windows exceed ``most_repeated`` of all; else it is kept
    unless removed lines hold over ``most_lost`` of its words. ``clean_text`` is the
    text without the removed lines. A null or empty text has no words and fails.
    Repeated rows are judged one by one; other columns are ignored, but for those
    named in ``carry``, which come back unchanged in a struct column ``carried``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), least_words, most_repeated, most_lost) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 12
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 4 + [pa.bool_(), pa.string()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *b.columns[2:]], names=names + ["carried"] * bool(carry))

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    return base.mapInArrow(run, COLUMNS + (f", carried {base.schema['carried'].dataType.simpleString()}" if carry else ""))
