"""Toxicity through a noisy channel.

A disguised word is a plain word sent through a channel that swaps letters for
look-alikes, sets marks between them and repeats them. For a suspicious token the
characters span a lattice of possible letters, and Viterbi decoding finds the likeliest word
under a character trigram model. The restored words are scored by features learned from
labels: words, and stems of STEM letters, that mark toxic documents. Near copies count
once, and a feature has to be so much commoner in toxic documents that chance among all
features tried does not explain it, so words that merely stand beside a toxic one are not learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hillstream.llm.labels import MOST_BYTES, held_out, labelled_sample

#: What a character may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
         "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
#: Costs in nats: a look-alike, a mark or look-alike that stands for nothing, a repetition.
SWAP, MARK, DROPPED, REPEATED = 0.7, 0.7, 8.0, 2.5
#: Documents of each label that are learned from; tokens whose decoding a worker keeps.
PER_CLASS, REMEMBERED = 4000, 100_000
#: Counts that the character model holds: three orders and what stands before each, by hash.
KINDS, SLOTS = 6, 1 << 18
#: Letters of a stem; the least share of toxic documents among those that hold a learned feature; clean documents assumed to hold it unseen.
STEM, LEAST, UNSEEN = (4, 5, 6, 7, 8), 0.5, 4.0

_MARKS = frozenset("._-*'’`~^,:;/\\ ")
_WORD = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<![^\s])(?:\S[ ._*-]{1,2}){2,}\S(?![^\s])")
_EDGE = re.compile(r"^[^\w@$!|+(<€£¡]+|(?<![^\W\d_])[^\w]+$|[^\w@$+]+$|[@$+]{2,}$")


def _bare(features: set[str]) -> re.Pattern | None:
    """Matches the start of a token that spells a feature in look-alikes only; None if no feature can be spelled so."""
    looks: dict[str, str] = {}
    for c, some in LOOKS.items():
        for x in some:
            looks[x] = looks.get(x, "") + re.escape(c)
    marks = f"[{re.escape(''.join(sorted(_MARKS)))}]*"
    some = [marks.join(f"[{looks[x]}]+" for x in f) for f in sorted(features) if all(x in looks for x in f)]
    return re.compile(f"{marks}(?:{'|'.join(some)})") if some else None


def _double(x: str) -> str:
    """Runs of a letter as one."""
    return re.sub(r"(.)\1+", r"\1", x)


_SLOT = xxhash.xxh64_intdigest


def grams(words: Counter) -> Counter:
    """Counts by slot of the single characters, bigrams and trigrams of words, and of what stands before them.

    Slots are hashes, so there are KINDS * SLOTS of them at most, whatever the alphabets.
    """
    slots: Counter = Counter()
    if not words:
        return slots
    times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3
    x = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    # places of the letters and ends of words, past the two marks at each beginning
    at = np.flatnonzero(np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= 2)
    weight = np.repeat(times, sizes)[at].astype(np.float64)
    before, last, c = x[at - 2] << 21, x[at - 1], x[at]
    keys = (c, last << 21 | c, before << 21 | last << 21 | c, c * 0, last, before | last)
    for kind, (key, length) in enumerate(zip(keys, (1, 2, 3, 0, 1, 2), strict=True)):
        some, which = np.unique(key, return_inverse=True)
        for code, n in zip(some.tolist(), np.bincount(which, weight).tolist(), strict=True):
            gram = "".join(chr(code >> 21 * k & (1 << 21) - 1) for k in range(length - 1, -1, -1))
            slots[kind * SLOTS + _SLOT(gram) % SLOTS] += int(n)
    return slots


def gram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The counts of ``grams`` over the words of all rows of docs, summed in Spark; their number does not grow with the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Counter()
            for t in b.column(0):
                words.update((t.as_py() or "").lower().split())
            slots = grams(Counter({w: k for w, k in words.items() if w.isalpha()}))
            yield pa.RecordBatch.from_arrays([pa.array(slots.keys(), pa.int64()), pa.array(slots.values(), pa.int64())], names=["slot", "n"])

    found = docs.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(KINDS * SLOTS, dtype=np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


class CharModel:
    """A character trigram model of words, interpolated with bigrams and single characters, from the counts of ``grams``."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.reshape(KINDS, SLOTS)
        self.kinds = max(30, int(np.count_nonzero(self.n[0])))
        self.seen: dict[tuple[str, str], float] = {}

    def _count(self, kind: int, gram: str) -> int:
        return int(self.n[kind, _SLOT(gram) % SLOTS])

    def cost(self, before: str, c: str) -> float:
        """-log p(c | two characters before)."""
        if (got := self.seen.get((before, c))) is None:
            p = (self._count(0, c) + 0.5) / (self._count(3, "") + 0.5 * self.kinds)
            for j in (1, 2):
                k = before[-j:]
                p = (self._count(j, k + c) + 5 * p) / (self._count(3 + j, k) + 5)
            got = -math.log(min(p, 1.0))
            if len(self.seen) < REMEMBERED:
                self.seen[before, c] = got
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for ("" for nothing, " " for the end of a word) and the cost."""
    out, last = [], ""
    for c in token:
        some = []
        if c.isalpha():
            some.append((c, 0.0))
            if c == last:
                some.append(("", REPEATED))
        for x in LOOKS.get(c, ""):
            some.append((x, SWAP))
        if c in _MARKS:
            some += [("", MARK), (" ", MARK)]
        elif not c.isalpha():
            some.append(("", DROPPED if c in LOOKS else MARK))
            if c == last:
                some.append(("", REPEATED))
        out.append(some)
        last = c
    return out


def decode(model: CharModel, token: str) -> str:
    """The likeliest word, or words, behind a token."""
    states = {"^^": (0.0, None)}
    for some in lattice(token):
        then: dict[str, tuple] = {}
        for state, (cost, path) in states.items():
            for c, extra in some:
                if c == " ":
                    key, total, way = "^^", cost + extra + (model.cost(state, "$") if state != "^^" else 0.0), (path, c)
                elif c:
                    key, total, way = state[1] + c, cost + extra + model.cost(state, c), (path, c)
                else:
                    key, total, way = state, cost + extra, path
                if key not in then or total < then[key][0]:
                    then[key] = (total, way)
        states = then
    best = min(states.items(), key=lambda x: (x[1][0] + model.cost(x[0], "$"), x[0]))[1][1]
    out = []
    while best:
        best, c = best
        out.append(c)
    return "".join(reversed(out))


def suspicious(text: str) -> tuple[set[str], set[str]]:
    """The plain words of a lower-case text, and the tokens to be decoded."""
    plain, odd = set(), set()
    triple = _TRIPLE.search(text) is not None
    for t in set(text.split()):
        if t.isalpha():
            (odd if triple and _TRIPLE.search(t) else plain).add(t)
            continue
        t = _EDGE.sub("", t)
        if t.isalpha() and not (triple and _TRIPLE.search(t)):
            plain.add(t)
        elif _WORD.search(t):
            odd.add(t)
            plain.update(_WORD.findall(t))
    odd.update(m[0] for m in _SPACED.finditer(text) if _WORD.search(m[0]))
    return plain, odd


def features(words: set[str]) -> set[str]:
    """Words as they are, and their beginnings of STEM letters, marked by a trailing dash."""
    return words | {w[:k] + "-" for w in words for k in STEM if len(w) >= k}


def distinct(texts: list[str]) -> list[int]:
    """Numbers of the texts that share no band of a small MinHash of word triples with an earlier one."""
    odd = np.random.default_rng(7).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen, out = set(), []
    for k, text in enumerate(texts):
        w = text.encode().split()
        triples = set(zip(w, w[1:], w[2:], strict=False)) or {tuple(w)}
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(x)) for x in triples), dtype=np.uint64, count=len(triples))
        low = [int((h * m >> np.uint64(20)).min()) for m in odd]
        bands = {(i, low[i], low[i + 1]) for i in range(0, 8, 2)}
        if not bands & seen:
            out.append(k)
        seen |= bands
    return out


class ToxicModel:
    """Learned features with their odds, and the character model."""

    def __init__(self, sample: pd.DataFrame, letters: np.ndarray | None = None, doubt: float = 3.0, least: float = LEAST):
        """letters: the counts of ``gram_counts``; without them the words of the sample are counted."""
        usual: set[str] = set()
        words, docs, sizes, counts = Counter(), [0, 0], [0, 0], [Counter(), Counter()]
        for label in (0, 1):
            texts = [t.lower() for t in sample["text"][sample["label"] == label]]
            for k in distinct(texts):
                plain, _ = suspicious(texts[k])
                words.update(plain)
                if label == 0:
                    usual |= plain
                docs[label] += 1
                sizes[label] += len(plain)
                counts[label].update(features(plain))
        clean, toxic = counts
        share = docs[1] / max(1, sum(docs))
        needed = math.log(max(1, len(toxic))) + doubt
        chosen = {}
        for f, k in toxic.items():
            part = k / (k + clean[f])
            if part >= least and part > share > 0 and k * math.log(part / share) + (clean[f] * math.log((1 - part) / (1 - share)) if clean[f] else 0) >= needed:
                # odds for a document of one word: those of a toxic document times how often it holds f, against the rate of f in clean words
                chosen[f] = docs[1] / max(1, docs[0]) * (k / docs[1]) * max(1, sizes[0]) / (clean[f] + UNSEEN)
        # of stems that say the same the longest stays
        self.odds = {f: r for f, r in chosen.items() if f[-1] != "-" or not any(g[:-1].startswith(f[:-1]) and len(g) == len(f) + 1 and toxic[g] >= 0.9 * toxic[f] for g in chosen if g[-1] == "-")}
        explained = self.odds.keys()
        toxic_texts = [t.lower() for t in sample["text"][sample["label"] == 1]]
        left = [t for t in toxic_texts if not features(suspicious(t)[0]) & explained]
        n_clean = len(sample) - len(toxic_texts)
        self.base = (len(left) + 0.5) / (len(left) + n_clean + 1) if toxic_texts else 0.0
        self.stems = {f[:-1]: p for f, p in self.odds.items() if f[-1] == "-"}
        self.words = {f: p for f, p in self.odds.items() if f[-1] != "-"}
        self.single = {_double(f): (f, p) for f, p in self.words.items()}
        self.single_stems = {_double(f): (f, p) for f, p in self.stems.items()}
        # words of clean documents are taken as they are written, doubled letters and all
        self.usual = usual
        self.bare = _bare({*self.words, *self.stems})
        self.heads = {f[:3] for f in (*self.words, *self.stems)}
        self.lengths, self.single_lengths = sorted({len(f) for f in self.stems}), sorted({len(f) for f in self.single_stems})
        if letters is None:
            letters = np.zeros(KINDS * SLOTS, dtype=np.int64)
            for slot, k in grams(words).items():
                letters[slot] += k
        self.chars = CharModel(letters)
        self.known: dict[str, str] = {}

    def _best(self, w: str) -> float:
        """The odds of the feature of a word that says most, 0 without one."""
        best = self.words.get(w, 0.0)
        for k in self.lengths:
            if len(w) >= k and (r := self.stems.get(w[:k], 0.0)) > best:
                best = r
        return best

    def _best_single(self, w: str) -> tuple[str, float]:
        """As _best for a word whose doubled letters are single, with the word that it stands for."""
        w = _double(w)
        best = self.single.get(w, ("", 0.0))
        for k in self.single_lengths:
            if len(w) >= k and (got := self.single_stems.get(w[:k], ("", 0.0)))[1] > best[1]:
                best = (got[0] + w[k:], got[1])
        return best

    def hidden(self, text: str, plain: set[str]) -> set[str]:
        """What stands for learned features though it looks plain: doubled letters, look-alikes only, words in pieces."""
        out = {w for w in plain if _DOUBLED.search(w) and w not in self.usual and self._best_single(w)[1]}
        if self.bare:
            out.update(t for t in text.split() if not _WORD.search(t) and self.bare.match(t))
        return out

    def pieces(self, text: str) -> set[str]:
        """Learned words written with spaces inside, unless every piece is a usual word."""
        closed, out = "".join(text.split()), set()
        for f in self.words:
            if f in closed:
                for m in re.finditer(r"(?<!\w)" + r"\s*".join(map(re.escape, f)) + r"(?!\w)", text):
                    if len(parts := m[0].split()) > 1 and not self.usual.issuperset(parts):
                        out.add(f)
                        break
        return out

    def restored(self, token: str) -> str:
        if (got := self.known.get(token)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[token] = decode(self.chars, token)
        return got

    def score(self, text: str) -> float:
        """1 minus the product of the chances that each marked word of the restored text misleads.

        A long text holds more words that look marked by chance, so odds are divided by the number of its words.
        """
        text = text.lower()
        plain, odd = suspicious(text)
        found = {w: r for w in plain if w[:3] in self.heads and (r := self._best(w))}
        for w in self.pieces(text):
            found[w] = max(self.words[w], found.get(w, 0.0))
        for t in odd | self.hidden(text, plain) if self.odds else ():
            for w in _WORD.findall(self.restored(t)):
                if not (r := self._best(w)):
                    w, r = self._best_single(w)
                if r:
                    found[w] = max(r, found.get(w, 0.0))
        miss = 1 - self.base
        size = max(1, len(plain))
        for r in found.values():
            miss *= size / (size + r)
        return 1 - miss


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                    per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, threshold: float = 0.7) -> DataFrame:
    """Learn from a bounded sample of labelled rows that are not held out, then score every whole text.

    Returns one row per input row: doc_id, held_out, score (0 to 1, higher: label 1 is
    likelier) and predicted. A null text is empty; an empty text gets the score of a
    text without features. Repeated rows get equal scores; a null doc_id is not held
    out. Without toxic labels all scores are 0. Other columns are ignored. Features are learned from at
    most ``per_class`` documents and ``most_bytes`` bytes of each label; the character model counts the words of all
    documents that are not held out, in a number of counts that is fixed. Both are broadcast.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(ToxicModel(sample, gram_counts(docs.filter(~held_out(id_col)), text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            score = [m.score(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held_out("doc_id").alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))
