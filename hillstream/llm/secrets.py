"""Secret scans: fixed patterns and sliding-window Shannon entropy [DataFrame functions only].

Candidates of the entropy scan are runs of the characters of a class. A window
slides over a candidate; the counts of the characters in it are updated by the one
that enters and the one that leaves, and the sum of c * log2(c) over the counts by the
terms that change, from which the window's entropy follows. Windows that reach the class's
threshold merge to one span. Candidates on the allow-list give no span: they hold a
placeholder, are a UUID, lie in a longer dotted or slashed path, or have no digit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 32 and more is a whole run of [0-9a-f]+ that is long enough, and likewise AKIA[A-Z0-9]+ of 16 and more.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: name: (runs looked at, alphabet, window, least entropy in bits)
CLASSES = {
    "entropy_hex": (r"[0-9a-fA-F]{20,}", "0123456789abcdef", 20, 2.8),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
}
#: Runs that are no secrets: placeholders, the letters or digits in order, UUIDs, words joined without a digit.
#: The possessive loop needs no stack, however many words are joined.
ALLOWED = r"(?i)example|placeholder|dummy|sample|changeme|xxxx|0{8}|abcdefgh|01234567|12345678|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[^0-9]*$|^[A-Za-z]+([_/-][A-Za-z]+)*+[0-9]{0,4}$"


#: Matches, and windows, that one fold takes; a list it grows is never longer, so the work is in proportion to the text.
FOLD = 256
#: Sums of c * log2(c) are kept as whole numbers of this part of a bit, so that they do not drift.
UNIT = 1 << 40


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _folds(items: Column, n: Column, f, more: int = 0) -> Column:
    """f(part, offset) for each FOLD of the ``n`` first places of a bound array; a part reaches ``more`` items into the next."""
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _bound(F.slice(items, i + 1, F.lit(FOLD + more)), lambda part: f(part, i)))


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,hit>> in code points: the lengths of what lies between matches place them."""
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"
    none = F.array().cast(kind)
    zero = F.lit(0).cast("long")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.char_length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit")))).alias("out"))

    # places inside each fold, then where the folds begin
    parts = lambda items: _folds(items, F.size(items), lambda part, i: F.aggregate(part, F.struct(zero.alias("at"), none.alias("out")), step))
    begins = lambda folds: F.aggregate(folds, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
                                       lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    moved = lambda fold, by: F.transform(fold["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hit"].alias("hit")))
    placed = _bound(_bound(pairs, parts), lambda folds: F.flatten(F.zip_with(folds, begins(folds), moved)))
    return F.when(F.size(found) > 0, placed).otherwise(none)


def window_spans(run: Column, alphabet: str, window: int, least: float) -> Column:
    """array<struct<start,end>> of ``run``, merged from the windows whose entropy reaches ``least``.

    The counts of a window are one text with a character for each of the alphabet, of which a step changes two.
    """
    kind = "array<struct<start:bigint,end:bigint>>"
    # what c * log2(c) grows by when a count c goes to c + 1
    terms = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 2)]
    grows = F.array(*(F.lit(b - a) for a, b in zip(terms, terms[1:], strict=False)))
    # the entropy is log2(window) - sum / window
    most = math.floor((math.log2(window) - least + 1e-10) * window * UNIT)
    codes = F.transform(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c) + 1)  # 1: not in the alphabet
    far = F.lit(-1).cast("long")
    start = F.struct(F.lit("0" * (len(alphabet) + 1)).alias("counts"), F.lit(0).cast("long").alias("sum"), far.alias("start"), far.alias("end"), F.array().cast(kind).alias("out"))

    def step(s: Column, o: Column) -> Column:
        count = lambda at: F.ascii(F.substring(s["counts"], at, F.lit(1))) - 48
        put = lambda text, at, by: F.overlay(text, F.char(F.lit(48) + count(at) + by), at, F.lit(1))
        same = (o["comes"] == o["goes"]) | (o["comes"] < 0)
        entered = put(s["counts"], o["comes"], 1)
        counts = F.when(same, s["counts"]).when(o["goes"] < 0, entered).otherwise(put(entered, o["goes"], -1))
        more = F.element_at(grows, count(o["comes"]) + 1)
        total = F.when(same, s["sum"]).when(o["goes"] < 0, s["sum"] + more).otherwise(s["sum"] + more - F.element_at(grows, count(o["goes"])))
        # the window that ended before this character is judged now, when its sum is known
        begin = o["at"] - window
        high = (o["last"] >= window) & (s["sum"] <= most)
        new = high & (s["end"] < begin)
        done = F.when(new & (s["end"] >= 0), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(new, begin).otherwise(s["start"]).alias("start"), F.when(high, o["at"]).otherwise(s["end"]).alias("end"), done.alias("out"))

    def finished(s: Column) -> Column:
        return F.when(s["end"] >= 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def folded(part: Column, offset: Column) -> Column:
        """The spans of the windows that begin in one fold; a last step without a character judges the last window."""
        op = lambda comes, j: F.struct(comes.alias("comes"), F.when((j >= window) & (j < F.size(part)), F.get(part, j - window)).otherwise(-1).alias("goes"), j.alias("last"), (offset + j).cast("long").alias("at"))
        return F.aggregate(F.concat(F.transform(part, op), F.array(op(F.lit(-1), F.size(part)))), start, step, finished)

    def merged(spans: Column) -> Column:
        """Spans of neighbouring folds that touch become one."""
        begins = F.filter(spans, lambda x, i: (i == 0) | (F.get(spans, i - 1)["end"] < x["start"]))
        ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > x["end"]))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return _bound(codes, lambda c: _bound(F.flatten(_folds(c, F.size(c) - (window - 1), folded, window - 1)), merged))


def _entropy_spans(found: str, alphabet: str, window: int, least: float, allowed: str) -> Column:
    """The spans in the candidates of column ``found`` that are not on the allow-list."""
    folded = (lambda run: F.lower(run)) if alphabet == alphabet.lower() else (lambda run: run)

    def placed(x: Column) -> Column:
        return F.transform(window_spans(folded(x["hit"]), alphabet, window, least),
                           lambda s: F.struct((s["start"] + x["start"]).alias("start"), (s["end"] + x["start"]).alias("end"), F.lit("").alias("hit")))

    return F.flatten(F.transform(F.filter(found, lambda x: ~F.rlike(x["hit"], F.lit(allowed))), placed))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: dict | None = None, allowed: str = ALLOWED) -> DataFrame:
    """Spans of secrets, in code points of the whole text, the end exclusive.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex, n_entropy,
    base_sha256 and spans ("kind:start:end" by start, then kind in the order assign,
    access, hex, entropy classes; comma-joined). base_sha256 is of the spans of the three
    patterns. Entropy spans never displace those. A null text is empty and, like any
    text without secrets, has no spans. Repeated rows are scanned one by one; other
    columns are ignored.
    """
    classes = CLASSES if classes is None else classes
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {k: c[0] for k, c in classes.items()}
    for k, p in kinds.items():
        d = d.withColumn(f"m_{k}", F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    for k, p in kinds.items():
        d = d.withColumn(f"m_{k}", _ends(text, p, F.col(f"m_{k}")))
    d = d.withColumn("m_assign", F.filter("m_assign", lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8))
    for k, (_, alphabet, window, least) in classes.items():
        d = d.withColumn(f"m_{k}", _entropy_spans(f"m_{k}", alphabet, window, least, allowed))

    def span(kind: str, place: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.concat(F.lit(kind + ":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")).alias("span"))

    def listed(names: list[str]) -> Column:
        rows = F.concat(*(F.transform(f"m_{k}", span(k, i)) for i, k in enumerate(names)))
        return F.array_join(F.transform(F.array_sort(rows), lambda x: x["span"]), ",")

    n = {k: F.size(f"m_{k}").cast("long") for k in kinds}
    return d.select("doc_id", n["assign"].alias("n_assign"), n["access"].alias("n_access"), n["hex"].alias("n_hex"),
                    sum((n[k] for k in classes), F.lit(0).cast("long")).alias("n_entropy"), F.sha2(listed(["assign", "access", "hex"]), 256).alias("base_sha256"), listed(list(kinds)).alias("spans"))
