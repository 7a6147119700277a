"""The queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hillstream.llm import secrets
from hillstream.llm.byte_bpe import byte_bpe
from hillstream.llm.byte_conv import quality_scores
from hillstream.llm.exact_dedup import exact_dedup
from hillstream.llm.mixing import mix
from hillstream.llm.quality_rules import BOILERPLATE, quality_rules
from hillstream.llm.secrets import secret_scan
from hillstream.llm.sharding import lookup_table, place
from hillstream.llm.simhash import simhash_groups
from hillstream.llm.substring_dedup import substring_dedup
from hillstream.llm.toxicity import toxicity_scores


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir)).drop("clean_text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(128)], 16381


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_docs(spark, sf_dir), SHARDS, SLOTS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir)).drop("removed", "kept_text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_simhash, op3_mixing, op4_secrets, op5_toxicity, op6_sharding, op7_byte_bpe, op8_substring_dedup, op9_quality, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_mixing": OP3_SQL, "op4_secrets": _secrets_sql(), "op6_sharding": _sharding_sql(), "op8_substring_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}


def _sharding_sql() -> str:
    """The filled table is a list of shard numbers, made by its rule; placement is SQL."""
    slot = f"CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}"
    return f"SELECT doc_id, {slot} AS slot, {SHARDS}[{lookup_table(SHARDS, SLOTS)}[{slot} + 1] + 1] AS shard FROM documents"


#: Blocks and quotas by listing all quotients and taking the highest.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CASE WHEN doc_id IS NULL THEN ':' || md5(coalesce(text, '')) ELSE ':' || doc_id END AS name FROM documents
), s AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)
), w AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, cap / weight AS turn, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, place, source_size, least(cap, coalesce((SELECT arg_min(level, (turn, place)) FROM l WHERE level <= turn) * weight, cap)) AS target FROM l
), b AS (
  SELECT *, CAST(coalesce(greatest(1, least(1024, floor((SELECT min(target) FROM t WHERE target > 0) / 128))), 1) AS BIGINT) AS block FROM t
), n AS (
  SELECT *, (SELECT CAST(round(sum(target) / any_value(block)) AS BIGINT) FROM b) AS blocks FROM b
), q AS (
  SELECT place FROM (SELECT place, blocks, target / (2 * unnest(range(0, blocks)) + 1) AS quotient FROM n WHERE target > 0) QUALIFY row_number() OVER (ORDER BY quotient DESC, place) <= blocks
), sb AS (
  SELECT n.*, coalesce(c.won, 0) AS source_blocks, greatest(1, least(65536, CAST(ceil(source_size / 1048576) AS BIGINT))) AS shards FROM n LEFT JOIN (SELECT place, count(*) AS won FROM q GROUP BY 1) c USING (place)
), r AS (
  SELECT doc_id, size, place, source_size, target, block, source_blocks, CAST('0x' || substring(md5('17:shard' || name), 1, 15) AS BIGINT) % shards AS shard, CAST('0x' || substring(md5('17:order' || name), 1, 15) AS BIGINT) AS turn FROM d JOIN sb ON d.source IS NOT DISTINCT FROM sb.source
), p AS (
  SELECT place, shard, any_value(block) AS block, any_value(source_blocks) AS source_blocks, CAST(sum(size) AS BIGINT) AS words FROM r GROUP BY 1, 2
), pq AS (
  SELECT place, shard, count(*) AS won FROM (SELECT place, shard FROM (SELECT place, shard, source_blocks, CAST(words AS DOUBLE) / (2 * unnest(range(0, source_blocks)) + 1) AS quotient FROM p WHERE words > 0)
    QUALIFY row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) <= source_blocks) GROUP BY 1, 2
), k AS (
  SELECT place, shard, words, n, least(coalesce(won, 0), 3 * n) AS quota FROM (SELECT *, CASE WHEN words > 0 THEN greatest(1, CAST(round(words / block) AS BIGINT)) ELSE 0 END AS n FROM p) LEFT JOIN pq USING (place, shard)
), c AS (
  SELECT *, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS rounds, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest, CASE WHEN n > 0 THEN CAST('0x' || substring(md5('17:start:' || place || ':' || shard), 1, 15) AS BIGINT) % n ELSE 0 END AS start FROM k
), o AS (
  SELECT r.*, words, n, rounds, rest, start, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r JOIN c USING (place, shard)
)
SELECT doc_id, size, source_size, target, CASE WHEN n > 0 THEN CAST(rounds * size + greatest(0, least(upto, least(start + rest, n) * words // n) - greatest(upto - size, start * words // n)) + greatest(0, least(upto, greatest(0, start + rest - n) * words // n) - (upto - size)) AS BIGINT) ELSE 0 END AS taken FROM o
"""


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

def _secrets_sql() -> str:
    """Matches are placed by the lengths between them; windows are judged by DuckDB's own entropy and merged as islands."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX} | {k: c[0] for k, c in secrets.CLASSES.items()}
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {i} AS place, unnest(regexp_extract_all(t, {quoted(p)})) AS hit, unnest(string_split_regex(t, {quoted(p)})) AS gap, unnest(range(0, len(regexp_extract_all(t, {quoted(p)})) + 1)) AS n FROM d WHERE regexp_matches(t, {quoted(p)})"
        for i, (k, p) in enumerate(kinds.items()))
    runs = " UNION ALL ".join(
        f"SELECT doc_id, kind, place, b, {'lower(hit)' if alphabet == alphabet.lower() else 'hit'} AS run, {w} AS w, {least} AS least FROM placed WHERE kind = '{k}' AND NOT regexp_matches(hit, {quoted(secrets.ALLOWED.replace('*+', '*'))})"
        for k, (_, alphabet, w, least) in secrets.CLASSES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}),
placed AS (SELECT doc_id, kind, place, hit, e - length(hit) AS b, e FROM (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS e FROM found) WHERE hit IS NOT NULL),
runs AS ({runs}),
windows AS (SELECT * FROM (SELECT doc_id, kind, place, b, run, w, least, unnest(range(0, length(run) - w + 1)) AS i FROM runs) WHERE list_aggregate(string_split(substring(run, i + 1, w), ''), 'entropy') >= least - 1e-9),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind, b ORDER BY i) AS island FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, kind, b ORDER BY i) + w THEN 0 ELSE 1 END AS new FROM windows)),
spans AS (
  SELECT doc_id, kind, place, CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM placed WHERE place < 3 AND (kind <> 'assign' OR length(regexp_extract(hit, {quoted(secrets.ASSIGN)}, 2)) >= 8)
  UNION ALL SELECT doc_id, kind, place, CAST(b + min(i) AS BIGINT), CAST(b + max(i) + any_value(w) AS BIGINT) FROM islands GROUP BY doc_id, kind, place, b, island
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex, count(*) FILTER (WHERE place > 2) AS n_entropy,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) FILTER (WHERE place < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), triples AS (
  SELECT doc_id, i, words[i : i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS n FROM d)
), words AS (
  SELECT doc_id, n, word, lag(word) OVER (PARTITION BY doc_id, n ORDER BY k) AS before FROM (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM lines)
), each AS (
  SELECT doc_id, n, word, count(*) AS times, count(*) FILTER (WHERE before = word) AS repeats FROM words GROUP BY ALL
), measured AS (
  SELECT doc_id, n, sum(times) AS n_words, sum(times) FILTER (WHERE regexp_matches(word, '[#*$%&<>]|!!|\?\?')) AS marked, sum(times) FILTER (WHERE word IN ('|', '»', '›', '•', '>')) AS bars, max(times) AS most, sum(repeats) AS repeats FROM each GROUP BY ALL
), faults AS (
  SELECT m.doc_id, l.line, m.n_words, CASE
    WHEN coalesce(marked, 0) * 5 > n_words THEN 'punctuation'
    WHEN n_words >= 5 AND len(regexp_extract_all(line, '\p{Lu}')) * 10 > 7 * len(regexp_extract_all(line, '\p{L}')) THEN 'punctuation'
    WHEN coalesce(bars, 0) >= 3 AND bars * 10 > n_words THEN 'navigation'
    WHEN n_words >= 5 AND (most * 2 > n_words OR repeats * 3 > n_words) THEN 'navigation'
    WHEN n_words <= 30 AND regexp_matches(line, '(?i)BOILERPLATE') THEN 'boilerplate' END AS fault
  FROM measured m JOIN lines l ON l.doc_id = m.doc_id AND l.n = m.n
), summed AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n_words) FILTER (WHERE fault IS NULL), 0) AS left_, count(*) FILTER (WHERE fault = 'punctuation') AS p, count(*) FILTER (WHERE fault = 'navigation') AS v, count(*) FILTER (WHERE fault = 'boilerplate') AS b FROM faults GROUP BY doc_id
), all_ AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(left_, 0) AS BIGINT) AS n_words_left,
    coalesce(p, 0) AS lines_punctuation, coalesce(v, 0) AS lines_navigation, coalesce(b, 0) AS lines_boilerplate
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN summed s USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - n_words_left) <= n_words AS kept FROM all_
""".replace("BOILERPLATE", "|".join(BOILERPLATE))

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, len(words) - 19)) AS s, words FROM w WHERE len(words) >= 20
), windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS seq FROM starts
), later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w
), kept AS (
  SELECT e.doc_id, count(*) AS n, count(g.i) AS removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
