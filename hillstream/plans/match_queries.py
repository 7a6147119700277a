"""Queries that take several operators together: feeds, registries, telemetry and reports, with DuckDB SQL beside them.

Greedy rules are recursive in SQL: a step takes the next row of a key and carries what was kept as a list.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hillstream.functions import geometry, scores, text
from hillstream.operators import asof, correct, gates, registration, resolve, series, threads
from hillstream.plans import sinks
from hillstream.plans.queries import BUCKET, BUCKETED, CLUSTERS, FILLED, FRAME, KD, KEY, ORDER, RUNS, SCORED, _boxes, _dice_sql, _scored, _stats, _totals, query
from hillstream.sources.tables import observations, roster, table

# ---- similarity of names: Ratcliff-Obershelp by splitting pairs at their longest common part, the first in both

SPLITS = """m AS (
  SELECT id, a AS x, b AS y, CAST(0 AS BIGINT) AS size, 0 AS depth FROM pairs
  UNION ALL
  SELECT id, unnest([substring(x, 1, l * 1000 - v - 1), substring(x, l * 1000 - v + l)]), unnest([substring(y, 1, instr(y, part) - 1), substring(y, instr(y, part) + l)]), unnest([l, 0]), depth + 1
  FROM (SELECT *, (v + 999) // 1000 AS l, substring(x, (v + 999) // 1000 * 1000 - v, (v + 999) // 1000) AS part FROM (
    SELECT *, list_max(flatten([[n * 1000 - i for n in range(1, length(x) - i + 2) if contains(y, substring(x, i, n))] for i in range(1, length(x) + 1)])) AS v FROM m WHERE length(x) > 0 AND length(y) > 0)) WHERE v IS NOT NULL
), parts AS (SELECT id, CAST(sum(size) AS DOUBLE) AS shared, CAST(max(size) FILTER (WHERE depth <= 1) AS DOUBLE) AS longest FROM m GROUP BY id)"""
FEED = f"""CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 WHEN a = b THEN 1.0 ELSE least(1.0, 0.17 * (2 * shared / (length(a) + length(b)))
  + 0.10 * CASE WHEN contains(a, b) OR contains(b, a) THEN CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) ELSE 0.0 END
  + 0.22 * CAST({_dice_sql('a', 'b', 2)} AS DOUBLE) + 0.24 * CAST({_dice_sql('a', 'b', 3)} AS DOUBLE) + 0.12 * (2 * longest / (length(a) + length(b)))
  + 0.15 * (CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)))) END"""
ROSTER = "CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) ELSE 2 * shared / (length(a) + length(b)) END"


@query(f"""WITH RECURSIVE p AS (SELECT p_brand, p_size, p_partkey, regexp_replace(lower(p_name || p_type), '[^a-z0-9]', '', 'g') AS name FROM part),
t AS (SELECT *, substring(name, 1, CAST(p_partkey % 7 AS BIGINT) + 2) || substring(name, CAST(p_partkey % 7 AS BIGINT) + 4) AS seen FROM p),
both_ AS (SELECT t.p_partkey AS text_id, q.p_partkey AS player_id, seen AS a, q.name AS b FROM t JOIN p q USING (p_brand, p_size)),
pairs AS (SELECT DISTINCT a || '|' || b AS id, a, b FROM both_), {SPLITS},
scored AS (SELECT text_id, player_id, CAST({FEED} AS DOUBLE) AS score FROM both_ JOIN parts ON parts.id = a || '|' || b)
SELECT text_id, player_id, round(score, 6) AS score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, player_id) = 1""")
def fuzzy_top1(spark, d):
    """Texts with a letter missing against the names of their block, by the whole similarity of names in a feed."""
    p = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", text.ascii_key(F.concat("p_name", "p_type")).alias("name"))
    cut = (F.col("p_partkey") % 7).cast("int")
    seen = p.select("p_brand", "p_size", F.col("p_partkey").alias("text_id"), F.concat(F.substring("name", F.lit(1), cut + 2), F.substring(F.col("name"), cut + 4, F.length("name"))).alias("seen"))
    players = p.select("p_brand", "p_size", F.col("p_partkey").alias("player_id"), "name")
    best = resolve.best_player(seen, players, ["p_brand", "p_size"], ["text_id"], "seen", "name")
    return best.select("text_id", "player_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, lead(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
pairs AS (SELECT * FROM p WHERE b IS NOT NULL), {SPLITS}
SELECT id AS p_partkey, round(CAST({FEED} AS DOUBLE), 6) AS feed, round(CAST({ROSTER} AS DOUBLE), 6) AS roster, round(CAST(least(1.0, 0.35 * 0.8 + 0.65 * {ROSTER}) AS DOUBLE), 6) AS confidence, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 2 * longest / (length(a) + length(b)) END, 6) AS longest
FROM pairs JOIN parts USING (id)""")
def seq_similarity(spark, d):
    a = text.ascii_key(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", a.alias("a"), F.lead(a).over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).filter("b is not null")
    r = lambda c: F.round(c, 6)
    both = p.select("p_partkey", text.feed_similarity(F.col("a"), F.col("b")).alias("feed"), text.roster_similarity(F.col("a"), F.col("b")).alias("roster"), text.longest_common_part(F.col("a"), F.col("b")).alias("longest"))
    return both.select("p_partkey", r("feed").alias("feed"), r("roster").alias("roster"), r(scores.name_confidence(F.lit(0.8), F.col("roster"))).alias("confidence"), r("longest").alias("longest"))


# ---- rules for the boxes of a frame

BOXED = """bx AS (SELECT match_id, t // 14400 AS frame, event_id AS id, ['grayscale', 'red', 'blue', 'yellow'][k % 4 + 1] AS variant, player_id, CASE WHEN player_id <= 4 THEN 'friendly' ELSE 'enemy' END AS team,
  k / 100 AS confidence, CAST(k * 7 % 300 AS INTEGER) AS x, CAST(k * 13 % 90 AS INTEGER) AS y, CAST(k % 20 + 40 AS INTEGER) AS w, 18 AS h FROM obs)"""
ALIKE = "abs({a}.x + {a}.w / 2 - {b}.x - {b}.w / 2) + abs({a}.y + {a}.h / 2 - {b}.y - {b}.h / 2) <= 40 AND abs({a}.w - {b}.w) + abs({a}.h - {b}.h) <= 35"


def kept_sql(name: str, source: str, by: str = "match_id, frame", order: str = "confidence DESC, id") -> str:
    """CTEs that end in ``name``: the rows of source without an alike box of the same player kept before, with their place ``i``."""
    same = " AND ".join(f"n.{k.strip()} = r.{k.strip()}" for k in by.split(","))
    box = "struct_pack(p := n.player_id, x := n.x, y := n.y, w := n.w, h := n.h)"
    dup = f"len(list_filter(r.kept, lambda q: q.p = n.player_id AND {ALIKE.format(a='q', b='n')})) > 0"
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS i FROM {source}),
{name}_r AS (SELECT n.*, [{box}] AS kept, true AS new FROM {name}_n n WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN {dup} THEN r.kept ELSE list_append(r.kept, {box}) END, NOT ({dup}) FROM {name}_r r JOIN {name}_n n ON {same} AND n.i = r.i + 1),
{name} AS (SELECT * EXCLUDE (kept, new) FROM {name}_r WHERE new)"""


BOX_COLUMNS = "match_id, frame, id, variant, player_id, team, confidence, x, y, w, h"


@query("{obs}, " + BOXED + ", " + kept_sql("kb", "bx") + f" SELECT {BOX_COLUMNS} FROM kb", recursive=True)
def box_dedupe(spark, d):
    return resolve.deduped_boxes(_boxes(spark, d), FRAME)


@query("{obs}, " + BOXED + ", " + kept_sql("each_", "bx", "match_id, frame, variant") + ", each_rows AS (SELECT * EXCLUDE (i) FROM each_), " + kept_sql("kb", "each_rows") + f" SELECT {BOX_COLUMNS} FROM kb", recursive=True)
def variant_union(spark, d):
    """Each view's boxes deduped, put together and deduped again."""
    b = _boxes(spark, d)
    views = [resolve.deduped_boxes(b.filter(F.col("variant") == v), FRAME) for v in ("grayscale", "red", "blue", "yellow")]
    whole = views[0]
    for v in views[1:]:
        whole = whole.unionByName(v)
    return resolve.deduped_boxes(whole, FRAME)


@query("{obs}, " + BOXED + """, gn AS (SELECT *, y + h / 2 AS c, row_number() OVER (PARTITION BY match_id, frame ORDER BY y + h / 2, x, id) AS i FROM bx),
gr AS (SELECT match_id, frame, i, [struct_pack(c := c, s := CAST(greatest(1, h) AS DOUBLE), n := 1, top := y, ids := [id])] AS g FROM gn WHERE i = 1
  UNION ALL SELECT match_id, frame, i, CASE WHEN spot IS NULL THEN list_append(g, struct_pack(c := c, s := CAST(greatest(1, h) AS DOUBLE), n := 1, top := y, ids := [id]))
    ELSE [CASE WHEN q = spot THEN struct_pack(c := g[q].c + c, s := g[q].s + greatest(1, h), n := g[q].n + 1, top := least(g[q].top, y), ids := list_append(g[q].ids, id)) ELSE g[q] END for q in range(1, len(g) + 1)] END
  FROM (SELECT n.*, r.g, list_min([q for q in range(1, len(r.g) + 1) if abs(r.g[q].c / r.g[q].n - n.c) <= 0.85 * greatest(1, n.h, r.g[q].s / r.g[q].n)]) AS spot FROM gr r JOIN gn n ON n.match_id = r.match_id AND n.frame = r.frame AND n.i = r.i + 1)),
gl AS (SELECT match_id, frame, arg_max(g, i) AS g FROM gr GROUP BY 1, 2),
gu AS (SELECT match_id, frame, unnest(g) AS x, unnest(range(len(g))) AS made FROM gl),
gi AS (SELECT match_id, frame, unnest(x.ids) AS id, row_index FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, frame ORDER BY x.top, made) - 1 AS INTEGER) AS row_index FROM gu))
SELECT """ + BOX_COLUMNS + ", row_index FROM bx JOIN gi USING (match_id, frame, id)", recursive=True)
def row_groups(spark, d):
    return resolve.grouped_rows(_boxes(spark, d), FRAME)


IOU = ("CAST(greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) AS DOUBLE) / greatest(1, greatest(1, a.w * a.h) + greatest(1, o.w * o.h)"
       " - greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)))")
MERGED = BOXED + ", " + kept_sql("every", "bx") + f""",
near AS (SELECT a.match_id, a.frame, a.id AS anchor, o.id AS best FROM bx a JOIN every o ON o.match_id = a.match_id AND o.frame = a.frame WHERE a.variant = 'red' AND o.team = 'enemy' AND {ALIKE.format(a='a', b='o')}
  QUALIFY row_number() OVER (PARTITION BY a.match_id, a.frame, a.id ORDER BY {IOU} DESC, o.confidence DESC, o.i) = 1),
anchored AS (SELECT a.match_id, a.frame, b.id, b.variant, b.player_id, b.team, b.confidence, a.x, a.y, a.w, a.h, 'enemy' AS side, row_number() OVER (PARTITION BY a.match_id, a.frame ORDER BY a.id) AS pos
  FROM bx a LEFT JOIN near ON near.match_id = a.match_id AND near.frame = a.frame AND near.anchor = a.id JOIN bx b ON b.id = coalesce(near.best, a.id) WHERE a.variant = 'red'),
left_ AS (SELECT e.*, row_number() OVER (PARTITION BY e.match_id, e.frame ORDER BY e.i) AS j FROM every e WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.match_id = e.match_id AND near.frame = e.frame AND near.best = e.id) AND EXISTS (SELECT 1 FROM anchored a WHERE a.match_id = e.match_id AND a.frame = e.frame)),
taken AS (SELECT match_id, frame, CAST(0 AS BIGINT) AS j, list(struct_pack(x := x, y := y, w := w, h := h)) AS kept, false AS new, CAST(NULL AS BIGINT) AS id FROM anchored GROUP BY ALL
  UNION ALL SELECT n.match_id, n.frame, n.j, CASE WHEN dup THEN kept ELSE list_append(kept, struct_pack(x := n.x, y := n.y, w := n.w, h := n.h)) END, NOT dup, n.id
  FROM (SELECT n.*, r.kept, len(list_filter(r.kept, lambda q: {ALIKE.format(a='q', b='n')})) > 0 AS dup FROM taken r JOIN left_ n ON n.match_id = r.match_id AND n.frame = r.frame AND n.j = r.j + 1) n),
whole AS (SELECT * FROM anchored UNION ALL SELECT l.match_id, l.frame, l.id, variant, player_id, team, confidence, x, y, w, h, 'friendly', 100000 + l.j FROM left_ l JOIN taken t ON t.match_id = l.match_id AND t.frame = l.frame AND t.j = l.j AND t.new),
""" + kept_sql("once", "whole", order="confidence DESC, id, pos") + f""",
merged AS (SELECT {BOX_COLUMNS}, side FROM once UNION ALL SELECT {BOX_COLUMNS}, CAST(NULL AS VARCHAR) FROM every e WHERE NOT EXISTS (SELECT 1 FROM anchored a WHERE a.match_id = e.match_id AND a.frame = e.frame))"""


@query("{obs}, " + MERGED + " SELECT * FROM merged", recursive=True)
def anchored_merge(spark, d):
    return resolve.merged_variants(_boxes(spark, d), FRAME)


# ---- event threads

THREAD = "STRUCT(y DOUBLE, seen DOUBLE, lp BIGINT, lt VARCHAR, lc DOUBLE, rp BIGINT, rt VARCHAR, rc DOUBLE, counted BOOLEAN)"
ROWS = """er AS (SELECT match_id, event_id, t / 10000.0::DOUBLE AS t, CAST(k * 13 % 90 AS DOUBLE) AS y, CASE WHEN event_type <> 'error' THEN player_id END AS lp, CASE WHEN event_type <> 'error' THEN CASE WHEN player_id <= 4 THEN 'friendly' ELSE 'enemy' END END AS lt,
  CASE WHEN event_type <> 'error' THEN k / 100 END AS lc, CASE WHEN k % 5 <> 0 THEN k % 8 + 1 END AS rp, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 8 + 1 <= 4 THEN 'friendly' ELSE 'enemy' END END AS rt, CASE WHEN k % 5 <> 0 THEN (k * 37 % 100) / 100 END AS rc,
  row_number() {W} AS i FROM obs)"""
THREADS = ROWS + f""", th AS (
  SELECT match_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS {THREAD}[]) AS open, [-1e18::DOUBLE for _ in range(8)] AS deaths, CAST(NULL AS BOOLEAN) AS created, false AS counted, CAST(NULL AS VARCHAR) AS blocked, CAST(NULL AS BIGINT) AS killer, CAST(NULL AS BIGINT) AS victim FROM er GROUP BY match_id
  UNION ALL
  SELECT match_id, i, event_id, CASE WHEN none THEN open ELSE [CASE WHEN q = spot THEN struct_update(now, counted := now.counted OR counts) ELSE alive[q] END for q in range(1, greatest(len(alive), spot) + 1)] END,
    CASE WHEN counts THEN [CASE WHEN q = now.rp THEN t ELSE deaths[q] END for q in range(1, 9)] ELSE deaths END, CASE WHEN NOT none THEN spot > len(alive) END, counts, CASE WHEN NOT counts THEN verdict END, CASE WHEN counts THEN now.lp END, CASE WHEN counts THEN now.rp END
  FROM (SELECT *, coalesce(verdict = 'counted', false) AS counts FROM (
    SELECT *, CASE WHEN none OR now.counted OR now.lp IS NULL OR now.rp IS NULL THEN NULL WHEN now.lp = now.rp OR now.lt = now.rt THEN 'same_side' WHEN least(now.lc, now.rc) < 0.55 THEN 'low_confidence' WHEN t - deaths[now.rp] < 4.5 THEN 'victim_cooldown' ELSE 'counted' END AS verdict FROM (
      SELECT *, CASE WHEN spot > len(alive) THEN struct_pack(y := y, seen := t, lp := lp, lt := lt, lc := lc, rp := rp, rt := rt, rc := rc, counted := false)
        ELSE struct_pack(y := y, seen := t, lp := CASE WHEN newl THEN lp ELSE h.lp END, lt := CASE WHEN newl THEN lt ELSE h.lt END, lc := CASE WHEN newl THEN lc ELSE h.lc END,
          rp := CASE WHEN newr THEN rp ELSE h.rp END, rt := CASE WHEN newr THEN rt ELSE h.rt END, rc := CASE WHEN newr THEN rc ELSE h.rc END, counted := h.counted) END AS now FROM (
        SELECT *, h.lp IS NULL OR lp IS NOT NULL AND lc >= h.lc AS newl, h.rp IS NULL OR rp IS NOT NULL AND rc >= h.rc AS newr FROM (
          SELECT *, alive[spot] AS h FROM (
            SELECT *, coalesce(list_min([struct_pack(gap := abs(alive[q].y - y), q := q) for q in range(1, len(alive) + 1) if abs(alive[q].y - y) <= 45 AND t - alive[q].seen <= 1.5
              AND (alive[q].lp IS NULL OR lp IS NULL OR alive[q].lp = lp) AND (alive[q].rp IS NULL OR rp IS NULL OR alive[q].rp = rp)]).q, len(alive) + 1) AS spot FROM (
              SELECT e.*, r.open, r.deaths, e.lp IS NULL AND e.rp IS NULL AS none, list_filter(r.open, lambda q: e.t - q.seen <= 4.5) AS alive FROM th r JOIN er e ON e.match_id = r.match_id AND e.i = r.i + 1)))))))
), ev AS (SELECT match_id, event_id, created, counted, blocked, killer, victim FROM th WHERE i > 0)"""


def _feed_rows(spark, d) -> DataFrame:
    """Rows of two names made from the readings."""
    o, k = observations(spark, d), F.col("k")
    side = lambda who: F.when(who <= 4, "friendly").otherwise("enemy")
    left, right = F.col("event_type") != "error", k % 5 != 0
    who = k % 8 + 1
    return o.select("match_id", "event_id", (F.col("t") / 10000.0).alias("t"), (k * 13 % 90).cast("double").alias("y"), F.when(left, F.col("player_id")).alias("left_player"), F.when(left, side(F.col("player_id"))).alias("left_team"),
                    F.when(left, k / 100).alias("left_confidence"), F.when(right, who).alias("right_player"), F.when(right, side(who)).alias("right_team"), F.when(right, (k * 37 % 100) / 100).alias("right_confidence"))


def _events(spark, d) -> DataFrame:
    return threads.event_threads(_feed_rows(spark, d), KEY, ORDER)


@query("{obs}, " + THREADS + " SELECT * FROM ev", recursive=True)
def event_threads(spark, d):
    return _events(spark, d).select("match_id", "event_id", "created", "counted", "blocked", "killer", "victim")


COUNTED = THREADS + """, c AS (SELECT match_id, count(*) FILTER (WHERE counted) AS kills, count(*) FILTER (WHERE counted) AS deaths, CAST(0 AS BIGINT) AS trades, count(*) FILTER (WHERE created) AS event_threads_created, count(*) FILTER (WHERE NOT created) AS event_threads_reused,
  count(*) FILTER (WHERE counted) AS events_counted, count(*) FILTER (WHERE blocked = 'same_side') AS events_blocked_same_side, count(*) FILTER (WHERE blocked = 'low_confidence') AS events_blocked_low_confidence, count(*) FILTER (WHERE blocked = 'victim_cooldown') AS events_blocked_victim_cooldown FROM ev GROUP BY 1),
n AS (SELECT match_id, count(*) AS row_groups_detected, CAST(sum(CASE WHEN lp IS NULL THEN 0 ELSE 1 END + CASE WHEN rp IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS resolved_name_detections, count(*) FILTER (WHERE lp IS NULL OR rp IS NULL) AS single_side_row_groups FROM er GROUP BY 1),
b AS (SELECT match_id, count(*) AS name_detections FROM obs GROUP BY 1),
counters AS (SELECT b.*, resolved_name_detections, row_groups_detected, single_side_row_groups, c.* EXCLUDE (match_id) FROM b JOIN n USING (match_id) JOIN c USING (match_id))"""


@query("{obs}, " + COUNTED + " SELECT * FROM counters", recursive=True)
def kill_counters(spark, d):
    """All counters of the feed."""
    return threads.kill_counters(observations(spark, d), _feed_rows(spark, d), _events(spark, d), KEY)


@query("{obs}, " + ROWS + ", x AS (SELECT match_id, unnest([lp, rp]) AS player_id FROM er) SELECT match_id, player_id, count(*) AS detections FROM x WHERE player_id IS NOT NULL GROUP BY 1, 2")
def player_detections(spark, d):
    return threads.player_detections(_feed_rows(spark, d), KEY)


@query("{obs}, " + THREADS + """, p AS (SELECT m.match_id, p.player_id, '[T]Player ' || p.player_id AS name, CASE WHEN p.player_id <= 4 THEN 'ally' ELSE 'enemy' END AS team FROM (SELECT DISTINCT match_id FROM obs) m, range(1, 9) p(player_id)),
s AS (SELECT *, (SELECT count(*) FROM ev WHERE ev.match_id = p.match_id AND killer = player_id) AS kills, (SELECT count(*) FROM ev WHERE ev.match_id = p.match_id AND victim = player_id) AS deaths FROM p)
SELECT *, round(CASE WHEN deaths = 0 THEN CAST(kills AS DOUBLE) ELSE kills / deaths END, 2) AS kd FROM s""", recursive=True)
def kd_of_events(spark, d):
    """Kills and deaths of the events that the threads counted."""
    from hillstream.operators import summary

    return summary.kills_deaths(_events(spark, d).filter("counted"), roster(spark, d), KEY)


def kill_rows(spark, d) -> DataFrame:
    """Boxes to rows of two names: views merged at the red boxes, grouped by height, and the two sides chosen."""
    merged = resolve.merged_variants(_boxes(spark, d), FRAME)
    return resolve.row_sides(resolve.grouped_rows(merged, FRAME), FRAME)


@query()
def kill_events(spark, d):
    """From boxes to counted kills, each rule on the result of the one before."""
    rows = kill_rows(spark, d).withColumn("t", F.col("frame") * 0.3)
    return threads.event_threads(rows, KEY, ["t", "row_index"])


# ---- names of a frame, clusters and the registry

RATIOS = lambda names: "MAP {" + ", ".join(f"'{a}|{b}': {difflib_or_held(a, b)!r}" for a in names for b in names) + "}"


def difflib_or_held(a: str, b: str) -> float:
    """What two roster names have in common, for the tables in the SQL."""
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    return difflib.SequenceMatcher(None, a, b).ratio()


SEEN = [f"player{p}{x}" for p in range(1, 9) for x in ("", "x")]


@query("{obs}, cn AS (SELECT match_id, t, event_id, 'player' || player_id || CASE WHEN k % 3 = 0 THEN 'x' ELSE '' END AS name, row_number() {W} AS i FROM obs), sim AS (SELECT " + RATIOS(SEEN) + """ AS s),
cr AS (SELECT match_id, t, event_id, name, i, [name] AS keys, CAST(0 AS BIGINT) AS cluster FROM cn WHERE i = 1
  UNION ALL SELECT match_id, t, event_id, name, i, CASE WHEN best IS NULL THEN list_append(keys, name) ELSE keys END, coalesce(best, len(keys)) FROM (
    SELECT n.*, r.keys, -list_max([struct_pack(s := sim.s[r.keys[q + 1] || '|' || n.name], q := -q) for q in range(len(r.keys)) if sim.s[r.keys[q + 1] || '|' || n.name] >= 0.82]).q AS best FROM cr r JOIN cn n ON n.match_id = r.match_id AND n.i = r.i + 1, sim))
SELECT match_id, t, event_id, name, CAST(cluster AS INTEGER) AS cluster FROM cr""", recursive=True)
def roster_clusters(spark, d):
    o = observations(spark, d).select("match_id", "t", "event_id", F.concat(F.lit("player"), F.col("player_id").cast("string"), F.when(F.col("k") % 3 == 0, "x").otherwise("")).alias("name"))
    return threads.roster_clusters(o, KEY, ORDER)


@query("{obs}, dn AS (SELECT match_id, t // 14400 AS frame, event_id, 'player' || k % 12 AS name, -k AS rank, row_number() OVER (PARTITION BY match_id, t // 14400 ORDER BY -k, event_id) AS i FROM obs), sim AS (SELECT " + RATIOS([f"player{i}" for i in range(12)]) + """ AS s),
dr AS (SELECT match_id, frame, event_id, name, rank, i, [name] AS kept, true AS new FROM dn WHERE i = 1
  UNION ALL SELECT match_id, frame, event_id, name, rank, i, CASE WHEN dup THEN kept ELSE list_append(kept, name) END, NOT dup FROM (
    SELECT n.*, r.kept, len([q for q in r.kept if sim.s[n.name || '|' || q] >= 0.82]) > 0 AS dup FROM dr r JOIN dn n ON n.match_id = r.match_id AND n.frame = r.frame AND n.i = r.i + 1, sim))
SELECT match_id, frame, event_id, name, rank FROM dr WHERE new""", recursive=True)
def name_dedupe(spark, d):
    o = observations(spark, d).select("match_id", F.floor(F.col("t") / 14400).alias("frame"), "event_id", F.concat(F.lit("player"), (F.col("k") % 12).cast("string")).alias("name"), (-F.col("k")).alias("rank"))
    return threads.deduped_names(o, FRAME, ["rank", "event_id"])


NAMED = ["kestrel", "mongoose", "drifter", "quartz", "saffron", "tundra", "vortex", "willow"]
SPELLED = [n + x for n in NAMED for x in ("", "x", "zzzzzz")]


def _board(spark, d) -> DataFrame:
    """Names read on the board, made from the readings: three spellings each, shown in lower case or with a capital."""
    k, p = F.col("k"), F.col("player_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, NAMED)), p.cast("int")), F.when(k % 7 == 0, "x").when(k % 11 == 0, "zzzzzz").otherwise(""))
    return observations(spark, d).select("match_id", F.floor(F.col("t") / 86400).cast("long").alias("frame"), F.when(p <= 4, "friendly").otherwise("enemy").alias("team"), ((p - 1) % 4).alias("slot_index"),
                                         F.when(k % 2 == 0, F.initcap(name)).otherwise(name).alias("display_name"), name.alias("normalized_name"), ((k % 40 + 60) / 100).alias("confidence"))


BOARD = "rd AS (SELECT match_id, t // 86400 AS frame, CASE WHEN player_id <= 4 THEN 'friendly' ELSE 'enemy' END AS team, (player_id - 1) % 4 AS slot, CASE WHEN k % 2 = 0 THEN upper(left(name, 1)) || substring(name, 2) ELSE name END AS display, name, (k % 40 + 60) / 100 AS confidence FROM (SELECT *, " + str(NAMED) + "[player_id] || CASE WHEN k % 7 = 0 THEN 'x' WHEN k % 11 = 0 THEN 'zzzzzz' ELSE '' END AS name FROM obs)), sim AS (SELECT " + RATIOS(SPELLED) + " AS s)"
REGISTERED = BOARD + """, fn AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame, team ORDER BY confidence DESC, slot, display, name) AS i FROM rd),
fr AS (SELECT match_id, frame, team, display, name, confidence, i, [name] AS kept, true AS new FROM fn WHERE i = 1
  UNION ALL SELECT match_id, frame, team, display, name, confidence, i, CASE WHEN dup THEN kept ELSE list_append(kept, name) END, NOT dup FROM (
    SELECT n.*, r.kept, len([q for q in r.kept if sim.s[q || '|' || n.name] >= 0.82]) > 0 AS dup FROM fr r JOIN fn n ON n.match_id = r.match_id AND n.frame = r.frame AND n.team = r.team AND n.i = r.i + 1, sim)),
sn AS (SELECT match_id, team, frame, display, name, confidence, row_number() OVER (PARTITION BY match_id, team ORDER BY frame, i) AS i FROM fr WHERE new),
sr AS (SELECT match_id, team, frame, display, confidence, i, [name] AS keys, CAST(0 AS BIGINT) AS cluster FROM sn WHERE i = 1
  UNION ALL SELECT match_id, team, frame, display, confidence, i, CASE WHEN best IS NULL THEN list_append(keys, name) ELSE keys END, coalesce(best, len(keys)) FROM (
    SELECT n.*, r.keys, -list_max([struct_pack(s := sim.s[r.keys[q + 1] || '|' || n.name], q := -q) for q in range(len(r.keys)) if sim.s[r.keys[q + 1] || '|' || n.name] >= 0.82]).q AS best FROM sr r JOIN sn n ON n.match_id = r.match_id AND n.team = r.team AND n.i = r.i + 1, sim)),
fs AS (SELECT DISTINCT match_id, frame FROM rd),
shown AS (SELECT f.match_id, f.frame, team, cluster, display, count(*) AS times, min(i) AS since FROM fs f JOIN sr ON sr.match_id = f.match_id AND sr.frame <= f.frame GROUP BY ALL),
names AS (SELECT match_id, frame, team, cluster, arg_max(display, (times, length(display), -since)) AS name FROM shown GROUP BY ALL),
cs AS (SELECT f.match_id, f.frame, team, cluster, count(*) AS n, sum(confidence) AS w FROM fs f JOIN sr ON sr.match_id = f.match_id AND sr.frame <= f.frame GROUP BY ALL),
tops AS (SELECT match_id, frame, team, cluster, name, n, least(1.0, w / n + least(0.20, 0.05 * (n - 1))) AS confidence, row_number() OVER (PARTITION BY match_id, frame, team ORDER BY n DESC, round(w, 6) DESC, length(name) DESC, cluster) AS place FROM cs JOIN names USING (match_id, frame, team, cluster) QUALIFY place <= 4),
okay AS (SELECT match_id, frame FROM (SELECT match_id, frame, team FROM tops WHERE n >= 2 AND confidence >= 0.72 GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL HAVING count(*) = 2),
locks AS (SELECT match_id, min(frame) AS lock FROM okay GROUP BY 1),
reg AS (SELECT f.match_id, f.frame, list(t.name ORDER BY CASE t.team WHEN 'friendly' THEN 0 ELSE 1 END, place) AS players, round(avg(t.confidence), 9) AS confidence, coalesce(any_value(f.frame >= lock), false) AS complete
  FROM fs f LEFT JOIN locks USING (match_id) JOIN tops t ON t.match_id = f.match_id AND t.frame = least(f.frame, coalesce(lock, f.frame)) GROUP BY 1, 2)"""


@query("{obs}, " + REGISTERED + " SELECT match_id, frame, array_to_string(players, ',') AS players, len(players) AS n_players, confidence, complete, complete AS locked FROM reg", recursive=True)
def registry_by_frame(spark, d):
    """The provisional registry after every visible frame, until it is complete and locked."""
    r = registration.registered(_board(spark, d), KEY, "frame")
    return r.select("match_id", "frame", F.array_join("players", ",").alias("players"), F.size("player_ids").cast("long").alias("n_players"), F.round("confidence", 9).alias("confidence"), "complete", "locked")


@query("{obs}, " + REGISTERED + " SELECT match_id, min(frame) AS frame, arg_min(array_to_string(players, ','), frame) AS players, arg_min(confidence, frame) AS confidence FROM reg WHERE complete GROUP BY 1", recursive=True)
def registration_done(spark, d):
    """The frame that completes each registry."""
    r = registration.completed(registration.registered(_board(spark, d), KEY, "frame"), KEY, "frame")
    return r.select("match_id", "frame", F.array_join("players", ",").alias("players"), F.round("confidence", 9).alias("confidence"))


LAST = "lastv AS (SELECT match_id, max(nades) AS nades, max(stuns) AS stuns, count(*) FILTER (WHERE event_type = 'signup') AS specialties, arg_max(score, (t, event_id)) FILTER (WHERE score IS NOT NULL) AS blue_score, arg_max(hill, (t, event_id)) FILTER (WHERE hill IS NOT NULL) AS hill FROM obs GROUP BY 1)"


@query("{obs}, " + REGISTERED + ", " + LAST + """, fin AS (SELECT match_id, arg_max(confidence, frame) AS confidence, arg_max(complete, frame) AS complete, CAST(arg_max(len(players), frame) AS INTEGER) AS players FROM reg GROUP BY 1)
SELECT match_id, players, confidence, nades, stuns, specialties, blue_score, hill FROM fin JOIN lastv USING (match_id) WHERE complete AND players = 8""", recursive=True)
def second_pass(spark, d):
    """The registries that are complete, locked and whole, with what the first pass hands on."""
    r = registration.registered(_board(spark, d), KEY, "frame")
    last = r.groupBy("match_id").agg(F.max_by(F.struct("complete", "locked", F.size("player_ids").alias("players"), F.round("confidence", 9).alias("confidence")), "frame").alias("r")).select("match_id", "r.*")
    o, w = observations(spark, d), F.struct("t", "event_id")
    some = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), w))
    return gates.second_pass(last, _totals(spark, d), o.groupBy("match_id").agg(some("score").alias("blue_score"), some("hill").alias("hill")), KEY)


# ---- gates and ticks

@query("""{obs}, g AS (SELECT *, (k * 37 % 100) / 100 AS c, regexp_replace(substring(event_type, 1, CAST(k % 5 AS BIGINT)) || '-', '[^\\p{L}\\p{N}_\\-\\[\\]]', '', 'g') AS name FROM obs)
SELECT match_id, event_id, value / 500 >= 0.03 AND c >= 0.70 AS visible, length(name) > 0 AND length(regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g')) >= 3 AND greatest(0.0, c - 0.3) >= 0.20 AS name_counts,
  CASE WHEN k < 10 AND k BETWEEN 1 AND 5 AND c >= 0.85 THEN CAST(k AS INTEGER) END AS hill,
  CASE WHEN greatest(c, k / 100) >= 0.60 AND greatest(c, k / 100) - least(c, k / 100) >= 0.18 THEN CASE WHEN k / 100 > c THEN 1 ELSE 0 END END AS counter, c >= 0.73 AS lit FROM g""")
def reading_gates(spark, d):
    """Which readings count: board visible, text can be a name, hill, counter and specialty."""
    k, c = F.col("k"), F.col("k") * 37 % 100 / 100
    name = text.ocr_text(F.concat(F.substring(F.col("event_type"), F.lit(1), (k % 5).cast("int")), F.lit("-")))
    return observations(spark, d).select("match_id", "event_id", gates.board_visible(F.expr("value / 500"), c).alias("visible"), gates.name_counts(name, c - 0.3).alias("name_counts"),
                                         gates.hill_reading(k.cast("string"), c).alias("hill"), gates.counter_reading(c, k / 100).alias("counter"), gates.lit(c).alias("lit"))


@query("""SELECT m.match_id, x.module, CASE WHEN NOT (m.match_id % 5 <> 4 OR x.module = 'scoreboard') THEN 'disabled' WHEN x.module = 'killfeed' AND NOT (m.match_id % 2 = 0 AND m.match_id % 3 <> 0 AND 8 - m.match_id % 7 // 6 = 8) THEN 'waiting'
  WHEN x.module = 'utility' AND m.match_id % 3 = 1 AND NOT m.match_id % 2 = 0 THEN 'waiting' ELSE 'active' END AS status FROM (SELECT DISTINCT user_id % 10 + 10 * (user_id // 100) AS match_id FROM events) m, (VALUES ('scoreboard'), ('killfeed'), ('utility'), ('hardpoint')) x(module)""")
def module_gates(spark, d):
    """Whether each module runs for each match: the feed needs a locked registry of eight, others at most completion."""
    m = F.col("match_id")
    state = roster(spark, d).select("match_id").distinct().select("match_id", (m % 5 != 4).alias("on"), (m % 2 == 0).alias("complete"), (m % 3 != 0).alias("locked"), (8 - F.floor(m % 7 / 6)).alias("players"), (m % 3 == 1).alias("needs"))
    always, never = F.lit(True), F.lit(False)
    status = {"scoreboard": gates.module_status(always, never, F.col("complete")), "killfeed": gates.module_status(F.col("on"), always, F.col("complete"), F.col("locked"), F.col("players")),
              "utility": gates.module_status(F.col("on"), F.col("needs"), F.col("complete")), "hardpoint": gates.module_status(F.col("on"), never, F.col("complete"))}
    return state.select("match_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, status)), F.array(*status.values()))).alias("module", "status"))


@query("""{obs}, f AS (SELECT match_id, event_id, t, k % 4 <> 0 AS image FROM obs), x AS (SELECT module, gap, uses, match_id, event_id, t, image FROM f, (VALUES ('scoreboard', 40000.0, false), ('killfeed', 40000.0 / 3, true), ('utility', 10000.0, true), ('hardpoint', 20000.0, true)) m(module, gap, uses) WHERE uses OR image),
r AS (
  SELECT module, match_id, event_id, t, image, gap FROM x QUALIFY row_number() OVER (PARTITION BY module, match_id ORDER BY t, event_id) = 1
  UNION ALL
  (SELECT x.module, x.match_id, x.event_id, x.t, x.image, x.gap FROM r JOIN x ON x.module = r.module AND x.match_id = r.match_id AND x.t - r.t >= r.gap - 1e-9 QUALIFY row_number() OVER (PARTITION BY x.module, x.match_id ORDER BY x.t, x.event_id) = 1)
) SELECT module, match_id, event_id FROM r WHERE image""", recursive=True)
def module_ticks(spark, d):
    """The frames that each of the four modules works on, at its rate; only the scoreboard looks for an image before it uses up a tick."""
    f = observations(spark, d).select("match_id", "event_id", "t", F.when(F.col("k") % 4 != 0, F.lit(1)).alias("image"))
    out = None
    for module in gates.RATES:
        some = gates.module_ticks(f, KEY, "t", ORDER, "image", module, 1 / 40000).select(F.lit(module).alias("module"), "match_id", "event_id")
        out = some if out is None else out.unionByName(some)
    return out


# ---- telemetry, reports and the rest

def _clean_sql(c: str) -> str:
    """CTEs that end in ``clean_<c>``: the cleaning of one score, each name marked by the column."""
    body = (f"raw AS (SELECT match_id, bucket AS t, bucket AS event_id, {c} AS score FROM filled), " + RUNS.replace("{c}", "score").replace("{src}", "raw") + """,
s1 AS (SELECT match_id, run, CASE WHEN n <= 4 AND lead(n) OVER r >= 6 AND abs(lead(v) OVER r - v) <= 20 THEN lead(v) OVER r ELSE v END AS v FROM runs WINDOW r AS (PARTITION BY match_id ORDER BY run)),
s2 AS (SELECT v2.match_id, v2.t, v2.event_id, s1.v FROM v2 JOIN s1 USING (match_id, run)), """ + CLUSTERS.replace("{src}", "s2") + ", "
            + RUNS.replace("{c}", "v").replace("{src}", "clustered").replace("v0", "w0").replace("v1", "w1").replace("v2", "w2").replace("runs", "wruns") + """,
s3 AS (SELECT match_id, run, CASE WHEN v - lead(v) OVER r BETWEEN 1 AND 25 AND lead(v, 2) OVER r - lead(v) OVER r BETWEEN 0 AND 6 AND lead(v, 3) OVER r - lead(v, 2) OVER r BETWEEN 0 AND 6 THEN lead(v) OVER r ELSE v END AS v
       FROM wruns WINDOW r AS (PARTITION BY match_id ORDER BY run)),
s4 AS (SELECT w2.match_id, w2.t, w2.event_id, s3.v FROM w2 JOIN s3 USING (match_id, run)), clean AS (SELECT match_id, t AS bucket, max(v) {ALONG} AS score FROM s4)""")
    for name in ("raw", "v0", "v1", "v2", "w0", "w1", "w2", "runs", "wruns", "s1", "s2", "s3", "s4", "i0", "i1", "i2", "i3", "i4", "i5", "i6", "clustered", "clean"):
        import re

        body = re.sub(rf"\b{name}\b", f"{name}_{c}", body)
    return body


KILL_COLUMNS = ", ".join(f"count(*) FILTER (WHERE killer = {p}) OVER w AS k{p}" for p in range(1, 9))
PLAYERS = [(p, text_) for p, text_ in zip(range(1, 9), ["Jo", "Jo", "Jo_2", "Al", "Al", "Bo", "Cy", "Jo"], strict=True)]
HEADERS = text.header_names([n for _, n in PLAYERS])
TELEMETRY = """base AS (SELECT *, CAST(CASE WHEN event_type <> 'error' AND k % 3 <> 0 THEN score // 2 + k % 4 END AS BIGINT) AS red FROM obs WHERE event_type <> 'purchase'),
b AS (SELECT *, CAST(floor((greatest(1, t - min(t) OVER (PARTITION BY match_id) + 1) - 1) / {BUCKET}) + 1 AS BIGINT) AS bucket, last_value(score IGNORE NULLS) {ALONG} AS blue_c, last_value(red IGNORE NULLS) {ALONG} AS red_c, last_value(hill IGNORE NULLS) {ALONG} AS hill_c FROM base),
lastr AS (SELECT match_id, bucket, arg_max(t, (t, event_id)) AS t, arg_max(nades, (t, event_id)) AS nades, arg_max(stuns, (t, event_id)) AS stuns FROM b GROUP BY 1, 2),
modes AS (SELECT match_id, bucket, what, arg_max(v, (n, v)) AS v FROM (SELECT match_id, bucket, what, v, count(*) AS n FROM (SELECT match_id, bucket, unnest(['blue', 'red', 'hill']) AS what, unnest([blue_c, red_c, hill_c]) AS v FROM b) WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
killed AS (SELECT l.match_id, l.bucket, """ + ", ".join(f"count(*) FILTER (WHERE o.killer = {p}) AS k{p}" for p in range(1, 9)) + """ FROM lastr l LEFT JOIN obs o ON o.match_id = l.match_id AND o.event_type = 'purchase' AND o.killer <> o.victim AND o.t <= l.t GROUP BY 1, 2),
rows_ AS (SELECT match_id, bucket, max(v) FILTER (WHERE what = 'blue') AS blue, max(v) FILTER (WHERE what = 'red') AS red, max(v) FILTER (WHERE what = 'hill') AS hill, any_value(nades) AS nades, any_value(stuns) AS stuns, """ + ", ".join(f"any_value(k{p}) AS k{p}" for p in range(1, 9)) + """
  FROM lastr l JOIN killed USING (match_id, bucket) LEFT JOIN modes USING (match_id, bucket) GROUP BY 1, 2),
spans AS (SELECT match_id, unnest(range(1, max(bucket) + 1)) AS bucket FROM rows_ GROUP BY 1),
j AS (SELECT s.match_id, s.bucket, CASE WHEN r.bucket IS NOT NULL THEN struct_pack(blue := r.blue, red := r.red, hill := r.hill, nades := r.nades, stuns := r.stuns, """ + ", ".join(f"k{p} := r.k{p}" for p in range(1, 9)) + """) END AS r FROM spans s LEFT JOIN rows_ r USING (match_id, bucket)),
filled AS (SELECT match_id, bucket, r.* FROM (SELECT match_id, bucket, last_value(r IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS r FROM j)),
""" + _clean_sql("blue") + ", " + _clean_sql("red") + """,
hm AS (SELECT match_id, bucket, arg_max(hill, (n, hill)) AS hill FROM (SELECT a.match_id, a.bucket, o.hill, count(*) AS n FROM filled a JOIN filled o ON o.match_id = a.match_id AND o.bucket BETWEEN a.bucket - 2 AND a.bucket + 2 WHERE o.hill IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
scored AS (SELECT f.match_id, f.bucket * 10 AS timestamp, cb.score AS blue_score, cr.score AS red_score, hm.hill, f.nades, f.stuns, """ + ", ".join(f"f.k{p}" for p in range(1, 9)) + """
  FROM filled f JOIN clean_blue cb USING (match_id, bucket) JOIN clean_red cr USING (match_id, bucket) LEFT JOIN hm USING (match_id, bucket)),
finals AS (SELECT DISTINCT match_id, CASE match_id % 3 WHEN 0 THEN 250 WHEN 1 THEN 120 END AS final_blue, CASE match_id % 3 WHEN 0 THEN 190 ELSE 250 END AS final_red FROM filled),
f1 AS (SELECT s.*, f.final_blue, f.final_red, CASE WHEN final_blue = 250 THEN blue_score ELSE red_score END AS win, max(timestamp) OVER (PARTITION BY match_id) AS last FROM scored s LEFT JOIN finals f USING (match_id)),
f2 AS (SELECT *, coalesce(final_blue IS NOT NULL AND final_red IS NOT NULL AND (final_blue = 250 OR final_red = 250), false) AND NOT max(timestamp = last AND blue_score IS NOT DISTINCT FROM final_blue AND red_score IS NOT DISTINCT FROM final_red) OVER (PARTITION BY match_id) AS live,
  coalesce(max_by(timestamp, (win, timestamp)) FILTER (WHERE win < 250) OVER (PARTITION BY match_id), last) AS anchor FROM f1),
f3 AS (SELECT *, 0 AS new FROM f2 UNION ALL SELECT * REPLACE (final_blue AS blue_score, final_red AS red_score), 1 FROM f2 WHERE live AND timestamp = anchor),
f4 AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp, new) * 10 AS number FROM f3),
telemetry AS (SELECT match_id, CASE WHEN live THEN number ELSE timestamp END AS timestamp, CASE WHEN live AND final_blue <> 250 AND red_score = 250 THEN final_blue ELSE blue_score END AS blue_score,
  CASE WHEN live AND final_blue = 250 AND blue_score = 250 THEN final_red ELSE red_score END AS red_score, hill AS hill_number, nades AS nades_used_to_that_point, stuns AS stuns_used_to_that_point, """ + ", ".join(f'k{p} AS "{h}"' for p, h in zip(range(1, 9), HEADERS, strict=True)) + " FROM f4)"


@query("{obs}, " + TELEMETRY + " SELECT * FROM telemetry")
def match_telemetry(spark, d):
    """The finished series of a match: readings with scores carried on, each player's kills as of their time, buckets, gaps
    filled, both scores and the hill cleaned, and the row that the final score has to show."""
    o = observations(spark, d)
    base = o.filter("event_type <> 'purchase'").withColumn("red", F.when((F.col("event_type") != "error") & (F.col("k") % 3 != 0), F.floor(F.col("score") / 2) + F.col("k") % 4).cast("long"))
    base = base.select("match_id", "t", "event_id", "nades", "stuns", *(series.carried(F.col(c), KEY, ORDER).alias(n) for c, n in (("score", "blue"), ("red", "red"), ("hill", "hill"))))
    kills = o.filter("event_type = 'purchase' and killer <> victim")
    columns = [f"k{p}" for p, _ in PLAYERS]
    kills = kills.select("match_id", "t", "event_id", *(series.running_count(F.col("killer") == p, KEY, ORDER).alias(f"k{p}") for p, _ in PLAYERS))
    rows = asof.asof_backward(base, kills.withColumnRenamed("event_id", "kill_id"), KEY, "t", ["event_id"], ["kill_id"], columns)
    rows = rows.select(*base.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns))
    lasts = ["nades", "stuns", *columns]
    # as-of values follow time, so of a bucket's rows the last by time has them; rows of one time agree
    filled = series.gap_filled(series.bucketed(rows, KEY, "t", ORDER, ["blue", "red", "hill"], lasts, BUCKET), KEY, ["blue", "red", "hill", *lasts], BUCKET)
    clean = series.clean_scores(filled, KEY, ["bucket"], "blue")
    clean = series.clean_scores(clean, KEY, ["bucket"], "red").withColumn("hill", series.mode_smoothed("hill", KEY, ["bucket"]))
    s = clean.select("match_id", (F.col("bucket") * 10).alias("timestamp"), F.col("blue").cast("long").alias("blue_score"), F.col("red").cast("long").alias("red_score"), F.col("hill").alias("hill_number"),
                     F.col("nades").alias("nades_used_to_that_point"), F.col("stuns").alias("stuns_used_to_that_point"), *(F.col(f"k{p}").alias(h) for (p, _), h in zip(PLAYERS, HEADERS, strict=True)))
    m = F.col("match_id") % 3
    finals = s.select("match_id").distinct().select("match_id", F.when(m == 0, 250).when(m == 1, 120).cast("long").alias("final_blue"), F.when(m == 0, 190).otherwise(250).cast("long").alias("final_red"))
    return correct.forced_final_row(s, finals, KEY)


KILLS_BY_BUCKET = """b AS (SELECT match_id, killer, CAST(floor((greatest(1, t - min(t) OVER (PARTITION BY match_id) + 1) - 1) / {BUCKET}) + 1 AS BIGINT) AS bucket FROM obs),
n AS (SELECT match_id, bucket, p AS player_id, (SELECT count(*) FROM b k WHERE k.match_id = x.match_id AND k.killer = p AND k.bucket <= x.bucket) AS n FROM (SELECT DISTINCT match_id, bucket FROM b) x, range(1, 9) r(p))"""


@query("{obs}, " + KILLS_BY_BUCKET + " SELECT match_id, bucket * 10 AS timestamp, " + ", ".join(f'CAST(max(n) FILTER (WHERE player_id = {p}) AS BIGINT) AS "{("Player", f"Player_{p}")[p > 1]}"' for p in range(1, 9)) + " FROM n GROUP BY 1, 2")
def kills_over_time(spark, d):
    """The table of cumulative kills that is written as CSV: a column for each player, headers made unique."""
    o = series.bucket_number(observations(spark, d), KEY, "t", BUCKET).withColumn("timestamp", F.col("bucket") * 10)
    stamps = o.select("match_id", "timestamp").distinct()
    people = stamps.withColumn("player_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    per = o.groupBy("match_id", "timestamp", F.col("killer").alias("player_id")).agg(F.count(F.lit(1)).alias("one"))
    w = Window.partitionBy("match_id", "player_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kills = people.join(per, ["match_id", "timestamp", "player_id"], "left").withColumn("n", F.sum(F.coalesce("one", F.lit(0))).over(w))
    return sinks.telemetry_table(stamps, kills, KEY, [(p, "Player") for p in range(1, 9)])


@query("""WITH RECURSIVE x AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Jo' WHEN 1 THEN 'Jo_2' ELSE 'Al' END AS name, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS i, p_size FROM part),
r AS (SELECT p_brand, p_size, p_partkey, i, name AS header, [name] AS used FROM x WHERE i = 1
  UNION ALL SELECT p_brand, p_size, p_partkey, i, header, list_append(used, header) FROM (
    SELECT x.*, r.used, [c for c in list_concat([x.name], [x.name || '_' || n for n in range(2, len(r.used) + 3)]) if NOT list_contains(r.used, c)][1] AS header FROM r JOIN x ON x.p_brand = r.p_brand AND x.p_size = r.p_size AND x.i = r.i + 1))
SELECT p_partkey, header FROM r""")
def header_suffixes(spark, d):
    """Unique headers for the names of each group, also where a name looks like another's suffixed header."""
    k = F.col("p_partkey") % 3
    names = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.when(k == 0, "Jo").when(k == 1, "Jo_2").otherwise("Al").alias("name"))
    groups = names.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "name"))).alias("people"))
    headers = F.pandas_udf(lambda some: some.map(lambda names: text.header_names(list(names))), "array<string>")
    made = groups.select("people", headers(F.transform("people", lambda p: p["name"])).alias("headers"))
    return made.select(F.explode(F.zip_with("people", "headers", lambda p, h: F.struct(p["p_partkey"].alias("p_partkey"), h.alias("header")))).alias("x")).select("x.*")


@query("{obs}, " + KD + """, t AS (SELECT match_id, max(nades) AS n, max(stuns) AS s, count(*) FILTER (WHERE event_type = 'signup') AS p FROM obs GROUP BY 1)
SELECT match_id, '{"final_score":{"blue":250},"registry":' || CAST(to_json(list(struct_pack(player_id := player_id, name := name, team := team, kills := kills, deaths := deaths, kd := kd) ORDER BY player_id)) AS VARCHAR)
  || ',"kd":{' || string_agg('"' || player_id || '":' || kd, ',' ORDER BY player_id) || '},"kills":{' || string_agg('"' || player_id || '":' || kills, ',' ORDER BY player_id) || '},"deaths":{' || string_agg('"' || player_id || '":' || deaths, ',' ORDER BY player_id)
  || '},"utility":{"nades":' || any_value(n) || ',"stuns":' || any_value(s) || ',"specialties":' || any_value(p) || '}}' AS document FROM kd JOIN t USING (match_id) GROUP BY match_id""")
def summary_documents(spark, d):
    finals = roster(spark, d).select("match_id").distinct().select("match_id", F.lit(250).alias("json_blue"), F.lit(None).cast("int").alias("json_red"))
    return sinks.summary_json(_stats(spark, d), finals, _totals(spark, d), KEY)


def _report_sql() -> str:
    ranked = lambda c: f"coalesce(list('- ' || name || ': ' || st.{c} ORDER BY st.{c} DESC, lower(name), player_id) FILTER (WHERE st.{c} > 0), ['- none'])"
    counters = ", ".join(f"'{k}: ' || any_value(counters.{v})" for k, v in sinks.COUNTERS.items())
    return "{obs}, " + COUNTED + f""", pl AS (SELECT m.match_id, p.player_id, '[T]Player ' || p.player_id AS name FROM (SELECT DISTINCT match_id FROM obs) m, range(1, 9) p(player_id)),
st AS (SELECT pl.*, (SELECT count(*) FROM ev WHERE ev.match_id = pl.match_id AND killer = player_id) AS kills, (SELECT count(*) FROM ev WHERE ev.match_id = pl.match_id AND victim = player_id) AS deaths,
  (SELECT count(*) FILTER (WHERE lp = player_id) + count(*) FILTER (WHERE rp = player_id) FROM er WHERE er.match_id = pl.match_id) AS detections FROM pl),
t AS (SELECT match_id, count(*) AS frames, max(t) AS last_t, max(nades) AS n, max(stuns) AS s, count(*) FILTER (WHERE event_type = 'signup') AS p, arg_max(score, (t, event_id)) FILTER (WHERE score IS NOT NULL) AS blue FROM obs GROUP BY 1),
l AS (SELECT match_id, list_concat(['Validation Summary', 'Source: match ' || match_id, 'Last frame: ' || any_value(frames), 'Last timestamp: ' || any_value(last_t), '', 'Registered Players:'], list('- ' || name ORDER BY player_id),
  ['', 'Scoreboard Registration:', 'Visible: False', 'Registration complete: True', '', 'Killfeed Counts:', {counters}, 'Player detection counts:'], {ranked('detections')}, ['', 'Player Kills:'], {ranked('kills')}, ['', 'Player Deaths:'], {ranked('deaths')},
  ['', 'Utility Counts:', 'Grenade: ' || any_value(n), 'Stun: ' || any_value(s), 'Specialty equipment: ' || any_value(p), '', 'Hardpoint:', 'Blue score: ' || coalesce(CAST(any_value(blue) AS VARCHAR), 'None'), 'Red score: None', 'Current hill: None', '', 'OCR confidence: None', '', 'Module Status:', '- killfeed: active', '- utility: disabled']) AS lines
  FROM st JOIN t USING (match_id) JOIN counters USING (match_id) GROUP BY match_id)
SELECT match_id, unnest(range(1, len(lines) + 1)) AS line_number, unnest(lines) AS line FROM l"""


@query(_report_sql(), recursive=True)
def report_text(spark, d):
    """The whole text report, line by line."""
    from hillstream.operators import summary

    o, rows, events = observations(spark, d), _feed_rows(spark, d), _events(spark, d)
    w = F.struct("t", "event_id")
    facts = o.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.max("t").alias("last_t"), F.max_by(F.when(F.col("score").isNotNull(), F.col("score")), F.when(F.col("score").isNotNull(), w)).alias("blue"))
    facts = facts.join(threads.kill_counters(o, rows, events, KEY), "match_id").join(_totals(spark, d), "match_id")
    stats = summary.kills_deaths(events.filter("counted"), roster(spark, d), KEY).join(threads.player_detections(rows, KEY), [*KEY, "player_id"], "left").na.fill(0, ["detections"])
    none, text_ = F.lit(None), F.lit
    return sinks.report(stats, facts, KEY, {"Source": F.concat(F.lit("match "), F.col("match_id").cast("string")), "Last frame": F.col("frames"), "Last timestamp": F.col("last_t")},
                        {"Visible": text_("False"), "Registration complete": text_("True")}, {"Blue score": F.col("blue"), "Red score": none, "Current hill": none}, none, {"killfeed": text_("active"), "utility": text_("disabled")})


@query("{obs} SELECT match_id, unnest(['First pass complete.', 'Frames processed: ' || count(*), 'Players seen: ' || count(DISTINCT player_id)]) AS line, unnest([1, 2, 3]) AS line_number FROM obs GROUP BY 1")
def pass_summaries(spark, d):
    """What a pass prints when it ends."""
    facts = observations(spark, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("p"))
    lines = [F.lit("First pass complete."), F.concat(F.lit("Frames processed: "), F.col("n").cast("string")), F.concat(F.lit("Players seen: "), F.col("p").cast("string"))]
    return sinks.numbered(facts, KEY, F.array(*lines)).withColumn("line_number", F.col("line_number").cast("int"))


#: What the chart of equipment by hill calls its columns.
TRACES = {"nades_delta": "Grendades", "stuns_delta": "Tacticals", "specialties_delta": "Field Upgrade"}


@query("{obs}, x AS (SELECT match_id, hill, unnest(['Grendades', 'Tacticals']) AS trace, unnest([nades - lag(nades) {W}, stuns - lag(stuns) {W}]) AS used FROM obs) SELECT match_id, hill AS hill_number, trace, CAST(coalesce(sum(used), 0) AS BIGINT) AS used FROM x WHERE hill IS NOT NULL GROUP BY ALL")
def usage_traces(spark, d):
    """Equipment by hill as the chart's named traces."""
    from hillstream.operators import summary

    u = summary.usage_by_group(observations(spark, d).withColumnRenamed("hill", "hill_number"), KEY, ORDER, "hill_number", ["nades", "stuns"])
    long = u.unpivot(["match_id", "hill_number"], ["nades", "stuns"], "column", "used")
    return long.select("match_id", "hill_number", text.alias_lookup(F.concat("column", F.lit("_delta")), TRACES).alias("trace"), "used")


@query("""{obs}, b AS (SELECT match_id, event_id, t, nades FROM obs WHERE event_type = 'view') SELECT a.match_id, a.event_id, arg_max(b.event_id, (b.t, b.event_id)) AS kill_event, arg_max(b.nades, (b.t, b.event_id)) AS kills FROM b a JOIN b ON b.match_id = a.match_id AND b.t <= a.t GROUP BY ALL""")
def asof_self(spark, d):
    """Rows merged with themselves, as where no first pass is given."""
    b = observations(spark, d).filter("event_type = 'view'").select("match_id", "event_id", "t", "nades")
    other = b.select("match_id", "t", F.col("event_id").alias("kill_event"), F.col("nades").alias("kills"))
    return asof.asof_backward(b.select("match_id", "event_id", "t"), other, KEY, "t", ["event_id"], ["kill_event"], ["kill_event", "kills"]).select("match_id", "event_id", "kill_event", "kills")


@query("""SELECT l_orderkey, l_linenumber, CAST(least(x1, x2, x3) AS INTEGER) AS x, CAST(least(y1, y2, y3) AS INTEGER) AS y, CAST(greatest(x1, x2, x3) - least(x1, x2, x3) AS INTEGER) AS w, CAST(greatest(y1, y2, y3) - least(y1, y2, y3) AS INTEGER) AS h FROM (
  SELECT l_orderkey, l_linenumber, trunc(l_quantity + 0.7) AS x1, trunc(l_quantity * 1.5) AS x2, CAST(l_partkey % 60 AS DOUBLE) AS x3, trunc(l_linenumber * 2.5) AS y1, CAST(l_suppkey % 30 AS DOUBLE) AS y2, trunc(l_quantity / 3) AS y3 FROM lineitem)""")
def boxes_of_quads(spark, d):
    """Boxes around the points of a recogniser, cut to integers."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(point(q + 0.7, n * 2.5), point(q * 1.5, F.col("l_suppkey") % 30), point(F.col("l_partkey") % 60, q / 3))
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.box_of(quad).alias("b"))
    return b.select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.w", "b.h")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN CAST(20 + trunc(l_tax * 200) AS INTEGER) END AS x, CASE WHEN l_linenumber % 3 > 0 THEN CAST(10 + trunc(l_discount * 90) AS INTEGER) END AS y,
  CASE WHEN l_linenumber % 3 > 0 THEN CAST(trunc(l_discount * 200) AS INTEGER) END AS w, CASE WHEN l_linenumber % 3 > 0 THEN CAST(trunc(l_tax * 90) AS INTEGER) END AS h FROM lineitem""")
def regions_in_regions(spark, d):
    """Regions in parts of a parent box; a region that is not set gives none."""
    r = F.when(F.col("l_linenumber") % 3 > 0, F.struct(F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_discount").alias("w"), F.col("l_tax").alias("h")))
    parent = F.struct(F.lit(20).alias("x"), F.lit(10).alias("y"), F.lit(200).alias("w"), F.lit(90).alias("h"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.pixels(r, F.lit(640), F.lit(480), parent).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "p.x", "p.y", "p.w", "p.h")


@query("""{obs}, n AS (SELECT match_id, victim, count(*) AS n FROM obs GROUP BY 1, 2) SELECT match_id, '{' || string_agg('"' || victim || '":' || n, ',' ORDER BY victim) || '}' AS kills FROM n GROUP BY 1""")
def kill_maps(spark, d):
    """Counters by player as a map of text to whole numbers."""
    n = observations(spark, d).groupBy("match_id", "victim").agg(F.count(F.lit(1)).cast("double").alias("n"))
    kills = F.map_from_entries(F.array_sort(F.collect_list(F.struct("victim", "n"))))
    return n.groupBy("match_id").agg(kills.alias("k")).select("match_id", F.to_json(scores.whole_kills(F.col("k"))).alias("kills"))


@query("{obs}, " + BOXED + " SELECT id, variant = 'red' AND team = 'enemy' OR variant = 'blue' AND team = 'friendly' OR variant NOT IN ('red', 'blue') AS allowed FROM bx")
def variant_pools(spark, d):
    """Which names a view's texts are looked up among."""
    return _boxes(spark, d).select("id", resolve.variant_pool(F.col("variant"), F.col("team")).alias("allowed"))


@query("{obs}, " + BUCKETED % BUCKET + ", " + FILLED % BUCKET + ", " + SCORED + " SELECT match_id, 'match_' || match_id || '_' || CASE WHEN match_id % 2 = 0 THEN '20240101_000000' ELSE '20240102_123000' END AS run_id, count(*) AS n FROM scored GROUP BY match_id")
def run_folders(spark, d):
    """The folder of each match's run: the recording's name, spaces as underscores, and when the run began."""
    m = F.col("match_id")
    began = F.when(m % 2 == 0, F.lit("2024-01-01 00:00:00")).otherwise("2024-01-02 12:30:00").cast("timestamp_ntz")
    n = _scored(spark, d)[0].groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("match_id", sinks.run_id(F.concat(F.lit("/videos/match "), m.cast("string"), F.lit(".mkv")), began).alias("run_id"), "n")
