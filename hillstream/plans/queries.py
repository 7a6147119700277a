"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hillstream.functions import geometry, scores, text
from hillstream.operators import asof, correct, folds, resolve, series, states, summary, threads
from hillstream.plans import sinks
from hillstream.sources.tables import observations, roster, table
from hillstream.streaming.keyed import latest_state

KEY, ORDER = ["match_id"], ["t", "event_id"]
BUCKET = 21600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = """e AS (
  SELECT user_id % 10 + 10 * (user_id // 100) AS match_id, user_id % 8 + 1 AS player_id, event_id, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS t,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, value FROM events
), obs AS (
  SELECT *, CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS BIGINT) AS state01,
         event_type IN ('click', 'view') AS active,
         CAST(CASE WHEN event_type <> 'error' THEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w + CASE WHEN k < 10 THEN k % 7 ELSE 0 END END AS BIGINT) AS score,
         k % 5 + 1 AS hill, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nades,
         CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS stuns, player_id AS killer, k % 8 + 1 AS victim
  FROM e WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
)"""
ALONG = "OVER (PARTITION BY match_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
W = "OVER (PARTITION BY match_id ORDER BY t, event_id)"


def query(sql: str | None = None, recursive: bool = False):
    """Register a query by its name; ``{obs}`` in the SQL stands for the readings."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.replace("{ALONG}", ALONG).replace("{W}", W).replace("{BUCKET}", str(BUCKET))
            SQL[f.__name__] = body.replace("{obs}", f"WITH {'RECURSIVE ' * recursive}{OBS}")
        return f

    return add


@query("""{obs}, d AS (SELECT match_id, hill, nades - lag(nades) {W} AS nades, stuns - lag(stuns) {W} AS stuns FROM obs)
SELECT match_id, hill, CAST(coalesce(sum(nades), 0) AS BIGINT) AS nades, CAST(coalesce(sum(stuns), 0) AS BIGINT) AS stuns FROM d WHERE hill IS NOT NULL GROUP BY 1, 2""")
def usage_by_group(spark, d):
    return summary.usage_by_group(observations(spark, d), KEY, ORDER, "hill", ["nades", "stuns"])


@query("""{obs}, r AS (
  SELECT match_id, event_id, t FROM obs QUALIFY row_number() {W} = 1
  UNION ALL
  (SELECT o.match_id, o.event_id, o.t FROM r JOIN obs o ON o.match_id = r.match_id AND o.t >= r.t + {BUCKET} QUALIFY row_number() OVER (PARTITION BY o.match_id ORDER BY o.t, o.event_id) = 1)
) SELECT * FROM r""", recursive=True)
def throttle_min_gap(spark, d):
    return folds.throttled(observations(spark, d).select("match_id", "event_id", "t"), KEY, "t", ORDER, 1 / BUCKET)


@query("""{obs}, n AS (SELECT match_id, event_id, row_number() {W} - 1 AS frame_index FROM obs)
SELECT * FROM n WHERE frame_index >= 45 AND frame_index % 8 = 0""")
def sample_every_nth(spark, d):
    return series.every_nth(observations(spark, d).select("match_id", "event_id", "t"), KEY, ORDER, 30.0, 4.0, 1.5).select("match_id", "event_id", "frame_index")


BUCKETED = """b AS (SELECT *, CAST(floor((greatest(1, t - min(t) OVER (PARTITION BY match_id) + 1) - 1) / %d) + 1 AS BIGINT) AS bucket FROM obs),
m AS (SELECT match_id, bucket, arg_max(nades, (t, event_id)) AS nades, arg_max(stuns, (t, event_id)) AS stuns FROM b GROUP BY 1, 2),
s AS (SELECT match_id, bucket, arg_max(score, (n, score)) AS score FROM (SELECT match_id, bucket, score, count(*) AS n FROM b WHERE score IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT match_id, bucket, arg_max(hill, (n, hill)) AS hill FROM (SELECT match_id, bucket, hill, count(*) AS n FROM b WHERE hill IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
bucketed AS (SELECT match_id, bucket, score, hill, nades, stuns FROM m LEFT JOIN s USING (match_id, bucket) LEFT JOIN h USING (match_id, bucket))"""


def _bucketed(spark, d, seconds=BUCKET):
    return series.bucketed(observations(spark, d), KEY, "t", ORDER, ["score", "hill"], ["nades", "stuns"], seconds)


@query("{obs}, " + BUCKETED % BUCKET + " SELECT * FROM bucketed")
def bucket_mode_last(spark, d):
    return _bucketed(spark, d)


FILLED = """spans AS (SELECT match_id, unnest(range(1, max(bucket) + 1)) AS bucket FROM bucketed GROUP BY 1),
j AS (SELECT s.match_id, s.bucket, CASE WHEN b.bucket IS NOT NULL THEN struct_pack(score := b.score, hill := b.hill, nades := b.nades, stuns := b.stuns) END AS r FROM spans s LEFT JOIN bucketed b USING (match_id, bucket)),
k AS (SELECT match_id, bucket, last_value(r IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS r FROM j),
filled AS (SELECT match_id, bucket, bucket * %d AS timestamp, r.score AS score, r.hill AS hill, r.nades AS nades, r.stuns AS stuns FROM k)"""


def _filled(spark, d, seconds=BUCKET):
    return series.gap_filled(_bucketed(spark, d, seconds), KEY, ["score", "hill", "nades", "stuns"], seconds)


@query("{obs}, " + BUCKETED % 1800 + ", " + FILLED % 1800 + " SELECT * FROM filled")
def gap_filled_series(spark, d):
    return _filled(spark, d, 1800)


@query("{obs} SELECT match_id, event_id, last_value(score IGNORE NULLS) {ALONG} AS score FROM obs")
def locf(spark, d):
    return observations(spark, d).select("match_id", "event_id", series.carried(F.col("score"), KEY, ORDER).alias("score"))


@query("{obs} SELECT match_id, event_id, max(score) {ALONG} AS score FROM obs")
def running_max(spark, d):
    return observations(spark, d).select("match_id", "event_id", series.running_max(F.col("score"), KEY, ORDER).alias("score"))


@query("{obs} SELECT match_id, event_id, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) {ALONG} AS BIGINT) AS active_so_far, CAST(sum(CASE WHEN k < 10 THEN 1 ELSE 0 END) {ALONG} AS BIGINT) AS spikes_so_far FROM obs")
def prefix_counts(spark, d):
    o = observations(spark, d)
    return o.select("match_id", "event_id", series.running_count(F.col("active"), KEY, ORDER).alias("active_so_far"), series.running_count(F.col("k") < 10, KEY, ORDER).alias("spikes_so_far"))


@query("{obs} SELECT match_id, event_id, k - lag(k) {W} AS step FROM obs")
def difference(spark, d):
    return observations(spark, d).select("match_id", "event_id", series.difference(F.col("k"), KEY, ORDER).alias("step"))


@query("""{obs}, base AS (SELECT match_id, event_id, t FROM obs WHERE event_type = 'view'), other AS (SELECT match_id, t, event_id AS kill_event, stuns AS kills FROM obs WHERE event_type = 'purchase'),
x AS (SELECT b.match_id, b.event_id, b.t, o.kill_event, o.kills FROM base b LEFT JOIN other o ON o.match_id = b.match_id AND o.t <= b.t QUALIFY row_number() OVER (PARTITION BY b.match_id, b.event_id ORDER BY o.t DESC NULLS LAST, o.kill_event DESC) = 1)
SELECT match_id, event_id, t, kill_event, coalesce(kills, 0) AS kills FROM x""")
def asof_backward(spark, d):
    o = observations(spark, d)
    base = o.filter("event_type = 'view'").select("match_id", "event_id", "t")
    other = o.filter("event_type = 'purchase'").select("match_id", "t", F.col("event_id").alias("kill_event"), F.col("stuns").alias("kills"))
    return asof.asof_backward(base, other, KEY, "t", ["event_id"], ["kill_event"], ["kill_event", "kills"]).withColumn("kills", F.coalesce("kills", F.lit(0)).cast("long"))


RUNS = """v0 AS (SELECT match_id, t, event_id, {c} AS v FROM {src}),
v1 AS (SELECT *, CASE WHEN row_number() {W} > 1 AND lag(v) {W} IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS new FROM v0),
v2 AS (SELECT *, sum(new) {ALONG} AS run FROM v1),
runs AS (SELECT match_id, run, any_value(v) AS v, count(*) AS n FROM v2 GROUP BY 1, 2)"""
COARSE = "CASE WHEN k >= 90 THEN NULL ELSE k // 30 END"


def _coarse(spark, d):
    return observations(spark, d).select("match_id", "t", "event_id", F.when(F.col("k") < 90, F.floor(F.col("k") / 30)).cast("long").alias("v"))


@query("{obs}, " + RUNS.replace("{c}", COARSE).replace("{src}", "obs") + """,
x AS (SELECT match_id, run, CASE WHEN n <= 2 AND lead(n) OVER r >= 2 AND abs(lead(v) OVER r - v) <= 1 THEN lead(v) OVER r ELSE v END AS v FROM runs WINDOW r AS (PARTITION BY match_id ORDER BY run))
SELECT v2.match_id, v2.t, v2.event_id, x.v FROM v2 JOIN x USING (match_id, run)""")
def short_run_replace(spark, d):
    return series.short_runs_replaced(_coarse(spark, d), KEY, ORDER, "v", 2, 2, 1)


@query("{obs}, " + RUNS.replace("{c}", COARSE).replace("{src}", "obs") + """,
x AS (SELECT match_id, run, CASE WHEN v - lead(v) OVER r BETWEEN 1 AND 2 AND lead(v, 2) OVER r - lead(v) OVER r BETWEEN 0 AND 1 AND lead(v, 3) OVER r - lead(v, 2) OVER r BETWEEN 0 AND 1 THEN lead(v) OVER r ELSE v END AS v
      FROM runs WINDOW r AS (PARTITION BY match_id ORDER BY run))
SELECT v2.match_id, v2.t, v2.event_id, x.v FROM v2 JOIN x USING (match_id, run)""")
def high_run_lower(spark, d):
    return series.high_runs_lowered(_coarse(spark, d), KEY, ORDER, "v", 3, 1, 2)


@query("""{obs}, n AS (SELECT match_id, event_id, hill, row_number() {W} AS i FROM obs),
c AS (SELECT a.match_id, a.event_id, b.hill, count(*) AS n FROM n a JOIN n b ON a.match_id = b.match_id AND b.i BETWEEN a.i - 2 AND a.i + 2 WHERE b.hill IS NOT NULL GROUP BY 1, 2, 3)
SELECT match_id, event_id, arg_max(hill, (n, hill)) AS hill FROM c GROUP BY 1, 2""")
def mode_smooth(spark, d):
    return observations(spark, d).select("match_id", "event_id", series.mode_smoothed("hill", KEY, ORDER).alias("hill"))


CLUSTERS = """i0 AS (SELECT match_id, t, event_id, v, row_number() {W} AS i FROM {src}),
i1 AS (SELECT a.match_id, a.i, a.v AS own, b.v FROM i0 a JOIN i0 b ON a.match_id = b.match_id AND b.i BETWEEN a.i - 4 AND a.i + 4 WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
i2 AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY match_id, i ORDER BY v) > 2 THEN 1 ELSE 0 END AS gap FROM i1),
i3 AS (SELECT *, sum(gap) OVER (PARTITION BY match_id, i ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM i2),
i4 AS (SELECT match_id, i, cluster, any_value(own) AS own, count(*) AS n, CAST(round_even(avg(v), 0) AS BIGINT) AS mean FROM i3 GROUP BY 1, 2, 3),
i5 AS (SELECT match_id, i, max(n) AS n, arg_max(mean, (n, -abs(mean - own), -cluster)) AS mean FROM i4 GROUP BY 1, 2),
i6 AS (SELECT i0.match_id, t, event_id, i, CASE WHEN v IS NULL THEN NULL WHEN i5.n < 2 THEN v ELSE mean END AS v FROM i0 LEFT JOIN i5 USING (match_id, i)),
clustered AS (SELECT match_id, t, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM i6)"""


@query("{obs}, src AS (SELECT match_id, t, event_id, score AS v FROM obs), " + CLUSTERS.replace("{src}", "src") + " SELECT * FROM clustered")
def cluster_consensus(spark, d):
    o = observations(spark, d).select("match_id", "t", "event_id", F.col("score").alias("v"))
    return series.cluster_consensus(o, KEY, ORDER, "v")


@query("{obs}, " + BUCKETED % BUCKET + ", " + FILLED % BUCKET + ", raw AS (SELECT match_id, bucket AS t, bucket AS event_id, score FROM filled), " + RUNS.replace("{c}", "score").replace("{src}", "raw") + """,
s1 AS (SELECT match_id, run, CASE WHEN n <= 4 AND lead(n) OVER r >= 6 AND abs(lead(v) OVER r - v) <= 20 THEN lead(v) OVER r ELSE v END AS v FROM runs WINDOW r AS (PARTITION BY match_id ORDER BY run)),
s2 AS (SELECT v2.match_id, v2.t, v2.event_id, s1.v FROM v2 JOIN s1 USING (match_id, run)), """ + CLUSTERS.replace("{src}", "s2") + ", "
       + RUNS.replace("{c}", "v").replace("{src}", "clustered").replace("v0", "w0").replace("v1", "w1").replace("v2", "w2").replace("runs", "wruns") + """,
s3 AS (SELECT match_id, run, CASE WHEN v - lead(v) OVER r BETWEEN 1 AND 25 AND lead(v, 2) OVER r - lead(v) OVER r BETWEEN 0 AND 6 AND lead(v, 3) OVER r - lead(v, 2) OVER r BETWEEN 0 AND 6 THEN lead(v) OVER r ELSE v END AS v
       FROM wruns WINDOW r AS (PARTITION BY match_id ORDER BY run)),
s4 AS (SELECT w2.match_id, w2.t, w2.event_id, s3.v FROM w2 JOIN s3 USING (match_id, run))
SELECT match_id, t AS bucket, max(v) {ALONG} AS score FROM s4""")
def clean_score_series(spark, d):
    f = _filled(spark, d).select("match_id", "bucket", "score")
    return series.clean_scores(f, KEY, ["bucket"], "score").select("match_id", "bucket", F.col("score").cast("long").alias("score"))


SCORED = """scored AS (SELECT match_id, bucket * 10 AS timestamp, CASE WHEN match_id % 3 = 1 THEN least(245, 2 * bucket) ELSE least(248 + 2 * (match_id % 2), 3 * bucket + match_id) END AS blue_score,
  CASE WHEN match_id % 3 = 1 THEN least(246 + match_id, 3 * bucket) ELSE 2 * bucket END AS red_score, nades FROM filled),
finals AS (SELECT DISTINCT match_id, CAST(CASE match_id % 3 WHEN 0 THEN 250 WHEN 1 THEN 200 END AS BIGINT) AS final_blue, CAST(CASE match_id % 3 WHEN 0 THEN 190 WHEN 1 THEN 250 ELSE 250 END AS BIGINT) AS final_red FROM filled)"""


def _scored(spark, d):
    f, m, b = _filled(spark, d), F.col("match_id"), F.col("bucket")
    blue = F.when(m % 3 == 1, F.least(F.lit(245), 2 * b)).otherwise(F.least(248 + 2 * (m % 2), 3 * b + m))
    red = F.when(m % 3 == 1, F.least(246 + m, 3 * b)).otherwise(2 * b)
    s = f.select("match_id", (b * 10).alias("timestamp"), blue.cast("long").alias("blue_score"), red.cast("long").alias("red_score"), "nades")
    finals = f.select("match_id").distinct().select("match_id", F.when(m % 3 == 0, 250).when(m % 3 == 1, 200).cast("long").alias("final_blue"),
                                                    F.when(m % 3 == 0, 190).otherwise(250).cast("long").alias("final_red"))
    return s, finals


@query("{obs}, " + BUCKETED % BUCKET + ", " + FILLED % BUCKET + ", " + SCORED + """,
f1 AS (SELECT s.*, f.final_blue, f.final_red, CASE WHEN final_blue = 250 THEN blue_score ELSE red_score END AS win, max(timestamp) OVER (PARTITION BY match_id) AS last FROM scored s LEFT JOIN finals f USING (match_id)),
f2 AS (SELECT *, coalesce(final_blue IS NOT NULL AND final_red IS NOT NULL AND (final_blue = 250 OR final_red = 250), false) AND NOT max(timestamp = last AND blue_score IS NOT DISTINCT FROM final_blue AND red_score IS NOT DISTINCT FROM final_red) OVER (PARTITION BY match_id) AS live,
  coalesce(max_by(timestamp, (win, timestamp)) FILTER (WHERE win < 250) OVER (PARTITION BY match_id), last) AS anchor FROM f1),
f3 AS (SELECT match_id, timestamp, 0 AS new, blue_score, red_score, nades, final_blue, final_red, live FROM f2 UNION ALL SELECT match_id, timestamp, 1, final_blue, final_red, nades, final_blue, final_red, live FROM f2 WHERE live AND timestamp = anchor),
f4 AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp, new) * 10 AS number FROM f3)
SELECT match_id, CASE WHEN live THEN number ELSE timestamp END AS timestamp, CASE WHEN live AND final_blue <> 250 AND red_score = 250 THEN final_blue ELSE blue_score END AS blue_score,
  CASE WHEN live AND final_blue = 250 AND blue_score = 250 THEN final_red ELSE red_score END AS red_score, nades FROM f4""")
def forced_final_row(spark, d):
    return correct.forced_final_row(*_scored(spark, d), KEY)


@query("{obs}, " + BUCKETED % BUCKET + ", " + FILLED % BUCKET + ", " + SCORED + """,
l AS (SELECT match_id, arg_max(struct_pack(b := blue_score, r := red_score), timestamp) AS s FROM scored WHERE blue_score IS NOT NULL OR red_score IS NOT NULL GROUP BY 1)
SELECT f.match_id, CASE WHEN final_blue IS NOT NULL AND final_red IS NOT NULL AND (final_blue = 250 OR final_red = 250) THEN final_blue WHEN l.s IS NOT NULL THEN l.s.b ELSE 1 END AS csv_blue,
  CASE WHEN final_blue IS NOT NULL AND final_red IS NOT NULL AND (final_blue = 250 OR final_red = 250) THEN final_red WHEN l.s IS NOT NULL THEN l.s.r ELSE 2 END AS csv_red,
  coalesce(final_blue, 1) AS json_blue, coalesce(final_red, 2) AS json_red FROM finals f LEFT JOIN l USING (match_id)""")
def final_score_resolve(spark, d):
    s, finals = _scored(spark, d)
    board = finals.select("match_id", F.col("final_blue").alias("blue"), F.col("final_red").alias("red"))
    snapshot = finals.select("match_id", F.lit(1).cast("long").alias("blue"), F.lit(2).cast("long").alias("red"))
    return correct.final_scores(board, s, snapshot, KEY, ["timestamp"])


DEBOUNCED = """d0 AS (SELECT *, CASE WHEN state01 = lag(state01) {W} THEN state01 END AS twice FROM obs), d1 AS (SELECT *, last_value(twice IGNORE NULLS) {ALONG} AS accepted FROM d0)"""


@query("{obs}, " + DEBOUNCED + " SELECT match_id, event_id, accepted FROM d1")
def debounce(spark, d):
    return observations(spark, d).select("match_id", "event_id", states.debounced("state01", KEY, ORDER).alias("accepted"))


@query("{obs}, " + DEBOUNCED + """, d2 AS (SELECT *, CASE WHEN accepted = 1 AND lag(accepted) {W} IS DISTINCT FROM 1 THEN 1 ELSE 0 END AS starts FROM d1)
SELECT match_id, event_id, greatest(0, CAST(sum(starts) {ALONG} AS BIGINT) - 1) AS uses FROM d2""")
def cycle_count(spark, d):
    return states.cycle_counts(observations(spark, d), "state01", KEY, ORDER).select("match_id", "event_id", "uses")


@query("""{obs}, c AS (SELECT *, CASE WHEN lag(active) {W} IS NOT DISTINCT FROM active THEN 0 ELSE 1 END AS chg FROM obs), i AS (SELECT *, sum(chg) {ALONG} AS island FROM c),
g AS (SELECT *, t - min(t) OVER (PARTITION BY match_id, island) AS gone, row_number() OVER (PARTITION BY match_id, island ORDER BY t, event_id) AS len FROM i),
l AS (SELECT *, NOT active AND gone >= 12000 AND coalesce(lag(gone) OVER (PARTITION BY match_id, island ORDER BY t, event_id) < 12000, true) AS late FROM g),
a AS (SELECT *, last_value(CASE WHEN active AND len = 2 THEN true WHEN late THEN false END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed FROM l)
SELECT match_id, event_id, CAST(sum(CASE WHEN late AND coalesce(armed, false) THEN 1 ELSE 0 END) {ALONG} AS BIGINT) AS uses FROM a""")
def absence_count(spark, d):
    return states.absence_counts(observations(spark, d), "active", "t", KEY, ORDER, 12000).select("match_id", "event_id", "uses")


@query("""{obs}, r AS (
  SELECT match_id, victim, event_id, t FROM obs QUALIFY row_number() OVER (PARTITION BY match_id, victim ORDER BY t, event_id) = 1
  UNION ALL
  (SELECT o.match_id, o.victim, o.event_id, o.t FROM r JOIN obs o ON o.match_id = r.match_id AND o.victim = r.victim AND o.t >= r.t + 90000 QUALIFY row_number() OVER (PARTITION BY o.match_id, o.victim ORDER BY o.t, o.event_id) = 1)
) SELECT o.match_id, o.victim, o.event_id, r.event_id IS NOT NULL AS counted FROM obs o LEFT JOIN r ON r.event_id = o.event_id""", recursive=True)
def cooldown_filter(spark, d):
    o = observations(spark, d).select("match_id", "victim", "event_id", "t")
    return folds.cooled_down(o, ["match_id", "victim"], "t", ORDER, 90000).select("match_id", "victim", "event_id", "counted")


@query("""{obs}, n AS (SELECT match_id, event_id, k AS v, row_number() {W} AS i FROM obs), r AS (
  SELECT match_id, event_id, i, v IS NOT NULL AS accepted, v AS last FROM n WHERE i = 1
  UNION ALL
  SELECT n.match_id, n.event_id, n.i, n.v IS NOT NULL AND (r.last IS NULL OR abs(n.v - r.last) < 15), CASE WHEN n.v IS NOT NULL AND (r.last IS NULL OR abs(n.v - r.last) < 15) THEN n.v ELSE r.last END
  FROM r JOIN n ON n.match_id = r.match_id AND n.i = r.i + 1
) SELECT match_id, event_id, accepted FROM r""", recursive=True)
def delta_gate(spark, d):
    o = observations(spark, d).select("match_id", "event_id", "t", "k")
    return folds.delta_gated(o, KEY, "k", ORDER).select("match_id", "event_id", "accepted")


KD = """kills AS (SELECT match_id, killer, victim FROM obs WHERE event_type = 'purchase' AND killer <> victim),
players AS (SELECT m.match_id, p.player_id, '[T]Player ' || p.player_id AS name, CASE WHEN p.player_id <= 4 THEN 'ally' ELSE 'enemy' END AS team FROM (SELECT DISTINCT match_id FROM obs) m, range(1, 9) p(player_id)),
stats AS (SELECT p.match_id, p.player_id, p.name, p.team, (SELECT count(*) FROM kills k WHERE k.match_id = p.match_id AND k.killer = p.player_id) AS kills, (SELECT count(*) FROM kills k WHERE k.match_id = p.match_id AND k.victim = p.player_id) AS deaths FROM players p),
kd AS (SELECT *, round(CASE WHEN deaths = 0 THEN CAST(kills AS DOUBLE) ELSE kills / deaths END, 2) AS kd FROM stats)"""


def _stats(spark, d):
    e = observations(spark, d).filter("event_type = 'purchase' and killer <> victim").select("match_id", "killer", "victim")
    return summary.kills_deaths(e, roster(spark, d), KEY)


def _totals(spark, d):
    return observations(spark, d).groupBy("match_id").agg(F.max("nades").alias("nades"), F.max("stuns").alias("stuns"), F.count_if(F.col("event_type") == "signup").alias("specialties"))


@query("{obs}, " + KD + " SELECT match_id, player_id, name, team, kills, deaths, kd FROM kd")
def kd_summary(spark, d):
    return _stats(spark, d)


@query("{obs}, " + KD + """ SELECT match_id, player_id, team, kills, CAST(sum(kills) OVER w AS BIGINT) AS team_kills, CAST(sum(deaths) OVER w AS BIGINT) AS team_deaths,
  round(CAST(sum(CAST(kd AS DECIMAL(18, 2))) OVER w AS DOUBLE), 2) AS team_kd_sum, CAST(sum(kills) OVER w AS BIGINT) - kills AS remaining FROM kd WINDOW w AS (PARTITION BY match_id, team)""")
def team_share(spark, d):
    return summary.team_share(_stats(spark, d), KEY).select("match_id", "player_id", "team", "kills", "team_kills", "team_deaths", "team_kd_sum", "remaining")


WIDE = "{obs}, " + KD + """, tot AS (SELECT match_id, max(nades) AS nades, max(stuns) AS stuns, count(*) FILTER (WHERE event_type = 'signup') AS specialties FROM obs GROUP BY 1),
rows_ AS (SELECT match_id, player_id, unnest(['team', 'kd', 'total_kills', 'total_deaths']) AS metric, unnest([team, printf('%.2f', kd), CAST(kills AS VARCHAR), CAST(deaths AS VARCHAR)]) AS v FROM kd),
whole AS (SELECT k.match_id, CAST(sum(kills) AS BIGINT) AS k, CAST(sum(deaths) AS BIGINT) AS d, any_value(nades) AS n, any_value(stuns) AS s, any_value(specialties) AS p FROM kd k JOIN tot USING (match_id) GROUP BY 1),
alls AS (SELECT match_id, unnest(['team', 'kd', 'total_kills', 'total_deaths', 'total_nades_used', 'total_stuns_used', 'total_specialties_used']) AS metric, unnest(['', '', CAST(k AS VARCHAR), CAST(d AS VARCHAR), CAST(n AS VARCHAR), CAST(s AS VARCHAR), CAST(p AS VARCHAR)]) AS all_match FROM whole),
wide AS (SELECT a.match_id, a.metric, """ + ", ".join(f"coalesce(max(v) FILTER (WHERE player_id = {p}), '') AS p{p}" for p in range(1, 9)) + """, a.all_match FROM alls a LEFT JOIN rows_ r USING (match_id, metric) GROUP BY a.match_id, a.metric, a.all_match)"""


def _wide(spark, d):
    return summary.summary_wide(_stats(spark, d), _totals(spark, d), KEY, list(range(1, 9)))


@query(WIDE + " SELECT * FROM wide")
def match_summary_wide(spark, d):
    return _wide(spark, d)


@query("{obs}, " + KD + " SELECT match_id, 'p' || player_id AS player, team, kd, CAST(kills AS DOUBLE) AS total_kills, CAST(deaths AS DOUBLE) AS total_deaths FROM kd")
def summary_transposed(spark, d):
    return summary.long_form(_wide(spark, d), KEY, list(range(1, 9)))


@query(WIDE + " SELECT match_id, p3 AS kd FROM wide WHERE metric = 'kd'")
def player_card(spark, d):
    return _wide(spark, d).filter("metric = 'kd'").select("match_id", F.col("p3").alias("kd"))


@query(WIDE + " SELECT match_id, metric, CAST(all_match AS BIGINT) AS total FROM wide WHERE metric IN ('total_nades_used', 'total_stuns_used', 'total_specialties_used')")
def utility_totals(spark, d):
    return _wide(spark, d).filter(F.col("metric").isin(*summary.METRICS[4:])).select("match_id", "metric", F.col("all_match").cast("long").alias("total"))


@query("{obs}, " + BUCKETED % BUCKET + ", " + FILLED % BUCKET + ", " + SCORED + " SELECT match_id, timestamp, blue_score, red_score FROM scored")
def score_over_time(spark, d):
    return _scored(spark, d)[0].select("match_id", "timestamp", "blue_score", "red_score")


@query("{obs}, " + KD + """, r AS (SELECT match_id, team, row_number() OVER (PARTITION BY match_id, team ORDER BY kills DESC, lower(name), player_id) AS place, printf('- %s: %d kills, %d deaths', name, kills, deaths) AS line FROM kd) SELECT * FROM r""")
def report_lines(spark, d):
    return sinks.report_lines(_stats(spark, d), KEY)


@query("""{obs} SELECT match_id, arg_max(score, (t, event_id)) FILTER (WHERE score IS NOT NULL) AS score, arg_max(event_id, (t, event_id)) AS event_id, max(t) AS t FROM obs GROUP BY 1""")
def latest_reading(spark, d):
    o = observations(spark, d).withColumn("score", series.carried(F.col("score"), KEY, ORDER))
    return latest_state(o, KEY, ORDER, ["score", "event_id", "t"])


@query(r"""SELECT c_custkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(raw, '\[[^\]]*\]', '', 'g'), '[\[\]]', '', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(raw, '[\[\]]', '', 'g')), ''), trim(raw)) AS player,
  regexp_replace(raw, '[^\p{L}\p{N}_\-\[\]]', '', 'g') AS ocr, regexp_replace(lower(raw), '[^\p{L}\p{N}]', '', 'g') AS feed_key, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS roster_key,
  regexp_replace(raw, '[^A-Za-z0-9_\-\[\]]', '', 'g') AS display, nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') AS digits
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[' || c_mktsegment || ']' WHEN 1 THEN '[' || left(c_mktsegment, 3) || ']' || c_name ELSE ' ' || c_name || '  [x É] -' || CAST(c_nationkey AS VARCHAR) END AS raw FROM customer)""")
def name_clean(spark, d):
    c, m = table(spark, d, "customer"), F.col("c_custkey") % 4
    raw = (F.when(m == 0, F.concat(F.lit("["), "c_mktsegment", F.lit("]"))).when(m == 1, F.concat(F.lit("["), F.left("c_mktsegment", F.lit(3)), F.lit("]"), "c_name"))
           .otherwise(F.concat(F.lit(" "), "c_name", F.lit("  [x É] -"), F.col("c_nationkey").cast("string"))))
    return c.select("c_custkey", text.player_name(raw).alias("player"), text.ocr_text(raw).alias("ocr"), text.match_key(raw).alias("feed_key"), text.ascii_key(raw).alias("roster_key"),
                    text.display_name(raw).alias("display"), text.digits_only(raw).alias("digits"))


GRAMS = "list_distinct([substring({x}, CAST(i AS BIGINT), {n}) for i in range(1, length({x}) - {n} + 2)])"


def _dice_sql(a: str, b: str, n: int) -> str:
    x, y = GRAMS.format(x=a, n=n), GRAMS.format(x=b, n=n)
    return f"CASE WHEN length({a}) < {n} OR length({b}) < {n} THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


@query(f"""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, lead(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, round(CAST({_dice_sql('a', 'b', 2)} AS DOUBLE), 6) AS dice2, round(CAST({_dice_sql('a', 'b', 3)} AS DOUBLE), 6) AS dice3,
  round(CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b), 1), 6) AS length_ratio FROM p WHERE b IS NOT NULL""")
def ngram_dice(spark, d):
    a = text.ascii_key(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", a.alias("a"), F.lead(a).over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).filter("b is not null")
    r = lambda c: F.round(c, 6)
    return p.select("p_partkey", r(text.dice(F.col("a"), F.col("b"), 2)).alias("dice2"), r(text.dice(F.col("a"), F.col("b"), 3)).alias("dice3"), r(text.length_ratio(F.col("a"), F.col("b"))).alias("length_ratio"))


BOXES = """bx AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 90 AS INTEGER) AS ax, CAST(l_suppkey % 40 AS INTEGER) AS ay, CAST(l_quantity AS INTEGER) AS aw, 20 AS ah, CAST(l_orderkey % 90 AS INTEGER) AS bx, CAST(l_partkey % 40 AS INTEGER) AS by_, CAST(l_quantity AS INTEGER) // 2 AS bw, 25 AS bh FROM lineitem),
ov AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS i FROM bx)"""


@query("WITH " + BOXES + """ SELECT l_orderkey, l_linenumber, round(CAST(i AS DOUBLE) / greatest(1, greatest(1, aw * ah) + greatest(1, bw * bh) - i), 6) AS iou,
  abs(ax + aw / 2.0 - bx - bw / 2.0) + abs(ay + ah / 2.0 - by_ - bh / 2.0) <= 40 AND abs(aw - bw) + abs(ah - bh) <= 35 AS alike FROM ov""")
def box_iou(spark, d):
    q = F.col("l_quantity").cast("int")
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), F.lit(h).alias("h"))
    li = table(spark, d, "lineitem")
    a, b = box(F.col("l_partkey") % 90, F.col("l_suppkey") % 40, q, 20), box(F.col("l_orderkey") % 90, F.col("l_partkey") % 40, F.floor(q / 2), 25)
    x = li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return x.select("l_orderkey", "l_linenumber", F.round(geometry.overlap(F.col("a"), F.col("b")), 6).alias("iou"), geometry.alike(F.col("a"), F.col("b")).alias("alike"))


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_tax * 640) AS INTEGER) AS x, CAST(trunc(l_discount * 480) AS INTEGER) AS y, CAST(trunc(l_discount * 640) AS INTEGER) AS w, CAST(trunc(l_tax * 480) AS INTEGER) AS h FROM lineitem")
def region_pixels(spark, d):
    r = F.struct(F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_discount").alias("w"), F.col("l_tax").alias("h"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.pixels(r, F.lit(640), F.lit(480)).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "p.x", "p.y", "p.w", "p.h")


def _boxes(spark, d):
    """Detections in frames of four hours, made from the readings."""
    o = observations(spark, d)
    return o.select("match_id", F.floor(F.col("t") / 14400).cast("long").alias("frame"), F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, ("grayscale", "red", "blue", "yellow"))), (F.col("k") % 4 + 1).cast("int")).alias("variant"),
                    "player_id", F.when(F.col("player_id") <= 4, "friendly").otherwise("enemy").alias("team"), (F.col("k") / 100).alias("confidence"),
                    (F.col("k") * 7 % 300).cast("int").alias("x"), (F.col("k") * 13 % 90).cast("int").alias("y"), (F.col("k") % 20 + 40).cast("int").alias("w"), F.lit(18).alias("h"))


FRAME = ["match_id", "frame"]


BX = """b0 AS (SELECT match_id, t // 14400 AS frame, event_id AS id, k % 4 AS variant, player_id, k / 100 AS confidence, k * 7 % 300 AS x, k * 13 % 90 AS y, k % 20 + 40 AS w, 18 AS h FROM obs)"""


@query("{obs}, " + BX + """, p AS (SELECT a.match_id, a.frame, a.id AS anchor_id, o.id AS other_id, o.confidence, CAST(greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) AS DOUBLE) AS i, a.w * a.h AS s, o.w * o.h AS u
  FROM b0 a JOIN b0 o ON a.match_id = o.match_id AND a.frame = o.frame WHERE a.variant = 1 AND o.variant <> 1 AND o.player_id > 4 AND abs(a.x + a.w / 2 - o.x - o.w / 2) + abs(a.y + a.h / 2 - o.y - o.h / 2) <= 40 AND abs(a.w - o.w) + abs(a.h - o.h) <= 35)
SELECT match_id, frame, anchor_id, other_id, round(i / (s + u - i), 6) AS iou, confidence FROM p QUALIFY row_number() OVER (PARTITION BY match_id, frame, anchor_id ORDER BY i / (s + u - i) DESC, confidence DESC, other_id) = 1""")
def spatial_best_match(spark, d):
    b = _boxes(spark, d).withColumn("box", F.struct("x", "y", "w", "h"))
    out = resolve.best_partner(b.filter("variant = 'red'"), b.filter("variant <> 'red' and team = 'enemy'"), FRAME)
    return out.select("match_id", "frame", "anchor_id", "other_id", F.round("iou", 6).alias("iou"), "confidence")


def _names(spark, d):
    o = observations(spark, d)
    return o.select("match_id", F.when(F.col("player_id") <= 4, "friendly").otherwise("enemy").alias("team"), (F.col("player_id") % 4).alias("slot_index"),
                    F.concat(F.lit("p"), F.col("player_id").cast("string"), F.lit("v"), (F.col("k") % 3).cast("string")).alias("name"),
                    F.concat(F.lit("P"), F.col("player_id").cast("string"), F.lit("v"), (F.col("k") % 3).cast("string"), F.when(F.col("k") % 2 == 0, "-").otherwise("")).alias("display"), (F.col("k") / 100).alias("confidence"))


NAMES = """nm AS (SELECT match_id, CASE WHEN player_id <= 4 THEN 'friendly' ELSE 'enemy' END AS team, player_id % 4 AS slot_index, 'p' || player_id || 'v' || k % 3 AS name,
  'P' || player_id || 'v' || k % 3 || CASE WHEN k % 2 = 0 THEN '-' ELSE '' END AS display, CAST(k / 100 AS DECIMAL(18, 6)) AS confidence FROM obs)"""


@query("{obs}, " + NAMES + """, s AS (SELECT match_id, team, slot_index, name, display, count(*) AS n, sum(confidence) AS w FROM nm GROUP BY ALL),
g AS (SELECT match_id, team, slot_index, name, sum(n) AS n, sum(w) AS w, arg_max(display, (n, length(display), display)) AS display FROM s GROUP BY ALL),
b AS (SELECT match_id, team, slot_index, arg_max(struct_pack(name := name, display := display, n := n, w := w), (w, n, name)) AS b, sum(w) AS total FROM g GROUP BY ALL)
SELECT match_id, team, slot_index, b.name AS name, b.display AS display, CAST(b.n AS BIGINT) AS observations, round(CAST(b.w AS DOUBLE) / CAST(total AS DOUBLE), 6) AS confidence FROM b""")
def consensus_name(spark, d):
    return resolve.slot_consensus(_names(spark, d), KEY, ["team", "slot_index"])


CLUST = NAMES + """, cl AS (SELECT match_id, team, name, count(*) AS observations, sum(confidence) AS weight, round(least(1.0, CAST(sum(confidence) AS DOUBLE) / count(*) + least(0.20, 0.05 * (count(*) - 1))), 6) AS confidence FROM nm GROUP BY ALL)"""


def _clusters(spark, d):
    c = _names(spark, d).groupBy("match_id", "team", "name").agg(F.count(F.lit(1)).alias("observations"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("weight"))
    return c.withColumn("confidence", F.round(resolve.cluster_confidence(F.col("weight").cast("double"), F.col("observations")), 6))


@query("{obs}, " + CLUST + " SELECT match_id, team, name, observations, confidence, row_number() OVER (PARTITION BY match_id, team ORDER BY observations DESC, weight DESC, length(name) DESC, name) AS place FROM cl QUALIFY place <= 4")
def roster_top4(spark, d):
    return resolve.top_names(_clusters(spark, d), ["match_id", "team"]).select("match_id", "team", "name", "observations", "confidence", F.col("place").cast("long").alias("place"))


@query("{obs}, " + CLUST + """, ok AS (SELECT match_id, team FROM cl WHERE observations >= 2 AND confidence >= 0.6 GROUP BY ALL HAVING count(*) >= 4)
SELECT o.match_id, o.event_id FROM obs o WHERE o.match_id IN (SELECT match_id FROM ok GROUP BY 1 HAVING count(*) = 2)""")
def registry_gate(spark, d):
    ready = resolve.ready_teams(_clusters(spark, d), KEY, sure=0.6)
    return observations(spark, d).join(ready, KEY, "left_semi").select("match_id", "event_id")


@query("{obs}, " + CLUST + " SELECT match_id, team, name, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN team = 'friendly' THEN 0 ELSE 1 END, observations, name) AS player_id FROM cl")
def dense_ids(spark, d):
    c = _clusters(spark, d).withColumn("slot_index", F.col("observations"))
    return resolve.dense_ids(c, KEY).select("match_id", "team", "name", F.col("player_id").cast("long").alias("player_id"))


@query("""{obs}, c AS (SELECT match_id, event_id, t, count(*) FILTER (WHERE k >= 20) {ALONG} AS seen FROM obs) SELECT match_id, min_by(event_id, (t, event_id)) AS event_id, min(t) AS t FROM c WHERE seen >= 8 GROUP BY 1""")
def registration_frame(spark, d):
    o = observations(spark, d)
    seen = o.select("match_id", "event_id", "t", series.running_count(F.col("k") >= 20, KEY, ORDER).alias("seen")).filter("seen >= 8")
    return seen.groupBy("match_id").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"), F.min("t").alias("t"))


@query("SELECT l_orderkey, round(avg(CAST(round(l_discount * 100) AS BIGINT)) FILTER (WHERE round(l_discount * 100) > 0), 6) AS mean_positive, round(avg(CAST(round(l_discount * 100) AS BIGINT)), 6) AS mean_present FROM lineitem GROUP BY 1")
def positive_avg(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100).cast("long").alias("v"))
    return summary.mean_or_null(li, ["l_orderkey"], "v").select("l_orderkey", F.round("mean_positive", 6).alias("mean_positive"), F.round("mean_present", 6).alias("mean_present"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS first_truthy, round(list_avg(list_filter([l_discount, l_tax, l_quantity], lambda x: x > 0)), 6) AS mean_positive FROM lineitem""")
def first_truthy(spark, d):
    c = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.first_truthy(*c).alias("first_truthy"), F.round(scores.mean_positive(*c), 6).alias("mean_positive"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.03 THEN l_discount / 0.03 WHEN l_discount <= 0.06 THEN 1.0 ELSE greatest(0.0, (1 - l_discount) / (1 - 0.06)) END, 6) AS band,
  round(least(1.0, 0.45 * least(1.0, l_discount / 0.2) + 0.35 * l_tax + 0.20 * l_tax), 6) AS row_score, round(least(1.0, 0.45 * l_discount + 0.35 * l_tax + 0.20 * least(1.0, l_linenumber / 6.0)), 6) AS crop_score,
  round(least(1.0, 0.35 * l_tax + 0.65 * l_discount), 6) AS name_score,
  round(least(1.0, greatest(0.65 * l_discount * 10 + 0.35 * CASE WHEN l_tax <= 0 THEN 0.4 WHEN l_discount * 10 >= 0.5 THEN greatest(l_tax, 0.4) ELSE l_tax END, 0.9 * 0.4)), 6) AS floored FROM lineitem""")
def score_blends(spark, d):
    x, y = F.col("l_discount"), F.col("l_tax")
    r = lambda c: F.round(c, 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(scores.band_score(x, 0.03, 0.06)).alias("band"), r(scores.row_readability(x, y, y)).alias("row_score"), r(scores.crop_readability(x, y, F.col("l_linenumber"))).alias("crop_score"),
                                              r(scores.name_confidence(y, x)).alias("name_score"), r(scores.floored_blend(x * 10, y, 0.4)).alias("floored"))


LABELS = "CASE event_id % 4 WHEN 0 THEN CAST(t // 60 AS VARCHAR) || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') WHEN 1 THEN CAST(t AS VARCHAR) WHEN 2 THEN '  ' ELSE NULL END"


@query("{obs}, l AS (SELECT event_id, " + LABELS + """ AS label FROM obs)
SELECT event_id, greatest(0.0, CASE WHEN label IS NULL OR trim(label) = '' THEN 0.0 WHEN contains(label, ':') THEN 60.0 * CAST(split_part(label, ':', 1) AS INTEGER) + CAST(split_part(label, ':', 2) AS DOUBLE) ELSE CAST(label AS DOUBLE) END) AS seconds,
  CASE WHEN contains(trim(label), ':') THEN replace(trim(label), ':', 'm') || 's' ELSE trim(label) || 's' END AS name FROM l""")
def parse_times(spark, d):
    t, m = F.col("t"), F.col("event_id") % 4
    label = (F.when(m == 0, F.concat(F.floor(t / 60).cast("string"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"))).when(m == 1, t.cast("string")).when(m == 2, "  "))
    return observations(spark, d).select("event_id", label.alias("label")).select("event_id", text.seconds_of(F.col("label")).alias("seconds"), text.time_label(F.col("label")).alias("name"))


@query("""{obs} SELECT match_id, event_id, k AS score FROM obs WHERE value / 500 BETWEEN 0.08 AND 0.55 AND k BETWEEN 0 AND 250 AND (k * 37 % 100) / 100 >= CASE WHEN k < 10 THEN 0.8 ELSE 0.7 END""")
def score_reading_gate(spark, d):
    o = observations(spark, d).withColumn("confidence", F.col("k") * 37 % 100 / 100)
    digits = F.col("k").cast("string")
    return (o.filter(F.expr("value / 500").between(0.08, 0.55)).filter(scores.digit_domain(digits)).filter(F.col("confidence") >= F.when(F.length(digits) == 1, 0.8).otherwise(0.7))
            .select("match_id", "event_id", F.col("k").alias("score")))


@query("{obs} SELECT match_id, t // 3600 AS frame, min(event_id) AS event_id FROM obs GROUP BY 1, 2")
def first_of_frame(spark, d):
    o = observations(spark, d).select("match_id", F.floor(F.col("t") / 3600).cast("long").alias("frame"), "event_id")
    return o.groupBy("match_id", "frame").agg(F.min("event_id").alias("event_id"))


@query("{obs} SELECT match_id, t // 14400 AS frame, arg_max(k, (k / 100, -event_id)) AS value, max(k / 100) AS confidence FROM obs WHERE k > 0 GROUP BY 1, 2")
def best_numeric(spark, d):
    o = observations(spark, d).filter("k > 0").withColumn("frame", F.floor(F.col("t") / 14400).cast("long"))
    return o.groupBy("match_id", "frame").agg(F.max_by("k", F.struct(F.col("k") / 100, -F.col("event_id"))).alias("value"), F.max(F.col("k") / 100).alias("confidence"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(trunc(s_acctbal) AS INTEGER) END AS whole, TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM supplier""")
def number_parsing(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", text.whole_number(F.when(k % 5 == 0, " ").otherwise(F.col("s_acctbal").cast("string"))).alias("whole"),
                                              scores.as_number(F.when(k % 3 == 0, F.col("s_name")).otherwise(F.concat(k.cast("string"), F.lit(".5")))).alias("number"))


@query("SELECT o_custkey AS root, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 3")
def newest_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("run"), "o_orderdate")
    return sinks.newest_runs(o, ["root"], "o_orderdate", 3).select("root", "run", "place")


@query("{obs} SELECT match_id, count(*) AS n, count(DISTINCT player_id) AS players FROM (SELECT match_id, player_id FROM obs WHERE event_type = 'view' UNION ALL SELECT match_id, player_id FROM obs WHERE event_type = 'click' UNION ALL SELECT match_id, player_id FROM obs WHERE k < 30) GROUP BY 1")
def union_variants(spark, d):
    o = observations(spark, d).select("match_id", "player_id", "event_type", "k")
    u = o.filter("event_type = 'view'").unionByName(o.filter("event_type = 'click'")).unionByName(o.filter("k < 30"))
    return u.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("player_id").alias("players"))


@query("{obs}, " + BUCKETED % BUCKET + " SELECT match_id, bucket, row_number() OVER (PARTITION BY match_id ORDER BY bucket) * 10 AS timestamp FROM bucketed")
def retimestamp(spark, d):
    b = _bucketed(spark, d)
    return b.select("match_id", "bucket", (F.row_number().over(Window.partitionBy("match_id").orderBy("bucket")) * 10).cast("long").alias("timestamp"))


@query("""SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'killfeed' WHEN '2-high' THEN 'utility' END AS section, printf('%.3f', o_totalprice) AS label, replace(regexp_extract(path, '([^/]+)\\.[^./]*$', 1), ' ', '_') AS stem FROM (SELECT *, '/runs/' || o_orderstatus || '/match ' || o_orderkey || '.v2.mp4' AS path FROM orders)""")
def labels_and_stems(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.lit("/runs/"), "o_orderstatus", F.lit("/match "), F.col("o_orderkey").cast("string"), F.lit(".v2.mp4"))
    return o.select("o_orderkey", text.alias_lookup(F.col("o_orderpriority"), {"1-urgent": "killfeed", "2-high": "utility"}).alias("section"), F.format_string("%.3f", "o_totalprice").alias("label"), text.path_stem(path).alias("stem"))


from hillstream.plans import match_queries  # noqa: E402, F401  adds its queries to the same tables
