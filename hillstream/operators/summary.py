"""Counts, ratios, shares and pivots of a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hillstream.functions.scores import as_number, kill_ratio, team_label


def usage_by_group(series: DataFrame, keys: list[str], order: list[str], group: str, counters: list[str]) -> DataFrame:
    """Steps of cumulative counters, over the whole series, summed by the group of the row; null groups go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = series.select(*keys, group, *((F.col(c) - F.lag(c).over(w)).alias(c) for c in counters))
    return d.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters))


def kills_deaths(events: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """events: keys, killer, victim; players: keys, player_id, name, team. One row per player, 0 where none."""
    long = events.select(*keys, F.explode(F.array(F.struct(F.col("killer").alias("player_id"), F.lit(1).alias("kill")), F.struct(F.col("victim").alias("player_id"), F.lit(0).alias("kill")))).alias("e"))
    n = long.groupBy(*keys, F.col("e.player_id").alias("player_id")).agg(F.sum("e.kill").alias("kills"), F.sum(1 - F.col("e.kill")).alias("deaths"))
    d = players.join(n, [*keys, "player_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = d.withColumn("kills", zero("kills")).withColumn("deaths", zero("deaths"))
    return d.select(*keys, "player_id", "name", team_label(F.col("team")).alias("team"), "kills", "deaths", kill_ratio(F.col("kills"), F.col("deaths")).alias("kd"))


def team_share(stats: DataFrame, keys: list[str]) -> DataFrame:
    """stats as kills_deaths gives. Each player's kills beside the rest of the team's, and the team's sums."""
    w = Window.partitionBy(*keys, "team")
    return (stats.withColumn("team_kills", F.sum("kills").over(w).cast("long")).withColumn("team_deaths", F.sum("deaths").over(w).cast("long"))
            .withColumn("team_kd_sum", F.round(F.sum(F.round("kd", 2).cast("decimal(18,2)")).over(w).cast("double"), 2))
            .withColumn("remaining", F.col("team_kills") - F.col("kills")))


METRICS = ("team", "kd", "total_kills", "total_deaths", "total_nades_used", "total_stuns_used", "total_specialties_used")


def summary_wide(stats: DataFrame, totals: DataFrame, keys: list[str], players: list[int]) -> DataFrame:
    """Metric rows by player columns p<id> and all_match, as text. The players are given, never inferred.

    totals: keys, nades, stuns, specialties.
    """
    per = stats.select(*keys, "player_id", F.explode(F.array(
        F.struct(F.lit("team").alias("metric"), F.col("team").alias("v")), F.struct(F.lit("kd").alias("metric"), F.format_string("%.2f", "kd").alias("v")),
        F.struct(F.lit("total_kills").alias("metric"), F.col("kills").cast("string").alias("v")),
        F.struct(F.lit("total_deaths").alias("metric"), F.col("deaths").cast("string").alias("v")))).alias("m")).select(*keys, "player_id", "m.metric", "m.v")
    whole = stats.groupBy(*keys).agg(F.sum("kills").alias("k"), F.sum("deaths").alias("d")).join(totals, keys)
    whole = whole.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("string").alias("v")) for m, v in zip(
        METRICS, [F.lit(""), F.lit(""), F.col("k"), F.col("d"), F.col("nades"), F.col("stuns"), F.col("specialties")], strict=True)))).alias("m")).select(*keys, "m.metric", F.col("m.v").alias("all_match"))
    wide = per.groupBy(*keys, "metric").pivot("player_id", players).agg(F.first("v"))
    return whole.join(wide, [*keys, "metric"], "left").select(*keys, "metric", *(F.coalesce(F.col(str(p)), F.lit("")).alias(f"p{p}") for p in players), "all_match")


def long_form(wide: DataFrame, keys: list[str], players: list[int]) -> DataFrame:
    """The wide summary turned: one row per player with numbers where the text is one."""
    cells = wide.unpivot([*keys, "metric"], [f"p{p}" for p in players], "player", "v")
    d = cells.groupBy(*keys, "player").pivot("metric", list(METRICS[:4])).agg(F.first("v"))
    return d.select(*keys, "player", "team", *(as_number(F.col(m)).alias(m) for m in METRICS[1:4]))


def mean_or_null(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Means of the positive values and of all that are not null."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(c) > 0, F.col(c))).alias("mean_positive"), F.avg(c).alias("mean_present"))
