"""Writers of a match's outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hillstream.functions.text import header_names, path_stem


def telemetry_table(series: DataFrame, kills: DataFrame, keys: list[str], players: list[tuple[int, str]]) -> DataFrame:
    """series: keys, timestamp, ...; kills: keys, timestamp, player_id, n (cumulative). One column per player, 0 where none."""
    headers = header_names([n for _, n in players])
    wide = kills.groupBy(*keys, "timestamp").pivot("player_id", [i for i, _ in players]).agg(F.max("n"))
    out = series.join(wide, [*keys, "timestamp"], "left")
    return out.select(*series.columns, *(F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(h) for (i, _), h in zip(players, headers, strict=True)))


def write_csv(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """CSV with a header and nulls as empty cells; a folder for each value of ``partition``."""
    w = df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
    (w.partitionBy(*partition) if partition else w).csv(path)


def summary_json(stats: DataFrame, finals: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per match: final score, players, ratios and totals. Players of a match are few by their ids."""
    people = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("player_id", "name", "team", "kills", "deaths", "kd"))).alias("players"))
    d = people.join(finals, keys).join(totals, keys)
    by_name = lambda c: F.map_from_entries(F.transform("players", lambda p: F.struct(p["player_id"].cast("string"), p[c])))
    doc = F.struct(F.struct(F.col("json_blue").alias("blue"), F.col("json_red").alias("red")).alias("final_score"), F.col("players").alias("registry"),
                   by_name("kd").alias("kd"), by_name("kills").alias("kills"), by_name("deaths").alias("deaths"), F.struct("nades", "stuns", "specialties").alias("utility"))
    return d.select(*keys, F.to_json(doc).alias("document"))


def report_lines(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of the text report: per team the players by falling kills, then lower-case name; "- none" without any."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "team").orderBy(F.desc("kills"), F.lower("name"), "player_id")
    some = stats.select(*keys, "team", F.row_number().over(w).alias("place"), F.format_string("- %s: %d kills, %d deaths", "name", "kills", "deaths").alias("line"))
    teams = stats.select(*keys).distinct().withColumn("team", F.explode(F.array(F.lit("ally"), F.lit("enemy"))))
    return teams.join(some, [*keys, "team"], "left").select(*keys, "team", F.coalesce("place", F.lit(1)).cast("long").alias("place"), F.coalesce("line", F.lit("- none")).alias("line"))


def newest_runs(runs: DataFrame, keys: list[str], mtime: str, keep: int) -> DataFrame:
    """The newest runs of each root. Only chosen here; nothing is deleted."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(mtime), F.desc("run"))
    return runs.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= keep)


def run_id(path: Column, began: Column) -> Column:
    """The folder of a run: the recording's name and when the run began. A new recording begins a new run."""
    return F.concat(path_stem(path), F.lit("_"), F.date_format(began, "yyyyMMdd_HHmmss"))


def numbered(df: DataFrame, keys: list[str], lines: Column) -> DataFrame:
    """One row for each of a row's lines, numbered from 1."""
    return df.select(*keys, F.posexplode(lines).alias("n", "line")).select(*keys, (F.col("n") + 1).cast("long").alias("line_number"), "line")


#: What the report calls the counters of the feed, in its order.
COUNTERS = {"Kills": "kills", "Deaths": "deaths", "Trades": "trades", "Name detections": "name_detections", "Resolved name detections": "resolved_name_detections", "Row groups detected": "row_groups_detected",
            "Single-side row groups": "single_side_row_groups", "Event threads created": "event_threads_created", "Event threads reused": "event_threads_reused", "Events counted": "events_counted",
            "Events blocked by victim cooldown": "events_blocked_victim_cooldown", "Events blocked by low confidence": "events_blocked_low_confidence", "Events blocked by same-side pairing": "events_blocked_same_side"}
USED = {"Grenade": "nades", "Stun": "stuns", "Specialty equipment": "specialties"}


def report(stats: DataFrame, facts: DataFrame, keys: list[str], head: dict[str, Column], registration: dict[str, Column], scores: dict[str, Column], confidence: Column, modules: dict[str, Column]) -> DataFrame:
    """The text report of each match, one row a line.

    stats: keys, player_id, name, kills, deaths, detections; facts: keys, the columns of COUNTERS and USED and those that the other
    arguments use. Players of a match, few by their ids, are listed by falling count, then lower-case name; those
    without a count are left out, an empty list says so, and a value that is missing is None.
    """
    people = stats.groupBy(*keys).agg(F.collect_list(F.struct("player_id", "name", "kills", "deaths", "detections")).alias("_people"))

    def ranked(c: str) -> Column:
        some = F.transform(F.filter("_people", lambda p: p[c] > 0), lambda p: F.struct((-p[c]).alias("n"), F.lower(p["name"]).alias("k"), p["player_id"], p["name"].alias("name")))
        return F.transform(F.array_sort(some), lambda p: F.concat(F.lit("- "), p["name"], F.lit(": "), (-p["n"]).cast("string")))

    names = F.transform(F.array_sort(F.transform("_people", lambda p: F.struct(p["player_id"], p["name"].alias("name")))), lambda p: F.concat(F.lit("- "), p["name"]))
    listed = lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("- none")))
    said = lambda some, mark="": [F.concat(F.lit(f"{mark}{k}: "), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("None"))) for k, v in some.items()]
    block = lambda *some: F.array(*(F.lit(x) if isinstance(x, str) else x for x in some))
    lines = F.concat(block("Validation Summary", *said(head), "", "Registered Players:"), listed(names), block("", "Scoreboard Registration:", *said(registration)),
                     block("", "Killfeed Counts:", *said(COUNTERS), "Player detection counts:"), listed(ranked("detections")), block("", "Player Kills:"), listed(ranked("kills")),
                     block("", "Player Deaths:"), listed(ranked("deaths")), block("", "Utility Counts:", *said(USED)), block("", "Hardpoint:", *said(scores)),
                     block("", *said({"OCR confidence": confidence}), "", "Module Status:", *said(modules, "- ")))
    some = facts.join(people, keys, "left").withColumn("_people", F.coalesce("_people", F.array().cast("array<struct<player_id:bigint,name:string,kills:bigint,deaths:bigint,detections:bigint>>")))
    return numbered(some, keys, lines)
