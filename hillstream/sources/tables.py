"""Readers: frames, CSV outputs, images, and the adapter from the driver's event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hillstream.operators.series import upto

TELEMETRY = "timestamp int, blue_score int, red_score int, hill_number int, nades_used_to_that_point int, stuns_used_to_that_point int, specialties_used_to_that_point int"
FINAL = "blue_final_score int, red_final_score int"
FRAMES = "match_id string, frame_index long, timestamp_seconds double, source_path string, image binary"


def telemetry_csv(spark: SparkSession, path: str, players: list[str]) -> DataFrame:
    return spark.read.option("header", True).schema(TELEMETRY + "".join(f", `{p}` int" for p in players)).csv(path)


def final_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(FINAL).csv(path)


def summary_csv(spark: SparkSession, path: str, players: list[str]) -> DataFrame:
    return spark.read.option("header", True).schema("metric string" + "".join(f", `{p}` string" for p in players) + ", all_match string").csv(path)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """png, jpg and jpeg files with the name of their folder as label."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", True).load(path)
            .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), "path", "content"))


def templates(spark: SparkSession, path: str, decode: Callable[[bytes], object | None], most: int = 10_000) -> dict[str, list]:
    """Pictures by the name of their folder, in the order of their paths, for a worker's recogniser. Those that ``decode`` makes None of are left out.

    They are assets and few; more than ``most`` files are an error.
    """
    files = image_files(spark, path)
    if files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pictures under {path}")
    out: dict[str, list] = {}
    for r in files.orderBy("path").collect():
        if (picture := decode(bytes(r.content))) is not None:
            out.setdefault(r.label, []).append(picture)
    return out


def frame_at(frames: DataFrame, keys: list[str], t: str, seconds: float) -> DataFrame:
    """The first frame at or after a time, for each key."""
    return frames.filter(F.col(t) >= seconds).groupBy(*keys).agg(F.min_by(F.struct("*"), t).alias("_f")).select("_f.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _match() -> Column:
    return F.col("user_id") % 10 + 10 * F.floor(F.col("user_id") / 100)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of matches, ten for each hundred users: whole seconds t, and signals made from the type and the number in props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    d = e.select(_match().alias("match_id"), (F.col("user_id") % 8 + 1).alias("player_id"), "event_id",
                 F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("t"), k.alias("k"), "event_type", "value")
    kind = F.col("event_type")
    purchases = F.sum(F.when(kind == "purchase", 1).otherwise(0)).over(upto(["match_id"], ["t", "event_id"]))
    count = lambda what: F.sum(F.when(kind == what, 1).otherwise(0)).over(upto(["match_id"], ["t", "event_id"])).cast("long")
    return (d.withColumn("state01", F.when(kind != "error", kind.isin("purchase", "view").cast("int")).cast("long"))
            .withColumn("active", kind.isin("click", "view"))
            .withColumn("score", F.when(kind != "error", purchases + F.when(F.col("k") < 10, F.col("k") % 7).otherwise(0)).cast("long"))
            .withColumn("hill", F.col("k") % 5 + 1).withColumn("nades", count("click")).withColumn("stuns", count("view"))
            .withColumn("killer", F.col("player_id")).withColumn("victim", F.col("k") % 8 + 1))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight players for each match, four a side."""
    r = table(spark, sf_dir, "events").select(_match().alias("match_id")).distinct().select("match_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("player_id"))
    return r.select("match_id", "player_id", F.concat(F.lit("[T]Player "), F.col("player_id").cast("string")).alias("name"), F.when(F.col("player_id") <= 4, "friendly").otherwise("enemy").alias("team"))
