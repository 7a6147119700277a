"""Final scores and the row that the end of a series has to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forced_final_row(series: DataFrame, finals: DataFrame, keys: list[str], top: int = 250, seconds: int = 10) -> DataFrame:
    """Insert the final score after the last row with the winner's highest score below ``top``.

    series: keys, timestamp, blue_score, red_score and more; finals: keys, final_blue,
    final_red. Nothing happens without rows, without both finals, if none is ``top``, or
    if the last row shows both already. The new row repeats the anchor (the last row if no
    score is below ``top``); all rows are numbered again; rows in which the winner has
    ``top`` get the loser's final.
    """
    w = Window.partitionBy(*keys)
    d = series.join(finals.select(*keys, "final_blue", "final_red"), keys, "left")
    blue_wins = F.col("final_blue") == top
    d = d.withColumn("_win", F.when(blue_wins, F.col("blue_score")).otherwise(F.col("red_score")))
    d = d.withColumn("_last", F.max("timestamp").over(w))
    shown = (F.col("timestamp") == F.col("_last")) & F.col("blue_score").eqNullSafe(F.col("final_blue")) & F.col("red_score").eqNullSafe(F.col("final_red"))
    d = d.withColumn("_on", F.col("final_blue").isNotNull() & F.col("final_red").isNotNull() & ((F.col("final_blue") == top) | (F.col("final_red") == top)) & ~F.max(shown).over(w))
    d = d.withColumn("_anchor", F.coalesce(F.max_by(F.when(F.col("_win") < top, F.col("timestamp")), F.when(F.col("_win") < top, F.struct("_win", "timestamp"))).over(w), F.col("_last")))
    copies = F.when(F.col("_on") & (F.col("timestamp") == F.col("_anchor")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_new", F.explode(copies))
    d = (d.withColumn("blue_score", F.when(F.col("_new") == 1, F.col("final_blue")).otherwise(F.col("blue_score")))
         .withColumn("red_score", F.when(F.col("_new") == 1, F.col("final_red")).otherwise(F.col("red_score"))))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "_new")) * seconds
    d = d.withColumn("timestamp", F.when(F.col("_on"), number.cast("long")).otherwise(F.col("timestamp")))
    fix_red = F.col("_on") & blue_wins & (F.col("blue_score") == top)
    fix_blue = F.col("_on") & ~blue_wins & (F.col("red_score") == top)
    d = (d.withColumn("red_score", F.when(fix_red, F.col("final_red")).otherwise(F.col("red_score")))
         .withColumn("blue_score", F.when(fix_blue, F.col("final_blue")).otherwise(F.col("blue_score"))))
    return d.select(*series.columns)


def final_scores(board: DataFrame, series: DataFrame, snapshot: DataFrame, keys: list[str], order: list[str], top: int = 250) -> DataFrame:
    """One row per match: the table's pair (csv_*) and the document's (json_*).

    csv: the board's pair if complete and one is ``top``; else the last row of the series
    with any score, whose other score may be null; else the snapshot. json: side by side, the board's
    value, else the snapshot's. board and snapshot have blue, red.
    """
    some = F.col("blue_score").isNotNull() | F.col("red_score").isNotNull()
    last = series.filter(some).groupBy(*keys).agg(F.max_by(F.struct("blue_score", "red_score"), F.struct(*order)).alias("_t"))
    d = (snapshot.select(*keys, F.struct("blue", "red").alias("_s")).join(board.select(*keys, F.struct("blue", "red").alias("_b")), keys, "full").join(last, keys, "full"))
    b, t, s = F.col("_b"), F.col("_t"), F.col("_s")
    whole = b["blue"].isNotNull() & b["red"].isNotNull() & ((b["blue"] == top) | (b["red"] == top))
    pick = lambda side, name: F.when(whole, b[side]).when(t.isNotNull(), t[name]).otherwise(s[side])
    return d.select(*keys, pick("blue", "blue_score").alias("csv_blue"), pick("red", "red_score").alias("csv_red"),
                    F.coalesce(b["blue"], s["blue"]).alias("json_blue"), F.coalesce(b["red"], s["red"]).alias("json_red"))
