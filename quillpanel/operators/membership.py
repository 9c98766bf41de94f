"""Membership of a set as of dates, from its present members and the history of changes.

Changes are rows of date, added, removed; nulls or blanks mean that nothing came or went.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events(changes: DataFrame) -> DataFrame:
    kinds = F.array(F.struct(F.col("added").alias("ticker"), F.lit(0).alias("removal")), F.struct(F.col("removed").alias("ticker"), F.lit(1).alias("removal")))
    return changes.where(F.col("date").isNotNull()).select("date", F.explode(kinds).alias("e")).select("date", "e.*").where("ticker is not null and trim(ticker) <> ''")


def members_on(changes: DataFrame, current: DataFrame, days: DataFrame) -> DataFrame:
    """date, ticker of every member on each of days (a short list of dates).

    The earliest change after the date decides: one that is to be removed was a member, one that
    is to be added was none; a ticker without later change is as it is now. A removal goes first.
    """
    days = F.broadcast(days.select(F.col("date").alias("on_date")).distinct())
    later = events(changes).join(days, F.col("date") > F.col("on_date"))
    state = later.groupBy("on_date", "ticker").agg(F.min_by("removal", F.struct("date", -F.col("removal"))).alias("removal"))
    now = current.select("ticker").distinct().join(days)
    return now.join(state, ["on_date", "ticker"], "full").where(F.coalesce(F.col("removal") == 1, F.lit(True))).select(F.col("on_date").alias("date"), "ticker")


def snapshots(changes: DataFrame, current: DataFrame, days: DataFrame) -> DataFrame:
    present = current.select("ticker").distinct().withColumn("__now", F.lit(1))
    return members_on(changes, current, days).join(present, "ticker", "left").groupBy("date").agg(F.count(F.lit(1)).alias("n_members"), F.count("__now").alias("still_current"))


def universe(changes: DataFrame, current: DataFrame, start, end) -> DataFrame:
    """All that were members at any time between the dates, with whether they still are."""
    first = changes.sparkSession.createDataFrame([(start,)], "date date")
    moved = events(changes).where(F.col("date").between(F.lit(start), F.lit(end))).select("ticker")
    every = members_on(changes, current, first).select("ticker").union(moved).distinct()
    present = current.select("ticker").distinct().withColumn("__now", F.lit(1))
    return every.join(present, "ticker", "left").select("ticker", F.when(F.col("__now") == 1, "current").otherwise("removed").alias("status"))


def removed_in(changes: DataFrame, start, end) -> DataFrame:
    """The latest removal of each ticker between the dates, both included."""
    return events(changes).where((F.col("removal") == 1) & F.col("date").between(F.lit(start), F.lit(end))).groupBy("ticker").agg(F.max("date").alias("date"))
