"""The universe of tickers from cached tables: constituents, membership changes, extras."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import membership
from .bars import normal_symbol, snake

#: Columns of the constituents' and the changes' tables.
RENAMED = {"gics_sub-industry": "gics_sub_industry", "headquarters_location": "headquarters"}
CHANGES = ("date", "add_tkr", "add_sec", "rem_tkr", "rem_sec", "reason")


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """The cached table of constituents, a row per symbol, with normal_symbol."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(RENAMED.get(snake(c), snake(c)) for c in df.columns))
    symbol = F.upper(F.trim("symbol"))
    df = df.withColumns({"symbol": symbol, "normal_symbol": normal_symbol(symbol)}).where("symbol IS NOT NULL AND symbol <> ''")
    return df.groupBy("symbol").agg(*(F.min(c).alias(c) for c in df.columns if c != "symbol"))


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The cached table of changes with CHANGES' columns; dates that do not parse go, blanks are null."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(snake(c) for c in df.columns))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.select(F.col("date").try_cast("date").alias("date"), *(normal_symbol(blank(c)).alias(c) if c.endswith("tkr") else blank(c).alias(c) for c in CHANGES[1:])).where("date IS NOT NULL")


def moves(changed: DataFrame) -> DataFrame:
    """The changes as the membership operators take them."""
    return changed.select("date", F.col("add_tkr").alias("added"), F.col("rem_tkr").alias("removed"))


def with_extras(tickers: DataFrame, extras=()) -> DataFrame:
    """ticker, place: distinct, the extras after the rest and in their order."""
    named = [tickers.select("ticker", F.lit(0).alias("place"))] + [tickers.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(extras)], "ticker string, place int")] * bool(extras)
    return reduce(DataFrame.unionByName, named).groupBy("ticker").agg(F.min("place").alias("place"))


def download_universe(current: DataFrame, changed: DataFrame, start, end, survivorship_free: bool = True, extras=()) -> DataFrame:
    """Present members (column ticker), or all that were members between the dates; and the extras."""
    tickers = membership.universe(moves(changed), current, start, end) if survivorship_free else current
    return with_extras(tickers.select("ticker"), extras)
