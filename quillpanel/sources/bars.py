"""Adapters that give the panel's bar columns: ticker, date, prices, volume, dividends, splits, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import fresh

PRICES = ("open", "high", "low", "close", "adj_close")
COLUMNS = ("date", *PRICES, "volume", "dividends", "splits", "ticker", "source")


def safe_name(symbol: Column) -> Column:
    return F.translate(symbol, "^/", "__")


def normal_symbol(symbol: Column) -> Column:
    return F.replace(F.upper(F.trim(symbol)), F.lit("."), F.lit("-"))


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def standardise(df: DataFrame, source: str, sequence: str = "seq") -> DataFrame:
    """Raw vendor rows as typed bars: one row per ticker and date, the last by the sequence column.

    The first column is the date if none is named so, and stock splits are splits. Values that do not
    parse become null; a missing adj_close is the close, missing dividends and splits are 0; rows
    without any of open, high, low, close go; without open, high, low, close or volume among the
    columns the result is empty. Rows have no order in Spark, so the sequence must be a column.
    """
    names = [snake(c) for c in df.columns]
    if "date" not in names and names:
        names[0] = "date"
    df = df.toDF(*("splits" if n == "stock_splits" else n for n in names))
    if snake(sequence) not in df.columns:
        raise ValueError(f"the column {sequence} is needed to tell which of repeated rows is the last")
    whole = {"open", "high", "low", "close", "volume", "ticker"} <= set(df.columns)
    has = lambda c: c in df.columns
    double = lambda c: F.col(c).try_cast("double")
    none = F.lit(None).cast("double")
    get = lambda c, default=none: double(c) if has(c) else default
    order = fresh(df, "_seq")
    out = df.select(
        F.col("date").try_cast("date").alias("date"),
        *(get(c).alias(c) for c in PRICES[:4]),
        get("adj_close", get("close")).alias("adj_close"),
        F.bround(get("volume")).cast("long").alias("volume"),
        get("dividends", F.lit(0.0)).alias("dividends"),
        get("splits", F.lit(0.0)).alias("splits"),
        (F.upper(F.trim("ticker")) if has("ticker") else F.lit(None).cast("string")).alias("ticker"),
        F.lit(source).alias("source"),
        F.col(snake(sequence)).alias(order),
    )
    out = out.where(F.lit(whole)).dropna("all", subset=list(PRICES[:4]))
    return keep_last(out, ["ticker", "date"], order).drop(order)


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = fresh(df, "_n")
    ties = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))).where(f"{n} = 1").drop(n)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last in order; rows equal in it are told apart by all columns."""
    return _first(df, keys, [F.desc(order)])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _first(df, keys, [F.col(order)])


def _bars(df: DataFrame, ticker: Column, day: Column, price: Column, size: Column, order: list[str], source: str) -> DataFrame:
    at = F.struct(*order)
    df = df.select(ticker.cast("string").alias("ticker"), day.alias("date"), price.alias("__p"), size.alias("__v"), at.alias("__at"))
    out = df.groupBy("ticker", "date").agg(
        F.min_by("__p", "__at").alias("open"),
        F.max("__p").alias("high"),
        F.min("__p").alias("low"),
        F.max_by("__p", "__at").alias("close"),
        F.sum("__v").cast("long").alias("volume"),
    )
    return out.select("date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume", F.lit(0.0).alias("dividends"), F.lit(0.0).alias("splits"), "ticker", F.lit(source).alias("source"))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ISO week from the unit prices of its line items."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.trunc(F.col("l_shipdate").cast("date"), "week")
    return _bars(df, F.col("l_suppkey"), day, price, F.col("l_quantity"), ["l_shipdate", "l_orderkey", "l_linenumber"], "lineitem")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per user and day from the values of events; days without events are gaps."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _bars(df, F.col("user_id"), F.col("ts").cast("date"), F.col("value"), F.lit(1), ["ts", "event_id"], "events")


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_bars with the faults that vendors' files have, by rules on the user u and the day of the month d.

    Flat bars without volume, at the start and within; highs below lows; prices of 0; weeks without a
    bar; users with a few days only; repeated dates (column seq tells the later row).
    """
    df = daily_bars(spark, sf_dir)
    u, d = F.col("ticker").cast("long"), F.day("date")
    df = df.where(~((u % 13 == 0) & (d > 6)) & ~((u % 6 == 1) & d.between(10, 16)))
    flat = ((u % 5 == 0) & (d <= 4)) | ((u + d) % 9 == 0)
    nothing, crossed = (u + d) % 41 == 0, (u * 3 + d) % 11 == 0
    close = F.when(nothing, 0.0).otherwise(F.col("close"))
    df = df.withColumns({"close": close, "adj_close": close, "high": F.when(crossed, F.col("low") * 0.9).otherwise(F.col("high"))})
    df = df.withColumns({c: F.when(flat, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")} | {"volume": F.when(flat, 0).otherwise(F.col("volume"))})
    again = df.where((u + d) % 23 == 0).withColumns({"volume": F.col("volume") + 10, "seq": F.lit(1)})
    return df.withColumn("seq", F.lit(0)).unionByName(again)


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean order totals by priority, as the four macro series."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mean = lambda p: F.avg(F.when(F.col("o_orderpriority").startswith(p), F.col("o_totalprice")))
    day = F.trunc(F.col("o_orderdate").cast("date"), "week").alias("date")
    return df.groupBy(day).agg(mean("1").alias("vix"), mean("2").alias("spx"), mean("3").alias("tnx10y"), mean("4").alias("irx13w"))
