"""Bars from a stream of trades: event-time windows with a watermark, late rows dropped after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """trades: ticker, ts, price, size. One bar per ticker and window; also valid on a batch.

    Of trades at one time the one of the least price opens and the one of the greatest closes.
    """
    at = F.window("ts", window).alias("w")
    out = trades.withWatermark("ts", late).groupBy("ticker", at).agg(
        F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "price")).alias("close"), F.sum("size").alias("volume")
    )
    return out.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
