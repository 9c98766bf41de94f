"""Technical indicators of each entity's bars, prices from adj_close unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Ewm, change, ewm, fresh, mean, rows, std

AVERAGES = (5, 10, 20, 50, 200)


def moving_averages(df: DataFrame, windows=AVERAGES) -> DataFrame:
    return df.withColumns({f"ma{n}": mean(F.col("adj_close"), n) for n in windows})


EMAS = (12, 26)


def _ema(spans) -> list[Ewm]:
    return [Ewm(f"ema{n}", "adj_close", 2 / (n + 1), n) for n in spans]


def exponential_averages(df: DataFrame, spans=EMAS) -> DataFrame:
    return ewm(df, _ema(spans))


def _steps(df: DataFrame, tag: str) -> DataFrame:
    step = F.col("adj_close") - F.lag("adj_close").over(rows())
    return df.withColumns({f"{tag}_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), f"{tag}_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})


def _rsi_means(tag: str, n: int) -> list[Ewm]:
    return [Ewm(f"{tag}_up", f"{tag}_gain", 1 / n, n), Ewm(f"{tag}_down", f"{tag}_loss", 1 / n, n)]


def _rsi(tag: str) -> Column:
    up, down = F.col(f"{tag}_up"), F.col(f"{tag}_down")
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))


def _without(df: DataFrame, tag: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(tag)))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index; 100 where the mean loss is zero, also in a flat series."""
    tag = fresh(df, "_rsi")
    return _without(ewm(_steps(df, tag), _rsi_means(tag, n)).withColumn(f"rsi{n}", _rsi(tag)), tag)


def macd(df: DataFrame, signal: int = 9) -> DataFrame:
    """Needs ema12 and ema26."""
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = ewm(df, [Ewm("macd_signal", "macd", 2 / (signal + 1), signal)])
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    x = F.col("adj_close")
    sd = fresh(df, "_sd")
    df = df.withColumns({"bb_mid": mean(x, n), sd: std(x, n, 0)})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + k * F.col(sd), "bb_lower": F.col("bb_mid") - k * F.col(sd)})
    band = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_width": F.try_divide(band, F.col("bb_mid")), "bb_pctb": F.try_divide(x - F.col("bb_lower"), band)}).drop(sd)


def true_range() -> Column:
    before = F.lag("close").over(rows())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean of the true range of unadjusted prices."""
    tag = fresh(df, "_atr")
    return _without(ewm(df.withColumn(f"{tag}_tr", true_range()), [Ewm(f"atr{n}", f"{tag}_tr", 1 / n, n)]), tag)


def momentum(df: DataFrame) -> DataFrame:
    """Needs ma20 and macd_hist."""
    x = F.col("adj_close")
    return df.withColumns(
        {
            "ma20_gap": F.try_divide(x, F.col("ma20")) - 1,
            "mom_20": change(x, 20),
            "macd_hist_norm": F.try_divide(F.col("macd_hist"), x),
            "vol_ma20": mean(F.col("volume"), 20),
        }
    )


def add_indicators(df: DataFrame, n: int = 14) -> DataFrame:
    """All of them; the exponential means of prices, steps and ranges come from one pass."""
    tag = fresh(df, "_ind")
    df = _steps(bollinger(moving_averages(df)), tag).withColumn(f"{tag}_tr", true_range())
    df = ewm(df, [*_ema(EMAS), *_rsi_means(tag, n), Ewm(f"atr{n}", f"{tag}_tr", 1 / n, n)])
    return momentum(macd(_without(df.withColumn(f"rsi{n}", _rsi(tag)), tag)))
