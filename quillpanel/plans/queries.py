"""Registered queries of the panel operators over the driver's tables, and DuckDB's SQL for them.

Doubles are rounded to eight places on both sides, as the order of additions may differ.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, features, indicators, membership, quality, reduction, signals
from ..sources import bars, store

DIGITS = 8
LIMITS = quality.Limits(max_return=1.0, min_history=15, max_gap=2, suspended=3, sustained=3, fill=2)
START, END = datetime.date(2024, 1, 5), datetime.date(2024, 1, 20)


def _out(df: DataFrame, *columns: str) -> DataFrame:
    df = df.select(*columns) if columns else df
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _weekly(step, *columns):
    return lambda spark, sf: _out(step(bars.weekly_bars(spark, sf)), "ticker", "date", *columns)


def _all_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return features.forward_returns(indicators.add_indicators(bars.weekly_bars(spark, sf)))


def _raw(spark, sf):
    """The faulty bars, once for each ticker and date."""
    return bars.keep_last(bars.faulty_bars(spark, sf), ["ticker", "date"], "seq").drop("seq")


def _days(spark, sf):
    return quality.calendar(_raw(spark, sf))


def _trimmed(spark, sf):
    return quality.enough_history(quality.trim_leading(_raw(spark, sf), LIMITS), LIMITS)


def _aligned(spark, sf):
    return quality.align(_trimmed(spark, sf), _days(spark, sf), LIMITS)


def _returned(spark, sf):
    return quality.returns(quality.repair(_aligned(spark, sf), LIMITS)[0], LIMITS)


def _changes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('signup', 'error')")
    user = F.col("user_id").cast("string")
    return e.groupBy(F.col("ts").cast("date").alias("date"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("k")).select("date", F.when(F.col("k") == "signup", user).alias("added"), F.when(F.col("k") == "error", user).alias("removed"))


def _current(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("ticker")).distinct()


def _dates(spark):
    return spark.createDataFrame([(START,), (END,)], "date date")


def _second(spark, sf):
    b = bars.weekly_bars(spark, sf)
    n = F.col("ticker").cast("long")
    off = F.when(n % 3 == 0, F.when(F.day("date") % 5 == 0, 1.05).otherwise(1.0)).when(n % 3 == 1, 1.08).otherwise(1.0)
    return b.where(n % 7 != 0).withColumn("close", F.col("close") * off)


def _matrix(spark, sf):
    return features.build_matrix(indicators.add_indicators(bars.weekly_bars(spark, sf)), bars.macro_series(spark, sf))


def _train(spark, sf):
    return features.purged_split(_matrix(spark, sf)).where("split = 'train'")


def _clean(spark, sf):
    return quality.clean(bars.faulty_bars(spark, sf), _days(spark, sf), LIMITS, "seq")


def _stats(spark, sf):
    panel, audit = _clean(spark, sf)
    return quality.cleaning_stats(_raw(spark, sf), quality.trim_leading(_raw(spark, sf), LIMITS), panel, audit, LIMITS)


def _corr_pruned(spark, sf):
    kept, dropped = reduction.prune(_train(spark, sf), features.feature_names(), ABOVE)
    return spark.createDataFrame([(k, None, None) for k in kept] + dropped, "feature string, correlated_with string, corr double")


def _loadings(spark, sf):
    rows = [(t["pc"], t["feature"], t["loading"]) for t in reduction.run_reduction(_matrix(spark, sf))["top_loadings"]]
    return spark.createDataFrame(rows, "pc string, feature string, loading double")


#: Correlation above which a feature is pruned.
ABOVE = 0.95


def queries() -> dict:
    daily, weekly = bars.daily_bars, bars.weekly_bars
    integrity = lambda s, d: quality.integrity(bars.faulty_bars(s, d), _days(s, d), LIMITS)
    return {
        "bars_weekly": lambda s, d: _out(weekly(s, d), "ticker", "date", "open", "high", "low", "close", "volume"),
        "sma": _weekly(indicators.moving_averages, "ma5", "ma10", "ma20", "ma50", "ma200"),
        "ema": _weekly(indicators.exponential_averages, "ema12", "ema26"),
        "rsi": _weekly(indicators.rsi, "rsi14"),
        "macd": _weekly(lambda b: indicators.macd(indicators.exponential_averages(b)), "macd", "macd_signal", "macd_hist"),
        "bollinger": _weekly(indicators.bollinger, "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pctb"),
        "atr": _weekly(indicators.atr, "atr14"),
        "forward_returns": _weekly(features.attach_labels, "fwd_ret_1", "fwd_ret_5", "fwd_ret_20", "label_up_1", "label_up_5", "label_up_20"),
        "lag_features": lambda s, d: _out(features.lag_features(weekly(s, d)), "ticker", "date", *features.LAGS),
        "macro_features": lambda s, d: _out(features.macro_features(bars.macro_series(s, d))),
        "macro_asof": lambda s, d: _out(features.as_of(daily(s, d).select("ticker", "date", "close"), bars.macro_series(s, d)), "ticker", "date", "close", "vix", "spx"),
        "feature_matrix": lambda s, d: _out(_matrix(s, d)),
        "purged_split": lambda s, d: features.purged_split(weekly(s, d).select("ticker", "date")),
        "daily_ic": lambda s, d: _out(signals.daily_ic(_all_indicators(s, d))),
        "ic_summary": lambda s, d: signals.ic_summary(signals.daily_ic(_all_indicators(s, d))),
        "rsi_buckets": lambda s, d: signals.rsi_buckets(_all_indicators(s, d)),
        "rsi_zones": lambda s, d: signals.rsi_zones(_all_indicators(s, d)),
        "calendar_majority": _days,
        "integrity": lambda s, d: integrity(s, d).withColumn("flags", F.array_join("flags", ",")),
        "flag_counts": lambda s, d: quality.flag_counts(integrity(s, d)),
        "clean_trim": lambda s, d: _out(_trimmed(s, d), "ticker", "date", "close"),
        "quarantine": lambda s, d: quality.quarantined(_raw(s, d), quality.trim_leading(_raw(s, d), LIMITS), LIMITS),
        "integrity_summary": lambda s, d: quality.integrity_summary(integrity(s, d)),
        "faulty_bars": lambda s, d: _out(bars.faulty_bars(s, d), "ticker", "date", "open", "high", "low", "close", "volume", "seq"),
        "clean": lambda s, d: _out(_clean(s, d)[0], "ticker", "date", "open", "high", "low", "close", "volume", "ret", "ret_winsor", "is_halt", "is_filled", "is_extreme", "is_suspect"),
        "cleaning_adjustments": lambda s, d: _clean(s, d)[1],
        "cleaning_stats": _stats,
        "prelisting_trimmed": lambda s, d: quality.prelisting(_stats(s, d)),
        "cleaning_report": lambda s, d: quality.cleaning_report(_stats(s, d)),
        "rsi_aligned": lambda s, d: _out(indicators.rsi(_aligned(s, d)), "ticker", "date", "rsi14"),
        "ema_aligned": lambda s, d: _out(indicators.exponential_averages(_aligned(s, d), (3, 8)), "ticker", "date", "ema3", "ema8"),
        "rsi_bars": lambda s, d: charts.rsi_bars(signals.rsi_buckets(_all_indicators(s, d))),
        "ic_grid": lambda s, d: charts.ic_grid(signals.ic_summary(signals.daily_ic(_all_indicators(s, d)))),
        "clean_align_ffill": lambda s, d: _out(_aligned(s, d), "ticker", "date", "close", "volume", "is_halt", "is_filled"),
        "clean_returns": lambda s, d: _out(_returned(s, d), "ticker", "date", "ret", "log_ret", "is_extreme", "is_suspect"),
        "clean_winsor": lambda s, d: _out(quality.winsorise(_returned(s, d), LIMITS, 10), "ticker", "date", "ret_winsor"),
        "panel_wide_pivot": lambda s, d: quality.wide(weekly(s, d), digits=DIGITS),
        "members_on": lambda s, d: membership.members_on(_changes(s, d), _current(s, d), _dates(s)),
        "membership_snapshots": lambda s, d: membership.snapshots(_changes(s, d), _current(s, d), _dates(s)),
        "universe": lambda s, d: membership.universe(_changes(s, d), _current(s, d), START, END),
        "removed_in": lambda s, d: membership.removed_in(_changes(s, d), START, END),
        "reconcile": lambda s, d: quality.reconcile(weekly(s, d), _second(s, d)),
        "reconcile_sample": lambda s, d: quality.reconcile_sample(weekly(s, d), _second(s, d), 20),
        "manifest_resume": lambda s, d: store.manifest(weekly(s, d), store.with_fallback(_second(s, d), weekly(s, d).withColumn("source", F.lit("fallback")))),
        "even_sample": lambda s, d: reduction.even_sample(weekly(s, d), "ticker", 6),
        "corr_matrix": lambda s, d: _out(reduction.correlations(_train(s, d), features.feature_names())),
        "corr_pruned": _corr_pruned,
        "top_loadings": _loadings,
        "snapshot": lambda s, d: store.snapshot(s, d),
    }
