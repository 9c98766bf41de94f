"""Integrity reports that change nothing, and the cleaning that follows them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.rolling import corr_of, fresh, rows
from .features import as_of
from .reduction import even_sample
from ..sources.bars import PRICES, keep_last

OHLC = PRICES[:4]
#: Cells of a wide table that a task fills at once, and rows whose tickers it looks up at once.
CELLS, LOOKED_UP = 1 << 21, 1 << 18


@dataclass(frozen=True)
class Limits:
    max_return: float = 0.20
    min_coverage: float = 0.90
    max_gap: int = 5
    min_price: float = 0.01
    min_real_ratio: float = 0.80
    min_history: int = 60
    stale: int = 10
    suspended: int = 10
    fill: int = 5
    sustained: int = 21
    winsor_k: float = 3.0


def placeholder() -> Column:
    """A flat bar without volume."""
    o, h, low, c = (F.col(k) for k in OHLC)
    return F.coalesce((o == h) & (h == low) & (low == c), F.lit(False)) & (F.coalesce("volume", F.lit(0)) == 0)


def disorder() -> Column:
    """Open, high, low and close that contradict each other by more than rounding."""
    o, h, low, c = (F.col(k) for k in OHLC)
    tol = F.greatest(F.abs(c) * 1e-6, F.lit(1e-6))
    off = [low - h, o - h, c - h, low - o, low - c]
    return F.when(c.isNull(), False).otherwise(F.coalesce(F.greatest(*off) > tol, F.lit(False)))


def calendar(df: DataFrame, benchmark: str | None = None, share: float = 0.5) -> DataFrame:
    """The benchmark's dates, or those that at least this share of tickers have; numbered."""
    if benchmark is not None:
        days = df.where(F.col("ticker") == benchmark).select("date").distinct()
    else:
        total = df.agg(F.countDistinct("ticker").alias("__n"))
        days = df.groupBy("date").agg(F.countDistinct("ticker").alias("__k")).crossJoin(F.broadcast(total)).where(F.col("__k") >= F.col("__n") * share)
    return days.select("date", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("session"))


def integrity(df: DataFrame, days: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per ticker: spans, coverage, gaps, counts of faults, lifecycle, flags and status.

    days is a calendar (a row per session). A date's place in it is the number of the last session at
    or before it, so spans and gaps are differences of numbers.
    """
    tag = fresh(df, "_i")
    c = lambda k: F.col(f"{tag}_{k}")
    order = Window.partitionBy("ticker").orderBy("date", *OHLC, "volume")
    df = df.withColumns({f"{tag}_ret": F.abs(F.try_divide(F.col("close"), F.lag("close").over(order)) - 1), f"{tag}_bad": disorder(), f"{tag}_flat": placeholder()})
    on = days.select("date", F.col("session").alias(f"{tag}_s"))
    df = df.join(on, "date", "left")
    df = df.withColumn(f"{tag}_jump", c("s") - F.lag(c("s")).over(Window.partitionBy("ticker", c("s").isNull()).orderBy("date")) - 1)
    some_null = F.greatest(*(F.col(k).isNull() for k in (*OHLC, "volume")))
    n = F.count(F.lit(1))
    out = df.groupBy("ticker").agg(
        F.min("source").alias("source"),
        n.alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("date").alias(f"{tag}_present"),
        F.coalesce(F.max(c("jump")), F.lit(0)).alias(f"{tag}_inner"),
        F.countDistinct(c("s")).alias(f"{tag}_on"),
        F.min(c("s")).alias(f"{tag}_s0"),
        F.max(c("s")).alias(f"{tag}_s1"),
        F.count_if(F.col("close").isNull()).alias("n_nan_close"),
        F.count_if(some_null).alias("n_nan_ohlcv"),
        F.count_if(F.least(*OHLC) <= limits.min_price).alias("n_nonpos_price"),
        F.count_if(c("bad")).alias("n_ohlc_violation"),
        F.count_if(F.coalesce("volume", F.lit(0)) == 0).alias("n_zero_volume"),
        F.count_if(c("flat")).alias("n_halt_like"),
        F.count_if(~c("flat")).alias("real_rows"),
        F.min(F.when(~c("flat"), F.col("date"))).alias("first_real_date"),
        F.bround(F.max(c("ret")), 4).alias("max_abs_return"),
        F.count_if(c("ret") > limits.max_return).alias("n_extreme_return"),
    )
    place = lambda df, day, name: as_of(df.withColumn("date", day), days.select("date", F.col("session").alias(f"{tag}_{name}")))
    out = place(place(out, F.date_sub("first_date", 1), "before"), F.col("last_date"), "until").drop("date")
    total = days.agg(F.coalesce(F.max("session"), F.lit(0)).alias(f"{tag}_total"))
    out = out.crossJoin(F.broadcast(total)).withColumns({f"{tag}_before": F.coalesce(c("before"), F.lit(0)), f"{tag}_until": F.coalesce(c("until"), F.lit(0))})
    expected = (c("until") - c("before")).cast("long")
    ends = F.greatest(c("s0") - c("before") - 1, c("until") - c("s1"))
    out = out.withColumns(
        {
            "n_dupe_dates": F.col("rows") - c("present"),
            "expected_days": expected,
            "missing_days": expected - c("on"),
            "coverage": F.when(expected > 0, F.bround(c("present") / expected, 4)).otherwise(0.0),
            "max_internal_gap": F.greatest(c("inner"), F.coalesce(ends, expected)).cast("long"),
            "real_row_ratio": F.bround(F.col("real_rows") / F.col("rows"), 4),
        }
    )
    x = F.col
    lifecycle = F.when(x("real_rows") < limits.min_history, "short_history").when(c("total") - c("until") > limits.stale, "delisted").when(x("max_internal_gap") > limits.suspended, "suspended").otherwise("active")
    tests = {
        "low_coverage": x("coverage") < limits.min_coverage,
        "long_gap": x("max_internal_gap") > limits.max_gap,
        "dupe_dates": x("n_dupe_dates") > 0,
        "nonpos_price": x("n_nonpos_price") > 0,
        "ohlc_violation": x("n_ohlc_violation") > 0,
        "halt_like_rows": x("n_halt_like") > 0,
        "extreme_returns": x("n_extreme_return") > 0,
        "fabricated_rows": x("real_row_ratio") < limits.min_real_ratio,
        "short_history": x("real_rows") < limits.min_history,
    }
    flags = F.filter(F.array(*(F.when(t, k) for k, t in tests.items())), lambda f: f.isNotNull())
    fails = (x("coverage") < 0.5) | tests["dupe_dates"] | tests["nonpos_price"] | (x("n_ohlc_violation") > x("rows") * 0.005) | tests["fabricated_rows"] | tests["short_history"]
    out = out.withColumns({"lifecycle": lifecycle, "flags": flags}).withColumn("status", F.when(fails, "fail").when(F.size("flags") > 0, "warn").otherwise("clean"))
    return out.drop(*(k for k in out.columns if k.startswith(f"{tag}_")))


def report_order(report: DataFrame) -> DataFrame:
    return report.orderBy("status", "coverage", "ticker")


def flag_counts(report: DataFrame) -> DataFrame:
    return report.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def integrity_summary(report: DataFrame) -> DataFrame:
    """(kind, name, n): tickers by status and by lifecycle, flags, and rows in all."""
    counted = lambda kind: report.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    flags = flag_counts(report).select(F.lit("flag").alias("kind"), F.col("flag").alias("name"), "n")
    total = report.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("rows").alias("name"), "n")
    return counted("status").unionByName(counted("lifecycle")).unionByName(flags).unionByName(total)


def trim_leading(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows from the first date on which a run of traded bars starts; tickers without one go.

    A traded bar is no placeholder and has volume; where no run is long enough, the first one counts.
    """
    tag = fresh(df, "_t")
    real = ((~placeholder()) & (F.coalesce("volume", F.lit(0)) > 0)).cast("int")
    df = df.withColumns({f"{tag}_real": real, f"{tag}_run": F.min(real).over(rows().rowsBetween(0, limits.sustained - 1)) == 1})
    whole = Window.partitionBy("ticker")
    first = lambda test: F.min(F.when(test, F.col("date"))).over(whole)
    start = F.coalesce(first(F.col(f"{tag}_run")), first(F.col(f"{tag}_real") == 1))
    return df.withColumn(f"{tag}_start", start).where(f"date >= {tag}_start").drop(f"{tag}_real", f"{tag}_run", f"{tag}_start")


def cleaning_stats(raw: DataFrame, trimmed: DataFrame, panel: DataFrame, audit: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per ticker of raw: rows before and after, what was trimmed, masked, filled, mended and flagged, and why it was dropped."""
    n = F.count(F.lit(1))
    out = raw.groupBy("ticker").agg(n.alias("raw_rows"), F.min("date").alias("orig_first_date"))
    left = trimmed.groupBy("ticker").agg(n.alias("kept"), F.min("date").alias("first_real_date"), F.count_if(placeholder()).alias("masked"))
    done = panel.groupBy("ticker").agg(n.alias("clean_rows"), F.count_if("is_filled").alias("gap_filled"), F.count_if("is_extreme").alias("n_extreme"), F.count_if("is_suspect").alias("n_suspect"))
    mended = audit.groupBy("ticker").agg(F.count_if(F.col("reason") == "ohlc_order_fix").alias("ohlc_fixed"), F.count_if(F.col("reason") == "nonpositive_price").alias("nonpos_fixed"))
    out = out.join(left, "ticker", "left").join(done, "ticker", "left").join(mended, "ticker", "left")
    kept = F.coalesce("kept", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    dropped = kept < limits.min_history
    return out.select(
        "ticker", "raw_rows", zero("clean_rows"), F.when(kept > 0, F.col("raw_rows") - kept).otherwise(0).alias("leading_trimmed"),
        F.when(dropped, 0).otherwise(F.coalesce("masked", F.lit(0))).alias("halt_masked"), zero("gap_filled"), zero("ohlc_fixed"), zero("nonpos_fixed"), zero("n_extreme"), zero("n_suspect"),
        "orig_first_date", "first_real_date", dropped.alias("dropped"),
        F.when(kept == 0, "no sustained real trading window").when(dropped, f"real history < {limits.min_history} days").alias("reason"),
    )


def prelisting(stats: DataFrame) -> DataFrame:
    return stats.where("leading_trimmed > 0").select("ticker", "orig_first_date", "first_real_date", "leading_trimmed", "raw_rows")


def cleaning_report(stats: DataFrame) -> DataFrame:
    """The totals of the cleaning run, one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return stats.agg(
        F.count(F.lit(1)).alias("tickers_in"), F.count_if(~F.col("dropped")).alias("tickers_kept"),
        *(total(c) for c in ("raw_rows", "clean_rows", "leading_trimmed", "halt_masked", "gap_filled", "ohlc_fixed", "nonpos_fixed", "n_extreme", "n_suspect")),
    )


def quarantined(df: DataFrame, trimmed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Tickers with too few rows after trimming, with the rows they came with and why."""
    raw = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("raw_rows"))
    left = trimmed.groupBy("ticker").agg(F.count(F.lit(1)).alias("kept"))
    kept = F.coalesce("kept", F.lit(0))
    return raw.join(left, "ticker", "left").where(kept < limits.min_history).select("ticker", "raw_rows", F.when(kept == 0, "no sustained real trading window").otherwise(f"real history < {limits.min_history} days").alias("reason"))


def enough_history(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(F.col("__n") >= limits.min_history).drop("__n")


def align(df: DataFrame, days: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per ticker and session between its ends; halts masked, short gaps filled forward."""
    spans = df.groupBy("ticker").agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    grid = spans.join(F.broadcast(days.select("date")), F.col("date").between(F.col("__a"), F.col("__b"))).select("ticker", "date")
    masked = placeholder()
    bars = df.withColumns({c: F.when(~masked, F.col(c)) for c in (*PRICES, "volume")})
    df = grid.join(bars, ["ticker", "date"], "left")
    w = rows()
    fill = {c: F.last(c, True).over(w.rowsBetween(-limits.fill, 0)) for c in PRICES}
    gap = F.greatest(*(F.col(c).isNull() for c in PRICES))
    df = df.withColumns({"is_halt": F.col("adj_close").isNull(), "__gap": gap}).withColumns(fill)
    source = F.coalesce(F.last("source", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("source", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    whole = ~F.greatest(*(F.col(c).isNull() for c in PRICES))
    return df.withColumns(
        {"is_filled": F.col("__gap") & whole, "volume": F.coalesce("volume", F.lit(0)), "dividends": F.coalesce("dividends", F.lit(0.0)), "splits": F.coalesce("splits", F.lit(0.0)), "source": source}
    ).drop("__gap")


def repair(df: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Bars with highs and lows widened to their prices and non-positive bars emptied; and the audit."""
    bad = disorder()
    low, high = F.least(*OHLC), F.greatest(*OHLC)
    pair = lambda a, b: F.format_string("%.4f/%.4f", a, b)
    order_log = df.where(bad).select("ticker", "date", F.lit("high/low").alias("field"), pair(F.col("high"), F.col("low")).alias("old"), pair(high, low).alias("new"), F.lit("ohlc_order_fix").alias("reason"))
    df = df.withColumns({"__h": F.when(bad, high).otherwise(F.col("high")), "__l": F.when(bad, low).otherwise(F.col("low"))})
    df = df.withColumns({"high": F.col("__h"), "low": F.col("__l")}).drop("__h", "__l")
    zero = F.coalesce(F.least(*PRICES) <= limits.min_price, F.lit(False)) & F.col("adj_close").isNotNull()
    zero_log = df.where(zero).select("ticker", "date", F.lit("price").alias("field"), F.lit("<=min").alias("old"), F.lit("NaN").alias("new"), F.lit("nonpositive_price").alias("reason"))
    df = df.withColumn("__z", zero).withColumns({c: F.when(~F.col("__z"), F.col(c)) for c in PRICES}).drop("__z")
    return df, order_log.unionByName(zero_log)


def returns(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Returns between rows where neither filled nor halted, with extreme and reverting ones marked."""
    x = F.col("adj_close")
    ret = F.when(~F.col("is_filled") & ~F.col("is_halt"), F.try_divide(x, F.lag(x).over(rows())) - 1)
    df = df.withColumn("ret", ret)
    nxt = F.lead("ret").over(rows())
    extreme = F.coalesce(F.abs("ret") > limits.max_return, F.lit(False))
    back = (F.signum(nxt) == -F.signum("ret")) & (F.abs(nxt) > F.abs("ret") * 0.5)
    return df.withColumns({"log_ret": F.when(F.col("ret") > -1, F.log1p("ret")), "is_extreme": extreme, "is_suspect": extreme & F.coalesce(back, F.lit(False))})


def winsorise(df: DataFrame, limits: Limits = Limits(), least: int = 20) -> DataFrame:
    """ret_winsor: ret clipped to its ticker's median and absolute deviation, with over so many returns."""
    mid = df.groupBy("ticker").agg(F.median("ret").alias("__m"), F.count("ret").alias("__n"))
    df = df.join(mid, "ticker", "left")
    mad = df.groupBy("ticker").agg((F.median(F.abs(F.col("ret") - F.col("__m"))) * 1.4826 * limits.winsor_k).alias("__d"))
    df = df.join(mad, "ticker", "left")
    clipped = F.greatest(F.least(F.col("ret"), F.col("__m") + F.col("__d")), F.col("__m") - F.col("__d"))
    value = F.when(F.col("ret").isNotNull(), F.when(F.col("__n") > least, clipped).otherwise(F.col("ret")))
    return df.withColumn("ret_winsor", value).drop("__m", "__n", "__d")


def clean(df: DataFrame, days: DataFrame, limits: Limits = Limits(), sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned panel and the audit of repaired bars.

    Of repeated (ticker, date) rows the last by the sequence column stays; without one the row of the
    greatest volume, ties by all columns.
    """
    named = df.withColumn("ticker", F.upper(F.trim("ticker")))
    once = keep_last(named, ["ticker", "date"], sequence or "volume")
    kept = enough_history(trim_leading(once.drop(sequence) if sequence else once, limits), limits)
    fixed, audit = repair(align(kept, days, limits), limits)
    return winsorise(returns(fixed, limits), limits), audit


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, some put together to LOOKED_UP rows."""
    few = []
    for batch in batches:
        few.append(batch)
        if sum(map(len, few)) >= LOOKED_UP:
            yield pa.concat_batches(few)
            few = []
    if few:
        yield pa.concat_batches(few)


def _spread(names: list[str]):
    """From rows (date, ticker, mean) in order of date: a row for each date, with a column for each name."""

    def spread(batches):
        import pyarrow.compute as pc

        most = max(1, CELLS // max(1, len(names)))
        days, at, places, means = [], np.empty(0, np.int64), np.empty(0, np.int64), None

        def rows(lo, hi):
            """The dates lo to hi - 1; the cells of a column lie side by side."""
            a, b = np.searchsorted(at, [lo, hi])
            of = np.full(len(names) * (hi - lo), -1)
            of[places[a:b] * (hi - lo) + at[a:b] - lo] = np.arange(a, b)
            cells = means.take(pa.array(of, mask=of < 0))
            columns = [cells.slice(j * (hi - lo), hi - lo) for j in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(days[lo:hi], kind), *columns], ["date", *names])

        for batch in _gathered(batches):
            coded = batch.column("date").dictionary_encode("encode")
            kind, found = batch.column("date").type, coded.dictionary.to_pylist()
            again = bool(days) and found[0] == days[-1]
            row = coded.indices.to_numpy().astype(np.int64) + len(days) - again
            days += found[again:]
            ticker = batch.column("ticker")
            place = pc.fill_null(pc.index_in(ticker, value_set=pa.array(names, ticker.type), skip_nulls=True), -1).to_numpy()
            known = place >= 0
            mean = batch.column("mean").filter(pa.array(known))
            at, places = np.concatenate([at, row[known]]), np.concatenate([places, place[known]])
            means = mean if means is None else pa.concat_arrays([means, mean])
            done = (len(days) - 1) // most * most
            yield from (rows(i, i + most) for i in range(0, done, most))
            if done:
                a = np.searchsorted(at, done)
                days, at, places, means = days[done:], at[a:] - done, places[a:], pa.concat_arrays([means[a:]])
        if days:
            yield rows(0, len(days))

    return spread


def wide(panel: DataFrame, names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """A column of prices for each of the tickers named, by default for every ticker; rounded to digits, if given.

    Tasks of Python fill the columns, so that the plan has the names once and no expression for each.
    """
    ticker = F.col("ticker").cast("string").alias("ticker")
    if names is None:
        names = [r.ticker for r in panel.select(ticker).where("ticker IS NOT NULL").distinct().orderBy("ticker").collect()]
    mean = F.avg("adj_close") if digits is None else F.round(F.avg("adj_close"), digits)
    means = panel.groupBy("date", ticker).agg(mean.alias("mean"))
    kinds = dict(zip(means.columns, means.schema.fields))
    schema = StructType([kinds["date"], *(StructField(str(n), kinds["mean"].dataType) for n in names)])
    return means.repartition("date").sortWithinPartitions("date").mapInArrow(_spread([str(n) for n in names]), schema)


def reconcile(left: DataFrame, right: DataFrame, least: int = 30) -> DataFrame:
    """Two vendors' closes compared for every ticker of left on their common dates."""
    both = left.select("ticker", "date", F.col("close").alias("__y")).join(right.select("ticker", "date", F.col("close").alias("__s")), ["ticker", "date"]).dropna()
    step = lambda c: F.try_divide(F.col(c), F.lag(c).over(rows())) - 1
    both = both.withColumns({"pct": F.abs(F.try_divide(F.col("__y"), F.col("__s")) - 1), "ry": step("__y"), "rs": step("__s")})
    out = both.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("overlap_days"),
        corr_of(F.col("ry"), F.col("rs")).alias("__corr"),
        F.bround(F.median("pct"), 5).alias("median_abs_pct"),
        F.bround(F.max("pct"), 4).alias("max_abs_pct"),
        F.count_if(F.col("pct") > 0.02).alias("n_days_gt_2pct"),
        F.max_by("date", F.struct("pct", -F.unix_date("date"))).alias("worst_date"),
    )
    has = right.select("ticker").distinct().withColumn("__alt", F.lit(True))
    out = left.select("ticker").distinct().join(out, "ticker", "left").join(has, "ticker", "left")
    n = F.coalesce("overlap_days", F.lit(0))
    warn = F.coalesce(F.col("__corr") < 0.9, F.lit(False)) | (F.col("n_days_gt_2pct") > n * 0.02) | (F.col("median_abs_pct") > 0.01)
    status = F.when(F.col("__alt").isNull(), "no_alt_source").when(n < least, "insufficient_overlap").when(F.col("median_abs_pct") > 0.05, "mismatch").when(warn, "warn").otherwise("ok")
    enough = lambda c: F.when(n >= least, c)
    return out.select("ticker", n.alias("overlap_days"), status.alias("status"), enough(F.bround("__corr", 4)).alias("return_corr"), *(enough(F.col(c)).alias(c) for c in ("median_abs_pct", "max_abs_pct", "n_days_gt_2pct", "worst_date")))


def reconcile_sample(left: DataFrame, right: DataFrame, sample: int | None = 60, tickers: list[str] | None = None, least: int = 30) -> DataFrame:
    """reconcile over the named tickers, or over an even sample of left's (all if sample is 0 or None)."""
    if tickers is not None:
        left = left.where(F.col("ticker").isin(tickers))
    elif sample:
        left = left.join(even_sample(left, "ticker", sample), "ticker", "left_semi")
    return reconcile(left, right, least)
