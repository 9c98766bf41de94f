"""Model features: lags, ranges, volume, macro series as of a date, labels and the purged split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import EPS, change, fresh, last_n, mean, rows, std

#: Corrections of the moments of 20 values for their bias.
SKEW_20, KURT_20 = (20 * 19) ** 0.5 / 18, 19 / (18 * 17)
HORIZONS = (1, 5, 20)
MACRO = ("vix", "vix_chg", "vix_z", "tnx10y", "tnx_chg", "term_spread", "spx_ret_1", "spx_vol_20", "spx_ma_gap")
INDICATORS = ("rsi14", "macd_hist_norm", "bb_pctb", "bb_width")


#: The lag features' windows of returns, volatility, extremes and averages.
RETURNS, SPREADS, RANGES, GAPS, VOLUMES = (1, 5, 10, 20, 60), (5, 10, 20, 60), (20, 60), (5, 20, 60), (5, 20)


def _names() -> list[str]:
    out = [*(f"roc_{n}" for n in RETURNS), "mom_12_1", *(f"vol_{n}" for n in SPREADS), "vol_regime", "skew_20", "kurt_20"]
    out += ["kmid", "klen", "kmid2", "kup", "klow", "ksft", *(f"ma_gap_{n}" for n in GAPS)]
    out += [f"{k}_{n}" for n in RANGES for k in ("rsv", "higap", "logap")]
    return [*out, "cntp_20", "cntd_20", *(f"vratio_{n}" for n in VOLUMES), "dollar_vol", "amihud_20", "corr_pv_20"]


#: Names of the lag features, in order.
LAGS = tuple(_names())


def lag_features(df: DataFrame) -> DataFrame:
    """df with every lag feature.

    Each window is evaluated once, into a helper column; whether a window is full is known from the
    rows since the last null, a running value, and not counted again for each frame.
    """
    tag = fresh(df, "_lag")
    c = lambda k: F.col(f"{tag}_{k}")
    add = lambda df, columns: df.withColumns({f"{tag}_{k}": v for k, v in columns.items()})
    x, o, h, low, close = (F.col(k) for k in ("adj_close", "open", "high", "low", "close"))
    v, w = F.col("volume").cast("double"), rows()
    df = add(df, {"ret": change(x), "v": v, "lv": F.ln(v + 1), "row": F.row_number().over(w)})
    df = add(df, {"up": F.coalesce(c("ret") > 0, F.lit(False)).cast("double"), "down": F.coalesce(c("ret") < 0, F.lit(False)).cast("double"), "ill": F.abs(c("ret")) / (close * v + EPS)})
    since = w.rowsBetween(Window.unboundedPreceding, 0)
    watched = {"ret": c("ret"), "x": x, "v": c("v"), "ill": c("ill"), "pv": x + c("lv")}
    over = lambda f, n: f.over(last_n(n, w))
    base = {f"since_{k}": c("row") - F.coalesce(F.last(F.when(e.isNull(), c("row")), True).over(since), F.lit(0)) for k, e in watched.items()}
    base |= {f"back_{n}": F.lag(x, n).over(w) for n in (*RETURNS[1:], 21, 252)}
    base |= {f"sd_{n}": over(F.stddev_samp(c("ret")), n) for n in SPREADS}
    base |= {f"mean_{n}": over(F.avg(x), n) for n in GAPS} | {f"vol_{n}": over(F.avg(c("v")), n) for n in VOLUMES}
    base |= {f"low_{n}": over(F.min(x), n) for n in RANGES} | {f"high_{n}": over(F.max(x), n) for n in RANGES}
    base |= {"skew": over(F.skewness(c("ret")), 20), "kurt": over(F.kurtosis(c("ret")), 20), "least": over(F.min(c("ret")), 20), "most": over(F.max(c("ret")), 20)}
    base |= {"ups": over(F.avg(c("up")), 20), "downs": over(F.avg(c("down")), 20), "ills": over(F.avg(c("ill")), 20)}
    base |= {"cov": over(F.covar_pop(x, c("lv")), 20), "sdx": over(F.stddev_pop(x), 20), "sdv": over(F.stddev_pop(c("lv")), 20)}
    df = add(df, base)

    full = lambda k, n, value: F.when(c(f"since_{k}") >= n, value)
    both = o.isNotNull() & close.isNotNull()
    top, bottom, span = F.when(both, F.greatest(o, close)), F.when(both, F.least(o, close)), h - low + EPS
    sd = {n: full("ret", n, c(f"sd_{n}")) for n in SPREADS}
    flat = c("least") == c("most")
    out = {"roc_1": c("ret")} | {f"roc_{n}": F.try_divide(x, c(f"back_{n}")) - 1 for n in RETURNS[1:]}
    out["mom_12_1"] = F.try_divide(c("back_21"), c("back_252")) - 1
    out |= {f"vol_{n}": sd[n] for n in SPREADS} | {"vol_regime": sd[5] / (sd[20] + EPS)}
    out["skew_20"] = full("ret", 20, F.when(flat, 0.0).otherwise(c("skew") * SKEW_20))
    out["kurt_20"] = full("ret", 20, F.when(flat, -3.0).otherwise((c("kurt") * 21 + 6) * KURT_20))
    out |= {"kmid": (close - o) / (o + EPS), "klen": (h - low) / (o + EPS), "kmid2": (close - o) / span}
    out |= {"kup": (h - top) / (o + EPS), "klow": (bottom - low) / (o + EPS), "ksft": (2 * close - h - low) / (o + EPS)}
    out |= {f"ma_gap_{n}": full("x", n, F.try_divide(x, c(f"mean_{n}")) - 1) for n in GAPS}
    for n in RANGES:
        least, most = c(f"low_{n}"), c(f"high_{n}")
        out |= {f"rsv_{n}": full("x", n, (x - least) / (most - least + EPS)), f"higap_{n}": full("x", n, F.try_divide(most, x) - 1), f"logap_{n}": full("x", n, F.try_divide(least, x) - 1)}
    out["cntp_20"] = F.when(c("row") >= 20, c("ups"))
    out["cntd_20"] = F.when(c("row") >= 20, c("ups") - c("downs"))
    out |= {f"vratio_{n}": full("v", n, c("v") / (c(f"vol_{n}") + EPS)) for n in VOLUMES}
    out["dollar_vol"] = F.ln(close * v + 1)
    out["amihud_20"] = full("ill", 20, c("ills") * 1e9)
    out["corr_pv_20"] = full("pv", 20, F.try_divide(c("cov"), c("sdx") * c("sdv")))
    df = df.withColumns({k: out[k] for k in LAGS})
    return df.drop(*(k for k in df.columns if k.startswith(f"{tag}_")))


def macro_features(macro: DataFrame) -> DataFrame:
    """Nine columns of the four series, gaps filled forward. A market's dates fit one task."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    names = ("vix", "spx", "tnx10y", "irx13w")
    macro = macro.select("date", *((F.last(n, True).over(so_far) if n in macro.columns else F.lit(None).cast("double")).alias(n) for n in names))
    vix, spx, long, short = (F.col(n) for n in names)
    macro = macro.withColumn("__ret", change(spx, 1, w))
    return macro.select(
        "date",
        "vix",
        (vix - F.lag(vix).over(w)).alias("vix_chg"),
        F.try_divide(vix - mean(vix, 252, w), std(vix, 252, 1, w)).alias("vix_z"),
        "tnx10y",
        (long - F.lag(long).over(w)).alias("tnx_chg"),
        (long - short).alias("term_spread"),
        F.col("__ret").alias("spx_ret_1"),
        std(F.col("__ret"), 20, 1, w).alias("spx_vol_20"),
        (F.try_divide(spx, mean(spx, 50, w)) - 1).alias("spx_ma_gap"),
    )


#: Rows of the right side of an as-of join that may be broadcast.
AS_OF_ROWS = 200_000


def as_of(left: DataFrame, right: DataFrame, on: str = "date") -> DataFrame:
    """left with the columns of right's latest row at or before each row's date, nulls within it kept.

    right has one row a date. Its rows become intervals up to the next one's date; left is read once.
    Up to AS_OF_ROWS intervals (counted) are broadcast as a sorted array of a single row that each row
    of left searches; beyond, both sides meet by calendar year, into which intervals are cut.
    """
    tag = fresh(left, "_asof")
    rest = [c for c in right.columns if c != on]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias(f"{tag}_row")
    known = right.where(F.col(on).isNotNull())
    if known.limit(AS_OF_ROWS + 1).count() <= AS_OF_ROWS:
        w = Window.partitionBy(F.lit(0)).orderBy(on)
        spans = known.select(F.col(on).alias(f"{tag}_from"), F.lead(on).over(w).alias(f"{tag}_to"), row)
        # One day of the calendar is one row: an equi-join on days, not a nested loop.
        days = F.sequence(f"{tag}_from", F.coalesce(F.date_sub(f"{tag}_to", 1), F.col(f"{tag}_from")))
        last = F.col(f"{tag}_to").isNull()
        by_day = F.broadcast(spans.select(F.explode(days).alias(on), f"{tag}_row"))
        tail = F.broadcast(spans.where(last).select(F.col(f"{tag}_from").alias(f"{tag}_end"), F.col(f"{tag}_row").alias(f"{tag}_late")))
        out = left.join(by_day, on, "left").join(tail, F.col(on) > F.col(f"{tag}_end"), "left")
        found = F.coalesce(f"{tag}_row", f"{tag}_late")
    else:
        year = f"{tag}_year"
        cut = known.withColumn(year, F.year(on)).select(year, on, row)
        asked = left.withColumn(year, F.year(on)).withColumn(f"{tag}_ask", F.lit(1))
        w = Window.partitionBy(year).orderBy(on, f"{tag}_ask").rowsBetween(Window.unboundedPreceding, 0)
        # The last row of each earlier year stands at the start of the next ones, one row a year.
        ends = cut.groupBy(year).agg(F.max_by(f"{tag}_row", on).alias(f"{tag}_carry"))
        years = asked.select(year).distinct()
        carry = years.join(F.broadcast(ends.withColumnRenamed(year, f"{tag}_y")), F.col(f"{tag}_y") < F.col(year)).groupBy(year).agg(F.max_by(f"{tag}_carry", f"{tag}_y").alias(f"{tag}_carry"))
        both = asked.unionByName(cut.withColumn(f"{tag}_ask", F.lit(0)), allowMissingColumns=True)
        out = both.withColumn(f"{tag}_row", F.last(f"{tag}_row", True).over(w)).where(f"{tag}_ask = 1").join(F.broadcast(carry), year, "left")
        found = F.coalesce(f"{tag}_row", f"{tag}_carry")
    return out.withColumn(f"{tag}_found", found).select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"{tag}_found")[c].alias(c) for c in rest))


def forward_returns(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    x = F.col("adj_close")
    return df.withColumns({f"fwd_ret_{h}": F.try_divide(F.lead(x, h).over(rows()), x) - 1 for h in horizons})


def attach_labels(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    df = forward_returns(df, horizons)
    return df.withColumns({f"label_up_{h}": (F.col(f"fwd_ret_{h}") > 0).cast("byte") for h in horizons})


def feature_names() -> list[str]:
    return [*LAGS, *MACRO, *INDICATORS]


def build_matrix(indicators: DataFrame, macro: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Features and labels; rows that lack a feature go, rows that lack a label stay."""
    names = names or feature_names()
    df = as_of(attach_labels(lag_features(indicators)), macro_features(macro))
    labels = [f"{p}_{h}" for p in ("fwd_ret", "label_up") for h in HORIZONS]
    return df.select("ticker", "date", *names, *labels).dropna(subset=names)


def purged_split(df: DataFrame, fraction: float = 0.7, embargo: int = max(HORIZONS) + 1) -> DataFrame:
    """df with split: train, test, or null for the embargoed dates between them."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = df.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    cut = F.floor(F.col("n") * fraction)
    side = F.when(F.col("i") >= cut, "test").when(F.col("i") <= F.greatest(cut - embargo, F.lit(0)), "train")
    return df.join(days.select("date", side.alias("split")), "date", "left")
