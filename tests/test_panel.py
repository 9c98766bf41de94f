import datetime
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillpanel.functions.rolling import Ewm, average_rank, ewm, kurt, skew
from quillpanel.operators import features, indicators, membership, quality, reduction, signals
from quillpanel.plans import queries
from quillpanel.sources import bars, store
from quillpanel.streaming.bars import stream_bars

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=int(i))


def series(spark, values, ticker="A", **more):
    frame = pd.DataFrame({"ticker": ticker, "date": [day(i) for i in range(len(values))], "x": values})
    rows = [(t, d, None if v is None or math.isnan(v) else float(v)) for t, d, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "ticker string, date date, x double")


def bar_rows(spark, rows):
    """rows of (ticker, day number, open, high, low, close, volume)"""
    made = [(day(d), o, h, lo, c, c, v, 0.0, 0.0, t, "test") for t, d, o, h, lo, c, v in rows]
    return spark.createDataFrame(made, "date date, open double, high double, low double, close double, adj_close double, volume long, dividends double, splits double, ticker string, source string")


def walk(spark, n, seed=1, ticker="A"):
    g = np.random.default_rng(seed)
    p = 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))
    return bar_rows(spark, [(ticker, i, float(x), float(x * 1.01), float(x * 0.99), float(x * 1.001), 1000 + i) for i, x in enumerate(p)])


@pytest.mark.parametrize("alphas", [(1 / 14, 2 / 13, 0.2, 2 / 3, 0.95), (1 / 14,), (0.9,)])
def test_ewm_with_gaps_of_any_length(spark, alphas):
    g = np.random.default_rng(3)
    x = np.where(g.random(10_000) < 0.1, np.nan, g.normal(50, 9, 10_000))
    for start, gap in ((0, 3), (100, 1), (200, 50), (400, 200), (900, 600), (2000, 2000)):
        x[start : start + gap] = np.nan
    got = ewm(series(spark, x), [Ewm(f"y{i}", "x", a, 9) for i, a in enumerate(alphas)]).orderBy("date").toPandas()
    for i, a in enumerate(alphas):
        want = pd.Series(x).ewm(alpha=a, adjust=False, min_periods=9).mean()
        assert (got[f"y{i}"].isna() == want.isna()).all()
        np.testing.assert_allclose(got[f"y{i}"].dropna(), want.dropna(), rtol=1e-9)


def test_a_constant_stays_after_a_long_gap(spark):
    got = ewm(series(spark, [10.0] * 30 + [math.nan] * 700 + [10.0] * 30), [Ewm("y", "x", 0.2, 1)]).toPandas()["y"]
    np.testing.assert_allclose(got, 10.0)


def test_shape_of_windows(spark):
    x = np.r_[np.full(25, 2.0), np.random.default_rng(1).normal(size=40)]
    w = series(spark, x).select("date", skew(F.col("x"), 20).alias("s"), kurt(F.col("x"), 20).alias("k")).orderBy("date").toPandas()
    np.testing.assert_allclose(w["s"][45:], pd.Series(x).rolling(20).skew()[45:], rtol=1e-6)
    np.testing.assert_allclose(w["k"][45:], pd.Series(x).rolling(20).kurt()[45:], rtol=1e-6)
    assert (w["s"][20], w["k"][20]) == (0.0, -3.0) and w["s"][:19].isna().all()


def test_ties_share_their_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0)], "g string, x double")
    assert sorted(r[0] for r in df.select(average_rank(F.col("x"), "g")).collect()) == [1.5, 1.5, 3.0]


def test_indicators_at_their_first_rows(spark):
    rising = bar_rows(spark, [("A", i, i + 1.0, i + 1.0, i + 1.0, i + 1.0, 5) for i in range(40)])
    got = indicators.add_indicators(rising).orderBy("date").toPandas()
    assert got["rsi14"][:14].isna().all() and (got["rsi14"][14:] == 100).all()
    assert got["macd_signal"].first_valid_index() == 33 and got["macd"].first_valid_index() == 25
    assert got["ma20"][19] == 10.5 and got["atr14"].first_valid_index() == 13


def test_features_do_not_look_ahead(spark):
    whole = walk(spark, 300)
    part = whole.where(F.col("date") <= day(280))
    names = list(features.LAGS)
    assert len(names) == 35 and len(features.feature_names()) == 48
    a, b = (features.lag_features(d).where(F.col("date") == day(280)).select(names).toPandas() for d in (whole, part))
    pd.testing.assert_frame_equal(a, b)


def test_as_of_takes_whole_rows(spark):
    left = spark.createDataFrame([("A", day(0)), ("A", day(3)), ("B", day(3)), ("A", day(5))], "ticker string, date date")
    right = spark.createDataFrame([(day(1), 1.0, 2.0), (day(5), None, 3.0)], "date date, u double, v double")
    got = {(r.ticker, r.date): (r.u, r.v) for r in features.as_of(left, right).collect()}
    assert got == {("A", day(0)): (None, None), ("A", day(3)): (1.0, 2.0), ("B", day(3)): (1.0, 2.0), ("A", day(5)): (None, 3.0)}


def test_labels_and_purged_split(spark):
    got = features.attach_labels(walk(spark, 100)).orderBy("date").toPandas()
    assert got["label_up_5"][-5:].isna().all() and got["label_up_5"][:-5].notna().all()
    split = features.purged_split(walk(spark, 100)).groupBy("split").agg(F.min("date"), F.max("date")).collect()
    spans = {r[0]: r[1:] for r in split}
    assert spans["train"][1] == day(49) and spans["test"][0] == day(70)


def test_ic_needs_enough_names(spark):
    rows = [(f"T{i:02d}", day(d), float(i), float(i)) for d, n in ((0, 20), (1, 19)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, date date, rsi14 double, fwd_ret_1 double")
    got = signals.daily_ic(df, ("rsi14",), (1,)).collect()
    assert [(r.date, r.n_names, round(r.ic, 9)) for r in got] == [(day(0), 20, 1.0)]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.5, 30.0, 70.0, 100.0)], "x double")
    got = [r[0] for r in df.select(signals.interval(F.col("x"), range(0, 101, 10))).collect()]
    assert got == [None, "(0, 10]", "(10, 20]", "(20, 30]", "(60, 70]", "(90, 100]"]


def test_integrity_counts_faults(spark):
    rows = [("A", d, 10.0, 11.0, 9.0, 10.0, 5) for d in range(70) if d not in (20, 21, 22)]
    rows += [("B", d, 10.0, 11.0, 9.0, 10.0 if d != 30 else 20.0, 5) for d in range(70)]
    rows += [("C", d, 5.0, 5.0, 5.0, 5.0, 0) for d in range(70)]
    df = bar_rows(spark, rows)
    got = {r.ticker: r for r in quality.integrity(df, quality.calendar(df)).collect()}
    assert (got["A"].missing_days, got["A"].max_internal_gap, got["A"].status, got["A"].flags) == (3, 3, "clean", [])
    assert got["B"].n_ohlc_violation == 1 and got["B"].n_extreme_return == 2 and got["B"].status == "fail"
    assert got["C"].n_halt_like == 70 and got["C"].lifecycle == "short_history" and got["C"].status == "fail"


def test_clean_trims_fills_and_repairs(spark):
    rows = [("a ", d, 50.0, 50.0, 50.0, 50.0, 0) for d in range(5)]
    rows += [("a ", d, 10.0, 11.0, 9.0, 10.0, 5) for d in range(5, 90) if not 30 <= d < 38]
    rows += [("b", d, 10.0, 8.0 if d == 10 else 11.0, 9.0, 10.0, 5) for d in range(90)]
    df = bar_rows(spark, rows)
    panel, audit = quality.clean(df, quality.calendar(df))
    got = {(r.ticker, r.date): r for r in panel.collect()}
    assert ("A", day(4)) not in got and got["A", day(34)].is_filled and got["A", day(34)].close == 10.0
    assert got["A", day(35)].close is None and got["A", day(35)].is_halt and not got["A", day(35)].is_filled
    assert got["B", day(10)].high == 10.0 and [r.reason for r in audit.collect()] == ["ohlc_order_fix"]


def test_membership_reverses_changes(spark):
    changes = spark.createDataFrame([(day(5), "N", "O"), (day(8), None, "P"), (day(9), "Q", "")], "date date, added string, removed string")
    current = spark.createDataFrame([("N",), ("Q",), ("S",)], "ticker string")
    asked = spark.createDataFrame([(day(4),), (day(5),), (day(9),)], "date date")
    got = {}
    for r in membership.members_on(changes, current, asked).collect():
        got.setdefault(r.date, set()).add(r.ticker)
    assert got == {day(4): {"O", "P", "S"}, day(5): {"N", "P", "S"}, day(9): {"N", "Q", "S"}}


def test_reconcile_statuses(spark):
    a = walk(spark, 60, 1, "A").unionByName(walk(spark, 60, 2, "B")).unionByName(walk(spark, 10, 3, "C")).unionByName(walk(spark, 40, 4, "D"))
    b = a.where("ticker <> 'D'").withColumn("close", F.when(F.col("ticker") == "B", F.col("close") * 1.2).otherwise(F.col("close")))
    got = {r.ticker: r.status for r in quality.reconcile(a, b).collect()}
    assert got == {"A": "ok", "B": "mismatch", "C": "insufficient_overlap", "D": "no_alt_source"}


def test_prune_and_components(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x + 0.01 * g.normal(size=500), "z": g.normal(size=500)}))
    kept, dropped = reduction.prune(df, ["x", "y", "z"])
    assert kept == ["x", "z"] and dropped[0][:2] == ("y", "x")
    mean, scale, ratio, loadings = reduction.principal_components(df, ["x", "y", "z"])
    z = (df.toPandas()[["x", "y", "z"]].to_numpy() - mean) / scale
    np.testing.assert_allclose(ratio, (np.linalg.svd(z, compute_uv=False) ** 2 / (z**2).sum())[: len(ratio)], rtol=1e-8)


def test_standardise_keeps_the_last_row(spark):
    raw = spark.createDataFrame([("a", "2020-01-01", "1", "2", "0", "1", "10.5", 1), ("A ", "2020-01-01", "x", "3", "1", "2", "11.5", 2), ("A", "2020-01-02", None, None, "-", None, "1", 3)], "Ticker string, Date string, Open string, High string, Low string, Close string, Volume string, seq int")
    got = bars.standardise(raw, "v").collect()
    assert len(got) == 1 and got[0].open is None and got[0].adj_close == 2.0 and got[0].volume == 12 and got[0].splits == 0.0


def test_splits_and_an_unnamed_date(spark):
    raw = spark.createDataFrame([("2020-01-01", "a", 1.0, 1.0, 1.0, 1.0, 5, 2.0, 1)], "When string, Ticker string, Open double, High double, Low double, Close double, Volume long, `Stock Splits` double, seq int")
    got = bars.standardise(raw, "v").collect()[0]
    assert (got.date, got.splits, got.dividends) == (DAY, 2.0, 0.0)
    with pytest.raises(ValueError):
        bars.standardise(raw.drop("seq"), "v")


def test_store(spark, tmp_path):
    df = walk(spark, 5)
    store.write(df, str(tmp_path / "t"), "ticker")
    assert store.read(spark, str(tmp_path / "t"), ["date", "close"]).count() == 5
    asked = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    assert [r.ticker for r in store.missing(asked, df).collect()] == ["Z"]
    assert {r.ticker: (r.status, r.n_rows) for r in store.manifest(asked, df).collect()} == {"A": ("ok", 5), "Z": ("empty", 0)}
    assert all(len(r.sha256) == 64 for r in store.snapshot(spark, str(tmp_path / "t")).where("file like '%parquet'").collect())


def test_stream_bars_on_a_batch(spark):
    t = datetime.datetime(2020, 1, 1, 9)
    df = spark.createDataFrame([("A", t, 1.0, 2), ("A", t + datetime.timedelta(hours=1), 3.0, 4)], "ticker string, ts timestamp, price double, size long")
    r = stream_bars(df).collect()[0]
    assert (r.open, r.high, r.low, r.close, r.volume) == (1.0, 3.0, 1.0, 3.0, 6)


def test_every_ticker_has_its_column(spark):
    path = "/root/testdata/sf0.001"
    got = queries.queries()["panel_wide_pivot"](spark, path)
    tickers = {r.ticker for r in bars.weekly_bars(spark, path).select("ticker").distinct().collect()}
    assert len(tickers) > 3 and set(got.columns) == {"date", *tickers}
    cells = got.select(sum(F.count(f"`{t}`") for t in tickers)).first()[0]
    assert cells == bars.weekly_bars(spark, path).count()


def test_wide_plan_has_no_expression_for_each_ticker(spark):
    def compound(node):
        own, below = node.expressions(), node.children()
        return sum(own.apply(i).children().size() > 0 for i in range(own.size())) + sum(compound(below.apply(i)) for i in range(below.size()))

    panel = spark.range(400).selectExpr("date'2020-01-01' AS date", "cast(id AS string) AS ticker", "cast(id AS double) AS adj_close")
    got = quality.wide(panel, digits=2)
    assert compound(got._jdf.queryExecution().optimizedPlan()) < 40
    assert got.first().asDict() == {"date": DAY, **{str(i): float(i) for i in range(400)}}


def test_wide_keeps_dates_without_prices(spark):
    rows = [("B", day(0), 1.0), ("B", day(0), 2.0), ("A", day(1), math.nan), ("A", None, 3.0), (None, day(2), 4.0), ("B", day(1), None), ("C", day(3), 0.126)]
    panel = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    whole = {r.date: tuple(r)[1:] for r in quality.wide(panel, digits=2).collect()}
    assert str(whole.pop(day(1))) == "(nan, None, None)"
    assert whole == {day(0): (None, 1.5, None), None: (3.0, None, None), day(2): (None, None, None), day(3): (None, None, 0.13)}
    named = quality.wide(panel, ["Z", "A"])
    assert named.columns == ["date", "Z", "A"] and {(r.date, r.Z, str(r.A)) for r in named.collect()} == {(day(0), None, "None"), (day(1), None, "nan"), (day(2), None, "None"), (day(3), None, "None"), (None, None, "3.0")}
    assert quality.wide(panel.limit(0)).columns == ["date"]


@pytest.mark.parametrize("cells, rows", [(1, 1), (12, 5), (40, 64)])
def test_wide_rows_do_not_depend_on_batches(monkeypatch, cells, rows):
    monkeypatch.setattr(quality, "CELLS", cells)
    monkeypatch.setattr(quality, "LOOKED_UP", rows)
    g, names = np.random.default_rng(1), list("abcdef")
    table = [(d, t, float(g.random())) for d in [None, *map(day, range(30))] for t in [*names, "other", None] if g.random() < 0.4]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table[i : i + 7]), (pa.date32(), pa.string(), pa.float64()))], ["date", "ticker", "mean"]) for i in range(0, len(table), 7)]
    got = pa.Table.from_batches(quality._spread(names)(iter(batches))).to_pylist()
    dates = list(dict.fromkeys(d for d, *_ in table))
    of = {(d, t): x for d, t, x in table}
    assert got == [{"date": d, **{n: of.get((d, n)) for n in names}} for d in dates]


def test_snapshot_has_every_file_with_its_rows(spark):
    path = "/root/testdata/sf0.001"
    got = {r.file: (r.rows, r.bytes) for r in queries.queries()["snapshot"](spark, path).collect()}
    files = {str(f.relative_to(path)): f for f in Path(path).rglob("*.parquet")}
    assert got == {k: (spark.read.parquet(str(f)).count(), f.stat().st_size) for k, f in files.items()}


def test_feature_matrix_has_every_feature(spark):
    got = queries.queries()["feature_matrix"](spark, "/root/testdata/sf0.001")
    assert set(features.feature_names()) <= set(got.columns)
