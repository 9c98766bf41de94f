"""DuckDB's SQL for the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

from ..operators.features import INDICATORS, MACRO, feature_names
from .queries import ABOVE, DIGITS, END, LIMITS, START

BARS = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         first(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY ALL)"""
DAILY = """bars AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open,
         max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events GROUP BY ALL)"""
RAW = DAILY.replace("bars AS", "plain AS", 1) + """,
cut AS (SELECT * FROM (SELECT *, CAST(ticker AS BIGINT) AS u, day(date) AS d FROM plain) WHERE NOT (u % 13 = 0 AND d > 6) AND NOT (u % 6 = 1 AND d BETWEEN 10 AND 16)),
made AS (SELECT *, CASE WHEN (u + d) % 41 = 0 THEN 0.0::DOUBLE ELSE close END AS c, CASE WHEN (u * 3 + d) % 11 = 0 THEN low * 0.9::DOUBLE ELSE high END AS h, (u % 5 = 0 AND d <= 4) OR (u + d) % 9 = 0 AS flat FROM cut),
once AS (SELECT ticker, date, CASE WHEN flat THEN c ELSE open END AS open, CASE WHEN flat THEN c ELSE h END AS high, CASE WHEN flat THEN c ELSE low END AS low, c AS close, CASE WHEN flat THEN 0 ELSE volume END AS volume, u, d FROM made),
faulty AS (SELECT ticker, date, open, high, low, close, volume, 0 AS seq FROM once UNION ALL SELECT ticker, date, open, high, low, close, volume + 10, 1 FROM once WHERE (u + d) % 23 = 0),
bars AS (SELECT ticker, date, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS place FROM faulty) WHERE place = 1)"""
SERIES = """macro AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
         avg(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS vix, avg(o_totalprice) FILTER (o_orderpriority LIKE '2%') AS spx,
         avg(o_totalprice) FILTER (o_orderpriority LIKE '3%') AS tnx10y, avg(o_totalprice) FILTER (o_orderpriority LIKE '4%') AS irx13w
  FROM orders GROUP BY ALL)"""
CALENDAR = "days AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM bars GROUP BY date HAVING count(DISTINCT ticker) >= 0.5 * (SELECT count(DISTINCT ticker) FROM bars))"
W = "PARTITION BY ticker ORDER BY date"


def r(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) AS {name}"


def over(f: str, n: int, x: str = "close") -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"


def smooth(x: str, alpha: float, name: str) -> str:
    """One step of the recursion over rows whose gaps, if any, all lie at the start."""
    return f"CASE WHEN s.{x} IS NULL THEN e.{name} WHEN e.{name} IS NULL THEN s.{x} ELSE {1 - alpha!r} * e.{name} + {alpha!r} * s.{x} END"


def recursion(source: str, name: str, means: dict[str, tuple[str, float]]) -> str:
    start = ", ".join(f"{x} AS {k}" for k, (x, _) in means.items())
    step = ", ".join(f"{smooth(x, a, k)}" for k, (x, a) in means.items())
    return f"""{name} AS (SELECT ticker, date, n, {start} FROM {source} WHERE n = 1 UNION ALL
  SELECT s.ticker, s.date, s.n, {step} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.n = e.n + 1)"""


NUMBERED = f"""num AS (SELECT *, row_number() OVER ({W}) AS n, close - lag(close) OVER ({W}) AS step,
  greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars),
src AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gain, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS loss FROM num)"""
EMAS = {"ema12": ("close", 2 / 13), "ema26": ("close", 2 / 27)}
LINE = "line AS (SELECT ticker, date, n, CASE WHEN n >= 26 THEN ema12 - ema26 END AS macd FROM em)"
RSI = "CASE WHEN n > 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END"
CHAIN = f"""WITH RECURSIVE {BARS}, {NUMBERED}, {recursion('src', 'em', EMAS | {'up': ('gain', 1 / 14), 'dn': ('loss', 1 / 14)})},
{LINE}, {recursion('line', 'sg', {'signal': ('macd', 0.2)})},
ind AS (SELECT bars.ticker, bars.date, bars.close, {RSI} AS rsi14,
  (bars.close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) AS bb_pctb, 4 * sd / m AS bb_width, bars.close / m - 1 AS ma20_gap, bars.close / back - 1 AS mom_20,
  CASE WHEN n >= 34 THEN macd - signal END / bars.close AS macd_hist_norm, f1 / bars.close - 1 AS fwd_ret_1, f5 / bars.close - 1 AS fwd_ret_5, f20 / bars.close - 1 AS fwd_ret_20
  FROM bars JOIN em USING (ticker, date) JOIN (SELECT ticker, date, macd FROM line) USING (ticker, date) JOIN (SELECT ticker, date, signal FROM sg) USING (ticker, date)
  JOIN (SELECT ticker, date, {over('avg', 20)} AS m, {over('stddev_pop', 20)} AS sd, lag(close, 20) OVER ({W}) AS back,
        lead(close) OVER ({W}) AS f1, lead(close, 5) OVER ({W}) AS f5, lead(close, 20) OVER ({W}) AS f20 FROM bars) USING (ticker, date))"""
PAIRS = " UNION ALL ".join(f"SELECT '{s}' AS signal, {h} AS horizon, date, {s} AS x, fwd_ret_{h} AS y FROM ind" for s in ("rsi14", "bb_pctb", "ma20_gap", "mom_20", "macd_hist_norm") for h in (1, 5, 20))
BY = "PARTITION BY signal, horizon, date"
IC = f"""{CHAIN}, pairs AS (SELECT * FROM ({PAIRS}) WHERE x IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT *, rank() OVER ({BY} ORDER BY x) + (count(*) OVER ({BY}, x) - 1) / 2.0 AS rx, rank() OVER ({BY} ORDER BY y) + (count(*) OVER ({BY}, y) - 1) / 2.0 AS ry FROM pairs),
ic AS (SELECT signal, horizon, date, count(*) AS n_names, corr(rx, ry) AS ic FROM ranked GROUP BY ALL HAVING count(*) >= 20 AND NOT isnan(corr(rx, ry)))"""


def lags() -> dict[str, str]:
    f = {f"roc_{n}": f"close / lag(close, {n}) OVER ({W}) - 1" for n in (1, 5, 10, 20, 60)}
    f["mom_12_1"] = f"lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1"
    f |= {f"vol_{n}": over("stddev_samp", n, "ret") for n in (5, 10, 20, 60)}
    f["vol_regime"] = f"({f['vol_5']}) / ({f['vol_20']} + 1e-12)"
    f |= {"skew_20": over("skewness", 20, "ret"), "kurt_20": over("kurtosis", 20, "ret")}
    f |= {"kmid": "(close - open) / (open + 1e-12)", "klen": "(high - low) / (open + 1e-12)", "kmid2": "(close - open) / (high - low + 1e-12)"}
    f |= {"kup": "(high - greatest(open, close)) / (open + 1e-12)", "klow": "(least(open, close) - low) / (open + 1e-12)", "ksft": "(2 * close - high - low) / (open + 1e-12)"}
    f |= {f"ma_gap_{n}": f"close / ({over('avg', n)}) - 1" for n in (5, 20, 60)}
    for n in (20, 60):
        f |= {f"rsv_{n}": f"(close - ({over('min', n)})) / (({over('max', n)}) - ({over('min', n)}) + 1e-12)", f"higap_{n}": f"({over('max', n)}) / close - 1", f"logap_{n}": f"({over('min', n)}) / close - 1"}
    f |= {"cntp_20": over("avg", 20, "up"), "cntd_20": f"({over('avg', 20, 'up')}) - ({over('avg', 20, 'dn')})"}
    f |= {f"vratio_{n}": f"volume / ({over('avg', n, 'volume')} + 1e-12)" for n in (5, 20)}
    f |= {"dollar_vol": "ln(close * volume + 1)", "amihud_20": f"({over('avg', 20, 'illiq')}) * 1e9"}
    w = f"OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    f["corr_pv_20"] = f"CASE WHEN count(close) {w} = 20 THEN corr(close, ln(volume + 1)) {w} END"
    return f


STEPPED = f"""stepped AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM bars),
feat AS (SELECT *, CAST(coalesce(ret > 0, false) AS DOUBLE) AS up, CAST(coalesce(ret < 0, false) AS DOUBLE) AS dn, abs(ret) / (close * volume + 1e-12) AS illiq FROM stepped)"""
FLAT = "(open = high AND high = low AND low = close AND volume = 0)"
TRIM = f"""flagged AS (SELECT *, CAST(NOT {FLAT} AND volume > 0 AS INT) AS real FROM bars),
runs AS (SELECT *, min(real) OVER ({W} ROWS BETWEEN CURRENT ROW AND {LIMITS.sustained - 1} FOLLOWING) AS run FROM flagged),
started AS (SELECT ticker, coalesce(min(date) FILTER (run = 1), min(date) FILTER (real = 1)) AS start FROM runs GROUP BY ticker),
trimmed AS (SELECT bars.*, count(*) OVER (PARTITION BY ticker) AS n FROM bars JOIN started USING (ticker) WHERE date >= start),
kept AS (SELECT * FROM trimmed WHERE n >= {LIMITS.min_history})"""
OHLC = ("open", "high", "low", "close")
TOP, BOTTOM = "greatest(open, high, low, close)", "least(open, high, low, close)"
BAD = "coalesce(greatest(low - high, open - high, close - high, low - open, low - close) > greatest(abs(close) * 1e-6, 1e-6), false)"


def filled(c: str) -> str:
    return f"coalesce(raw_{c}, {', '.join(f'lag(raw_{c}, {i}) OVER ({W})' for i in range(1, LIMITS.fill + 1))}) AS {c}"


GRID = f"""spans AS (SELECT ticker, min(date) AS a, max(date) AS b FROM kept GROUP BY ticker),
grid AS (SELECT ticker, days.date, {', '.join(f'CASE WHEN NOT {FLAT} THEN {c} END AS raw_{c}' for c in OHLC)}, CASE WHEN NOT {FLAT} THEN volume ELSE 0 END AS seen FROM spans JOIN days ON days.date BETWEEN a AND b LEFT JOIN kept USING (ticker, date)),
filled AS (SELECT ticker, date, coalesce(seen, 0) AS volume, raw_close IS NULL AS is_halt, {', '.join(map(filled, OHLC))} FROM grid),
aligned AS (SELECT *, is_halt AND close IS NOT NULL AS is_filled FROM filled),
mend AS (SELECT *, {BAD} AS bad FROM aligned),
ordered AS (SELECT * REPLACE (CASE WHEN bad THEN {TOP} ELSE high END AS high, CASE WHEN bad THEN {BOTTOM} ELSE low END AS low) FROM mend),
zeros AS (SELECT *, coalesce({BOTTOM} <= {LIMITS.min_price}, false) AND close IS NOT NULL AS zero FROM ordered),
fixed AS (SELECT * REPLACE ({', '.join(f'CASE WHEN NOT zero THEN {c} END AS {c}' for c in OHLC)}) FROM zeros),
ret AS (SELECT *, CASE WHEN NOT is_halt THEN close / nullif(lag(close) OVER ({W}), 0) - 1 END AS ret FROM fixed),
marked AS (SELECT *, coalesce(abs(ret) > {LIMITS.max_return}, false) AS is_extreme, coalesce(abs(ret) > {LIMITS.max_return} AND sign(nx) = -sign(ret) AND abs(nx) > 0.5 * abs(ret), false) AS is_suspect FROM (SELECT *, lead(ret) OVER ({W}) AS nx FROM ret))"""
WINSOR = "m AS (SELECT ticker, median(ret) AS m, count(ret) AS k FROM ret GROUP BY ticker), d AS (SELECT ticker, median(abs(ret - m)) * 1.4826 * 3 AS d FROM ret JOIN m USING (ticker) GROUP BY ticker)"
AUDIT = f"""audit AS (SELECT ticker, date, 'high/low' AS field, printf('%.4f/%.4f', high, low) AS old, printf('%.4f/%.4f', {TOP}, {BOTTOM}) AS new, 'ohlc_order_fix' AS reason FROM mend WHERE bad
UNION ALL SELECT ticker, date, 'price', '<=min', 'NaN', 'nonpositive_price' FROM zeros WHERE zero)"""
REASON = f"CASE WHEN coalesce(n, 0) = 0 THEN 'no sustained real trading window' WHEN n < {LIMITS.min_history} THEN 'real history < {LIMITS.min_history} days' END"
STATS = f"""stats AS (SELECT ticker, raw_rows, coalesce(clean_rows, 0) AS clean_rows, CASE WHEN n > 0 THEN raw_rows - n ELSE 0 END AS leading_trimmed, CASE WHEN coalesce(n, 0) < {LIMITS.min_history} THEN 0 ELSE masked END AS halt_masked,
  coalesce(gap_filled, 0) AS gap_filled, coalesce(ohlc_fixed, 0) AS ohlc_fixed, coalesce(nonpos_fixed, 0) AS nonpos_fixed, coalesce(n_extreme, 0) AS n_extreme, coalesce(n_suspect, 0) AS n_suspect,
  orig_first_date, first_real_date, coalesce(n, 0) < {LIMITS.min_history} AS dropped, {REASON} AS reason
  FROM (SELECT ticker, count(*) AS raw_rows, min(date) AS orig_first_date FROM bars GROUP BY ticker)
  LEFT JOIN (SELECT ticker, count(*) AS n, min(date) AS first_real_date, count(*) FILTER ({FLAT}) AS masked FROM trimmed GROUP BY ticker) USING (ticker)
  LEFT JOIN (SELECT ticker, count(*) AS clean_rows, count(*) FILTER (is_filled) AS gap_filled, count(*) FILTER (is_extreme) AS n_extreme, count(*) FILTER (is_suspect) AS n_suspect FROM marked GROUP BY ticker) USING (ticker)
  LEFT JOIN (SELECT ticker, count(*) FILTER (reason = 'ohlc_order_fix') AS ohlc_fixed, count(*) FILTER (reason = 'nonpositive_price') AS nonpos_fixed FROM audit GROUP BY ticker) USING (ticker))"""
FLAGS = {
    "low_coverage": f"coverage < {LIMITS.min_coverage}", "long_gap": f"max_internal_gap > {LIMITS.max_gap}", "dupe_dates": "n_dupe_dates > 0", "nonpos_price": "n_nonpos_price > 0", "ohlc_violation": "n_ohlc_violation > 0",
    "halt_like_rows": "n_halt_like > 0", "extreme_returns": "n_extreme_return > 0", "fabricated_rows": f"real_row_ratio < {LIMITS.min_real_ratio}", "short_history": f"real_rows < {LIMITS.min_history}",
}
FATAL = f"coverage < 0.5 OR n_ohlc_violation > 0.005 * rows OR {' OR '.join(FLAGS[k] for k in ('dupe_dates', 'nonpos_price', 'fabricated_rows', 'short_history'))}"
INTEGRITY = f"""stepped AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date, open, high, low, close, volume), 0) - 1) AS step FROM faulty),
counted AS (SELECT ticker, 'events' AS source, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS present, count(*) - count(DISTINCT date) AS n_dupe_dates,
  count(*) FILTER (close IS NULL) AS n_nan_close, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS n_nan_ohlcv, count(*) FILTER ({BOTTOM} <= {LIMITS.min_price}) AS n_nonpos_price,
  count(*) FILTER ({BAD}) AS n_ohlc_violation, count(*) FILTER (volume = 0) AS n_zero_volume, count(*) FILTER ({FLAT}) AS n_halt_like, count(*) FILTER (NOT {FLAT}) AS real_rows, min(date) FILTER (NOT {FLAT}) AS first_real_date,
  round_even(max(step), 4) AS max_abs_return, count(*) FILTER (step > {LIMITS.max_return}) AS n_extreme_return FROM stepped GROUP BY ticker),
wanted AS (SELECT ticker, days.date, session FROM counted JOIN days ON days.date BETWEEN first_date AND last_date),
absent AS (SELECT ticker, session, session - row_number() OVER (PARTITION BY ticker ORDER BY session) AS island FROM wanted ANTI JOIN (SELECT DISTINCT ticker, date FROM faulty) USING (ticker, date)),
gaps AS (SELECT ticker, sum(n) AS missing_days, max(n) AS max_internal_gap FROM (SELECT ticker, island, count(*) AS n FROM absent GROUP BY ALL) GROUP BY ticker),
spanned AS (SELECT ticker, count(*) AS expected_days FROM wanted GROUP BY ticker),
measured AS (SELECT * EXCLUDE (present), CASE WHEN expected_days > 0 THEN round_even(present / expected_days, 4) ELSE 0.0 END AS coverage, round_even(real_rows / rows, 4) AS real_row_ratio, (SELECT count(*) FROM days WHERE days.date > last_date) AS stale
  FROM (SELECT counted.*, coalesce(expected_days, 0) AS expected_days, CAST(coalesce(missing_days, 0) AS BIGINT) AS missing_days, coalesce(max_internal_gap, 0) AS max_internal_gap FROM counted LEFT JOIN gaps USING (ticker) LEFT JOIN spanned USING (ticker))),
report AS (SELECT * EXCLUDE (stale), CASE WHEN real_rows < {LIMITS.min_history} THEN 'short_history' WHEN stale > {LIMITS.stale} THEN 'delisted' WHEN max_internal_gap > {LIMITS.suspended} THEN 'suspended' ELSE 'active' END AS lifecycle,
  concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in FLAGS.items())}) AS flags, CASE WHEN {FATAL} THEN 'fail' WHEN {' OR '.join(FLAGS.values())} THEN 'warn' ELSE 'clean' END AS status FROM measured)"""
COUNTED_FLAGS = "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM report) WHERE flag <> '' GROUP BY flag"


def aged(source: str, name: str, means: dict[str, tuple[str, float]]) -> str:
    """The recursion over rows with gaps: each mean ages by the rows since its last observation."""
    start = ", ".join(f"{x} AS {k}, 1 AS {k}_age" for k, (x, _) in means.items())

    def step(x: str, a: float, k: str) -> str:
        left = f"pow({1 - a!r}, e.{k}_age)"
        value = f"CASE WHEN s.{x} IS NULL THEN e.{k} WHEN e.{k} IS NULL THEN s.{x} ELSE ({left} * e.{k} + {a!r} * s.{x}) / ({left} + {a!r}) END"
        return f"{value}, CASE WHEN s.{x} IS NULL THEN e.{k}_age + 1 ELSE 1 END"

    return f"""{name} AS (SELECT ticker, date, n, {start} FROM {source} WHERE n = 1 UNION ALL
  SELECT s.ticker, s.date, s.n, {', '.join(step(x, a, k) for k, (x, a) in means.items())} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.n = e.n + 1)"""


ALIGNED = f"""{RAW}, {CALENDAR}, {TRIM}, {GRID}, num AS (SELECT *, row_number() OVER ({W}) AS n, close - lag(close) OVER ({W}) AS step FROM aligned),
src AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gain, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS loss, count(step) OVER ({W}) AS steps, count(close) OVER ({W}) AS prices FROM num)"""
CHANGED = """change AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS ticker, last(event_type ORDER BY ts, event_id) AS kind
  FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL),
now AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id % 2 = 0)"""
MEMBERS = f"""asked AS (SELECT unnest([DATE '{START}', DATE '{END}']) AS on_date),
who AS (SELECT ticker FROM now UNION SELECT ticker FROM change),
member AS (SELECT on_date AS date, ticker FROM asked, who WHERE coalesce(
  (SELECT kind = 'error' FROM change c WHERE c.ticker = who.ticker AND c.date > on_date ORDER BY c.date LIMIT 1), ticker IN (SELECT ticker FROM now)))"""
WITHIN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
SECOND = """second AS (SELECT * REPLACE (close * CASE WHEN CAST(ticker AS BIGINT) % 3 = 0 THEN CASE WHEN day(date) % 5 = 0 THEN 1.05::DOUBLE ELSE 1.0 END
  WHEN CAST(ticker AS BIGINT) % 3 = 1 THEN 1.08::DOUBLE ELSE 1.0 END AS close) FROM bars WHERE CAST(ticker AS BIGINT) % 7 <> 0)"""


RECONCILED = f"""both_sides AS (SELECT ticker, date, a.close AS y, b.close AS s FROM bars a JOIN second b USING (ticker, date) WHERE a.close IS NOT NULL AND b.close IS NOT NULL),
moved AS (SELECT *, abs(y / nullif(s, 0) - 1) AS pct, y / nullif(lag(y) OVER ({W}), 0) - 1 AS ry, s / nullif(lag(s) OVER ({W}), 0) - 1 AS rs FROM both_sides),
worst AS (SELECT ticker, max(pct) AS worst FROM moved GROUP BY ticker),
compared AS (SELECT ticker, count(*) AS n, corr(ry, rs) AS c, round_even(median(pct), 5) AS med, round_even(max(pct), 4) AS top, count(*) FILTER (pct > 0.02) AS far, min(date) FILTER (pct = worst) AS day FROM moved JOIN worst USING (ticker) GROUP BY ticker),
reconciled AS (SELECT ticker, coalesce(n, 0) AS overlap_days, CASE WHEN ticker NOT IN (SELECT ticker FROM second) THEN 'no_alt_source' WHEN coalesce(n, 0) < 30 THEN 'insufficient_overlap' WHEN med > 0.05 THEN 'mismatch'
  WHEN (NOT isnan(c) AND c < 0.9) OR far > n * 0.02 OR med > 0.01 THEN 'warn' ELSE 'ok' END AS status, CASE WHEN n >= 30 AND NOT isnan(c) THEN round_even(c, 4) END AS return_corr, CASE WHEN n >= 30 THEN med END AS median_abs_pct,
  CASE WHEN n >= 30 THEN top END AS max_abs_pct, CASE WHEN n >= 30 THEN far END AS n_days_gt_2pct, CASE WHEN n >= 30 THEN day END AS worst_date FROM (SELECT DISTINCT ticker FROM bars) LEFT JOIN compared USING (ticker))"""


def whole_matrix() -> str:
    """The feature matrix (matrix) and its train part (train)."""
    w = "OVER (ORDER BY date)"
    macro = f"""{SERIES}, forward AS (SELECT date, {', '.join(f'last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}' for c in ('vix', 'spx', 'tnx10y', 'irx13w'))}, 1 AS ticker FROM macro),
market AS (SELECT *, spx / lag(spx) {w} - 1 AS ret FROM forward),
macros AS (SELECT date, vix, vix - lag(vix) {w} AS vix_chg, (vix - ({over('avg', 252, 'vix')})) / ({over('stddev_samp', 252, 'vix')}) AS vix_z, tnx10y, tnx10y - lag(tnx10y) {w} AS tnx_chg, tnx10y - irx13w AS term_spread, ret AS spx_ret_1,
  {over('stddev_samp', 20, 'ret')} AS spx_vol_20, spx / ({over('avg', 50, 'spx')}) - 1 AS spx_ma_gap FROM market)"""
    ahead = ", ".join(f"fwd_ret_{h}" for h in (1, 5, 20)) + ", " + ", ".join(f"CAST(fwd_ret_{h} > 0 AS TINYINT) AS label_up_{h}" for h in (1, 5, 20))
    return f"""{CHAIN}, {STEPPED}, {macro}, lagged AS (SELECT ticker, date, {', '.join(f'{v} AS {k}' for k, v in lags().items())} FROM feat),
joined AS (SELECT lagged.*, {', '.join(INDICATORS)}, {ahead} FROM lagged JOIN ind USING (ticker, date)),
matrix AS MATERIALIZED (SELECT * FROM (SELECT joined.*, {', '.join(MACRO)} FROM joined ASOF LEFT JOIN macros ON joined.date >= macros.date) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in feature_names())}),
numbered AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS days FROM (SELECT DISTINCT date FROM matrix)),
train AS MATERIALIZED (SELECT matrix.* FROM matrix JOIN numbered USING (date) WHERE i < floor(days * 0.7) AND i <= greatest(floor(days * 0.7) - 21, 0))"""


def oracle_sql() -> dict[str, str]:
    key, bands = "ticker, date", f"WITH {BARS}, b AS (SELECT *, {over('avg', 20)} AS m, {over('stddev_pop', 20)} AS sd FROM bars)"
    names = feature_names()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    k = len(names)
    cells = ", ".join(f"abs(corr({a}, {b}))" if i < j else "0.0" for i, a in enumerate(names) for j, b in enumerate(names))
    near = f"m[(x - 1) * {k} + pos]"
    pruned = f"""{whole_matrix()}, cells AS MATERIALIZED (SELECT [{cells}] AS m, {names!r} AS names FROM train),
walk AS (SELECT 1 AS pos, [1] AS kept UNION ALL SELECT pos + 1, CASE WHEN len(list_filter(kept, lambda x: m[(x - 1) * {k} + pos + 1] > {ABOVE})) > 0 THEN kept ELSE list_append(kept, pos + 1) END FROM walk, cells WHERE pos < {k}),
done AS (SELECT kept FROM walk WHERE pos = {k}), each AS (SELECT unnest(range(1, {k + 1})) AS pos),
closest AS (SELECT pos, list_contains(kept, pos) AS stays, list_max(list_transform(list_filter(kept, lambda x: x < pos), lambda x: {{'v': {near}, 'x': -x}})) AS best, names FROM each, done, cells)
SELECT names[pos] AS feature, CASE WHEN NOT stays THEN names[-best.x] END AS correlated_with, CASE WHEN NOT stays THEN round_even(best.v, 3) END AS corr FROM closest"""
    tenth = " ".join(f"WHEN rsi14 > {a} AND rsi14 <= {a + 10} THEN '({a}, {a + 10}]'" for a in range(0, 100, 10))
    sql = {
        "bars_weekly": f"WITH {BARS} SELECT {key}, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close'))}, volume FROM bars",
        "sma": f"WITH {BARS} SELECT {key}, {', '.join(r(over('avg', n), f'ma{n}') for n in (5, 10, 20, 50, 200))} FROM bars",
        "ema": f"WITH RECURSIVE {BARS}, {NUMBERED}, {recursion('src', 'em', EMAS)} SELECT {key}, " + ", ".join(r(f"CASE WHEN n >= {n} THEN ema{n} END", f"ema{n}") for n in (12, 26)) + " FROM em",
        "rsi": f"WITH RECURSIVE {BARS}, {NUMBERED}, {recursion('src', 'em', {'up': ('gain', 1 / 14), 'dn': ('loss', 1 / 14)})} SELECT {key}, {r(RSI, 'rsi14')} FROM em",
        "macd": f"WITH RECURSIVE {BARS}, {NUMBERED}, {recursion('src', 'em', EMAS)}, {LINE}, {recursion('line', 'sg', {'signal': ('macd', 0.2)})} SELECT {key}, {r('macd', 'macd')}, {r('CASE WHEN sg.n >= 34 THEN signal END', 'macd_signal')}, {r('macd - CASE WHEN sg.n >= 34 THEN signal END', 'macd_hist')} FROM line JOIN sg USING (ticker, date)",
        "bollinger": f"{bands} SELECT {key}, {r('m', 'bb_mid')}, {r('m + 2 * sd', 'bb_upper')}, {r('m - 2 * sd', 'bb_lower')}, {r('4 * sd / m', 'bb_width')}, {r('(close - m + 2 * sd) / nullif(4 * sd, 0)', 'bb_pctb')} FROM b",
        "atr": f"WITH RECURSIVE {BARS}, {NUMBERED}, {recursion('src', 'em', {'v': ('tr', 1 / 14)})} SELECT {key}, {r('CASE WHEN n >= 14 THEN v END', 'atr14')} FROM em",
        "forward_returns": f"WITH {BARS}, f AS (SELECT {key}, {', '.join(f'lead(close, {h}) OVER ({W}) / close - 1 AS f{h}' for h in (1, 5, 20))} FROM bars) SELECT {key}, {', '.join(r(f'f{h}', f'fwd_ret_{h}') + f', CAST(f{h} > 0 AS TINYINT) AS label_up_{h}' for h in (1, 5, 20))} FROM f",
        "lag_features": f"WITH {BARS}, {STEPPED} SELECT {key}, {', '.join(r(v, k) for k, v in lags().items())} FROM feat",
        "macro_asof": f"WITH {DAILY}, {SERIES} SELECT ticker, bars.date, {r('close', 'close')}, {r('vix', 'vix')}, {r('spx', 'spx')} FROM bars ASOF LEFT JOIN macro ON bars.date >= macro.date",
        "macro_features": f"""WITH {SERIES}, f AS (SELECT date, {', '.join(f'last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}' for c in ('vix', 'spx', 'tnx10y', 'irx13w'))} FROM macro),
x AS (SELECT *, spx / lag(spx) OVER (ORDER BY date) - 1 AS ret, 1 AS ticker, vix AS close FROM f)
SELECT date, {r('vix', 'vix')}, {r('vix - lag(vix) OVER (ORDER BY date)', 'vix_chg')}, {r(f"(vix - ({over('avg', 252, 'vix')})) / ({over('stddev_samp', 252, 'vix')})", 'vix_z')}, {r('tnx10y', 'tnx10y')},
{r('tnx10y - lag(tnx10y) OVER (ORDER BY date)', 'tnx_chg')}, {r('tnx10y - irx13w', 'term_spread')}, {r('ret', 'spx_ret_1')}, {r(over('stddev_samp', 20, 'ret'), 'spx_vol_20')}, {r(f"spx / ({over('avg', 50, 'spx')}) - 1", 'spx_ma_gap')} FROM x""",
        "purged_split": f"WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT {key}, CASE WHEN i >= floor(n * 0.7) THEN 'test' WHEN i <= greatest(floor(n * 0.7) - 21, 0) THEN 'train' END AS split FROM bars JOIN d USING (date)",
        "daily_ic": f"{IC} SELECT signal, horizon, date, n_names, {r('ic', 'ic')} FROM ic",
        "ic_summary": f"{IC} SELECT signal, horizon, round_even(avg(ic), 4) AS mean_ic, round_even(stddev_samp(ic), 4) AS ic_std, round_even(avg(ic) / nullif(stddev_samp(ic), 0), 3) AS info_ratio, round_even(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 2) AS t_stat, count(*) AS n_days FROM ic GROUP BY ALL",
        "rsi_buckets": f"{CHAIN} SELECT * FROM (SELECT CASE {tenth} END AS rsi_bucket, {', '.join(f'round_even(avg(fwd_ret_{h}) * 1e4, 1) AS fwd_{h}d_bps' for h in (1, 5, 20))}, count(*) AS count FROM ind GROUP BY 1) WHERE rsi_bucket IS NOT NULL",
        "rsi_zones": f"{CHAIN} SELECT * FROM (SELECT CASE WHEN rsi14 > 0 AND rsi14 <= 30 THEN 'oversold(<30)' WHEN rsi14 > 30 AND rsi14 <= 70 THEN 'neutral(30-70)' WHEN rsi14 > 70 THEN 'overbought(>70)' END AS zone, count(*) AS n, round_even(avg(fwd_ret_5) * 1e4, 1) AS mean_fwd_5d_bps, round_even(avg(CAST(fwd_ret_5 > 0 AS DOUBLE)), 3) AS hit_rate_up FROM ind WHERE fwd_ret_5 IS NOT NULL GROUP BY 1) WHERE zone IS NOT NULL",
        "calendar_majority": f"WITH {RAW}, {CALENDAR} SELECT date, CAST(session AS INT) AS session FROM days",
        "faulty_bars": f"WITH {RAW} SELECT {key}, {', '.join(r(c, c) for c in OHLC)}, volume, seq FROM faulty",
        "integrity": f"WITH {RAW}, {CALENDAR}, {INTEGRITY} SELECT * FROM report",
        "flag_counts": f"WITH {RAW}, {CALENDAR}, {INTEGRITY} {COUNTED_FLAGS}",
        "integrity_summary": f"WITH {RAW}, {CALENDAR}, {INTEGRITY} SELECT 'status' AS kind, status AS name, count(*) AS n FROM report GROUP BY ALL UNION ALL SELECT 'lifecycle', lifecycle, count(*) FROM report GROUP BY ALL UNION ALL SELECT 'flag', flag, n FROM ({COUNTED_FLAGS}) UNION ALL SELECT 'total', 'rows', CAST(sum(rows) AS BIGINT) FROM report",
        "clean_trim": f"WITH {RAW}, {TRIM} SELECT {key}, {r('close', 'close')} FROM kept",
        "quarantine": f"WITH {RAW}, {TRIM} SELECT ticker, raw_rows, {REASON} AS reason FROM (SELECT ticker, count(*) AS raw_rows FROM bars GROUP BY ticker) LEFT JOIN (SELECT ticker, count(*) AS n FROM trimmed GROUP BY ticker) USING (ticker) WHERE coalesce(n, 0) < {LIMITS.min_history}",
        "clean_align_ffill": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID} SELECT {key}, {r('close', 'close')}, volume, is_halt, is_filled FROM aligned",
        "clean_returns": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID} SELECT {key}, {r('ret', 'ret')}, {r('CASE WHEN ret > -1 THEN ln(1 + ret) END', 'log_ret')}, is_extreme, is_suspect FROM marked",
        "clean_winsor": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {WINSOR} SELECT {key}, {r('CASE WHEN ret IS NULL THEN NULL WHEN k > 10 THEN greatest(least(ret, m + d), m - d) ELSE ret END', 'ret_winsor')} FROM ret JOIN m USING (ticker) JOIN d USING (ticker)",
        "clean": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {WINSOR} SELECT {key}, {', '.join(r(c, c) for c in OHLC)}, volume, {r('ret', 'ret')}, {r('CASE WHEN ret IS NULL THEN NULL WHEN k > 20 THEN greatest(least(ret, m + d), m - d) ELSE ret END', 'ret_winsor')}, is_halt, is_filled, is_extreme, is_suspect FROM marked JOIN m USING (ticker) JOIN d USING (ticker)",
        "cleaning_adjustments": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {AUDIT} SELECT * FROM audit",
        "cleaning_stats": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {AUDIT}, {STATS} SELECT * FROM stats",
        "prelisting_trimmed": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {AUDIT}, {STATS} SELECT ticker, orig_first_date, first_real_date, leading_trimmed, raw_rows FROM stats WHERE leading_trimmed > 0",
        "cleaning_report": f"WITH {RAW}, {CALENDAR}, {TRIM}, {GRID}, {AUDIT}, {STATS} SELECT count(*) AS tickers_in, count(*) FILTER (NOT dropped) AS tickers_kept, "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("raw_rows", "clean_rows", "leading_trimmed", "halt_masked", "gap_filled", "ohlc_fixed", "nonpos_fixed", "n_extreme", "n_suspect")) + " FROM stats",
        "rsi_aligned": f"WITH RECURSIVE {ALIGNED}, {aged('src', 'em', {'up': ('gain', 1 / 14), 'dn': ('loss', 1 / 14)})} SELECT {key}, {r('CASE WHEN steps >= 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END', 'rsi14')} FROM em JOIN (SELECT ticker, date, steps FROM src) USING (ticker, date)",
        "ema_aligned": f"WITH RECURSIVE {ALIGNED}, {aged('src', 'em', {'ema3': ('close', 0.5), 'ema8': ('close', 2 / 9)})} SELECT {key}, " + ", ".join(r(f"CASE WHEN prices >= {n} THEN ema{n} END", f"ema{n}") for n in (3, 8)) + " FROM em JOIN (SELECT ticker, date, prices FROM src) USING (ticker, date)",
        "reconcile": f"WITH {BARS}, {SECOND}, {RECONCILED} SELECT * FROM reconciled",
        "reconcile_sample": f"WITH {BARS}, {SECOND}, {RECONCILED}, k AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ticker FROM bars)) SELECT reconciled.* FROM reconciled JOIN k USING (ticker) WHERE n <= 20 OR i IN (SELECT (j * n) // 20 FROM range(20) t(j))",
        "feature_matrix": f"{whole_matrix()} SELECT {key}, {', '.join(r(x, x) for x in (*names, 'fwd_ret_1', 'fwd_ret_5', 'fwd_ret_20'))}, label_up_1, label_up_5, label_up_20 FROM matrix",
        "corr_pruned": pruned,
        "rsi_bars": f"{CHAIN}, wide AS (SELECT * FROM (SELECT CASE {tenth} END AS rsi_bucket, {', '.join(f'round_even(avg(fwd_ret_{h}) * 1e4, 1) AS fwd_{h}d_bps' for h in (1, 5, 20))} FROM ind GROUP BY 1) WHERE rsi_bucket IS NOT NULL) " + " UNION ALL ".join(f"SELECT rsi_bucket, 'fwd_{h}d_bps' AS horizon, fwd_{h}d_bps AS bps FROM wide" for h in (1, 5, 20)),
        "ic_grid": f"{IC} SELECT signal, " + ", ".join(f'round_even(avg(ic) FILTER (horizon = {h}), 4) AS "{h}"' for h in (1, 5, 20)) + " FROM ic GROUP BY signal",
        "panel_wide_pivot": f"WITH {BARS} PIVOT (SELECT date, ticker, close FROM bars) ON ticker USING round(avg(close), {DIGITS}) GROUP BY date",
        "members_on": f"WITH {CHANGED}, {MEMBERS} SELECT date, ticker FROM member",
        "membership_snapshots": f"WITH {CHANGED}, {MEMBERS} SELECT date, count(*) AS n_members, count(*) FILTER (ticker IN (SELECT ticker FROM now)) AS still_current FROM member GROUP BY date",
        "universe": f"WITH {CHANGED}, {MEMBERS} SELECT ticker, CASE WHEN ticker IN (SELECT ticker FROM now) THEN 'current' ELSE 'removed' END AS status FROM (SELECT ticker FROM member WHERE date = DATE '{START}' UNION SELECT ticker FROM change WHERE {WITHIN})",
        "removed_in": f"WITH {CHANGED} SELECT ticker, max(date) AS date FROM change WHERE kind = 'error' AND {WITHIN} GROUP BY ticker",
        "manifest_resume": f"WITH {BARS}, {SECOND} SELECT ticker, 'ok' AS status, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, CASE WHEN CAST(ticker AS BIGINT) % 7 = 0 THEN 'fallback' ELSE 'lineitem' END AS source FROM bars GROUP BY ticker",
        "even_sample": f"WITH {BARS}, k AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ticker FROM bars)) SELECT ticker FROM k WHERE i IN (SELECT (j * n) // 6 FROM range(6) t(j))",
        "corr_matrix": f"{whole_matrix()}, flat AS (SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': corr({a}, {b})}}" for a, b in pairs) + f"]) AS p FROM train) SELECT p.a AS a, p.b AS b, {r('p.c', 'corr')} FROM flat",
    }
    return sql
