"""The frozen feature block: each of its groups, and the whole, against SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import canonical as N
from tidemark.plans import _data as D
from tidemark.plans._data import EVENT, OVER, q_ewm, q_lag, q_roll

QUERIES: dict = {}
SQL: dict[str, str] = {}

BENCHMARK, ASSETS = "view", {"ETHUSDT": "click", "SOLUSDT": "purchase", "DOGEUSDT": "signup"}
FINE = f"""{EVENT},
fine AS (SELECT symbol, time_bucket(INTERVAL '30 minutes', ticks.ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS ts, first(price ORDER BY ticks.ts, tie) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ticks.ts, tie) AS close, sum(size)::DOUBLE AS volume FROM ticks GROUP BY 1, 2),
days AS (SELECT date_trunc('day', ticks.ts)::TIMESTAMP AS ts, avg(price) AS a, max(price) AS b, min(price) AS c, sum(price) AS d, count(*)::DOUBLE AS e, sum(size)::DOUBLE AS f FROM ticks GROUP BY 1),
hour AS (SELECT symbol, date_trunc('hour', ticks.ts)::TIMESTAMP AS ts, avg(price) AS funding_rate, min(price) AS index_price, max(price) AS mark_price, sum(price) AS open_interest, sum(size)::DOUBLE AS insurance_balance,
  sum(CASE WHEN side = 1 THEN size ELSE 0 END)::DOUBLE AS taker_buy_vol, sum(CASE WHEN side = 0 THEN size ELSE 0 END)::DOUBLE AS taker_sell_vol, count(*)::DOUBLE AS trade_count, max(price) - min(price) AS spread, avg(side)::DOUBLE AS imbalance FROM ticks GROUP BY 1, 2)"""


def fine(s, d):
    return B.ohlcv(D.event_ticks(s, d), "30 minutes")


def round4(x):
    """Scaled, rounded and scaled back, which is what ``round`` of the SQL does to a tie."""
    return F.round(F.col(x).cast("double") * 1e4) / 1e4


def daily(s, d):
    return D.event_ticks(s, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("price").alias("a"), F.max("price").alias("b"), F.min("price").alias("c"), F.sum("price").alias("d"), F.count("*").cast("double").alias("e"), F.sum("size").alias("f"))


def macro(s, d):
    return daily(s, d).select("ts", F.col("a").alias("spy_close"), F.col("b").alias("gld_close"), F.col("c").alias("tlt_close"), F.col("d").alias("uup_close"), F.col("e").alias("vix_close"))


def equities(s, d):
    return daily(s, d).select("ts", F.col("a").alias("spy"), F.col("b").alias("gld"), F.col("c").alias("tlt"), F.col("d").alias("uup"), F.col("e").alias("vix"), F.col("d").alias("hyg"), F.col("f").alias("lqd"))


def micro(s, d):
    buy, sell = (F.sum(F.when(F.col("side") == x, F.col("size")).otherwise(0.0)) for x in (1, 0))
    hours = D.event_ticks(s, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return hours.agg(
        F.avg("price").alias("funding_rate"), F.min("price").alias("index_price"), F.max("price").alias("mark_price"), F.sum("price").alias("open_interest"), F.sum("size").alias("insurance_balance"),
        buy.alias("taker_buy_vol"), sell.alias("taker_sell_vol"), F.count("*").cast("double").alias("trade_count"), (F.max("price") - F.min("price")).alias("spread"), F.avg("side").alias("imbalance"),
    )


TAU = repr(2 * 3.141592653589793)
CAL = f"""cal AS (SELECT symbol, ts, year(ts) AS year, month(ts) AS month, dayofyear(ts) AS day_of_year, isodow(ts) - 1 AS weekday, hour(ts) AS hour, minute(ts) AS minute,
  {', '.join(f"{f}({TAU} * {x} / {n}) AS {c}_{f}" for c, x, n in (('hour', 'hour(ts)', 24), ('month', 'month(ts)', 12), ('weekday', '(isodow(ts) - 1)', 7)) for f in ('sin', 'cos'))},
  (isodow(ts) >= 6)::INT AS is_weekend, (day(ts) <= 3)::INT AS is_month_start, (day(ts) >= 28)::INT AS is_month_end, quarter(ts) AS quarter,
  (month(ts) % 3 = 1 AND day(ts) <= 5)::INT AS is_quarter_start, (month(ts) % 3 = 0 AND day(ts) >= 25)::INT AS is_quarter_end FROM fine)"""
T = "1e-10"
PC = q_lag("close")
PRICE = f"""p0 AS (SELECT *, ln(close / {PC}) AS ret_1, CASE WHEN {PC} IS NOT NULL THEN greatest(close - {PC}, 0) END AS gain, CASE WHEN {PC} IS NOT NULL THEN greatest({PC} - close, 0) END AS loss,
  CASE WHEN {PC} IS NULL THEN 0 ELSE greatest(high - low, abs(high - {PC}), abs(low - {PC})) END AS tr FROM fine),
{q_ewm('p_f', 'p0', 'close', 2 / 13)}, {q_ewm('p_s', 'p0', 'close', 2 / 27)},
p1 AS (SELECT p0.*, p_f.y AS ef, p_s.y AS es, p_f.y - p_s.y AS hist FROM p0 JOIN p_f USING (symbol, ts) JOIN p_s USING (symbol, ts)),
{q_ewm('p_h', 'p1', 'hist', 0.2)},
p2 AS (SELECT p1.*, p_h.y AS smooth, {', '.join(f"{q_roll('sum', 'ret_1', n)} AS ret_{n}" for n in (3, 6, 12, 24))}, {', '.join(f"{q_roll('stddev_samp', 'ret_1', n)} AS volatility_{n}" for n in (12, 24))},
  {q_roll('avg', 'volume', 6)} / ({q_roll('avg', 'volume', 24)} + {T}) AS vol_ratio, volume / nullif({q_lag('volume')}, 0) - 1 AS volume_change, {q_roll('avg', 'close', 6)} AS s6, {q_roll('avg', 'close', 12)} AS s12, {q_roll('avg', 'close', 24)} AS s24,
  100 - 100 / (1 + {q_roll('avg', 'gain', 14)} / ({q_roll('avg', 'loss', 14)} + {T})) AS rsi_14, {q_roll('avg', 'close', 20)} AS mid, {q_roll('stddev_samp', 'close', 20)} AS sd, {q_roll('avg', 'tr', 14)} / (close + {T}) AS atr_ratio
  FROM p1 JOIN p_h USING (symbol, ts)),
p3 AS (SELECT *, (close - s6) / (s6 + {T}) AS raw_sma_dist_6, (close - s12) / (s12 + {T}) AS raw_sma_dist_12, (s6 - s12) / (s12 + {T}) AS raw_sma_cross_signal, ef / (es + {T}) AS raw_ema_ratio, hist AS raw_macd_hist, smooth AS raw_macd_hist_smooth,
  (close - (mid - 2 * sd)) / (4 * sd + {T}) AS raw_bb_pos, 4 * sd / (mid + {T}) AS raw_bb_width, {q_roll('avg', 'volatility_24', 144)} AS calm FROM p2),
price AS (SELECT *, {', '.join(f'raw_{x} / (volatility_24 + {T}) AS {x}' for x in N.SCALED)}, coalesce(volatility_24 > {q_roll('quantile_cont({}, 0.5)', 'calm', 720, 1)}, false)::INT AS regime_high_vol,
  coalesce(abs((close - s24) / (sd + {T})) > 1, false)::INT AS regime_trending FROM p3)"""


def _frame(tag: str, seconds: int, n: int, moves: dict[str, int]) -> str:
    w = "OVER (PARTITION BY symbol ORDER BY b)"
    rows = f"OVER (PARTITION BY symbol ORDER BY b ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""b{tag} AS (SELECT symbol, floor(epoch(ts) / {seconds}) AS b, last(close ORDER BY ts) AS close, max(high) - min(low) AS span FROM fine GROUP BY 1, 2),
i{tag} AS (SELECT symbol, b, close / lag(close) {w} - 1 AS ret_{tag}, CASE WHEN count(close) {rows} >= {n} THEN stddev_samp(close) {rows} END AS vol_{tag}, {', '.join(f'close / lag(close, {k}) {w} - 1 AS {x}' for x, k in moves.items())}, span / (close + {T}) AS range_{tag}_pct FROM b{tag})"""


FRAMES = f"""{_frame('1h', 3600, 24, {'mom_1h_3h': 3, 'mom_1h_6h': 6})}, {_frame('4h', 14400, 6, {'mom_4h_12h': 3})},
frames AS (SELECT f.symbol, f.ts, {', '.join(N.FRAMES)} FROM fine f ASOF LEFT JOIN i1h h ON h.symbol = f.symbol AND floor(epoch(f.ts) / 3600) > h.b ASOF LEFT JOIN i4h q ON q.symbol = f.symbol AND floor(epoch(f.ts) / 14400) > q.b)"""
MACRO = f"""m0 AS (SELECT fine.*, a AS spy, b AS gld, c AS tlt, d AS uup, e AS vix FROM fine ASOF LEFT JOIN days ON fine.ts >= days.ts),
m1 AS (SELECT *, {', '.join(f"{q_roll('avg', x, 20)} AS {x}_ma" for x in ('spy', 'gld', 'tlt', 'uup', 'vix'))}, {', '.join(f'close / ({x} + {T}) AS q_{x}' for x in ('spy', 'gld', 'uup'))} FROM m0),
macro AS (SELECT symbol, ts, {', '.join(f'CASE WHEN {x}_ma > 0 THEN ({x} - {x}_ma) / ({x}_ma + {T}) END AS {x}_close_ma20_signal' for x in ('spy', 'gld', 'tlt', 'uup', 'vix'))},
  {', '.join(f"q_{x} / {q_lag(f'q_{x}', 12)} - 1 AS btc_{x}_ratio_chg" for x in ('spy', 'gld', 'uup'))} FROM m1)"""
MICRO = f"""n0 AS (SELECT f.symbol, f.ts, hour.* EXCLUDE (symbol, ts) FROM fine f ASOF LEFT JOIN hour ON hour.symbol = f.symbol AND f.ts >= hour.ts),
micro AS (SELECT *, (mark_price - index_price) / (index_price + {T}) AS basis_pct, open_interest / nullif({q_lag('open_interest', 12)}, 0) - 1 AS oi_chg_12, taker_buy_vol / (taker_buy_vol + taker_sell_vol + {T}) AS taker_buy_sell_ratio FROM n0)"""


def _asset(a: str) -> str:
    def row(n):
        return f"OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    q = [f"c_{a} / lag(c_{a}) OVER w - 1 AS {a}_returns", f"c_{a} / cb AS {a}_btc_ratio", f"(c_{a} / cb) / lag(c_{a} / cb) OVER w - 1 AS {a}_btc_ratio_chg"]
    q.append(f"CASE WHEN count(v_{a}) {row(24)} >= 24 THEN (v_{a} - avg(v_{a}) {row(24)}) / (stddev_samp(v_{a}) {row(24)} + 1e-9) END AS {a}_volume_z")
    for n in N.SPANS:
        q.append(f"c_{a} / lag(c_{a}, {n}) OVER w - cb / lag(cb, {n}) OVER w AS {a}_btc_ret_rel_{n}")
        q.append(f"CASE WHEN count(r_{a}) {row(n)} >= {n} THEN corr(rb, r_{a}) {row(n)} END AS btc_corr_{a}_{n}")
    return ", ".join(q)


CROSS = f"""c0 AS (SELECT b.ts, b.close AS cb, {', '.join(f'{a}.close AS c_{a}, {a}.volume AS v_{a}' for a in ASSETS)} FROM fine b {' '.join(f"JOIN fine {a} ON {a}.ts = b.ts AND {a}.symbol = '{s}'" for a, s in ASSETS.items())} WHERE b.symbol = '{BENCHMARK}'),
c1 AS (SELECT *, cb / lag(cb) OVER w - 1 AS rb, {', '.join(f'c_{a} / lag(c_{a}) OVER w - 1 AS r_{a}' for a in ASSETS)} FROM c0 WINDOW w AS (ORDER BY ts)),
crosses AS (SELECT ts, {', '.join(map(_asset, ASSETS))} FROM c1 WINDOW w AS (ORDER BY ts))"""


def _mean(x):
    return f"avg({x}) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


EQUITIES = f"""e0 AS (SELECT ts, {', '.join(f'({x} - {_mean(x)}) / (abs({_mean(x)}) + {T}) AS eq_{n}_signal' for n, x in (('spy', 'a'), ('gold', 'b'), ('tlt', 'c'), ('uup', 'd')))}, greatest(e / ({_mean('e')} + {T}) - 1, 0) AS eq_vix_signal,
  coalesce(c / nullif(lag(c, 20) OVER (ORDER BY ts), 0) - 1 < 0, false)::INT AS eq_rates_falling, greatest(d / (f + {T}) - {_mean(f'd / (f + {T})')}, 0) AS eq_credit_stress FROM days),
e1 AS (SELECT *, (eq_vix_signal > 0.5)::INT AS eq_vix_spike FROM e0), e2 AS (SELECT *, (eq_spy_signal > 0 AND eq_vix_spike = 0)::INT AS eq_risk_on, (NOT eq_spy_signal > 0 OR eq_vix_spike = 1)::INT AS eq_risk_off FROM e1),
eq AS (SELECT f.symbol, f.ts, {', '.join(f'coalesce({x}, 0) AS {x}' for x in N.EQUITIES)} FROM fine f ASOF LEFT JOIN e2 ON f.ts >= e2.ts)"""
CTE = {"cal": CAL, "price": PRICE, "frames": FRAMES, "macro": MACRO, "micro": MICRO, "crosses": CROSS, "eq": EQUITIES}


def shown(names):
    return ", ".join(f"round({x}, 4)::DOUBLE AS {x}" for x in names)


def _group(key: str, cte: str, names, make) -> None:
    QUERIES[key] = lambda s, d: make(s, d).select(*(["ts"] if cte == "crosses" else ["symbol", "ts"]), *[round4(x).alias(x) for x in names])
    SQL[key] = f"WITH {FINE}, {CTE[cte]} SELECT {'ts' if cte == 'crosses' else 'symbol, ts'}, {shown(names)} FROM {cte}"


TECHNICALS = [f"raw_{x}" if x in N.SCALED else x for x in N.PRICE]
_group("F40_calendar_block", "cal", N.CALENDAR, lambda s, d: N.resolve(fine(s, d), N.CALENDAR))
_group("F41_technical_block", "price", TECHNICALS, lambda s, d: N.resolve(fine(s, d), TECHNICALS))
_group("F42_scaled_block", "price", (*N.SCALED, *N.REGIME), lambda s, d: N.resolve(fine(s, d), (*N.SCALED, *N.REGIME)))
_group("F43_closed_frames", "frames", N.FRAMES, lambda s, d: N.resolve(fine(s, d), N.FRAMES))
_group("F45_macro_block", "macro", N.MACRO, lambda s, d: N.resolve(N.with_series(fine(s, d), macro(s, d)), N.MACRO))
_group("F46_equity_block", "eq", N.EQUITIES, lambda s, d: N.with_series(fine(s, d), N.equity_features(equities(s, d))).fillna(0, subset=list(N.EQUITIES)))
_group("F47_micro_block", "micro", N.MICRO, lambda s, d: N.resolve(N.asof(fine(s, d), micro(s, d), ["symbol"], [x for x in micro(s, d).columns if x not in ("symbol", "ts")]), N.MICRO))
_group("F50_cross_block", "crosses", [x for a in ASSETS for x in N.cross_names(a)], lambda s, d: N.cross_features(fine(s, d), BENCHMARK, ASSETS))


def whole(s, d):
    return N.block(fine(s, d), BENCHMARK, ASSETS, macro(s, d), micro(s, d), equities(s, d))


QUERIES["F57_canonical_block"] = lambda s, d: whole(s, d).select("symbol", "ts", *[round4(x).alias(x) for x in N.CANONICAL])
SQL["F57_canonical_block"] = f"""WITH {FINE}, {', '.join(CTE.values())}, j AS (SELECT cal.symbol, cal.ts, {', '.join(N.CANONICAL)} FROM cal JOIN price USING (symbol, ts) JOIN frames USING (symbol, ts) JOIN macro USING (symbol, ts) JOIN micro USING (symbol, ts)
  JOIN eq USING (symbol, ts) LEFT JOIN crosses ON crosses.ts = cal.ts) SELECT symbol, ts, {shown(N.CANONICAL)} FROM j WHERE {' AND '.join(f'{x} IS NOT NULL' for x in N.CANONICAL)}"""
del OVER
