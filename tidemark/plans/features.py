"""Feature blocks and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import regimes as M
from tidemark.operators import signals as S
from tidemark.plans import _data as D
from tidemark.plans._data import DAILY, EVENT, HOURLY, OVER, PART, SOFAR, q_frame, q_lag, q_roll
from tidemark.plans.bars import DAYS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key, sql=None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


P = q_lag("close")
query("F40_calendar", f"WITH {HOURLY} SELECT symbol, ts, year(ts) AS year, month(ts) AS month, dayofyear(ts) AS dayofyear, isodow(ts) - 1 AS weekday, hour(ts) AS hour, quarter(ts) AS quarter, round(sin(hour(ts) * {2 * 3.141592653589793 / 24!r}), 6) AS hour_sin, round(cos(month(ts) * {2 * 3.141592653589793 / 12!r}), 6) AS month_cos, (isodow(ts) >= 6)::INT AS is_weekend, (day(ts) = 1)::INT AS is_month_start, (month(ts) % 3 = 0 AND ts::DATE = last_day(ts))::INT AS is_quarter_end FROM hours")(lambda s, d: rounded(X.calendar(D.hourly(s, d)), 6, "hour_sin", "month_cos").select("symbol", "ts", "year", "month", "dayofyear", "weekday", "hour", "quarter", "hour_sin", "month_cos", "is_weekend", "is_month_start", "is_quarter_end"))
TEC = f"{DAILY}, t0 AS (SELECT *, close / nullif({P}, 0) - 1 AS ret FROM bars)"
query("F41_technicals", f"WITH {TEC} SELECT symbol, ts, round(ret, 6) AS ret, round(close / nullif({q_lag('close', 12)}, 0) - 1, 6) AS ret_12, round({q_roll('stddev_samp', 'ret', 12)}, 6) AS vol_12, round(volume / {q_roll('avg', 'volume', 24)}, 6) AS volume_ratio_24, round(close / {q_roll('avg', 'close', 50)} - 1, 6) AS dist_50 FROM t0")(lambda s, d: rounded(X.technicals(D.daily(s, d)), 6, "ret", "ret_12", "vol_12", "volume_ratio_24", "dist_50").select("symbol", "ts", "ret", "ret_12", "vol_12", "volume_ratio_24", "dist_50"))
query("F42_vol_normalised", f"WITH {TEC}, t1 AS (SELECT *, {q_roll('stddev_samp', 'ret', 24)} AS s FROM t0) SELECT symbol, ts, round(CASE WHEN s <> 0 THEN ret / s END, 6) AS ret_norm FROM t1")(lambda s, d: rounded(X.vol_normalised(D.daily(s, d).withColumn("ret", R.change("close")), ["ret"]), 6, "ret_norm").select("symbol", "ts", "ret_norm"))
HIGH = "dd AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, first(open ORDER BY hours.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY hours.ts) AS close FROM hours GROUP BY 1, 2), de AS (SELECT symbol, day + INTERVAL '1 day' AS te, close / nullif(lag(close) OVER w, 0) - 1 AS r, close / nullif(lag(close, 3) OVER w, 0) - 1 AS m, (high - low) / close AS g FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY day))"
query("F43_higher_frame", f"WITH {HOURLY}, {HIGH} SELECT h.symbol, h.ts, round(r, 6) AS d_ret, round(m, 6) AS d_mom, round(g, 6) AS d_range FROM hours h ASOF LEFT JOIN de ON de.symbol = h.symbol AND h.ts >= te")(lambda s, d: rounded(X.higher_frame(D.hourly(s, d), "1 day", "1 DAY", "d"), 6, "d_ret", "d_mom", "d_range").select("symbol", "ts", "d_ret", "d_mom", "d_range"))
query("F44_right_frame", f"WITH {HOURLY}, r4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', hours.ts - INTERVAL '1 microsecond', TIMESTAMP '1970-01-01') + INTERVAL '4 hours' AS te, last(close ORDER BY hours.ts) AS c FROM hours GROUP BY 1, 2), j AS (SELECT h.symbol, h.ts, c FROM hours h ASOF LEFT JOIN r4 ON r4.symbol = h.symbol AND h.ts >= te) SELECT symbol, ts, round(lag(c) {OVER}, 6) AS q_close FROM j")(lambda s, d: rounded(X.right_frame(D.hourly(s, d), "4 hours", "q"), 6, "q_close").select("symbol", "ts", "q_close"))
HT = {"1h": ("1 hour", 3600), "4h": ("4 hours", 14400), "1d": ("1 day", 86400)}
PL = "lag(close) OVER w"


def q_indicators(f, seconds):
    w = "PARTITION BY symbol ORDER BY te"
    mean = lambda c, n: f"avg({c}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""x{f}0 AS (SELECT symbol, (time_bucket(INTERVAL '{seconds} seconds', fine.ts - INTERVAL '1 microsecond', TIMESTAMP '1970-01-01') + INTERVAL '{seconds} seconds')::TIMESTAMP AS te, last(close ORDER BY fine.ts) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM fine GROUP BY 1, 2),
x{f}1 AS (SELECT *, te AS ts, CASE WHEN {PL} IS NOT NULL THEN greatest(high - low, abs(high - {PL}), abs(low - {PL})) END AS tr, CASE WHEN {PL} IS NOT NULL THEN greatest(close - {PL}, 0) END AS u, CASE WHEN {PL} IS NOT NULL THEN greatest({PL} - close, 0) END AS dn, close / {PL} - 1 AS ret, ln(close / {PL}) AS log_ret FROM x{f}0 WINDOW w AS ({w})),
{D.q_ewm(f'x{f}u', f'x{f}1', 'u', 1 / 14)}, {D.q_ewm(f'x{f}d', f'x{f}1', 'dn', 1 / 14)},
x{f}2 AS (SELECT a.*, {mean('tr', 14)} AS atr, {mean('tr', 14)} / close AS atr_pct, {mean('close', 20)} AS sma_20, {mean('close', 50)} AS sma_50, {mean('volume', 20)} AS vol_ma, volume / {mean('volume', 20)} AS vol_ratio, count(u) OVER ({w} ROWS UNBOUNDED PRECEDING) AS k FROM x{f}1 a),
x{f} AS (SELECT a.*, CASE WHEN k >= 14 THEN 100 - 100 / (1 + p.y / CASE WHEN q.y = 0 THEN 1e-9 ELSE q.y END) END AS rsi_14 FROM x{f}2 a LEFT JOIN x{f}u p ON p.symbol = a.symbol AND p.ts = a.te LEFT JOIN x{f}d q ON q.symbol = a.symbol AND q.ts = a.te)"""


HTN = [f"ht_{f}_{x}" for f in HT for x in X.INDICATORS]
query("F44_timeframes", f"WITH {EVENT}, fine AS (SELECT symbol, time_bucket(INTERVAL '20 minutes', ticks.ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS ts, first(price ORDER BY ticks.ts, tie) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ticks.ts, tie) AS close, sum(size)::DOUBLE AS volume FROM ticks GROUP BY 1, 2), {', '.join(q_indicators(f, n) for f, (_, n) in HT.items())}, j AS (SELECT b.symbol, b.ts, {', '.join(f'x{f}.{x} AS ht_{f}_{x}' for f in HT for x in X.INDICATORS)} FROM fine b {' '.join(f'ASOF LEFT JOIN x{f} ON x{f}.symbol = b.symbol AND b.ts >= x{f}.te' for f in HT)}) SELECT symbol, ts, {', '.join(f'round(lag({c}) {OVER}, 7) AS {c}' for c in HTN)} FROM j")(lambda s, d: rounded(X.timeframes(B.ohlcv(D.event_ticks(s, d), "20 minutes"), {f: r for f, (r, _) in HT.items()}), 7, *HTN).select("symbol", "ts", *HTN))
query("F45_macro", f"WITH {DAILY} SELECT symbol, ts, CASE WHEN close > {q_roll('avg', 'close', 20)} THEN 1 ELSE 0 END AS above, round(close / {q_roll('avg', 'close', 20)}, 6) AS ratio, round(close / nullif({q_lag('close', 12)}, 0) - 1, 6) AS moved FROM bars")(lambda s, d: rounded(X.macro_signals(D.daily(s, d)), 6, "ratio", "moved").select("symbol", "ts", "above", "ratio", "moved"))
query("F46_equity_regime", f"WITH {DAILY}, e AS (SELECT symbol, ts, (close > {q_roll('avg', 'close', 50)})::INT AS trend, (high > 1.3 * {q_roll('avg', 'high', 20)})::INT AS fear, (low < {q_lag('low', 20)})::INT AS rates_fall, (open < {q_roll('avg', 'open', 50)})::INT AS stress FROM bars) SELECT *, CASE WHEN trend = 1 AND fear = 0 AND stress = 0 THEN 'on' WHEN trend = 0 AND (fear = 1 OR stress = 1) THEN 'off' ELSE 'mixed' END AS risk FROM e")(lambda s, d: X.equity_regime(D.daily(s, d).select("symbol", "ts", F.col("close").alias("stocks"), F.col("high").alias("vix"), F.col("low").alias("rates"), F.col("open").alias("credit"))).select("symbol", "ts", "trend", "fear", "rates_fall", "stress", "risk"))
query("F47_micro", f"WITH {DAILY} SELECT symbol, ts, round((close - open) / nullif(open, 0), 6) AS basis, round(volume / nullif({q_lag('volume')}, 0) - 1, 6) AS oi_change, round(high / nullif({q_lag('high')}, 0) - 1, 6) AS fund_change, round(high / (high + low), 6) AS taker_ratio FROM bars")(lambda s, d: rounded(X.micro(D.daily(s, d).select("symbol", "ts", F.col("close").alias("mark"), F.col("open").alias("index"), F.col("volume").alias("oi"), F.col("high").alias("fund"), F.col("high").alias("buy"), F.col("low").alias("sell"))), 6, "basis", "oi_change", "fund_change", "taker_ratio").select("symbol", "ts", "basis", "oi_change", "fund_change", "taker_ratio"))
query("F48_book_top", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - l_quantity, 6) AS spread, round((l_discount - l_tax) / nullif(l_discount + l_tax, 0), 6) AS imbalance FROM lineitem")(lambda s, d: rounded(X.book_top(D.table(s, d, "lineitem").withColumnsRenamed({"l_quantity": "bid", "l_extendedprice": "ask", "l_discount": "bid_size", "l_tax": "ask_size"})), 6, "spread", "imbalance").select("l_orderkey", "l_linenumber", "l_partkey", "spread", "imbalance"))
CR = f"{DAILY}, ca AS (SELECT b.*, m.close AS bc FROM bars b JOIN bars m ON m.ts = b.ts AND m.symbol = '1-URGENT'), cb AS (SELECT *, close / bc AS ratio, close / nullif({P}, 0) - close / nullif({P}, 0) AS z, close / nullif({q_lag('close', 6)}, 0) - bc / nullif({q_lag('bc', 6)}, 0) AS rel_6 FROM ca)"
query("F50_cross_asset", f"WITH {CR} SELECT symbol, ts, round(ratio, 6) AS ratio, round(ratio / nullif({q_lag('ratio')}, 0) - 1, 6) AS ratio_change, round(rel_6, 6) AS rel_6 FROM cb")(lambda s, d: rounded(X.cross_asset(D.daily(s, d), "1-URGENT"), 6, "ratio", "ratio_change", "rel_6").select("symbol", "ts", "ratio", "ratio_change", "rel_6"))
LEAD = {"2-HIGH": "high", "5-LOW": "low"}
FILLED = ", ".join(f"last_value({x}.{c} IGNORE NULLS) OVER (ORDER BY t.ts ROWS UNBOUNDED PRECEDING) AS {c}_{x}" for x in LEAD.values() for c in ("close", "volume"))
MOVES = ", ".join(f"round(close_{x} / nullif(lag(close_{x}) OVER w, 0) - 1, 6) AS ca_{x}_ret, round(close_{x} / nullif(lag(close_{x}, 12) OVER w, 0) - 1, 6) AS ca_{x}_ret1h, round(CASE WHEN count(volume_{x}) OVER v >= 12 THEN stddev_samp(volume_{x}) OVER v END, 6) AS ca_{x}_vol" for x in LEAD.values())
query("F51_lead_lag", f"WITH {DAILY}, t AS (SELECT ts FROM bars WHERE symbol = '1-URGENT'), g AS (SELECT t.ts, {FILLED} FROM t {' '.join(f"LEFT JOIN bars {x} ON {x}.ts = t.ts AND {x}.symbol = '{s}'" for s, x in LEAD.items())}) SELECT ts, {MOVES} FROM g WINDOW w AS (ORDER BY ts), v AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")(lambda s, d: rounded(X.lead_lag(D.daily(s, d), "1-URGENT", LEAD), 6, *[f"ca_{x}_{y}" for x in LEAD.values() for y in ("ret", "ret1h", "vol")]).drop("symbol"))
query("F53_market_flow", f"WITH {DAILY}, m AS (SELECT 'market' AS symbol, ts, sum(volume) AS volume, avg(close) AS close FROM bars GROUP BY 2), a AS (SELECT *, (volume - {q_roll('avg', 'volume', 500)}) / ({q_roll('stddev_samp', 'volume', 500)} + 1e-10) AS n, (volume - {q_roll('avg', 'volume', 60)}) / ({q_roll('stddev_samp', 'volume', 60)} + 1e-10) AS z, close / nullif({P}, 0) - 1 AS r FROM m) SELECT ts, {', '.join(f'round(coalesce(last_value({x} IGNORE NULLS) {SOFAR}, 0), 6) AS {y}' for x, y in (('n', 'volume_norm'), ('z', 'volume_z'), ('r', 'ret')))} FROM a")(lambda s, d: rounded(X.market_flow(D.daily(s, d)), 6, "volume_norm", "volume_z", "ret").select("ts", "volume_norm", "volume_z", "ret"))
query("F54_breadth", f"WITH {TEC} SELECT ts, round(sum(close), 2) AS total, count(*) AS n, round(avg((ret > 0)::INT), 6) AS gainers, round(median(ret), 6) AS median, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std FROM t0 GROUP BY 1")(lambda s, d: rounded(rounded(X.breadth(D.daily(s, d)), 6, "gainers", "median", "mean", "std"), 2, "total"))
query("F54_snapshot_breadth", f"WITH {EVENT} SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS ts, round(sum(size), 4)::DOUBLE AS volume, round(sum(price), 4) AS liquidity, round(median(price), 4) AS fdv FROM ticks GROUP BY time_bucket(INTERVAL '10 minutes', ticks.ts, TIMESTAMP '1970-01-01')")(lambda s, d: rounded(X.snapshot_breadth(D.event_ticks(s, d).withColumnsRenamed({"size": "volume"}).withColumn("liquidity", F.col("price")).withColumn("fdv", F.col("price"))), 4, "volume", "liquidity", "fdv"))
TX = "tx AS (SELECT r_name AS chain, o_orderdate AS ts, o_totalprice AS value, o_totalprice * 0.25 AS fee, (o_orderkey % 97)::DOUBLE AS gas, o_orderkey % 5 AS outputs, o_orderkey % 3 AS inputs, o_orderkey % 11 = 0 AS coinbase, o_custkey AS sender, o_custkey % 50 AS receiver FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def tx(s, d):
    o = D.table(s, d, "orders").join(D.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(D.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(D.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    return o.select(F.col("r_name").alias("chain"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), (F.col("o_totalprice") * 0.25).alias("fee"), (k % 97).cast("double").alias("gas"), (k % 5).alias("outputs"), (k % 3).alias("inputs"), (k % 11 == 0).alias("coinbase"), F.col("o_custkey").alias("sender"), (F.col("o_custkey") % 50).alias("receiver"))


WHALES = {"ASIA": 400000, "EUROPE": 300000}
query("F55_chain_daily", f"WITH {TX}, w AS (SELECT *, value >= CASE chain WHEN 'ASIA' THEN 400000 WHEN 'EUROPE' THEN 300000 ELSE 1000 END AS big FROM tx) SELECT chain, ts::DATE AS date, count(*) AS n, round(sum(value), 2) AS value, sum(big::INT) AS whales, round(sum(CASE WHEN big THEN value ELSE 0 END), 2) AS whale_value, round(median(value), 4) AS median, round(sum(fee), 4) AS fee, round(avg(fee), 7) AS mean_fee, sum(gas) AS gas, sum(outputs)::BIGINT AS outputs, sum(inputs)::BIGINT AS inputs, sum(coinbase::INT) AS coinbase, count(DISTINCT sender) AS senders, count(DISTINCT receiver) AS receivers FROM w GROUP BY 1, 2")(lambda s, d: rounded(rounded(X.chain_daily(tx(s, d), WHALES).withColumn("mean_fee", F.round("mean_fee", 7)), 2, "value", "whale_value"), 4, "fee", "median"))


def chains(s, d):
    return X.chain_daily(tx(s, d), WHALES).select("chain", F.col("date").cast("timestamp_ntz").alias("ts"), F.col("n").cast("double").alias("n"), "value")


CHAIN_OF = [("1-URGENT", "AFRICA"), ("2-HIGH", "ASIA"), ("3-MEDIUM", "ASIA")]
QC = f"WITH {DAILY}, {D.VENUE}, {TX}, c AS (SELECT chain, date_trunc('day', ts)::TIMESTAMP AS cts, count(*)::DOUBLE AS n, sum(value) AS value FROM tx GROUP BY 1, 2), k(symbol, chain) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CHAIN_OF)}), f AS (SELECT symbol, ts AS fts, close AS rate FROM venues WHERE venue = 'F')"
query("F49_onchain", f"{QC}, b AS (SELECT bars.symbol, ts, chain FROM bars LEFT JOIN k ON k.symbol = bars.symbol) SELECT b.symbol, ts, {', '.join(f"round(CASE WHEN b.chain = '{c}' AND cts >= ts - INTERVAL '3 days' THEN c.{x} END, 2) AS oc_{c}_{x}" for c in ('AFRICA', 'ASIA') for x in ('n', 'value'))} FROM b ASOF LEFT JOIN c ON c.chain = b.chain AND ts >= cts")(lambda s, d: rounded(X.onchain(D.daily(s, d).select("symbol", "ts"), chains(s, d), s.createDataFrame(CHAIN_OF, "symbol string, chain string"), ["AFRICA", "ASIA"], ["n", "value"], "3 DAYS"), 2, *[f"oc_{c}_{x}" for c in ("AFRICA", "ASIA") for x in ("n", "value")]))
query("F49_funding", f"{QC} SELECT b.symbol, ts, CASE WHEN fts >= ts - INTERVAL '2 days' THEN rate END AS funding_rate FROM bars b ASOF LEFT JOIN f ON f.symbol = b.symbol AND ts >= fts")(lambda s, d: X.funding(D.daily(s, d).select("symbol", "ts"), D.venue_bars(s, d).where("venue = 'F'").select("symbol", "ts", F.col("close").alias("funding_rate")), "2 DAYS"))
FLOW = "r AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS rts, avg(price) AS rate FROM ticks WHERE symbol = 'error' GROUP BY 1), o AS (SELECT time_bucket(INTERVAL '20 minutes', ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS ots, sum(CASE WHEN side = 1 THEN size ELSE -size END)::DOUBLE AS flow FROM ticks WHERE symbol = 'signup' GROUP BY 1)"


def flows(s, d):
    t = D.event_ticks(s, d)
    rates = t.where("symbol = 'error'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("price").alias("funding_rate"))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("size")).otherwise(0.0))
    flow = t.where("symbol = 'signup'").groupBy(F.window("ts", "20 minutes").alias("w")).agg(side(1).alias("taker_buy_vol"), side(0).alias("taker_sell_vol")).withColumn("ts", F.col("w.start"))
    return rates, flow


query("F52_leading_signals", f"WITH {HOURLY}, {FLOW} SELECT h.symbol, h.ts, round(CASE WHEN rts >= h.ts - INTERVAL '1 hour' THEN rate END, 6) AS btc_funding, round(CASE WHEN ots >= h.ts - INTERVAL '1 hour' THEN flow END, 6) AS btc_taker_flow FROM hours h ASOF LEFT JOIN r ON h.ts >= rts ASOF LEFT JOIN o ON h.ts >= ots")(lambda s, d: rounded(X.leading_signals(D.hourly(s, d).select("symbol", "ts"), *flows(s, d), "1 HOUR"), 6, "btc_funding", "btc_taker_flow"))
query("F56_token_poll", "SELECT l_partkey AS token, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS liquidity, list_sort(list(l_discount))[len(list(l_discount)) // 2 + 1] AS move, max(l_extendedprice) AS fdv FROM lineitem GROUP BY 1")(lambda s, d: rounded(X.token_poll(D.table(s, d, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("liquidity"), F.col("l_discount").alias("move"), F.col("l_extendedprice").alias("fdv"))), 2, "liquidity"))
query("F57_canonical", f"WITH {DAILY}, c AS (SELECT symbol, ts, close, {q_roll('avg', 'close', 20)} AS s, row_number() {OVER} AS k FROM bars) SELECT symbol, ts, round(s, 4) AS s20, close, 0.0::DOUBLE AS missing FROM c WHERE k >= 20")(lambda s, d: rounded(X.canonical(D.daily(s, d).withColumn("s20", R.sma("close", 20)), ["s20", "close", "missing"]), 4, "s20"))
query("F59_presence", f"WITH {DAILY}, c AS (SELECT symbol, {q_roll('avg', 'close', 900)} AS s, close FROM bars) SELECT symbol, 's' AS feature, round(count(s) / count(*), 6) AS share, CASE WHEN count(s) / count(*) <= 0.6 THEN 'sparse' END AS reason FROM c GROUP BY 1 UNION ALL SELECT symbol, 'close', 1.0::DOUBLE, NULL FROM c GROUP BY 1")(lambda s, d: rounded(X.presence(D.daily(s, d).withColumn("s", R.sma("close", 900)), ["s", "close"]), 6, "share"))

MK = f"{DAILY}, m AS (SELECT 'market' AS symbol, ts, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY 2)"


def mk(s, d):
    return M.market(D.daily(s, d))


ADX = f"""x0 AS (SELECT *, {q_roll('max', 'close', 2)} AS hi, {q_roll('min', 'close', 2)} AS lo, {P} AS pc, close / nullif({P}, 0) - 1 AS r, abs(close - {P}) AS ad, row_number() {OVER} - 1 AS k FROM m),
x1 AS (SELECT *, hi - {q_lag('hi')} AS u, {q_lag('lo')} - lo AS w, greatest(hi - lo, abs(hi - pc), abs(lo - pc)) AS t FROM x0),
x2 AS (SELECT *, CASE WHEN u > w AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN w > u AND w > 0 THEN w ELSE 0 END AS n FROM x1),
x3 AS (SELECT *, 100 * {q_roll('avg', 'p', 14)} / ({q_roll('avg', 't', 14)} + 1e-12) AS sp, 100 * {q_roll('avg', 'n', 14)} / ({q_roll('avg', 't', 14)} + 1e-12) AS sn, {q_roll('stddev_samp', 'r', 20, 5)} AS vol,
  {q_roll('stddev_samp', 'r', 20)} AS vol20, abs(close - {q_lag('close', 20)}) / ({q_roll('sum', 'ad', 20, 1)} + 1e-12) AS er FROM x2),
x4 AS (SELECT *, {q_roll('avg', 'abs(sp - sn) / (sp + sn + 1e-12) * 100', 14)} AS adx FROM x3),
x5 AS (SELECT *, k < 30 OR adx IS NULL OR vol IS NULL OR er IS NULL AS early FROM x4)"""
query("F60_simple_gate", f"WITH {MK}, {ADX} SELECT ts, CASE WHEN k >= 25 AND adx IS NOT NULL AND vol20 IS NOT NULL AND (adx < 20 OR vol20 < 0.25) THEN 'chop' ELSE 'trend' END AS regime FROM x4")(lambda s, d: M.simple_gate(mk(s, d)).select("ts", "regime"))
query("F61_rule_regime", f"WITH {MK}, {ADX}, x6 AS (SELECT *, CASE WHEN early OR (adx >= 22 AND er >= 0.35 AND vol <= 0.6) THEN 'trend' ELSE 'chop' END AS raw FROM x5) SELECT ts, CASE WHEN early THEN 'trend' WHEN {q_lag('raw')} = raw AND {q_lag('raw', 2)} = raw THEN raw ELSE {q_lag('raw')} END AS regime FROM x6")(lambda s, d: M.rule_regime(mk(s, d), vol=0.6).select("ts", "regime"))
for _name, _sql in {
    "ma": f"k >= 200 AND coalesce({q_roll('avg', 'close', 50)} > {q_roll('avg', 'close', 200)}, false)",
    "kaufman": "er >= 0.35",
    "adaptive": "er >= 0.35 * (1 + 2 * vol)",
    "choppiness": f"NOT (100 * (log10({q_roll('sum', 'hi - lo', 14, 1)} + 1e-12) - log10(greatest({q_roll('max', 'hi', 14, 1)} - {q_roll('min', 'lo', 14, 1)}, 1e-12))) / log10(14) > 61.8)",
}.items():
    query(f"F62_{_name}", f"WITH {MK}, {ADX} SELECT ts, CASE WHEN early OR {_sql} THEN 'trend' ELSE 'chop' END AS regime FROM x5")(lambda s, d, n=_name: M.method_regime(mk(s, d), n).select("ts", "regime"))
query("F62_bbwp", f"WITH {MK}, {ADX}, b0 AS (SELECT *, 4 * {q_roll('stddev_samp', 'close', 20)} / {q_roll('avg', 'close', 20)} AS bw FROM x5), b1 AS (SELECT *, list(bw) {q_frame(50)} AS v, count(*) {q_frame(50)} AS bn, count(bw) {q_frame(50)} AS nw FROM b0) SELECT ts, CASE WHEN early OR NOT coalesce(CASE WHEN nw >= 5 AND bw IS NOT NULL THEN len(list_filter(v, lambda x: x <= bw + 1e-12)) / bn END < 0.2, false) THEN 'trend' ELSE 'chop' END AS regime FROM b1")(lambda s, d: M.method_regime(mk(s, d), "bbwp").select("ts", "regime"))
query("F63_four_state", f"WITH {PART}, v0 AS (SELECT *, ln(close / {q_lag('close')}) AS ret FROM parts), v AS (SELECT *, {q_roll('stddev_samp', 'ret', 24)} AS vol, {q_roll('avg', 'close', 24)} AS ma, {q_roll('stddev_samp', 'close', 20)} AS sd FROM v0), c AS (SELECT *, {q_roll('avg', 'vol', 144)} AS calm FROM v), q AS (SELECT *, {q_roll('quantile_cont({}, 0.5)', 'calm', 720, 1)} AS md FROM c) SELECT symbol, ts, CASE WHEN coalesce(vol > md, false) THEN 'high_vol' ELSE 'low_vol' END || '_' || CASE WHEN coalesce(abs((close - ma) / (sd + 1e-10)) > 1, false) THEN 'trend' ELSE 'range' END AS regime FROM q")(lambda s, d: M.four_state(D.part_bars(s, d)).select("symbol", "ts", "regime"))
query("F64_counter_regime", f"WITH RECURSIVE {MK}, a AS (SELECT ts, coalesce(abs(close / nullif({P}, 0) - 1) > 0.3, false) AS hot, row_number() {OVER} AS k FROM m), w AS (SELECT k, ts, CASE WHEN hot THEN 1 ELSE 0 END AS c FROM a WHERE k = 1 UNION ALL SELECT a.k, a.ts, CASE WHEN hot THEN w.c + 1 ELSE greatest(0, w.c - 1) END FROM w JOIN a ON a.k = w.k + 1) SELECT ts, c AS counter, CASE WHEN c >= 3 THEN 'chop' ELSE 'trend' END AS regime FROM w")(lambda s, d: M.counter_regime(mk(s, d), 0.3, 3).select("ts", "counter", "regime"))
query("F65_sma_filter", f"WITH {MK} SELECT ts, CASE WHEN coalesce(close > {q_roll('avg', 'close', 50)}, false) THEN 'on' ELSE 'off' END AS regime FROM m")(lambda s, d: M.sma_filter(mk(s, d)).select("ts", "regime"))
query("F65_benchmark_regime", f"WITH {DAILY}, r AS (SELECT symbol, ts, close / nullif({q_lag('close', 20)}, 0) - 1 AS r FROM bars), g AS (SELECT ts, max(CASE WHEN symbol = '1-URGENT' THEN r END) - median(CASE WHEN symbol <> '1-URGENT' THEN r END) AS gap FROM r GROUP BY 1) SELECT ts, round(gap, 6) AS gap, CASE WHEN gap > 0 THEN 'benchmark' WHEN gap <= 0 THEN 'others' END AS regime FROM g")(lambda s, d: rounded(M.benchmark_regime(D.daily(s, d), "1-URGENT"), 6, "gap"))
query("F66_diagnostics", f"WITH {MK}, r AS (SELECT ts, symbol, CASE WHEN coalesce(close > {q_roll('avg', 'close', 50)}, false) THEN 'on' ELSE 'off' END AS regime FROM m), c AS (SELECT *, CASE WHEN {q_lag('regime')} = regime THEN 0 ELSE 1 END AS ch FROM r), u AS (SELECT *, sum(ch) {SOFAR} AS run FROM c), n AS (SELECT run, regime, count(*) AS n FROM u GROUP BY 1, 2) SELECT regime, sum(n) AS rows, count(*) AS runs, round(avg(n), 6) AS mean_run, median(n) AS median_run, max(n) AS longest, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM n GROUP BY 1")(lambda s, d: rounded(M.diagnostics(M.sma_filter(mk(s, d))), 6, "mean_run", "share"))
RULED = f"{MK}, {ADX}, x6 AS (SELECT *, CASE WHEN early OR (adx >= 22 AND er >= 0.35 AND vol <= 0.6) THEN 'trend' ELSE 'chop' END AS raw FROM x5), x7 AS (SELECT *, CASE WHEN early THEN 'trend' WHEN {q_lag('raw')} = raw AND {q_lag('raw', 2)} = raw THEN raw ELSE {q_lag('raw')} END AS regime FROM x6)"
FEAT = [f"{n}_{c}" for c in ("adx", "vol", "er") for n in ("mean", "median")]
query("F66_features_by_regime", f"WITH {RULED} SELECT regime, count(*) AS rows, {', '.join(f'round({n}({c}), 6) AS {m}_{c}' for c in ('adx', 'vol', 'er') for n, m in (('avg', 'mean'), ('median', 'median')))} FROM x7 WHERE k >= 25 AND adx IS NOT NULL AND vol IS NOT NULL AND er IS NOT NULL GROUP BY 1")(lambda s, d: rounded(M.features_by_regime(M.rule_regime(mk(s, d), vol=0.6)), 6, *FEAT))
query("F66_transitions", f"WITH {RULED}, c AS (SELECT *, {q_lag('regime')} <> regime AS c FROM x7) SELECT symbol, count(*) AS rows, coalesce(sum(c::INT), 0)::BIGINT AS changes, round(100.0 * coalesce(sum(c::INT), 0) / count(*), 6) AS change_rate FROM c GROUP BY 1")(lambda s, d: rounded(M.transitions(M.rule_regime(mk(s, d), vol=0.6)), 6, "change_rate"))
query("F67_market", f"WITH {MK} SELECT ts, round(close, 4) AS close, volume FROM m")(lambda s, d: rounded(mk(s, d), 4, "close").select("ts", "close", "volume"))
query("F05_hurst")(lambda s, d: M.hurst(mk(s, d)).select("ts", F.round("hurst", 6).alias("hurst"), "regime"))


from tidemark.plans.signals import SQL as RULES  # noqa: E402

SWITCHED = f"""WITH t AS ({RULES['F01_donchian']}), c AS ({RULES['F13_rsi']}), s AS ({RULES['F23_roc']}), g AS ({SQL['F65_sma_filter']}),
j AS (SELECT t.symbol, t.ts, g.regime, t.entry AS te, t.exit AS tx, c.entry AS ce, c.exit AS cx, s.entry AS se, s.exit AS sx, max(c.entry) OVER (PARTITION BY t.ts) = 0 AS silent
  FROM t JOIN c USING (symbol, ts) JOIN s USING (symbol, ts) JOIN g USING (ts))
SELECT symbol, ts, CASE WHEN regime = 'on' THEN te WHEN silent THEN se ELSE ce END AS entry, CASE WHEN regime = 'on' THEN tx WHEN silent THEN sx ELSE cx END AS exit FROM j"""


@query("F36_regime_switched", SWITCHED)
def _(s, d):
    bars = D.daily(s, d)
    regime = M.sma_filter(M.market(bars)).select("ts", F.when(F.col("regime") == "on", "trend").otherwise("chop").alias("regime"))
    return S.regime_switched(S.donchian(bars), S.rsi(bars), S.roc(bars), regime)


del _name, _sql, DAYS
