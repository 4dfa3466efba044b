"""Ingest, alignment, bars, labels, positions, and the rolling primitives."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import align as A
from tidemark.operators import bars as B
from tidemark.operators import signals as S
from tidemark.plans import _data as D
from tidemark.plans._data import DAILY, EVENT, HOURLY, OVER, PART, SOFAR, VENUE, q_ewm, q_frame, q_lag, q_roll

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


BAR = "round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume"


def rounded(df, n=4, *names):
    names = names or ("open", "high", "low", "close", "volume")
    return df.withColumns({c: F.round(c, n) for c in names})


query("D01_ohlcv_from_ticks", f"WITH {HOURLY} SELECT symbol, ts, {BAR} FROM hours")(lambda s, d: rounded(D.hourly(s, d)))
RES = "SELECT symbol, time_bucket(INTERVAL '{r}', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM hours GROUP BY 1, 2"
query("D02_resample_4h", f"WITH {HOURLY} SELECT symbol, ts, {BAR} FROM ({RES.format(r='4 hours').replace('time_bucket(INTERVAL', 'time_bucket(INTERVAL').replace(', ts) AS ts', ', ts, TIMESTAMP %s) AS ts' % repr('1970-01-01'))})")(lambda s, d: rounded(B.resample(D.hourly(s, d), "4 hours")))
query("D02_resample_1d", f"WITH {HOURLY} SELECT symbol, ts, {BAR} FROM (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM hours GROUP BY symbol, date_trunc('day', hours.ts))".replace("first(open ORDER BY ts)", "first(open ORDER BY hours.ts)").replace("last(close ORDER BY ts)", "last(close ORDER BY hours.ts)"))(lambda s, d: rounded(B.resample(D.hourly(s, d), "1 day")))
query("D03_resample_right", f"WITH {HOURLY} SELECT symbol, ts, {BAR} FROM (SELECT symbol, time_bucket(INTERVAL '4 hours', hours.ts - INTERVAL '1 microsecond', TIMESTAMP '1970-01-01') + INTERVAL '4 hours' AS ts, first(open ORDER BY hours.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY hours.ts) AS close, sum(volume) AS volume FROM hours GROUP BY symbol, time_bucket(INTERVAL '4 hours', hours.ts - INTERVAL '1 microsecond', TIMESTAMP '1970-01-01'))")(lambda s, d: rounded(B.resample(D.hourly(s, d), "4 hours", closed="right")))
query("D04_volume_bars", f"WITH {HOURLY}, n AS (SELECT *, greatest(ceil(sum(volume) {SOFAR} / 50.0) - 1, 0)::BIGINT AS bar FROM hours) SELECT symbol, bar, max(n.ts) AS ts, round(first(open ORDER BY n.ts), 4) AS open, round(max(high), 4) AS high, round(min(low), 4) AS low, round(last(close ORDER BY n.ts), 4) AS close, round(sum(volume), 4) AS volume FROM n GROUP BY symbol, bar")(lambda s, d: rounded(B.volume_bars(D.hourly(s, d), target=50.0)))


@query("D05_volume_bars_other_venue", f"WITH {DAILY}, {VENUE}, v AS (SELECT symbol, ts, close AS other FROM venues WHERE venue = 'F'), j AS (SELECT b.*, last_value(other IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS o FROM bars b LEFT JOIN v ON v.symbol = b.symbol AND v.ts = b.ts), n AS (SELECT *, greatest(ceil(sum(o) {SOFAR} / 5e6) - 1, 0)::BIGINT AS bar FROM j WHERE o IS NOT NULL) SELECT symbol, bar, max(n.ts) AS ts, round(last(close ORDER BY n.ts), 4) AS close, round(sum(o), 2) AS volume FROM n GROUP BY symbol, bar")
def _(s, d):
    other = D.venue_bars(s, d).where("venue = 'F'").select("symbol", "ts", F.col("close").alias("other"))
    j = D.daily(s, d).join(other, ["symbol", "ts"], "left").withColumn("o", R.fill_forward("other")).where("o IS NOT NULL")
    return B.volume_bars(j, target=5e6, volume="o").select("symbol", "bar", "ts", F.round("close", 4).alias("close"), F.round("volume", 2).alias("volume"))


query("D06_grid_fill", f"WITH {DAILY}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '1 day')) AS ts FROM e) SELECT g.symbol, g.ts, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts")(lambda s, d: B.grid_fill(D.daily(s, d), "1 DAY", ["close"]))
query("D07_snapshot_bars", f"WITH {EVENT}, m AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS m, last(price ORDER BY ts, tie) AS p FROM ticks GROUP BY 1, 2) SELECT symbol, m AS ts, p AS open, p AS high, p AS low, p AS close, 0.0::DOUBLE AS volume FROM m")(lambda s, d: B.snapshot_bars(D.event_ticks(s, d)))


def q_barrier(h, up, low, stop_first=False):
    out = []
    for j in range(1, h + 1):
        t, b = f"lead(high, {j}) {OVER} >= {up}", f"lead(low, {j}) {OVER} <= {low}"
        out.append(f"CASE WHEN {b} THEN 0 WHEN {t} THEN 1 END" if stop_first else f"CASE WHEN {t} THEN 1 WHEN {b} THEN 0 END")
    return f"coalesce({', '.join(out)}, 2)"


query("D08_triple_barrier", f"WITH {PART} SELECT symbol, ts, CASE WHEN lead(ts, 6) {OVER} IS NOT NULL THEN {q_barrier(6, 'close * 1.3', 'close * 0.8')} ELSE 2 END AS label FROM parts")(lambda s, d: B.triple_barrier(D.part_bars(s, d), 6, 0.3, 0.2).select("symbol", "ts", "label"))
TR = f"CASE WHEN {q_lag('close')} IS NULL THEN 0 ELSE greatest(high - low, abs(high - {q_lag('close')}), abs(low - {q_lag('close')})) END"
ATR = f"t AS (SELECT *, {TR} AS tr FROM parts), u AS (SELECT *, {q_roll('avg', 'tr', 14)} / (close + 1e-10) * close AS x FROM t), v AS (SELECT *, CASE WHEN x > 0 THEN x ELSE close * 0.004 END AS atr FROM u)"
query("D09_triple_barrier_atr", f"WITH {PART}, {ATR} SELECT symbol, ts, CASE WHEN lead(ts, 6) {OVER} IS NOT NULL THEN {q_barrier(6, 'close + 1.5 * atr', 'close - 1.5 * atr')} ELSE 2 END AS label FROM v")(lambda s, d: B.triple_barrier_atr(D.part_bars(s, d), 6).select("symbol", "ts", "label"))
GRID = [(0.1, 0.1), (0.3, 0.2), (0.5, 0.5)]
query(
    "D10_label_grid",
    f"WITH {PART} "
    + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS take, {k}::DOUBLE AS stop, round(avg((l = 1)::INT), 6) AS long_share, round(avg((l = 0)::INT), 6) AS short_share, round(avg((l = 2)::INT), 6) AS flat_share, round(1 - avg((l = 2)::INT), 6) AS trade_rate, round(abs(avg((l = 1)::INT) - avg((l = 0)::INT)), 6) AS imbalance FROM (SELECT {q_barrier(4, f'close * (1 + {t})', f'close * (1 - {k})', True)} AS l FROM parts)"
        for t, k in GRID
    ),
)(lambda s, d: rounded(B.label_grid(D.part_bars(s, d), GRID, 4), 6, "long_share", "short_share", "flat_share", "trade_rate", "imbalance"))
query("D11_forward_returns", f"WITH {DAILY}, f AS (SELECT symbol, lead(close, 5) {OVER} / close - 1 AS r FROM bars) SELECT symbol, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(avg((r > 0)::INT), 6) AS positive, round(median(r), 6) AS median, round(skewness(r), 6) AS skew FROM f GROUP BY symbol")(lambda s, d: rounded(B.forward_returns(D.daily(s, d), 5), 6, "mean", "std", "positive", "median", "skew"))
SIG = f"{DAILY}, sg0 AS (SELECT *, {q_roll('max', 'high', 40, 1)} AS t, {q_roll('min', 'low', 40, 1)} AS b FROM bars), sg AS (SELECT symbol, ts, close, coalesce(close > {q_lag('t')}, false)::INT AS e, coalesce(close < {q_lag('b')}, false)::INT AS x, row_number() {OVER} AS k FROM sg0), walk AS (SELECT symbol, k, e AS pos FROM sg WHERE k = 1 UNION ALL SELECT sg.symbol, sg.k, CASE WHEN walk.pos = 0 AND sg.e = 1 THEN 1 WHEN walk.pos = 1 AND sg.x = 1 THEN 0 ELSE walk.pos END FROM walk JOIN sg ON sg.symbol = walk.symbol AND sg.k = walk.k + 1), held AS (SELECT sg.symbol, sg.ts, sg.close, walk.pos FROM sg JOIN walk USING (symbol, k))"
query("D12_positions", f"WITH RECURSIVE {SIG} SELECT symbol, ts, pos FROM held")(lambda s, d: B.positions(S.donchian(D.daily(s, d))).select("symbol", "ts", "pos"))
RUN = f"r AS (SELECT *, sum((pos = 1 AND coalesce({q_lag('pos')}, 0) = 0)::INT) {SOFAR} AS run FROM (SELECT *, {q_lag('pos')} AS pp FROM held))".replace(f"coalesce({q_lag('pos')}, 0)", "coalesce(pp, 0)")
query("D13_episodes", f"WITH RECURSIVE {SIG}, {RUN}, n AS (SELECT *, lead(ts) {OVER} AS nt, lead(close) {OVER} AS nc FROM r), g AS (SELECT symbol, run, min(ts) AS entry_ts, first(close ORDER BY ts) AS ep, max(ts) AS lt, last(close ORDER BY ts) AS lc, arg_max(coalesce(nt, TIMESTAMP '1900-01-01'), ts) AS nt, arg_max(coalesce(nc, -1), ts) AS nc FROM n WHERE pos = 1 GROUP BY 1, 2) SELECT symbol, run::BIGINT AS trade, entry_ts, ep AS entry_price, CASE WHEN nc < 0 THEN lt ELSE nt END AS exit_ts, CASE WHEN nc < 0 THEN lc ELSE nc END AS exit_price, nc < 0 AS open, round(CASE WHEN nc < 0 THEN lc ELSE nc END / ep - 1 - 0.001, 6) AS ret FROM g")(lambda s, d: rounded(B.episodes(B.positions(S.donchian(D.daily(s, d))), 0.001), 6, "ret"))
query("D14_tail_fraction", f"WITH {DAILY}, z AS MATERIALIZED (SELECT symbol, ts, close, row_number() {OVER} - 1 AS place, count(*) OVER (PARTITION BY symbol) AS total FROM bars) SELECT symbol, ts, close FROM z WHERE place >= floor(total * 0.7)")(lambda s, d: B.tail_fraction(D.daily(s, d), 0.7).select("symbol", "ts", "close"))


@query("D15_dropoff_events", f"WITH RECURSIVE {SIG}, {RUN}, m AS (SELECT ts, median(close) AS med FROM bars GROUP BY 1), x AS (SELECT r.*, first_value(CASE WHEN pos = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY r.ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ex FROM r), o AS (SELECT x.*, row_number() OVER (PARTITION BY symbol, run ORDER BY x.ts) AS k FROM x JOIN m ON m.ts = x.ts WHERE pos = 1 AND close < med) SELECT symbol, run::BIGINT AS run, ts AS drop_ts, close AS drop_price, ex AS exit_price, round(ex / close - 1, 6) AS missed FROM o WHERE k = 1")
def _(s, d):
    bars = D.daily(s, d)
    mid = bars.groupBy("ts").agg(F.percentile("close", F.lit(0.5)).alias("med"))
    screens = bars.join(mid, "ts").where("close >= med").select("symbol", "ts")
    return rounded(B.dropoff_events(B.positions(S.donchian(bars)), screens), 6, "missed")


# rolling primitives
def prim(key, spark, sql, ctes="", digits=6):
    QUERIES[key] = lambda s, d: spark(D.daily(s, d)).select("symbol", "ts", F.round("y", digits).alias("y"))
    SQL[key] = f"WITH {DAILY}{ctes} SELECT symbol, ts, round({sql}, {digits}) AS y FROM {'z' if ctes else 'bars'}"


RCTE = f", z AS (SELECT *, close / nullif({q_lag('close')}, 0) - 1 AS r FROM bars)"
ret = lambda b: b.withColumn("r", R.change("close"))
prim("E01_change", lambda b: b.withColumn("y", R.change("close", 3)), f"close / nullif({q_lag('close', 3)}, 0) - 1")
prim("E02_rolling_mean", lambda b: b.withColumn("y", R.sma("close", 10, 3)), q_roll("avg", "close", 10, 3))
prim("E02_rolling_std", lambda b: ret(b).withColumn("y", R.std("r", 10)), q_roll("stddev_samp", "r", 10), RCTE)
prim("E03_zscore", lambda b: b.withColumn("y", R.zscore("close", 20)), f"(close - {q_roll('avg', 'close', 20)}) / nullif({q_roll('stddev_samp', 'close', 20)}, 0)")
prim("E04_rolling_median", lambda b: b.withColumn("y", R.quantile("close", 0.5, 15)), q_roll("quantile_cont({}, 0.5)", "close", 15))
prim("E05_rolling_corr", lambda b: b.withColumn("y", R.corr("close", "volume", 30)), f"CASE WHEN count(close) {q_frame(30)} >= 30 THEN covar_pop(close, volume) {q_frame(30)} / nullif(stddev_pop(close) {q_frame(30)} * stddev_pop(volume) {q_frame(30)}, 0) END")
prim("E06_ewm", lambda b: R.ewm(b, "close", "y", span=12), "y", f", {q_ewm('z', 'bars', 'close', 2 / 13)}", 2)
prim("E06_ewm_slow", lambda b: R.ewm(b, "close", "y", alpha=0.01), "y", f", {q_ewm('z', 'bars', 'close', 0.01)}", 2)
prim("E07_mean_deviation", lambda b: b.withColumn("y", R.mean_deviation("close", 20)), "CASE WHEN m IS NOT NULL THEN list_avg(list_transform(v, lambda x: abs(x - m))) END", f", z AS (SELECT *, {q_roll('avg', 'close', 20)} AS m, list(close) {q_frame(20)} AS v FROM bars)")
prim("E08_percent_rank", lambda b: b.withColumn("y", R.percent_rank("close", 50, 5)), "CASE WHEN n >= 5 THEN len(list_filter(v, lambda x: x <= close)) / n END", f", z AS (SELECT *, count(*) {q_frame(50)} AS n, list(close) {q_frame(50)} AS v FROM bars)")
prim("E09_drawdown", lambda b: b.withColumn("y", R.drawdown("close")), f"1 - close / max(close) {SOFAR}")
prim("E10_fill", lambda b: b.withColumn("s", F.when(F.col("close") > F.col("open"), F.col("close"))).withColumn("y", F.coalesce(R.fill_forward("s"), F.lit(0.0)) + F.coalesce(R.fill_backward("s"), F.lit(0.0))), f"coalesce(last_value(s IGNORE NULLS) {SOFAR}, 0) + coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)", ", z AS (SELECT *, CASE WHEN close > open THEN close END AS s FROM bars)")
prim("E11_cross", lambda b: b.withColumn("y", R.flag(R.cross_up("close", 200000.0)) - R.flag(R.cross_down("close", 200000.0))), f"coalesce({q_lag('close')} <= 200000 AND close > 200000, false)::INT - coalesce({q_lag('close')} >= 200000 AND close < 200000, false)::INT")
prim("E12_up_share", lambda b: ret(b).withColumn("y", R.up_share("r", 14)), q_roll("avg({}::INT)", "u", 14), f", z AS (SELECT *, (close / nullif({q_lag('close')}, 0) - 1 > 0) AS u FROM bars)")

# ingest
HALF = "TIMESTAMP '1998-01-01'"
query("A02_build_multi", f"WITH {VENUE} SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY venue) AS k FROM venues WHERE symbol <> '5-LOW') WHERE k = 1")(lambda s, d: B.dedup(D.venue_bars(s, d).where("symbol <> '5-LOW'").dropna(subset=["close"]), ["symbol", "ts"], [F.col("venue")]).select("symbol", "ts", "close"))
query("A06_dedup_last", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC) AS k FROM lineitem) WHERE k = 1")(lambda s, d: B.dedup(D.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_partkey")], "last").select("l_orderkey", "l_linenumber", "l_extendedprice"))
query("A07_append_newer", f"WITH {DAILY}, o AS (SELECT * FROM bars WHERE ts < {HALF} AND symbol <> '5-LOW'), m AS (SELECT symbol, max(ts) AS t FROM o GROUP BY 1) SELECT symbol, ts, close FROM o UNION ALL SELECT b.symbol, b.ts, b.close FROM bars b LEFT JOIN m ON m.symbol = b.symbol WHERE t IS NULL OR b.ts > t")(lambda s, d: B.append_newer(D.daily(s, d).where(f"ts < {HALF} AND symbol <> '5-LOW'"), D.daily(s, d)).select("symbol", "ts", "close"))
query("A07_merge_append", f"WITH {VENUE}, u AS (SELECT symbol, ts, close, 0 AS n FROM venues WHERE venue = 'F' UNION ALL SELECT symbol, ts, close, 1 FROM venues WHERE venue = 'O') SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY n DESC) AS k FROM u) WHERE k = 1")(lambda s, d: B.merge_append(D.venue_bars(s, d).where("venue = 'F'"), D.venue_bars(s, d).where("venue = 'O'"), keep="last").select("symbol", "ts", "close"))
query("A08_extend_history", f"WITH {DAILY}, o AS (SELECT * FROM bars WHERE ts < {HALF}), m AS (SELECT symbol, max(ts)::DATE AS t FROM o GROUP BY 1) SELECT symbol, ts, close FROM o UNION ALL SELECT b.symbol, b.ts, b.close FROM bars b LEFT JOIN m ON m.symbol = b.symbol WHERE t IS NULL OR b.ts::DATE > t")(lambda s, d: B.extend_history(D.daily(s, d).where(f"ts < {HALF}"), D.daily(s, d)).select("symbol", "ts", "close"))
query("A09_manifest", f"WITH {VENUE} SELECT symbol, venue, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM venues GROUP BY 1, 2")(lambda s, d: B.manifest(D.venue_bars(s, d), ["symbol", "venue"]))
query("A10_query_manifest", f"WITH {VENUE} SELECT symbol, venue, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM venues WHERE venue IN ('F', 'O') AND symbol = '1-URGENT' GROUP BY 1, 2")(lambda s, d: B.query_manifest(B.manifest(D.venue_bars(s, d), ["symbol", "venue"]), venue=["F", "O"], symbol="1-URGENT"))

# joins
EXOG = "x AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(price) AS v FROM ticks WHERE symbol = 'error' GROUP BY 1)"


def exog(s, d):
    t = D.event_ticks(s, d).where("symbol = 'error'")
    return t.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("price").alias("v"))


def others(s, d):
    return D.hourly(s, d).where("symbol <> 'error'")


query("C05_asof", f"WITH {HOURLY}, {EXOG} SELECT h.symbol, h.ts, h.close, round(x.v, 6) AS v, x.ts AS matched_ts FROM hours h ASOF LEFT JOIN x ON h.ts >= x.ts WHERE h.symbol <> 'error'")(lambda s, d: A.asof(others(s, d).select("ts", "symbol", "close"), exog(s, d), [], ["v"]).select("symbol", "ts", "close", F.round("v", 6).alias("v"), "matched_ts"))
query("C05_asof_tolerance", f"WITH {HOURLY}, {EXOG} SELECT h.symbol, h.ts, CASE WHEN x.ts >= h.ts - INTERVAL '2 hours' THEN round(x.v, 6) END AS v FROM hours h ASOF LEFT JOIN x ON h.ts >= x.ts WHERE h.symbol <> 'error'")(lambda s, d: A.asof(others(s, d).select("ts", "symbol"), exog(s, d), [], ["v"], tolerance="2 HOURS").select("symbol", "ts", F.round("v", 6).alias("v")))
DAYS = "days AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP + INTERVAL '1 day' AS te, last(close ORDER BY hours.ts) AS dc FROM hours GROUP BY 1, 2)"


@query("C06_closed_bar_align", f"WITH {HOURLY}, {DAYS} SELECT h.symbol, h.ts, d.dc AS day_close FROM hours h ASOF LEFT JOIN days d ON h.symbol = d.symbol AND h.ts >= d.te")
def _(s, d):
    h = D.hourly(s, d)
    days = B.resample(h, "1 day").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("close").alias("day_close"))
    return A.asof(h.select("symbol", "ts"), days, ["symbol"], ["day_close"]).select("symbol", "ts", "day_close")


NEAR = "CASE WHEN f.ts IS NULL OR (b.ts IS NOT NULL AND h.ts - b.ts <= f.ts - h.ts) THEN b.v ELSE f.v END"
query("C07_nearest", f"WITH {HOURLY}, {EXOG} SELECT h.symbol, h.ts, round({NEAR}, 6) AS v FROM hours h ASOF LEFT JOIN x b ON h.ts >= b.ts ASOF LEFT JOIN x f ON h.ts <= f.ts WHERE h.symbol <> 'error'")(lambda s, d: A.nearest(others(s, d).select("ts", "symbol"), exog(s, d), [], "v").select("symbol", "ts", F.round("v", 6).alias("v")))
query("C01_benchmark_join", f"WITH {DAILY} SELECT b.symbol, b.ts, round(b.close / m.close, 6) AS ratio FROM bars b JOIN bars m ON m.ts = b.ts AND m.symbol = '1-URGENT'")(lambda s, d: D.daily(s, d).join(D.daily(s, d).where("symbol = '1-URGENT'").select("ts", F.col("close").alias("m")), "ts").select("symbol", "ts", F.round(F.col("close") / F.col("m"), 6).alias("ratio")))
query("C02_attach", f"WITH {DAILY}, {VENUE}, v AS (SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY venue) AS k FROM venues) WHERE k = 1) SELECT b.symbol, b.ts, b.close, v.close AS other FROM bars b LEFT JOIN v USING (symbol, ts)")(lambda s, d: A.attach(D.daily(s, d).select("symbol", "ts", "close"), D.venue_bars(s, d).select("symbol", "ts", "venue", F.col("close").alias("other")), ["symbol", "ts"], "venue").drop("venue"))
query("C03_merge_full", f"WITH {VENUE}, j AS (SELECT symbol, ts, a.close AS f, b.close AS o FROM (SELECT * FROM venues WHERE venue = 'F') a FULL JOIN (SELECT * FROM venues WHERE venue = 'O') b USING (symbol, ts)) SELECT symbol, ts, last_value(f IGNORE NULLS) {SOFAR} AS f, last_value(o IGNORE NULLS) {SOFAR} AS o FROM j")(
    lambda s, d: A.merge_full(D.venue_bars(s, d).where("venue = 'F'").select("symbol", "ts", F.col("close").alias("f")), D.venue_bars(s, d).where("venue = 'O'").select("symbol", "ts", F.col("close").alias("o")), ["symbol", "ts"]).select("symbol", "ts", R.fill_forward("f").alias("f"), R.fill_forward("o").alias("o"))
)
query("C04_common_times", f"WITH {DAILY} SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))")(lambda s, d: A.common_times(D.daily(s, d)).select("symbol", "ts", "close"))
query("C08_enrich", "SELECT s_suppkey, s_name, coalesce(n, 0) AS n_lines, coalesce(round(v, 2), 0.0) AS value FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_suppkey = s_suppkey")(
    lambda s, d: D.table(s, d, "supplier").join(D.table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v")), "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce(F.round("v", 2), F.lit(0.0)).alias("value"))
)
query("C09_best_of", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1")(lambda s, d: A.best_of(D.table(s, d, "orders"), "o_custkey", {"F": 0, "O": 1}, "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey"))
query("C10_best_match", "SELECT c_nationkey, s_suppkey FROM (SELECT c.c_nationkey, s.s_suppkey, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY (s.s_acctbal > 5000) DESC, s.s_acctbal DESC, s.s_suppkey) AS k FROM (SELECT DISTINCT c_nationkey FROM customer) c JOIN supplier s ON s.s_nationkey = c.c_nationkey) WHERE k = 1")(
    lambda s, d: B.dedup(D.table(s, d, "customer").select("c_nationkey").distinct().join(D.table(s, d, "supplier"), F.col("c_nationkey") == F.col("s_nationkey")), ["c_nationkey"], [(F.col("s_acctbal") <= 5000).cast("int"), -F.col("s_acctbal"), F.col("s_suppkey")]).select("c_nationkey", "s_suppkey")
)
query("C11_prefix_match", "SELECT name, stem FROM (SELECT p_type AS name, n.stem, row_number() OVER (PARTITION BY p_type ORDER BY length(stem) DESC, stem) AS k FROM (SELECT DISTINCT p_type FROM part) p JOIN (SELECT DISTINCT substr(p_type, 1, 4 + (p_partkey % 3)::INT) AS stem FROM part) n ON starts_with(p.p_type, n.stem)) WHERE k = 1")(
    lambda s, d: A.prefix_match(D.table(s, d, "part").select(F.col("p_type").alias("name")).distinct(), D.table(s, d, "part").select(F.expr("substring(p_type, 1, cast(4 + p_partkey % 3 AS int))").alias("stem")).distinct()).select("name", "stem")
)
query("C12_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: D.table(s, d, "customer").join(D.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"))
query("C12_missing_history", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R')")(lambda s, d: D.table(s, d, "part").select("p_partkey").join(D.table(s, d, "lineitem").where("l_quantity >= 48 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"))


@query("C13_assign_folds", f"WITH {DAILY}, r AS (SELECT symbol, ts, row_number() {OVER} - 1 AS rn FROM bars) SELECT symbol, ts, fold FROM r JOIN (SELECT range AS fold, range * 300 AS a, range * 300 + 500 AS b FROM range(6)) ON rn >= a AND rn < b")
def _(s, d):
    splits = s.range(6).selectExpr("id AS fold", "id * 300 AS first", "id * 300 + 500 AS last")
    rows = D.daily(s, d).withColumn("rn", F.row_number().over(R.by_symbol()) - 1)
    return A.assign_folds(rows, splits).select("symbol", "ts", "fold")


query("C14_grid_join", f"WITH {DAILY}, r AS (SELECT symbol, close / {q_lag('close')} - 1 AS r FROM bars) SELECT symbol, cost, round(sum(greatest(r - cost, 0)), 6) AS kept FROM r, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) g(cost) GROUP BY 1, 2")(
    lambda s, d: D.daily(s, d).select("symbol", R.change("close").alias("r")).crossJoin(F.broadcast(s.createDataFrame([(0.001,), (0.01,), (0.1,)], "cost double"))).groupBy("symbol", "cost").agg(F.round(F.sum(F.greatest(F.col("r") - F.col("cost"), F.when(F.col("r").isNotNull(), 0.0))), 6).alias("kept"))
)
query("C15_paired", f"WITH {VENUE} SELECT symbol, count(*) AS pairs, sum((a.close > b.close)::INT) AS wins FROM (SELECT * FROM venues WHERE venue = 'F') a JOIN (SELECT * FROM venues WHERE venue = 'O') b USING (symbol, ts) GROUP BY 1")(
    lambda s, d: D.venue_bars(s, d).where("venue = 'F'").join(D.venue_bars(s, d).where("venue = 'O'").select("symbol", "ts", F.col("close").alias("o")), ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("pairs"), F.sum((F.col("close") > F.col("o")).cast("int")).alias("wins"))
)
query("C16_align_columns", f"WITH {DAILY} SELECT coalesce({q_lag('close')}, 0) AS before, close, 0.0::DOUBLE AS absent FROM bars")(lambda s, d: A.align_columns(D.daily(s, d).withColumn("before", R.lag("close")), ["before", "close", "absent"]))

