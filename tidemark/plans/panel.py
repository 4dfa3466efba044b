"""Gates, screens, rankings and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import quality as Q
from tidemark.plans import _data as D
from tidemark.plans._data import DAILY, OVER, PART, SOFAR, VENUE, q_lag, q_roll
from tidemark.plans.bars import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key, sql=None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


query("B01_exclude", f"WITH {DAILY} SELECT symbol, ts, close FROM bars WHERE symbol NOT IN ('5-LOW', '2-HIGH')")(lambda s, d: G.exclude(D.daily(s, d), ["5-LOW", "2-HIGH"]).select("symbol", "ts", "close"))
query("B02_clean", f"WITH {DAILY} SELECT symbol, ts, close FROM bars WHERE close <> 0 AND open - low <> 0")(lambda s, d: G.clean(D.daily(s, d).withColumn("x", F.when(F.col("open") != F.col("low"), 1.0).otherwise(float("inf"))).withColumn("empty", F.lit(None).cast("double")), ["x", "empty"]).select("symbol", "ts", "close"))
query("B03_min_history", f"WITH {PART}, k AS (SELECT symbol FROM parts WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY 1 HAVING count(*) >= 350) SELECT symbol, ts FROM parts WHERE ts >= TIMESTAMP '1996-01-01' AND symbol IN (SELECT symbol FROM k)")(lambda s, d: G.min_history(D.part_bars(s, d), 350, start="1996-01-01").select("symbol", "ts"))
STATS = f"{PART}, l AS (SELECT symbol, max(ts) AS lt FROM parts GROUP BY 1), st AS (SELECT p.symbol, count(*) AS n_bars, date_diff('day', min(ts), max(ts)) AS days, avg(close * volume) AS mv, avg(CASE WHEN ts >= lt - INTERVAL '30 days' THEN close * volume END) AS rv FROM parts p JOIN l ON l.symbol = p.symbol GROUP BY 1)"
query("B04_quality_gate", f"WITH {STATS} SELECT symbol, n_bars, days, round(ln(mv), 6) AS log_mean, round(ln(rv), 6) AS log_recent, CASE WHEN n_bars < 380 THEN 'few bars' WHEN days < 2450 THEN 'short history' WHEN mv < 40000 THEN 'thin' WHEN rv < 40000 THEN 'thin lately' END AS reason FROM st")(lambda s, d: G.quality_gate(D.part_bars(s, d), 380, 2450, 40000, 40000).select("symbol", "n_bars", "days", F.round(F.ln("mean_value"), 6).alias("log_mean"), F.round(F.ln("recent_value"), 6).alias("log_recent"), "reason"))
query("B05_gate_sweep", f"WITH {STATS} SELECT min_value, min_days, sum((mv >= min_value AND days >= min_days)::INT) AS passing FROM st, (SELECT unnest([30000.0, 39000.0, 45000.0])::DOUBLE AS min_value), (SELECT unnest([2300, 2450]) AS min_days) GROUP BY 1, 2")(lambda s, d: G.gate_sweep(G.gate_stats(D.part_bars(s, d)), s.createDataFrame([(v, n) for v in (30000.0, 39000.0, 45000.0) for n in (2300, 2450)], "min_value double, min_days int")))
TIER = "tiers AS (SELECT s_suppkey AS symbol, ntile(3) OVER (ORDER BY s_acctbal DESC, s_suppkey) AS tier FROM supplier)"


def tiers(s, d):
    from pyspark.sql import Window

    sup = D.table(s, d, "supplier")
    ranked = sup.withColumn("u", F.lit(1)).select(F.col("s_suppkey").alias("symbol"), F.ntile(3).over(Window.partitionBy("u").orderBy(F.col("s_acctbal").desc(), "s_suppkey")).alias("tier"))
    return ranked


RS = f"r AS (SELECT *, close / nullif({q_lag('close')}, 0) - 1 AS r FROM parts), v AS (SELECT *, {q_roll('stddev_samp', 'r', 30)} AS s FROM r), a AS (SELECT symbol, avg(close * volume) AS adv, avg(s) AS vol FROM v GROUP BY 1 HAVING avg(s) IS NOT NULL)"
AR = "(rank() OVER (PARTITION BY tier ORDER BY {c}) + (count(*) OVER (PARTITION BY tier, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY tier)"
query(
    "B06_screen",
    f"WITH {PART}, {TIER}, {RS}, t AS (SELECT * FROM a ORDER BY adv DESC, symbol LIMIT 60), j AS (SELECT t.*, tier FROM t JOIN tiers USING (symbol)), k AS (SELECT *, {AR.format(c='adv')} AS ar, {AR.format(c='vol')} AS vr, row_number() OVER (PARTITION BY tier ORDER BY vol DESC, symbol) AS n, count(*) OVER (PARTITION BY tier) AS c FROM j) SELECT symbol, tier, round(adv, 2) AS adv, round(vol, 6) AS vol, round(ar, 6) AS adv_rank, round(vr, 6) AS vol_rank FROM k WHERE n <= greatest(3, floor(0.2 * c))",
)(lambda s, d: rounded(rounded(G.screen(D.part_bars(s, d), tiers(s, d), top=60), 2, "adv"), 6, "vol", "adv_rank", "vol_rank").select("symbol", "tier", "adv", "vol", "adv_rank", "vol_rank"))
DEX_TIER = "un AS (SELECT s_suppkey AS symbol, greatest(s_acctbal, 0) AS v FROM supplier), qt AS (SELECT quantile_cont(v, [0.333, 0.667]) AS q FROM un), tiers AS (SELECT symbol, CASE WHEN v >= q[2] THEN 'large' WHEN v >= q[1] THEN 'mid' ELSE 'tail' END AS tier FROM un, qt)"


def universe(s, d):
    return D.table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.greatest("s_acctbal", F.lit(0.0)).alias("volume"))


query(
    "B11_dex_tier",
    f"WITH {PART}, {DEX_TIER}, {RS}, t AS (SELECT * FROM a ORDER BY adv DESC, symbol LIMIT 60), j AS (SELECT t.*, tier FROM t JOIN tiers USING (symbol)), k AS (SELECT *, {AR.format(c='adv')} AS ar, {AR.format(c='vol')} AS vr, row_number() OVER (PARTITION BY tier ORDER BY vol DESC, symbol) AS n, count(*) OVER (PARTITION BY tier) AS c FROM j) SELECT symbol, tier, round(adv, 2) AS adv, round(vol, 6) AS vol, round(ar, 6) AS adv_rank, round(vr, 6) AS vol_rank FROM k WHERE n <= greatest(3, floor(0.2 * c))",
)(lambda s, d: rounded(rounded(G.dex_tier_screen(D.part_bars(s, d), universe(s, d), "volume", top=60), 2, "adv"), 6, "vol", "adv_rank", "vol_rank").select("symbol", "tier", "adv", "vol", "adv_rank", "vol_rank"))
query("B07_pit_screen", f"WITH {DAILY}, r AS (SELECT *, close / nullif({q_lag('close')}, 0) - 1 AS r FROM bars), x AS (SELECT symbol, ts, avg(close * volume) {SOFAR} AS adv, stddev_samp(r) {SOFAR} AS vol FROM r), y AS (SELECT *, row_number() {OVER} AS n FROM x WHERE vol IS NOT NULL) SELECT symbol, ts, round(ln(adv), 6) AS log_adv, round(vol, 6) AS vol, ntile(3) OVER (PARTITION BY ts ORDER BY adv DESC, symbol) AS tier FROM y WHERE n >= 20")(lambda s, d: rounded(G.pit_screen(D.daily(s, d)).withColumn("log_adv", F.ln("adv")).drop("adv"), 6, "vol", "log_adv"))
query("B08_screen_asof", "SELECT symbol, \"asof\" FROM (SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate)::DATE AS \"asof\" FROM lineitem GROUP BY 1, 2) WHERE \"asof\" = (SELECT max(date_trunc('month', l_shipdate))::DATE FROM lineitem WHERE date_trunc('month', l_shipdate) <= DATE '1996-05-20')")(lambda s, d: G.screen_asof(D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("asof")).distinct(), "1996-05-20").select("symbol", "asof"))
PAIRS = "pairs AS (SELECT l_partkey AS token, l_returnflag AS chain, l_linestatus AS dex, l_extendedprice AS liquidity, l_quantity AS volume, l_shipdate AS created FROM lineitem)"


def pairs(s, d):
    return D.table(s, d, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_returnflag").alias("chain"), F.col("l_linestatus").alias("dex"), F.col("l_extendedprice").alias("liquidity"), F.col("l_quantity").alias("volume"), F.col("l_shipdate").alias("created"))


query("B09_token_screen", f"WITH {PAIRS} SELECT token, max(liquidity) AS liquidity, sum(volume) AS volume, min(created) AS oldest, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, string_agg(DISTINCT dex, ',' ORDER BY dex) AS dexes, count(*) AS n_pairs FROM pairs GROUP BY token HAVING max(liquidity) >= 80000 AND sum(volume) >= 700 AND count(*) >= 25")(lambda s, d: G.token_screen(pairs(s, d), 80000, 700, 25))
query("B10_pool_filter", f"WITH {PAIRS} SELECT token, liquidity, volume, created FROM pairs WHERE volume >= 30 AND liquidity >= 60000 AND date_diff('day', created::DATE, DATE '1998-12-01') >= 900")(lambda s, d: G.pool_filter(pairs(s, d).withColumn("change", F.lit(0.0)), 30, 60000, 900, 0.5, "1998-12-01").select("token", "liquidity", "volume", "created"))
query("B11_value_tiers", "WITH q AS (SELECT quantile_cont(s_acctbal, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM supplier) SELECT s_suppkey, CASE WHEN s_acctbal <= q[1] THEN 'small' WHEN s_acctbal <= q[2] THEN 'mid' ELSE 'large' END AS tier FROM supplier, q".replace("1/3::DOUBLE", repr(1 / 3)).replace("2/3::DOUBLE", repr(2 / 3)))(lambda s, d: G.value_tiers(D.table(s, d, "supplier"), "s_acctbal").select("s_suppkey", "tier"))
query("B12_gate_or_top", f"WITH {STATS}, ok AS (SELECT symbol, mv FROM st WHERE mv >= 1e9), top AS (SELECT symbol, mv FROM st ORDER BY mv DESC, symbol LIMIT 10) SELECT symbol, round(mv, 2) AS mean_value, 'top' AS via FROM top")(lambda s, d: rounded(G.gate_or_top(G.gate_stats(D.part_bars(s, d)), F.col("mean_value") >= 1e9, "mean_value", 5, 10), 2, "mean_value").select("symbol", "mean_value", "via"))
query("B12_gate_passes", f"WITH {STATS}, ok AS (SELECT symbol, mv FROM st WHERE mv >= 50000), top AS (SELECT symbol, mv FROM st ORDER BY mv DESC, symbol LIMIT 10) SELECT symbol, round(mv, 5) AS mean_value, 'gate' AS via FROM ok UNION ALL SELECT symbol, round(mv, 5), 'top' FROM top WHERE (SELECT count(*) FROM ok) < 5 AND symbol NOT IN (SELECT symbol FROM ok)")(lambda s, d: rounded(G.gate_or_top(G.gate_stats(D.part_bars(s, d)), F.col("mean_value") >= 50000, "mean_value", 5, 10), 5, "mean_value").select("symbol", "mean_value", "via"))
query("B12_gate_filled", f"WITH {STATS}, ok AS (SELECT symbol, mv FROM st WHERE mv >= 63000), top AS (SELECT symbol, mv FROM st ORDER BY mv DESC, symbol LIMIT 10) SELECT symbol, round(mv, 5) AS mean_value, 'gate' AS via FROM ok UNION ALL SELECT symbol, round(mv, 5), 'top' FROM top WHERE (SELECT count(*) FROM ok) < 5 AND symbol NOT IN (SELECT symbol FROM ok)")(lambda s, d: rounded(G.gate_or_top(G.gate_stats(D.part_bars(s, d)), F.col("mean_value") >= 63000, "mean_value", 5, 10), 5, "mean_value").select("symbol", "mean_value", "via"))
query("B13_rank_top", f"WITH {PAIRS} SELECT token, max(liquidity) AS liquidity FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")(lambda s, d: G.rank_top(pairs(s, d), "token", "liquidity", 25))
query("B14_topk", f"WITH {DAILY} SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY close DESC, symbol) AS k FROM bars) WHERE k <= 2")(lambda s, d: G.topk(D.daily(s, d), 2, ["ts"], [F.col("close").desc(), F.col("symbol")]).select("symbol", "ts", "close"))
query("B15_candidate_pool", f"WITH {PART}, r AS (SELECT *, close / nullif({q_lag('close')}, 0) - 1 AS r, close * volume AS v FROM parts), x AS (SELECT symbol, ts, {q_roll('avg', 'v', 20)} AS adv, {q_roll('stddev_samp', 'r', 20)} AS vol, close / nullif({q_lag('close', 20)}, 0) - 1 AS ret FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM x) SELECT symbol, round(adv, 2) AS adv, round(vol, 6) AS vol, round(ret, 6) AS ret FROM y WHERE k = 1 AND adv IS NOT NULL ORDER BY y.vol DESC, symbol LIMIT 30")(lambda s, d: rounded(rounded(G.candidate_pool(D.part_bars(s, d), "vol", 30), 2, "adv"), 6, "vol", "ret"))
PRED = "p AS (SELECT event_type AS symbol, ts, event_id, (user_id % 7) / 10.0 AS p_short, (event_id % 11) / 10.0 AS p_long, 0.3 AS p_flat FROM events)"


def predictions(s, d):
    return D.table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", ((F.col("user_id") % 7) / 10.0).alias("p_short"), ((F.col("event_id") % 11) / 10.0).alias("p_long"), F.lit(0.3).alias("p_flat"))


query("B16_confidence_gate", f"WITH {PRED}, c AS (SELECT *, greatest(p_short, p_long, p_flat) AS conf FROM p), k AS (SELECT *, CASE WHEN p_flat = conf THEN 2 WHEN p_long = conf THEN 1 ELSE 0 END AS cls FROM c) SELECT event_id, round(conf, 6)::DOUBLE AS conf, cls FROM k WHERE conf >= 0.6 AND cls <> 2")(lambda s, d: G.confidence_gate(predictions(s, d), 0.6).select("event_id", F.round("conf", 6).alias("conf"), "cls"))
WALK = f"{DAILY}, w0 AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 WHEN close < open THEN 0 ELSE 2 END AS desired, abs(close / open - 1) - 0.1 AS margin, row_number() {OVER} AS k FROM bars), w AS (SELECT symbol, k, ts, CASE WHEN desired <> 2 AND margin > 0.02 THEN desired ELSE 2 END AS pos FROM w0 WHERE k = 1 UNION ALL SELECT a.symbol, a.k, a.ts, CASE WHEN a.desired <> 2 AND a.margin > 0 AND (a.desired = w.pos OR a.margin > 0.02) THEN a.desired ELSE 2 END FROM w JOIN w0 a ON a.symbol = w.symbol AND a.k = w.k + 1)"
query("B17_cost_filter", f"WITH RECURSIVE {WALK} SELECT symbol, ts, pos FROM w")(lambda s, d: G.cost_filter(D.daily(s, d).select("symbol", "ts", F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), 0).otherwise(2).alias("desired"), (F.abs(F.col("close") / F.col("open") - 1) - 0.1).alias("margin")), 0.01, 2.0).select("symbol", "ts", "pos"))
query("B18_rank_signals", f"WITH {PRED}, c AS (SELECT *, greatest(p_short, p_long, p_flat) AS conf, date_trunc('day', ts) AS day FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY abs(conf - p_short) DESC, event_id) AS place FROM c WHERE p_long = conf AND p_flat <> conf AND conf >= 0.6) SELECT event_id, place FROM k WHERE place <= 5")(lambda s, d: G.rank_signals(G.confidence_gate(predictions(s, d), 0.6).select(F.col("event_id").alias("symbol"), F.date_trunc("day", "ts").alias("ts"), "p_short", "conf", F.when(F.col("p_long") == F.col("conf"), 1).otherwise(0).alias("cls")), 0.6, 5).select(F.col("symbol").alias("event_id"), "place"))
query("B19_market_filter", "SELECT p_partkey, p_name FROM part WHERE p_retailprice >= 1000 AND NOT regexp_matches(lower(p_type), 'steel|tin') AND NOT regexp_matches(lower(p_name), 'steel|tin')")(lambda s, d: G.market_filter(D.table(s, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("volume"), F.col("p_type").alias("symbol"), F.col("p_name").alias("name")), 1000, ["steel", "tin"]).select("p_partkey", "p_name"))
query("B19_market_filter_some", "SELECT p_partkey, p_name FROM part WHERE p_retailprice >= 901 AND NOT regexp_matches(lower(p_type), 'promo|bolt') AND NOT regexp_matches(lower(p_name), 'promo|bolt')")(lambda s, d: G.market_filter(D.table(s, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("volume"), F.col("p_type").alias("symbol"), F.col("p_name").alias("name")), 901, ["promo", "bolt"]).select("p_partkey", "p_name"))

query("Q01_spikes", f"WITH {DAILY}, m AS (SELECT *, close / nullif({q_lag('close')}, 0) - 1 AS move FROM bars) SELECT symbol, ts, round(move, 6) AS move, CASE WHEN move > 0 THEN 'up' ELSE 'down' END AS direction FROM m WHERE abs(move) > 0.5")(lambda s, d: Q.spikes(D.daily(s, d), 0.5).select("symbol", "ts", F.round("move", 6).alias("move"), "direction"))
REC = f"{VENUE}, rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts DESC) AS n FROM venues) WHERE n <= 800), md AS (SELECT symbol, ts, median(close) AS consensus, count(DISTINCT venue) AS nv FROM rv GROUP BY 1, 2 HAVING count(DISTINCT venue) >= 2), dv AS (SELECT rv.*, consensus, abs(close / consensus - 1) AS dev FROM rv JOIN md USING (symbol, ts))"
query("Q02_reconcile", f"WITH {REC} SELECT symbol, venue, ts, round(consensus, 4) AS consensus, round(dev, 6) AS deviation, dev > 0.3 AS flagged, (dev = max(dev) OVER (PARTITION BY symbol, ts) AND dev > 0.3) AS worst FROM dv")(lambda s, d: Q.reconcile(D.venue_bars(s, d), 0.3, 800).select("symbol", "venue", "ts", F.round("consensus", 4).alias("consensus"), F.round("deviation", 6).alias("deviation"), "flagged", "worst"))
CON = f"{DAILY}, {VENUE}, md AS (SELECT symbol, ts, median(close) AS consensus FROM venues GROUP BY 1, 2 HAVING count(DISTINCT venue) >= 2), ck AS (SELECT b.symbol, b.ts, b.close, coalesce(abs(b.close / consensus - 1) > 0.2, false) AS flagged, CASE WHEN coalesce(abs(b.close / consensus - 1) > 0.2, false) THEN consensus ELSE b.close END AS repaired FROM bars b LEFT JOIN md USING (symbol, ts))"
query("Q03_consensus_repair", f"WITH {CON} SELECT symbol, ts, flagged, round(repaired, 4) AS repaired FROM ck")(lambda s, d: Q.consensus_check(D.daily(s, d), D.venue_bars(s, d), 0.2, True).select("symbol", "ts", "flagged", F.round("repaired", 4).alias("repaired")))
query("Q04_last_bar", f"WITH {DAILY} SELECT symbol, max(ts) AS ts, round(abs(last(close ORDER BY bars.ts) / 200000.0 - 1), 6) AS deviation, abs(last(close ORDER BY bars.ts) / 200000.0 - 1) > 0.3 AS flagged FROM bars GROUP BY symbol")(lambda s, d: Q.last_bar_check(D.daily(s, d), D.daily(s, d).select("symbol").distinct().withColumn("quote", F.lit(200000.0)), 0.3).select("symbol", "ts", F.round("deviation", 6).alias("deviation"), "flagged"))
query("Q05_micro_anomalies", "WITH m AS (SELECT l_partkey AS token, l_orderkey, l_extendedprice - 2000 AS liquidity, l_extendedprice AS fdv FROM lineitem), q AS (SELECT token, median(fdv) AS mid FROM m GROUP BY 1) SELECT token, l_orderkey, liquidity < 0 AS bad_liquidity, abs(fdv / mid - 1) > 0.9 AS far_value FROM m JOIN q USING (token)")(lambda s, d: Q.micro_anomalies(D.table(s, d, "lineitem").select(F.col("l_partkey").alias("token"), "l_orderkey", (F.col("l_extendedprice") - 2000).alias("liquidity"), F.col("l_extendedprice").alias("fdv")), 0.9).select("token", "l_orderkey", "bad_liquidity", "far_value"))
query("Q06_quality_summary", f"WITH {CON} SELECT symbol, count(*) AS checked, sum(flagged::INT) AS flagged, sum((repaired <> close)::INT) AS repaired FROM ck GROUP BY 1")(lambda s, d: Q.quality_summary(Q.consensus_check(D.daily(s, d), D.venue_bars(s, d), 0.2, True)))
query("Q07_discover", "WITH u AS (SELECT c_nationkey AS address, min(c_custkey) AS id, 0 AS source FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_suppkey), 1 FROM supplier GROUP BY 1) SELECT address, id, source FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY source) AS k FROM u) WHERE k = 1 AND address NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(
    lambda s, d: Q.discover([D.table(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("address")).agg(F.min("c_custkey").alias("id")), D.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("address")).agg(F.min("s_suppkey").alias("id"))], D.table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("address"))).select("address", "id", "source")
)
CLASSES = (["all rights reserved"], ["license", "error"], ["the"], ["der"])
query("A12_scan_logs", "WITH l AS (SELECT lower(unnest(string_split(text, chr(10)))) AS line FROM documents), c AS (SELECT CASE WHEN regexp_matches(line, 'all rights reserved') THEN 'benign' WHEN regexp_matches(line, 'license|error') THEN 'alert' WHEN regexp_matches(line, 'the') THEN 'worker' WHEN regexp_matches(line, 'der') THEN 'suspect' ELSE 'other' END AS kind FROM l) SELECT kind, count(*) AS n FROM c GROUP BY 1")(lambda s, d: D.table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(Q.log_class(F.lower("line"), *CLASSES).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")))
