"""Sources, scalar functions, streams run to the end of their input, and models."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import bars as B
from tidemark.operators import evaluate as V
from tidemark.operators import learn as L
from tidemark.operators import signals as S
from tidemark.plans import _data as D
from tidemark.plans._data import EVENT
from tidemark.plans.bars import rounded
from tidemark.sources import tables as T
from tidemark.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key, sql=None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def folder(spark, name):
    """A new path in the folder that all machines share; one of this machine only where none is named and all runs here, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder that all machines share is known")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream(s, d):
    """The events as a stream of files in time order; a last row far ahead closes all windows."""
    path = folder(s, "events")
    t = D.event_ticks(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    end = t.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit("~end").alias("symbol"), "ts", F.lit(0.0).alias("price"), F.lit(0.0).alias("size"), F.lit(-1).cast("long").alias("tie"), F.lit(0).cast("long").alias("side"))
    t.repartitionByRange(4, "ts").sortWithinPartitions("ts", "tie").write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    schema = s.read.parquet(path).schema
    return s.readStream.schema(schema).parquet(path)


def drain(s, df, mode="append"):
    return J.drained(df, folder(s, "checkpoint"), folder(s, "out"), mode)


def plain(df):
    return df.where("symbol <> '~end'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def scaled(c, n):
    """Scaled, rounded and scaled back, which is what ``round`` of the SQL does to a tie."""
    return F.round(F.col(c) * 10.0**n) / 10.0**n


query("H01_deduplicated", f"WITH {EVENT} SELECT symbol, tie, price FROM ticks")(lambda s, d: plain(drain(s, J.deduplicated(stream(s, d), ["tie"], "40 days"))).select("symbol", "tie", "price"))
query("H02_live_ohlcv", f"WITH {EVENT} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, round(first(price ORDER BY ticks.ts, tie), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low, round(last(price ORDER BY ticks.ts, tie), 4) AS close, round(sum(size), 4)::DOUBLE AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ticks.ts)")(lambda s, d: rounded(plain(drain(s, J.live_ohlcv(stream(s, d), "1 hour", "1 hour")))))
query("H03_taker_flow", f"WITH {EVENT} SELECT symbol, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS ts, sum(CASE WHEN side = 1 THEN size ELSE 0 END)::DOUBLE AS buy, sum(CASE WHEN side <> 1 THEN size ELSE 0 END)::DOUBLE AS sell, count(*) AS trades FROM ticks GROUP BY symbol, time_bucket(INTERVAL '5 minutes', ticks.ts, TIMESTAMP '1970-01-01')")(lambda s, d: plain(drain(s, J.taker_flow(stream(s, d), delay="1 hour"))))
query("H04_live_breadth", f"WITH {EVENT} SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS ts, sum(size)::DOUBLE AS volume, count(*) AS n, round(avg(price), 6) AS mean FROM ticks GROUP BY time_bucket(INTERVAL '10 minutes', ticks.ts, TIMESTAMP '1970-01-01')")(lambda s, d: rounded(drain(s, J.live_breadth(stream(s, d), delay="1 hour")).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 6, "mean"))
query("H05_spike_alerts", f"WITH {EVENT}, m AS (SELECT symbol, ts, price, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, tie) - 1 AS move FROM ticks) SELECT symbol, ts, price, round(move, 6) AS move FROM m WHERE abs(move) > 0.8")(lambda s, d: plain(drain(s, J.spike_alerts(stream(s, d), 0.8))).withColumn("move", scaled("move", 6)))
query("H06_venue_deviation", f"WITH {EVENT}, g AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n, median(price) AS c, list(price) AS l FROM ticks GROUP BY 1, 2) SELECT symbol, ts, n, round(c, 6) AS consensus, round(list_max(list_transform(l, lambda x: abs(x / c - 1))), 6) AS deviation FROM g")(lambda s, d: rounded(plain(drain(s, J.venue_deviation(stream(s, d).withColumn("close", F.col("price")), "1 hour", "1 hour", 0.5))), 6, "consensus", "deviation").select("symbol", "ts", "n", "consensus", "deviation"))
query("H09_stale_symbols")(lambda s, d: drain(s, J.stale_symbols(stream(s, d), 60, "10 minutes")))
@query("H08_log_alerts", "WITH l AS (SELECT lower(unnest(string_split(text, chr(10)))) AS line FROM documents), c AS (SELECT CASE WHEN regexp_matches(line, 'all rights reserved') THEN 'benign' WHEN regexp_matches(line, 'license|error') THEN 'alert' WHEN regexp_matches(line, 'the') THEN 'worker' WHEN regexp_matches(line, 'der') THEN 'suspect' ELSE 'other' END AS kind FROM l) SELECT kind, count(*) AS n FROM c WHERE kind IN ('alert', 'suspect') GROUP BY 1")
def _(s, d):
    path = folder(s, "log")
    D.table(s, d, "documents").select(F.explode(F.split(F.lower("text"), "\n")).alias("value")).write.text(path)
    out = drain(s, J.log_alerts(s.readStream.text(path), ["all rights reserved"], ["license", "error"], ["the"], ["der"]))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("H07_latest_signals", f"""WITH {EVENT}, d AS (SELECT symbol, ts, price, max(price) OVER w AS t, min(price) OVER w AS b FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, tie ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
e AS (SELECT symbol, ts, coalesce(price > lag(t) OVER o, false)::INT AS entry, coalesce(price < lag(b) OVER o, false)::INT AS exit, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM d WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, entry, exit FROM e WHERE k = 1""")
def _(s, d):
    price, path = F.col("price"), folder(s, "bars")
    bars = D.event_ticks(s, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.col("size").alias("volume"))
    edges = bars.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0] or []
    for a, b in zip([None, *edges], [*edges, None], strict=True):  # files in the order of time, a micro-batch each
        part = bars.where((F.lit(a is None) | (F.unix_micros("ts") > F.lit(a))) & (F.lit(b is None) | (F.unix_micros("ts") <= F.lit(b))))
        part.coalesce(1).write.mode("append").parquet(path)
    bars = s.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state, out = folder(s, "state"), folder(s, "signals")
    each = J.latest_signals(state, out, S.donchian, 100)
    bars.writeStream.foreachBatch(each).option("checkpointLocation", folder(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return J.newest_signals(s.read.parquet(out)).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "entry", "exit")


query("U01_norm_symbol", "SELECT s_suppkey, regexp_replace(regexp_replace(upper(trim(s_name || '-usdt')), '[-_/:]', '', 'g'), '(USDT|USDC|USD)$', '') AS symbol FROM supplier")(lambda s, d: D.table(s, d, "supplier").select("s_suppkey", T.norm_symbol(F.concat("s_name", F.lit("-usdt"))).alias("symbol")))
query("U02_safe_name", "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS name FROM part")(lambda s, d: D.table(s, d, "part").select("p_partkey", T.safe_name(F.col("p_type")).alias("name")))
query("U03_split_pair", "SELECT o_orderkey, string_split(upper(o_orderpriority), '-')[1] AS base, regexp_split_to_array(upper(o_orderpriority), '[-_/]')[2] AS quote FROM orders")(lambda s, d: D.table(s, d, "orders").select("o_orderkey", T.split_pair(F.col("o_orderpriority")).alias("p")).select("o_orderkey", "p.base", "p.quote"))
query("A04_normalize_ts", "SELECT event_id, ts FROM (SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events)")(
    lambda s, d: D.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).when(F.col("event_id") % 3 == 1, (1000 * F.unix_seconds(F.col("ts").cast("timestamp"))).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("raw")).select("event_id", T.normalize_ts(F.col("raw")).cast("timestamp_ntz").alias("ts"))
)


@query("A05_parse_pairs", "SELECT l_orderkey, l_returnflag AS chain, upper(l_linestatus) AS base, count(*) AS n, round(sum(l_extendedprice), 2) AS liquidity FROM lineitem GROUP BY 1, 2, 3")
def _(s, d):
    li = D.table(s, d, "lineitem")
    pair = F.struct(F.col("l_returnflag").alias("chainId"), F.struct(F.lower("l_linestatus").alias("symbol")).alias("baseToken"), F.struct(F.lit("usdt").alias("symbol")).alias("quoteToken"), F.struct(F.col("l_extendedprice").alias("usd")).alias("liquidity"))
    packed = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(pair)).alias("json"))
    out = T.parse_pairs(packed, "json").where("quote = 'USD'")
    return out.groupBy("l_orderkey", "chain", "base").agg(F.count("*").alias("n"), F.round(F.sum("liquidity"), 2).alias("liquidity"))


@query("A01_read_bars", f"WITH {D.DAILY} SELECT replace(replace(symbol, '-', ''), ' ', '') AS symbol, ts, close FROM bars")
def _(s, d):
    path = folder(s, "csv")
    name = F.regexp_replace("symbol", "[- ]", "")
    out = D.daily(s, d).select(name.alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")
    out.write.partitionBy("symbol").option("header", True).csv(path)
    return T.read_bars(s, path + "/*", r"symbol=([A-Za-z0-9]+)/(part).*\.csv$").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


@query("A03_read_transactions", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-02-01' AND DATE '1996-03-31'")
def _(s, d):
    path = folder(s, "tx")
    o = D.table(s, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    o.repartition("date").write.partitionBy("date").parquet(path)
    return T.read_transactions(s, path, "1996-02-01", "1996-03-31").select("o_orderkey", "o_totalprice")


@query("A11_write_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    path = folder(s, "sink")
    T.write_table(D.table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, ("o_orderstatus",))
    return s.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def numbered(s, d):
    b = B.triple_barrier(D.part_bars(s, d), 6, 0.3, 0.2)
    return b.withColumn("ret", R.change("close")).withColumn("mom", R.change("close", 5)).withColumn("vr", F.col("volume") / R.sma("volume", 10)).withColumn("rn", F.row_number().over(R.by_symbol()) - 1)


COLS = ["ret", "mom", "vr"]


def kept(s, d, named=("symbol", "ts")):
    """The numbered bars, written to the shared folder once: a fit reads its rows many times. What is not asked for takes no disk."""
    path, df = folder(s, "panel"), numbered(s, d).select(*named, "rn", "label", *COLS)
    df.write.option("compression", "zstd").parquet(path)
    return s.read.schema(df.schema).parquet(path)


def panel(s, d, named=("symbol", "ts")):
    return kept(s, d, named).dropna(subset=COLS)


def parted(df, rn):
    """Earlier and later rows."""
    return df.where(F.col("rn") < rn), df.where(F.col("rn") >= rn)


@query("M01_walk_forward")
def _(s, d):
    rows = kept(s, d)
    return L.walk_forward(rows.dropna(subset=COLS), COLS, V.wf_splits(rows, 10, 70, 10, 2), folder=folder(s, "folds"), trees=5, depth=3).groupBy("fold", "cls").agg(F.count("*").alias("n"))


query("M02_one_vs_rest")(lambda s, d: L.one_vs_rest(*parted(panel(s, d), 300), COLS, 1, 3)[0].groupBy("symbol").agg(F.avg("p").alias("p")))
query("M03_pooled_against_own")(lambda s, d: L.pooled_against_own(panel(s, d), COLS, folder(s, "own"), trees=3, depth=3))
query("M04_compare_depths")(lambda s, d: s.createDataFrame(sorted(L.compare_depths(*parted(panel(s, d), 300), COLS, (2, 4), trees=3)[0].items()), "depth int, macro_f1 double"))
query("M04_model_search")(lambda s, d: L.model_search(panel(s, d, ()), COLS, 250, 350, {"maxDepth": [2, 4], "numTrees": [3, 6]}))


@query("M05_score")
def _(s, d):
    early, late = parted(panel(s, d), 300)
    return L.score(L.three_class(early, COLS, 3, 3), late, COLS).select("symbol", "ts", "cls", "conf", "strength")
