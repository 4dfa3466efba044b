"""The driver's tables as ticks and bars, as DataFrames and as common table expressions of the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_ticks(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"), F.col("o_orderkey").alias("tie"), F.col("o_orderstatus").alias("venue"))


def daily(spark, d):
    return B.ohlcv(daily_ticks(spark, d), "1 day")


def event_ticks(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), (1.0 + F.col("user_id") % 10).alias("size"), F.col("event_id").alias("tie"), (F.col("event_id") % 2).alias("side"))


def hourly(spark, d):
    return B.ohlcv(event_ticks(spark, d), "1 hour")


#: Rows that a task takes over from an exchange by symbol, about.
ROWS_A_TASK = 500_000


def part_bars(spark, d):
    """Daily bars of one hundred and more symbols, laid out by symbol, so that windows over them need no further exchange.

    The more rows there are, the more parts, and a task's sort stays as small.
    """
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity")
    parts = li.count() // ROWS_A_TASK
    li = li.repartition(parts, "symbol") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else li.repartition("symbol")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.groupBy("symbol", "ts").agg(F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def venue_bars(spark, d):
    return daily_ticks(spark, d).groupBy("symbol", "venue", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("price", "tie").alias("close"))


DAILY = """bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""
EVENT = """ticks AS (SELECT event_type AS symbol, ts, value AS price, 1.0 + user_id % 10 AS size, event_id AS tie, event_id % 2 AS side FROM events)"""
HOURLY = f"""{EVENT},
hours AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, tie) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, tie) AS close, sum(size)::DOUBLE AS volume FROM ticks GROUP BY 1, 2)"""
PART = """parts AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""
VENUE = """venues AS (SELECT o_orderpriority AS symbol, o_orderstatus AS venue, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  last(o_totalprice ORDER BY o_orderkey) AS close FROM orders GROUP BY 1, 2, 3)"""

OVER = "OVER (PARTITION BY symbol ORDER BY ts)"
SOFAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def q_lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {OVER}"


def q_frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def q_roll(f: str, c: str, n: int, least: int | None = None) -> str:
    call = f.format(c) if "{}" in f else f"{f}({c})"
    return f"(CASE WHEN count({c}) {q_frame(n)} >= {n if least is None else least} THEN {call} {q_frame(n)} END)"


def q_ewm(name: str, source: str, column: str, a: float) -> str:
    """CTE ``name`` (symbol, ts, y): the recursion as a sum over the rows that still weigh anything."""
    import math

    r = 1 - a
    rows = math.ceil(45 / -math.log(r))
    return f"""{name}_n AS (SELECT symbol, ts, {column} AS x, row_number() {OVER} AS k FROM {source} WHERE {column} IS NOT NULL),
{name} AS (SELECT p.symbol, p.ts, sum(CASE WHEN q.k = 1 THEN 1 ELSE {a!r} END * pow({r!r}, p.k - q.k) * q.x) AS y
  FROM {name}_n p JOIN {name}_n q ON p.symbol = q.symbol AND q.k BETWEEN p.k - {rows} AND p.k GROUP BY 1, 2)"""
