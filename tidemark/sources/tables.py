"""Readers and writers of bar files, transactions, nested JSON and logs; scalar normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "ts string, open double, high double, low double, close double, volume double"
PAIR = (
    "array<struct<chainId: string, dexId: string, pairAddress: string, baseToken: struct<address: string, symbol: string>, quoteToken: struct<symbol: string>,"
    " liquidity: struct<usd: double>, volume: struct<h24: double>, txns: struct<h24: struct<buys: long, sells: long>>, pairCreatedAt: string>>"
)
USD_LIKE = ["USD", "USDT", "USDC", "DAI", "BUSD"]


def normalize_ts(c: Column) -> Column:
    """UTC time of an ISO string, or of epoch seconds or milliseconds as a number or string; null if it is none of these."""
    text = c.cast("string")
    number = text.try_cast("double")
    epoch = F.when(F.abs(number) >= 1e11, F.timestamp_millis(number.cast("long"))).when(F.abs(number) >= 1e8, F.timestamp_seconds(number.cast("long")))
    return F.when(number.isNotNull(), epoch).otherwise(F.try_to_timestamp(text))


def read_bars(spark: SparkSession, path: str, pattern: str = r"([A-Za-z0-9]+)_([0-9a-z]+)\.csv$") -> DataFrame:
    """Bars of many CSV files; symbol and timeframe come from file names; rows with a bad time or close go."""
    raw = spark.read.schema(BARS).option("header", True).option("mode", "PERMISSIVE").csv(path)
    file = F.col("_metadata.file_path")
    df = raw.select(F.upper(F.regexp_extract(file, pattern, 1)).alias("symbol"), F.regexp_extract(file, pattern, 2).alias("tf"), normalize_ts(F.col("ts")).alias("ts"), "open", "high", "low", "close", "volume")
    return df.where("ts IS NOT NULL AND close IS NOT NULL")


def read_transactions(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Transactions partitioned by date; only the dates asked for are read."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    return df.where(F.col("date") <= F.lit(last).cast("date")) if last else df


def parse_pairs(df: DataFrame, column: str) -> DataFrame:
    """One row a pair of a JSON array; the quote is ``USD`` for dollar-like tokens, missing numbers are 0."""
    p = df.withColumn("p", F.explode(F.from_json(column, PAIR)))
    quote = F.upper(F.coalesce("p.quoteToken.symbol", F.lit("")))
    return p.select(
        *[c for c in df.columns if c != column], F.col("p.chainId").alias("chain"), F.col("p.dexId").alias("dex"), F.col("p.pairAddress").alias("address"), F.upper(F.coalesce("p.baseToken.symbol", F.lit("?"))).alias("base"),
        F.when(quote.isin(USD_LIKE), "USD").otherwise(quote).alias("quote"), F.coalesce("p.liquidity.usd", F.lit(0.0)).alias("liquidity"), F.coalesce("p.volume.h24", F.lit(0.0)).alias("volume"),
        F.coalesce("p.txns.h24.buys", F.lit(0)).alias("buys"), F.coalesce("p.txns.h24.sells", F.lit(0)).alias("sells"), normalize_ts(F.col("p.pairCreatedAt")).alias("created"),
    )


def write_table(df: DataFrame, path: str, partition: tuple[str, ...] = (), kind: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition).format(kind).save(path)


def norm_symbol(c: Column) -> Column:
    """Upper case without separators and a trailing quote currency."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"[-_/:]", "")
    return F.regexp_replace(bare, r"(USDT|USDC|USD)$", "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")


def split_pair(c: Column) -> Column:
    """Struct of base and quote of ``BASE/QUOTE``, with ``-`` and ``_`` taken for the slash."""
    part = F.split(F.upper(c), r"[-_/]")
    return F.struct(part[0].alias("base"), F.try_element_at(part, F.lit(2)).alias("quote"))
