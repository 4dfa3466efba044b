"""Filters, gates, screens and rankings of a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, change, sma, std
from tidemark.operators.align import small
from tidemark.operators.bars import dedup


def exclude(df: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    return df.where(~F.col(key).isin(names))


def clean(df: DataFrame, required: list[str]) -> DataFrame:
    """Infinite and NaN values become null; rows without a required value go, for required columns that hold any value."""
    fine = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df = df.withColumns(fine) if fine else df
    counts = df.agg(*[F.count(c).alias(c) for c in required]).first()
    return df.dropna(subset=[c for c in required if counts[c]])


def min_history(bars: DataFrame, n: int, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    enough = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= n).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def gate_stats(bars: DataFrame, recent_days: int = 30) -> DataFrame:
    """Per symbol: bars, days of history, mean traded value in all and over the last days."""
    value = F.col("close") * F.col("volume")
    last = bars.groupBy("symbol").agg(F.max("ts").alias("__last"))
    recent = F.when(F.col("ts") >= F.col("__last") - F.expr(f"INTERVAL {recent_days} DAYS"), value)
    return bars.join(last, "symbol").groupBy("symbol").agg(F.count("*").alias("n_bars"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.avg(value).alias("mean_value"), F.avg(recent).alias("recent_value"))


def quality_gate(bars: DataFrame, min_bars: int, min_days: int, min_value: float, min_recent: float) -> DataFrame:
    """gate_stats with the first reason for rejection, null for those that pass."""
    reason = F.when(F.col("n_bars") < min_bars, "few bars").when(F.col("days") < min_days, "short history").when(F.col("mean_value") < min_value, "thin").when(F.col("recent_value") < min_recent, "thin lately")
    return gate_stats(bars).withColumn("reason", reason)


def gate_sweep(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Symbols that pass for each (min_value, min_days) of a small grid."""
    return stats.crossJoin(small(grid)).groupBy("min_value", "min_days").agg(F.sum(((F.col("mean_value") >= F.col("min_value")) & (F.col("days") >= F.col("min_days"))).cast("int")).alias("passing"))


def average_rank_share(by: Column, within: list[str]) -> Column:
    """Average rank over the number of rows, as a share; ties share their mean rank."""
    w = Window.partitionBy(*within)
    same = F.count(F.lit(1)).over(Window.partitionBy(*within, by))
    return (F.rank().over(w.orderBy(by)) + (same - 1) / 2) / F.count(F.lit(1)).over(w)


def screen(bars: DataFrame, tiers: DataFrame, top: int = 500, share: float = 0.2, least: int = 3, window: int = 30) -> DataFrame:
    """The ``top`` symbols by mean traded value, and of each tier the most volatile share of them (``least`` at least)."""
    df = bars.withColumn("__r", change("close")).withColumn("__s", std("__r", window))
    stats = df.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), F.avg("__s").alias("vol")).where("vol IS NOT NULL")
    liquid = stats.orderBy(F.col("adv").desc(), "symbol").limit(top).join(tiers, "symbol")
    liquid = liquid.withColumn("adv_rank", average_rank_share(F.col("adv"), ["tier"])).withColumn("vol_rank", average_rank_share(F.col("vol"), ["tier"]))
    w = Window.partitionBy("tier")
    liquid = liquid.withColumn("__n", F.row_number().over(w.orderBy(F.col("vol").desc(), "symbol"))).withColumn("__k", F.greatest(F.lit(least), F.floor(F.lit(share) * F.count(F.lit(1)).over(w))))
    return liquid.where("__n <= __k").drop("__n", "__k")


def pit_screen(bars: DataFrame, least: int = 20) -> DataFrame:
    """For every date, each symbol's mean traded value and return deviation over its bars so far, and its tercile of value."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("__r", change("close")).withColumn("adv", F.avg(F.col("close") * F.col("volume")).over(w)).withColumn("vol", F.stddev_samp("__r").over(w)).where(F.col("vol").isNotNull() & F.col("adv").isNotNull())
    df = df.withColumn("__n", F.row_number().over(by_symbol())).where(F.col("__n") >= least)
    return df.select("symbol", "ts", "adv", "vol", F.ntile(3).over(Window.partitionBy("ts").orderBy(F.col("adv").desc(), "symbol")).alias("tier"))


def screen_asof(screens: DataFrame, day: str) -> DataFrame:
    """The latest screen on or before a day, else the earliest."""
    at = F.lit(day).cast("date")
    chosen = screens.agg(F.coalesce(F.max(F.when(F.col("asof") <= at, F.col("asof"))), F.min("asof")).alias("asof"))
    return screens.join(F.broadcast(chosen), "asof", "left_semi")


def token_screen(pairs: DataFrame, min_liquidity: float, min_volume: float, min_pairs: int) -> DataFrame:
    """Tokens of pairs (token, chain, dex, liquidity, volume, created): best liquidity, total volume, oldest pair, lists."""
    made = pairs.groupBy("token").agg(
        F.max("liquidity").alias("liquidity"), F.sum("volume").alias("volume"), F.min("created").alias("oldest"), F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"), F.array_join(F.array_sort(F.collect_set("dex")), ",").alias("dexes"), F.count("*").alias("n_pairs")
    )
    return made.where((F.col("liquidity") >= min_liquidity) & (F.col("volume") >= min_volume) & (F.col("n_pairs") >= min_pairs))


def pool_filter(pools: DataFrame, min_volume: float, min_liquidity: float, min_age_days: int, max_change: float, now: str) -> DataFrame:
    age = F.datediff(F.lit(now).cast("date"), F.to_date("created"))
    return pools.where((F.col("volume") >= min_volume) & (F.col("liquidity") >= min_liquidity) & (age >= min_age_days) & (F.abs("change") <= max_change))


def value_tiers(df: DataFrame, by: str, names: tuple[str, str, str] = ("small", "mid", "large")) -> DataFrame:
    """Tier by the exact terciles of a column; the two cut values are a single row."""
    cut = df.agg(F.percentile(by, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__q"))
    return df.crossJoin(F.broadcast(cut)).withColumn("tier", F.when(F.col(by) <= F.col("__q")[0], names[0]).when(F.col(by) <= F.col("__q")[1], names[1]).otherwise(names[2])).drop("__q")


def volume_tiers(universe: DataFrame, by: str, low: float = 0.333, high: float = 0.667) -> DataFrame:
    """(symbol, tier): large from the upper quantile of a column on, mid from the lower one on, else tail; a missing value counts as 0."""
    v = F.coalesce(F.col(by), F.lit(0.0))
    cut = universe.agg(F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("__q"))  # one row
    return universe.crossJoin(F.broadcast(cut)).select("symbol", F.when(v >= F.col("__q")[1], "large").when(v >= F.col("__q")[0], "mid").otherwise("tail").alias("tier"))


def dex_tier_screen(bars: DataFrame, universe: DataFrame, by: str, **options) -> DataFrame:
    """The liquidity and volatility screen within tiers by a day's volume."""
    return screen(bars, volume_tiers(universe, by), **options)


def gate_or_top(stats: DataFrame, passes: Column, by: str, least: int, n: int) -> DataFrame:
    """Rows that pass; if fewer than ``least`` do, the top ``n`` by a column as well."""
    ok = stats.where(passes).withColumn("via", F.lit("gate"))
    few = ok.agg((F.count("*") < least).alias("__few"))
    top = stats.orderBy(F.col(by).desc(), "symbol").limit(n).crossJoin(F.broadcast(few)).where("__few").drop("__few").withColumn("via", F.lit("top"))
    return dedup(ok.unionByName(top), ["symbol"], [F.col("via")])


def rank_top(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.max(by).alias(by)).orderBy(F.col(by).desc(), key).limit(n)


def topk(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def candidate_pool(bars: DataFrame, kind: str, n: int) -> DataFrame:
    """Each symbol's last row: traded value, deviation and return over 20 rows; the n largest by value or deviation."""
    df = bars.withColumn("__v", F.col("close") * F.col("volume")).withColumn("__r", change("close"))
    df = df.withColumn("adv", sma("__v", 20)).withColumn("vol", std("__r", 20)).withColumn("ret", change("close", 20))
    last = dedup(df, ["symbol"], [F.col("ts")], "last").select("symbol", "adv", "vol", "ret").where("adv IS NOT NULL")
    by = {"adv": "adv", "vol": "vol", "broad": "adv"}[kind]
    return last if kind == "broad" else last.orderBy(F.col(by).desc_nulls_last(), "symbol").limit(n)


def confidence_gate(predictions: DataFrame, threshold: float) -> DataFrame:
    """Predictions (p_short, p_long, p_flat) that point a way surely enough, with class and confidence."""
    best = F.greatest("p_short", "p_long", "p_flat")
    cls = F.when(F.col("p_flat") == best, 2).when(F.col("p_long") == best, 1).otherwise(0)
    return predictions.withColumn("conf", best).withColumn("cls", cls).where((F.col("conf") >= threshold) & (F.col("cls") != 2))


def cost_filter(predictions: DataFrame, cost: float, times: float) -> DataFrame:
    """pos: the desired side (2 is flat) once, within its run of rows with a margin, some row's margin passed times * cost.

    Equal to changing position only for a margin that pays the cost, as the position before can only be the desired one
    inside such a run.
    """
    live = (F.col("desired") != 2) & (F.col("margin") > 0)
    df = predictions.withColumn("__live", live).withColumn("__key", F.when(live, F.col("desired")).otherwise(-1))
    before = F.lag("__key").over(by_symbol())
    df = df.withColumn("__run", F.sum(F.when(before.isNull() | (before != F.col("__key")), 1).otherwise(0)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    paid = F.max((F.col("margin") > times * cost).cast("int")).over(Window.partitionBy("symbol", "__run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("pos", F.when(F.col("__live") & (paid == 1), F.col("desired")).otherwise(2)).drop("__live", "__key", "__run")


def rank_signals(predictions: DataFrame, threshold: float, n: int) -> DataFrame:
    """Long rows that are sure enough, the n strongest of each time."""
    long = predictions.where((F.col("cls") == 1) & (F.col("conf") >= threshold)).withColumn("strength", F.col("conf") - F.col("p_short"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy(F.abs("strength").desc(), "symbol"))).where(F.col("place") <= n)


def market_filter(markets: DataFrame, min_volume: float, words: list[str]) -> DataFrame:
    pattern = "(?i)" + "|".join(words)
    return markets.where((F.col("volume") >= min_volume) & ~F.col("symbol").rlike(pattern) & ~F.col("name").rlike(pattern))
