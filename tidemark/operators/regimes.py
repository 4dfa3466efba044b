"""Market regimes: one row per time of a market series, then windows over that small table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, change, diff, frame, lag, percent_rank, roll, running, sma, std, with_quantile
from tidemark.operators.signals import bollinger

TINY = 1e-12


def market(bars: DataFrame) -> DataFrame:
    """The mean bar of all symbols at each time, as the one symbol ``market``."""
    return bars.groupBy("ts").agg(F.avg("open").alias("open"), F.avg("high").alias("high"), F.avg("low").alias("low"), F.avg("close").alias("close"), F.sum("volume").alias("volume")).withColumn("symbol", F.lit("market"))


def measured(m: DataFrame, n: int = 14, calm: int = 20, least: int = 5) -> DataFrame:
    """Adds what the regimes look at, from the closes alone: adx over two-bar highs and lows, vol (deviation of returns over ``calm`` bars,
    ``least`` of them known), er (net move over the path's length, ``calm`` bars), hi and lo (of two bars), and k, the bar's number from 0."""
    df = m.withColumns({"hi": roll(F.max, "close", 2), "lo": roll(F.min, "close", 2), "r": change("close"), "__d": F.abs(diff("close")), "k": F.row_number().over(by_symbol()) - 1})
    up, down, p = diff("hi"), -diff("lo"), lag("close")
    df = df.withColumns(
        {
            "__t": F.greatest(F.col("hi") - F.col("lo"), F.abs(F.col("hi") - p), F.abs(F.col("lo") - p)),
            "__p": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__m": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "vol": std("r", calm, least),
            "er": F.abs(diff("close", calm)) / (roll(F.sum, "__d", calm, 1) + TINY),
        }
    )
    df = df.withColumns({"__p": 100 * sma("__p", n) / (sma("__t", n) + TINY), "__m": 100 * sma("__m", n) / (sma("__t", n) + TINY)})
    df = df.withColumn("__x", F.abs(F.col("__p") - F.col("__m")) / (F.col("__p") + F.col("__m") + TINY) * 100)
    return df.withColumn("adx", sma("__x", n)).drop("__d", "__t", "__p", "__m", "__x")


def simple_gate(m: DataFrame, adx: float = 20, vol: float = 0.25, warm: int = 25) -> DataFrame:
    """Chop under either threshold; the first bars, and those without a measure yet, are a trend."""
    df = measured(m, least=20)
    known = F.col("adx").isNotNull() & F.col("vol").isNotNull()
    return df.withColumn("regime", F.when((F.col("k") >= warm) & known & ((F.col("adx") < adx) | (F.col("vol") < vol)), "chop").otherwise("trend"))


def _unknown(warm: int):
    return (F.col("k") < warm) | F.col("adx").isNull() | F.col("vol").isNull() | F.col("er").isNull()


def rule_regime(m: DataFrame, adx: float = 22, er: float = 0.35, vol: float = 0.22, warm: int = 30) -> DataFrame:
    """Trend when directional, efficient and calm. A regime stands once the two bars before agree with it; else that of the bar
    before stays, so that every change comes a bar late."""
    df = measured(m)
    df = df.withColumn("raw", F.when(_unknown(warm) | ((F.col("adx") >= adx) & (F.col("er") >= er) & (F.col("vol") <= vol)), "trend").otherwise("chop"))
    agreed = (lag("raw") == F.col("raw")) & (lag("raw", 2) == F.col("raw"))
    return df.withColumn("regime", F.when(_unknown(warm), "trend").when(agreed, F.col("raw")).otherwise(lag("raw")))


def method_regime(m: DataFrame, method: str, er: float = 0.35, warm: int = 30) -> DataFrame:
    """regime by ``ma`` (50 over 200; chop before 200 bars), ``choppiness`` (over 61.8), ``kaufman`` (efficiency of ``er`` at least),
    ``adaptive`` (the more, the more volatile) or ``bbwp`` (width rank). The first bars, and those without measures, are a trend."""
    df = measured(m)
    if method == "ma":
        trend = (F.col("k") >= 200) & F.coalesce(sma("close", 50) > sma("close", 200), F.lit(False))
    elif method == "choppiness":
        df = df.withColumn("__g", F.col("hi") - F.col("lo"))
        span = F.greatest(roll(F.max, "hi", 14, 1) - roll(F.min, "lo", 14, 1), F.lit(TINY))
        trend = ~(100 * (F.log10(roll(F.sum, "__g", 14, 1) + TINY) - F.log10(span)) / math.log10(14) > 61.8)
    elif method == "kaufman":
        trend = F.col("er") >= er
    elif method == "adaptive":
        trend = F.col("er") >= er * (1 + 2 * F.col("vol"))
    elif method == "bbwp":
        df = bollinger(df).withColumn("wp", percent_rank("width", 50, 5))
        trend = ~F.coalesce(F.col("wp") < 0.2, F.lit(False))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn("regime", F.when(_unknown(warm) | trend, "trend").otherwise("chop"))


def four_state(bars: DataFrame, n: int = 24, days: int = 144, past: int = 720, band: int = 20) -> DataFrame:
    """Deviation of log returns over ``n`` bars against the median of its own mean, and the close's distance from its mean in band deviations."""
    df = bars.withColumn("r", F.ln(F.col("close") / lag("close"))).withColumn("vol", std("r", n)).withColumn("calm", sma("vol", days))
    df = df.withColumn("far", F.coalesce(F.abs((F.col("close") - sma("close", n)) / (std("close", band) + 1e-10)) > 1, F.lit(False)))
    df = with_quantile(df, "calm", "mid", 0.5, past)
    high = F.coalesce(F.col("vol") > F.col("mid"), F.lit(False))
    return df.withColumn("regime", F.concat(F.when(high, "high_vol").otherwise("low_vol"), F.lit("_"), F.when(F.col("far"), "trend").otherwise("range"))).drop("far")


def counter_regime(m: DataFrame, threshold: float, k: int) -> DataFrame:
    """A counter that rises by one on a volatile bar and falls by one, not under 0, on others; choppy from k on.

    The counter is the running sum of its steps less that sum's least value so far, if that is under 0.
    """
    df = m.withColumn("r", change("close")).withColumn("step", F.when(F.abs("r") > threshold, 1).otherwise(-1)).withColumn("s", running(F.sum, "step"))
    df = df.withColumn("counter", F.col("s") - F.least(F.lit(0), running(F.min, "s")))
    return df.withColumn("regime", F.when(F.col("counter") >= k, "chop").otherwise("trend"))


def sma_filter(m: DataFrame, n: int = 50) -> DataFrame:
    return m.withColumn("regime", F.when(F.coalesce(F.col("close") > sma("close", n), F.lit(False)), "on").otherwise("off"))


def benchmark_regime(bars: DataFrame, benchmark: str, n: int = 20) -> DataFrame:
    """Sign of the benchmark's return over n bars less the others' median."""
    df = bars.withColumn("r", change("close", n))
    return df.groupBy("ts").agg((F.max(F.when(F.col("symbol") == benchmark, F.col("r"))) - F.percentile(F.when(F.col("symbol") != benchmark, F.col("r")), F.lit(0.5))).alias("gap")).withColumn("regime", F.when(F.col("gap") > 0, "benchmark").when(F.col("gap") <= 0, "others"))


def features_by_regime(regime: DataFrame, features: tuple[str, ...] = ("adx", "vol", "er"), first: int = 25) -> DataFrame:
    """Per regime the rows from bar ``first`` on that have all features, and mean and median of each."""
    whole = regime.where(F.col("k") >= first).dropna(subset=list(features))
    stats = [f(c).alias(f"{name}_{c}") for c in features for name, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))))]
    return whole.groupBy("regime").agg(F.count("*").alias("rows"), *stats)


def transitions(regime: DataFrame) -> DataFrame:
    """Per symbol: rows, changes of regime, and changes a hundred rows."""
    df = regime.withColumn("__c", (lag("regime") != F.col("regime")).cast("int"))
    return df.groupBy("symbol").agg(F.count("*").alias("rows"), F.coalesce(F.sum("__c"), F.lit(0)).alias("changes"), (100 * F.coalesce(F.sum("__c"), F.lit(0)) / F.count("*")).alias("change_rate"))


def diagnostics(regime: DataFrame) -> DataFrame:
    """Per regime: share of rows, runs, and mean, median and longest run."""
    changed = F.when(lag("regime") == F.col("regime"), 0).otherwise(1)
    df = regime.withColumn("run", F.sum(changed).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy("symbol", "run", "regime").agg(F.count("*").alias("n"))
    out = runs.groupBy("regime").agg(F.sum("n").alias("rows"), F.count("*").alias("runs"), F.avg("n").alias("mean_run"), F.percentile("n", F.lit(0.5)).alias("median_run"), F.max("n").alias("longest"))
    total = runs.agg(F.sum("n").alias("all"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("all")).drop("all")


def rescaled_range(closes: np.ndarray, most: int = 20) -> np.ndarray:
    """Of each row of closes the slope of log rescaled range on log lag over lags 2 to ``most``, within 0 and 1.

    For a lag the row is cut to a multiple of it, its log returns into stretches of that length; a still stretch counts as 1e-12.
    """
    logs, found = np.log(closes), []
    lags = [k for k in range(2, most + 1) if k < closes.shape[1] and closes.shape[1] // k * k - 1 >= k]
    for k in lags:
        moves = np.diff(logs[:, : closes.shape[1] // k * k], axis=1)
        x = moves[:, : moves.shape[1] // k * k].reshape(len(moves), -1, k)
        away = np.cumsum(x - x.mean(2, keepdims=True), axis=2)
        deviation = x.std(2)
        found.append(((away.max(2) - away.min(2)) / np.where(deviation > 0, deviation, 1e-12)).mean(1))
    x, y = np.log(lags), np.log(np.maximum(np.stack(found, 1), 1e-12))
    x = x - x.mean()
    return np.clip(y @ x / (x @ x), 0, 1)


def hurst(m: DataFrame, n: int = 60, threshold: float = 0.5) -> DataFrame:
    """hurst over the last n closes, and regime: trend over the threshold; before n bars, and where it is unknown, chop. Batches of frames."""

    @F.pandas_udf("double")
    def exponent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            out = np.full(len(frames), np.nan)
            whole = np.flatnonzero([v is not None and len(v) == n for v in frames])
            if len(whole):
                out[whole] = rescaled_range(np.stack(frames.iloc[whole].to_list()).astype(float))
            yield pd.Series(out).where(~np.isnan(out), None).astype(float)

    df = m.withColumn("__past", F.collect_list("close").over(frame(n))).withColumn("__k", F.row_number().over(by_symbol()) - 1)
    df = df.withColumn("hurst", exponent("__past")).withColumn("hurst", F.when(~F.isnan("hurst"), F.col("hurst")))
    return df.withColumn("regime", F.when((F.col("__k") >= n) & (F.col("hurst") > threshold), "trend").otherwise("chop")).drop("__past", "__k")
