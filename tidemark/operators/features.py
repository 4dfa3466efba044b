"""Feature blocks over bars and their side series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, change, corr, ewm, fill_forward, lag, log_ratio, ratio, sma, std, zscore
from tidemark.operators.align import asof, asof_columns, small
from tidemark.operators.bars import dedup, resample
from tidemark.operators.signals import bollinger, macd, rsi_simple

#: What ``timeframes`` takes from coarser bars.
INDICATORS = ("close", "ret", "log_ret", "atr", "atr_pct", "sma_20", "sma_50", "rsi_14", "vol_ma", "vol_ratio")


def calendar(df: DataFrame) -> DataFrame:
    """Calendar parts (Monday 0), their sines and cosines, and flags."""
    ts, tau = F.col("ts"), 2 * math.pi
    df = df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dayofyear": F.dayofyear(ts), "weekday": F.weekday(ts), "hour": F.hour(ts), "minute": F.minute(ts), "quarter": F.quarter(ts)})
    for c, n in (("month", 12), ("weekday", 7), ("hour", 24)):
        df = df.withColumn(f"{c}_sin", F.sin(F.col(c) * (tau / n))).withColumn(f"{c}_cos", F.cos(F.col(c) * (tau / n)))
    return df.withColumn("is_weekend", (F.col("weekday") >= 5).cast("int")).withColumn("is_month_start", (F.col("day") == 1).cast("int")).withColumn("is_quarter_end", ((F.col("month") % 3 == 0) & (F.to_date(ts) == F.last_day(ts))).cast("int"))


def technicals(df: DataFrame) -> DataFrame:
    df = df.withColumn("ret", change("close")).withColumn("log_ret", F.ln(F.col("close") / lag("close")))
    for n in (6, 12, 24):
        df = df.withColumn(f"ret_{n}", change("close", n)).withColumn(f"vol_{n}", std("ret", n)).withColumn(f"volume_ratio_{n}", F.try_divide(F.col("volume"), sma("volume", n)))
    for n in (20, 50):
        df = df.withColumn(f"dist_{n}", F.col("close") / sma("close", n) - 1)
    df = rsi_simple(macd(df).drop("ef", "es")).drop("gain", "loss")
    df = bollinger(df).withColumn("bb_place", F.try_divide(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))).drop("mid", "sd", "upper", "lower")
    return df


def vol_normalised(df: DataFrame, columns: list[str], n: int = 24) -> DataFrame:
    """Columns divided by the deviation of returns over n rows."""
    s = std("ret", n)
    return df.withColumns({f"{c}_norm": F.when(s != 0, F.col(c) / s) for c in columns})


def higher_frame(df: DataFrame, rule: str, interval: str, prefix: str, leaky: bool = False) -> DataFrame:
    """Return, deviation, momentum and range of coarser bars, taken only once these have closed.

    ``leaky=True`` takes them from their start on, which looks ahead; it exists to reproduce results that did.
    """
    high = resample(df.select("symbol", "ts", "open", "high", "low", "close", "volume"), rule)
    high = high.withColumn("r", change("close")).select("symbol", "ts", F.col("r").alias(f"{prefix}_ret"), std("r", 5).alias(f"{prefix}_vol"), change("close", 3).alias(f"{prefix}_mom"), ((F.col("high") - F.col("low")) / F.col("close")).alias(f"{prefix}_range"))
    if not leaky:
        high = high.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {interval}"))
    return asof(df, high, ["symbol"], [f"{prefix}_{x}" for x in ("ret", "vol", "mom", "range")]).drop("matched_ts")


def indicators(bars: DataFrame) -> DataFrame:
    """close, ret, log_ret, atr, atr_pct, sma_20, sma_50, rsi_14, vol_ma, vol_ratio of bars; means from the first bar on, RSI from 14 moves on.

    Next to a close of 0 the shares are infinite or NaN.
    """
    p, d = lag("close"), F.col("close") - lag("close")
    df = bars.withColumns({"__tr": F.when(p.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))), "__u": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__d": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    df = ewm(ewm(df, "__u", "__eu", alpha=1 / 14), "__d", "__ed", alpha=1 / 14)
    moves = F.count("__u").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"ret": ratio("close", p) - 1, "log_ret": log_ratio("close", p), "atr": sma("__tr", 14, 1), "sma_20": sma("close", 20, 1), "sma_50": sma("close", 50, 1), "vol_ma": sma("volume", 20, 1), "rsi_14": F.when(moves >= 14, 100 - 100 / (1 + F.col("__eu") / F.when(F.col("__ed") == 0, 1e-9).otherwise(F.col("__ed"))))})
    return df.withColumns({"atr_pct": ratio("atr", "close"), "vol_ratio": F.try_divide("volume", "vol_ma")}).select("symbol", "ts", *INDICATORS)


def timeframes(bars: DataFrame, frames: dict[str, str], lags: int = 1) -> DataFrame:
    """Bars with ``ht_<frame>_<indicator>`` of right-closed, right-labelled coarser bars, joined backward and set back ``lags`` rows.

    ``frames``: name to rule. Of all frames only the finished indicators meet the bars, in one pass.
    """
    names = [f"ht_{f}_{x}" for f in frames for x in INDICATORS]
    series = None
    for f, rule in frames.items():
        high = indicators(resample(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), rule, closed="right"))
        one = high.select("symbol", "ts", F.struct(*INDICATORS).alias(f))
        one = one.select("symbol", "ts", *[F.col(f) if g == f else F.lit(None).cast(high.select(F.struct(*INDICATORS).alias("x")).schema["x"].dataType).alias(g) for g in frames])
        series = one if series is None else series.unionByName(one)
    df = asof_columns(bars, series, ["symbol"], list(frames))
    df = df.withColumns({n: F.col(f"{f}.{x}") for (f, x), n in zip(((f, x) for f in frames for x in INDICATORS), names, strict=True)}).drop(*frames)
    return df.withColumns({n: lag(n, lags) for n in names}) if lags else df


def right_frame(df: DataFrame, rule: str, prefix: str) -> DataFrame:
    """One frame of ``timeframes`` under another prefix."""
    out = timeframes(df, {"f": rule})
    return out.withColumnsRenamed({f"ht_f_{x}": f"{prefix}_{x}" for x in INDICATORS})


def macro_signals(macro: DataFrame, n: int = 20, back: int = 12) -> DataFrame:
    """Of (symbol, ts, close): above its mean or not, ratio to it, and change."""
    return macro.withColumn("above", F.when(F.col("close") > sma("close", n), 1).otherwise(0)).withColumn("ratio", F.col("close") / sma("close", n)).withColumn("moved", change("close", back))


def equity_regime(wide: DataFrame) -> DataFrame:
    """Of daily (symbol, ts, stocks, vix, rates, credit): trend, fear, falling rates, credit stress, and risk on or off."""
    df = wide.withColumn("trend", (F.col("stocks") > sma("stocks", 50)).cast("int")).withColumn("fear", (F.col("vix") > 1.3 * sma("vix", 20)).cast("int"))
    df = df.withColumn("rates_fall", (F.col("rates") < lag("rates", 20)).cast("int")).withColumn("stress", (F.col("credit") < sma("credit", 50)).cast("int"))
    return df.withColumn("risk", F.when((F.col("trend") == 1) & (F.col("fear") == 0) & (F.col("stress") == 0), "on").when((F.col("trend") == 0) & ((F.col("fear") == 1) | (F.col("stress") == 1)), "off").otherwise("mixed"))


def micro(df: DataFrame) -> DataFrame:
    """Of (symbol, ts, mark, index, oi, fund, buy, sell): basis, open-interest and fund change, taker ratio."""
    return df.withColumns({"basis": F.try_divide(F.col("mark") - F.col("index"), F.col("index")), "oi_change": change("oi"), "fund_change": change("fund"), "taker_ratio": F.try_divide(F.col("buy"), F.col("buy") + F.col("sell"))})


def book_top(df: DataFrame) -> DataFrame:
    mid = (F.col("bid") + F.col("ask")) / 2
    return df.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": mid, "imbalance": F.try_divide(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))})


def cross_asset(bars: DataFrame, benchmark: str, horizons: tuple[int, ...] = (6, 12, 24, 48)) -> DataFrame:
    """Each symbol against a benchmark: returns, ratio and its change, volume z-score, relative returns, correlations."""
    b = bars.where(F.col("symbol") == benchmark).select("ts", F.col("close").alias("b_close"), F.col("volume").alias("b_volume"))
    df = bars.join(b, "ts").withColumn("ret", change("close")).withColumn("b_ret", change("b_close")).withColumn("ratio", F.col("close") / F.col("b_close"))
    df = df.withColumn("ratio_change", change("ratio")).withColumn("b_volume_z", zscore("b_volume", 20))
    for n in horizons:
        df = df.withColumn(f"rel_{n}", change("close", n) - change("b_close", n)).withColumn(f"corr_{n}", corr("ret", "b_ret", n))
    return df


def lead_lag(bars: DataFrame, target: str, others: dict[str, str], n: int = 12, least: int = 100) -> DataFrame:
    """One row a bar of the target: of each other symbol, its close at the target's times carried forward, return and return over n rows,
    and deviation of its volume over n rows, as ``ca_<name>_ret``, ``_ret1h`` and ``_vol``. ``others``: symbol to name; a symbol with
    fewer than ``least`` bars has no values."""
    few = bars.where(F.col("symbol").isin(*others))
    long = few.join(small(few.groupBy("symbol").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("symbol")), "symbol", "left_semi")
    wide = long.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"__{c}_{x}") for s, x in others.items() for c in ("close", "volume")])
    df = bars.where(F.col("symbol") == target).select("symbol", "ts").join(wide, "ts", "left")
    df = df.withColumns({f"__{c}_{x}": fill_forward(f"__{c}_{x}") for x in others.values() for c in ("close", "volume")})
    made = {f"ca_{x}_ret": change(f"__close_{x}") for x in others.values()} | {f"ca_{x}_ret1h": change(f"__close_{x}", n) for x in others.values()} | {f"ca_{x}_vol": std(f"__volume_{x}", n) for x in others.values()}
    return df.withColumns(made).select("symbol", "ts", *made)


def funding(bars: DataFrame, rates: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Bars with the last known ``funding_rate`` of their symbol; of rates at one time the last by value stands."""
    last = dedup(rates.select("symbol", "ts", "funding_rate"), ["symbol", "ts"], [F.col("funding_rate")], "last")
    return asof_columns(bars, last, ["symbol"], ["funding_rate"], tolerance)


def onchain(bars: DataFrame, daily: DataFrame, chain_of: DataFrame, chains: list[str], features: list[str], tolerance: str | None = None) -> DataFrame:
    """Bars with the last known daily features (chain, ts, features) of their symbol's chain as ``oc_<chain>_<feature>``.

    ``chain_of`` (symbol, chain) is sent to all tasks if a count shows it to be small. Symbols without a chain have no values.
    """
    mapped = bars.join(small(chain_of), "symbol", "left")
    df = asof_columns(mapped, daily.select("chain", "ts", *features), ["chain"], features, tolerance)
    return df.select(*bars.columns, *[F.when(F.col("chain") == c, F.col(f)).alias(f"oc_{c}_{f}") for c in chains for f in features])


def leading_signals(grid: DataFrame, rates: DataFrame, flow: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Rows of any symbols with the benchmark's last known funding and its taker flow, bought less sold: series without a key of (ts, funding_rate)
    and (ts, taker_buy_vol, taker_sell_vol), carried in one pass."""
    one = rates.select("ts", F.col("funding_rate").alias("btc_funding"), F.lit(None).cast("double").alias("btc_taker_flow"))
    two = flow.select("ts", F.lit(None).cast("double").alias("btc_funding"), (F.col("taker_buy_vol") - F.col("taker_sell_vol")).alias("btc_taker_flow"))
    return asof_columns(grid, one.unionByName(two), [], ["btc_funding", "btc_taker_flow"], tolerance)


def market_flow(bars: DataFrame, long: int = 500, short: int = 60) -> DataFrame:
    """Per time of the whole market: volume against its mean over many and over few rows, in deviations, and return; carried forward, 0 before."""
    m = bars.groupBy("ts").agg(F.sum("volume").alias("volume"), F.avg("close").alias("close")).withColumn("symbol", F.lit("market"))
    away = lambda n: (F.col("volume") - sma("volume", n)) / (std("volume", n) + 1e-10)
    m = m.withColumns({"volume_norm": away(long), "volume_z": away(short), "ret": change("close")})
    return m.withColumns({c: F.coalesce(fill_forward(c), F.lit(0.0)) for c in ("volume_norm", "volume_z", "ret")})


def breadth(bars: DataFrame) -> DataFrame:
    """Per time: sum of prices, symbols, share of gainers, median, mean and deviation of returns."""
    df = bars.withColumn("r", change("close"))
    return df.groupBy("ts").agg(F.sum("close").alias("total"), F.count("*").alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("gainers"), F.percentile("r", F.lit(0.5)).alias("median"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))


def snapshot_breadth(micro_rows: DataFrame, cycle: str = "10 minutes") -> DataFrame:
    return micro_rows.groupBy(F.window("ts", cycle).alias("w")).agg(F.sum("volume").alias("volume"), F.sum("liquidity").alias("liquidity"), F.percentile("fdv", F.lit(0.5)).alias("fdv")).select(F.col("w.start").alias("ts"), "volume", "liquidity", "fdv")


def chain_daily(tx: DataFrame, whale: float | dict[str, float], exact: bool = True) -> DataFrame:
    """Of transactions (chain, ts, value and what else there is of fee, gas, outputs, inputs, coinbase, from, to, sender, receiver) per chain and
    day: counts, sums, mean fee, whales and their value, median, and distinct parties. ``whale``: least value, for all chains or by chain (else 1000)."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    limit = F.lit(whale) if not isinstance(whale, dict) else F.coalesce(*[F.when(F.col("chain") == c, F.lit(float(w))) for c, w in whale.items()], F.lit(1000.0))
    big, have = F.col("value") >= limit, set(tx.columns)
    made = [F.count("*").alias("n"), F.sum("value").alias("value"), F.sum(big.cast("int")).alias("whales"), F.sum(F.when(big, F.col("value")).otherwise(0.0)).alias("whale_value"), F.percentile("value", F.lit(0.5)).alias("median")]
    made += [F.sum("fee").alias("fee"), F.avg("fee").alias("mean_fee")] if "fee" in have else []
    made += [F.sum(c).alias(c) for c in ("gas", "outputs", "inputs") if c in have]
    made += [F.sum(F.col("coinbase").cast("int")).alias("coinbase")] if "coinbase" in have else []
    made += [distinct(c).alias(f"{c}s") for c in ("from", "to", "sender", "receiver") if c in have]
    return tx.groupBy("chain", F.to_date("ts").alias("date")).agg(*made)


def token_poll(polls: DataFrame) -> DataFrame:
    """Of polls (token, volume, liquidity, move, fdv): sums, the upper median of moves, largest valuation."""
    moves = F.sort_array(F.collect_list("move"))
    return polls.groupBy("token").agg(F.sum("volume").alias("volume"), F.sum("liquidity").alias("liquidity"), F.element_at(moves, (F.floor(F.size(moves) / 2) + 1).cast("int")).alias("move"), F.max("fdv").alias("fdv"))


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key columns and exactly the listed ones in order; absent ones and nulls are 0, and rows before a symbol's first full one go."""
    present = [c for c in columns if c in df.columns]
    full = F.max(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in present], F.lit(0)) == 0, 1).otherwise(0)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("__full", full).where("__full = 1")
    return kept.select("symbol", "ts", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c) for c in columns])


def presence(df: DataFrame, columns: list[str], least: float = 0.6) -> DataFrame:
    """Per symbol and column the share of rows with a value, and why it is skipped if it is."""
    shares = df.groupBy("symbol").agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in columns])
    long = shares.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in columns])).alias("z")).select("symbol", "z.feature", "z.share")
    return long.withColumn("reason", F.when(F.col("share") <= least, "sparse"))

