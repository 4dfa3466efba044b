"""The frozen block of model features, declared as a graph and resolved into one ordered projection.

A feature names its inputs, so that any wanted set pulls in what it needs and nothing else. Features of equal depth are
computed in one projection; all windows run over the bars of a symbol in time order, those of coarser bars included, so
the whole block needs one exchange by symbol after the side series are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, change, corr, diff, ewm, lag, log_ratio, ratio, roll, sma, std, with_quantile
from tidemark.operators.align import asof, small
from tidemark.operators.bars import true_range

TINY = 1e-10
ASSETS = ("ETHUSDT", "SOLUSDT", "DOGEUSDT")
SPANS = (6, 12, 24, 48)
#: Names of the block's columns, in the order that models were trained on.
CALENDAR = ("year", "month", "day_of_year", "weekday", "hour", "minute", "hour_sin", "hour_cos", "month_sin", "month_cos", "weekday_sin", "weekday_cos", "is_weekend", "is_month_start", "is_month_end", "quarter", "is_quarter_start", "is_quarter_end")
PRICE = ("ret_1", "ret_3", "ret_6", "ret_12", "ret_24", "volatility_12", "volatility_24", "vol_ratio", "volume_change", "sma_dist_6", "sma_dist_12", "sma_cross_signal", "ema_ratio", "macd_hist", "macd_hist_smooth", "rsi_14", "bb_pos", "bb_width", "atr_ratio")
FRAMES = ("ret_1h", "vol_1h", "mom_1h_3h", "mom_1h_6h", "range_1h_pct", "ret_4h", "vol_4h", "mom_4h_12h", "range_4h_pct")
MACRO = ("spy_close_ma20_signal", "gld_close_ma20_signal", "tlt_close_ma20_signal", "uup_close_ma20_signal", "vix_close_ma20_signal", "btc_spy_ratio_chg", "btc_gld_ratio_chg", "btc_uup_ratio_chg")
MICRO = ("funding_rate", "basis_pct", "open_interest", "oi_chg_12", "insurance_balance", "taker_buy_vol", "taker_sell_vol", "taker_buy_sell_ratio", "trade_count", "imbalance", "spread")
EQUITIES = ("eq_spy_signal", "eq_gold_signal", "eq_tlt_signal", "eq_uup_signal", "eq_vix_signal", "eq_vix_spike", "eq_risk_on", "eq_risk_off", "eq_rates_falling", "eq_credit_stress")
REGIME = ("regime_high_vol", "regime_trending")


def cross_names(asset: str) -> list[str]:
    return [f"{asset}_{x}" for x in ("returns", "btc_ratio", "btc_ratio_chg", "volume_z")] + [f"{asset}_btc_ret_rel_{n}" for n in SPANS] + [f"btc_corr_{asset}_{n}" for n in SPANS]


CANONICAL: tuple[str, ...] = (*CALENDAR, *PRICE, *FRAMES, *MACRO, *MICRO, *cross_names("ETHUSDT"), *cross_names("SOLUSDT"), *EQUITIES, *cross_names("DOGEUSDT"), *REGIME)
#: These are divided by the deviation of returns over 24 bars.
SCALED = ("macd_hist", "macd_hist_smooth", "sma_dist_6", "sma_dist_12", "sma_cross_signal", "ema_ratio", "bb_pos", "bb_width")


@dataclass(frozen=True)
class Feature:
    """``make`` builds the column of the inputs' names; with ``span`` it is their exponential mean, with ``past`` the median of so many rows, instead."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[[], Column] | None = None
    span: int | None = None
    past: int | None = None


def _graph() -> dict[str, Feature]:
    c = F.col
    found: list[Feature] = []

    def add(name: str, inputs: str, make: Callable[[], Column] | None = None, span: int | None = None, past: int | None = None) -> None:
        found.append(Feature(name, tuple(inputs.split()), make, span, past))

    parts = {"year": F.year, "month": F.month, "day_of_year": F.dayofyear, "weekday": F.weekday, "hour": F.hour, "minute": F.minute, "day": F.dayofmonth, "quarter": F.quarter}
    for name, part in parts.items():
        add(name, "ts", lambda part=part: part("ts"))
    for name, n in (("hour", 24), ("month", 12), ("weekday", 7)):
        add(f"{name}_sin", name, lambda x=name, n=n: F.sin(c(x) * (2 * math.pi / n)))
        add(f"{name}_cos", name, lambda x=name, n=n: F.cos(c(x) * (2 * math.pi / n)))
    add("is_weekend", "weekday", lambda: (c("weekday") >= 5).cast("int"))
    add("is_month_start", "day", lambda: (c("day") <= 3).cast("int"))
    add("is_month_end", "day", lambda: (c("day") >= 28).cast("int"))
    add("is_quarter_start", "month day", lambda: ((c("month") % 3 == 1) & (c("day") <= 5)).cast("int"))
    add("is_quarter_end", "month day", lambda: ((c("month") % 3 == 0) & (c("day") >= 25)).cast("int"))

    add("ret_1", "close", lambda: log_ratio("close", lag("close")))
    for n in (3, 6, 12, 24):
        add(f"ret_{n}", "ret_1", lambda n=n: roll(F.sum, "ret_1", n))
    for n in (12, 24):
        add(f"volatility_{n}", "ret_1", lambda n=n: std("ret_1", n))
    add("vol_ratio", "volume", lambda: sma("volume", 6) / (sma("volume", 24) + TINY))
    add("volume_change", "volume", lambda: change("volume"))
    add("sma6", "close", lambda: sma("close", 6))
    add("sma12", "close", lambda: sma("close", 12))
    add("sma24", "close", lambda: sma("close", 24))
    for n in (6, 12):
        add(f"raw_sma_dist_{n}", f"close sma{n}", lambda n=n: (c("close") - c(f"sma{n}")) / (c(f"sma{n}") + TINY))
    add("raw_sma_cross_signal", "sma6 sma12", lambda: (c("sma6") - c("sma12")) / (c("sma12") + TINY))
    add("ema12", "close", span=12)
    add("ema26", "close", span=26)
    add("raw_ema_ratio", "ema12 ema26", lambda: c("ema12") / (c("ema26") + TINY))
    add("raw_macd_hist", "ema12 ema26", lambda: c("ema12") - c("ema26"))
    add("raw_macd_hist_smooth", "raw_macd_hist", span=9)
    add("gain", "close", lambda: F.when(diff("close").isNotNull(), F.greatest(diff("close"), F.lit(0.0))))
    add("loss", "close", lambda: F.when(diff("close").isNotNull(), F.greatest(-diff("close"), F.lit(0.0))))
    add("rsi_14", "gain loss", lambda: 100 - 100 / (1 + sma("gain", 14) / (sma("loss", 14) + TINY)))
    add("bb_mid", "close", lambda: sma("close", 20))
    add("bb_std", "close", lambda: std("close", 20))
    add("raw_bb_width", "bb_mid bb_std", lambda: 4 * c("bb_std") / (c("bb_mid") + TINY))
    add("raw_bb_pos", "close bb_mid bb_std", lambda: (c("close") - (c("bb_mid") - 2 * c("bb_std"))) / (4 * c("bb_std") + TINY))
    add("true_range", "high low close", true_range)
    add("atr_ratio", "true_range close", lambda: sma("true_range", 14) / (c("close") + TINY))
    for x in SCALED:
        add(x, f"raw_{x} volatility_24", lambda x=x: c(f"raw_{x}") / (c("volatility_24") + TINY))
    add("vol_6d", "volatility_24", lambda: sma("volatility_24", 144))
    add("vol_mid", "vol_6d", past=720)
    add("regime_high_vol", "volatility_24 vol_mid", lambda: F.coalesce(c("volatility_24") > c("vol_mid"), F.lit(False)).cast("int"))
    add("regime_trending", "close sma24 bb_std", lambda: F.coalesce(F.abs((c("close") - c("sma24")) / (c("bb_std") + TINY)) > 1, F.lit(False)).cast("int"))

    # bars of coarser frames as windows over the fine ones: the last bar of a bucket has its open to close, and every bar sees the
    # bucket that closed before its own
    for tag, seconds, n, moves in (("1h", 3600, 24, {"mom_1h_3h": 3, "mom_1h_6h": 6}), ("4h", 14400, 6, {"mom_4h_12h": 3})):
        b, end = f"bucket_{tag}", f"end_{tag}"
        own = lambda b=b: Window.partitionBy("symbol", b)
        ends = lambda end=end: Window.partitionBy("symbol", end).orderBy("ts")
        add(b, "ts", lambda s=seconds: F.floor(F.unix_seconds(c("ts").cast("timestamp")) / s))
        add(end, b, lambda b=b: F.coalesce(F.lead(b).over(by_symbol()) != c(b), F.lit(True)))
        add(f"span_{tag}", f"high low {b}", lambda own=own: F.max("high").over(own()) - F.min("low").over(own()))
        frame = lambda k, ends=ends: ends().rowsBetween(-(k - 1), 0)
        before = lambda k, ends=ends: F.lag("close", k).over(ends())
        made = {f"ret_{tag}": lambda before=before: ratio("close", before(1)) - 1, f"vol_{tag}": lambda frame=frame, n=n: F.when(F.count("close").over(frame(n)) >= n, F.stddev_samp("close").over(frame(n)))}
        made |= {x: lambda k=k, before=before: ratio("close", before(k)) - 1 for x, k in moves.items()}
        made[f"range_{tag}_pct"] = lambda tag=tag: c(f"span_{tag}") / (c("close") + TINY)
        for x, make in made.items():
            add(f"at_{x}", f"close {end} span_{tag}", make)
            add(x, f"at_{x} {end}", lambda x=x, end=end: F.last(F.when(c(end), F.coalesce(c(f"at_{x}"), F.lit(math.nan))), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1)))

    for x in ("spy", "gld", "tlt", "uup", "vix"):
        add(f"{x}_ma", f"{x}_close", lambda x=x: sma(f"{x}_close", 20))
        add(f"{x}_close_ma20_signal", f"{x}_close {x}_ma", lambda x=x: F.when(c(f"{x}_ma") > 0, (c(f"{x}_close") - c(f"{x}_ma")) / (c(f"{x}_ma") + TINY)))
    for x in ("spy", "gld", "uup"):
        add(f"btc_{x}_ratio", f"close {x}_close", lambda x=x: c("close") / (c(f"{x}_close") + TINY))
        add(f"btc_{x}_ratio_chg", f"btc_{x}_ratio", lambda x=x: change(f"btc_{x}_ratio", 12))
    add("basis_pct", "mark_price index_price", lambda: (c("mark_price") - c("index_price")) / (c("index_price") + TINY))
    add("basis_pct_chg", "basis_pct", lambda: diff("basis_pct", 12))
    for n in (12, 24):
        add(f"oi_chg_{n}", "open_interest", lambda n=n: change("open_interest", n))
    add("insurance_chg_12", "insurance_balance", lambda: change("insurance_balance", 12))
    add("taker_buy_sell_ratio", "taker_buy_vol taker_sell_vol", lambda: c("taker_buy_vol") / (c("taker_buy_vol") + c("taker_sell_vol") + TINY))
    return {f.name: f for f in found}


GRAPH = _graph()


def resolve(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` with the wanted features that its columns allow, in a projection for each depth of the graph; a column of ``df`` stands for its feature."""
    have = set(df.columns)
    depth: dict[str, int | None] = {}

    def level(name: str) -> int | None:
        """None where an input is missing."""
        if name in have:
            return 0
        if name not in depth:
            below = [level(x) for x in GRAPH[name].inputs] if name in GRAPH else [None]
            depth[name] = None if None in below else 1 + max(below)
        return depth[name]

    todo, needed = list(wanted), set()
    while todo:
        name = todo.pop()
        if name not in needed and level(name):
            needed.add(name)
            todo += GRAPH[name].inputs
    for k in range(1, max([depth[x] for x in needed], default=0) + 1):
        now = [GRAPH[x] for x in sorted(needed) if depth[x] == k]
        if plain := {f.name: f.make() for f in now if f.make}:
            df = df.withColumns(plain)
        for f in now:
            if f.span:
                df = ewm(df, f.inputs[0], f.name, span=f.span)
            if f.past:
                df = with_quantile(df, f.inputs[0], f.name, 0.5, f.past)
    extra = needed - set(wanted)
    # what a coarser bar does not have yet was carried as NaN, so that an older bar's value does not stand in for it
    carried = [x for x in FRAMES if x in needed]
    return df.drop(*extra).withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in carried}) if carried else df.drop(*extra)


def cross_features(bars: DataFrame, benchmark: str, assets: dict[str, str]) -> DataFrame:
    """(ts, columns of ``cross_names`` for each asset): an asset's bars against the benchmark's at the times that all of them have.

    ``assets``: column prefix to symbol. One row a time; the symbols are a fixed few, whose bars meet by time alone.
    """
    few = bars.where(F.col("symbol").isin(benchmark, *assets.values()))
    side = lambda sym, x: F.max(F.when(F.col("symbol") == sym, F.col(x)))
    wide = few.groupBy("ts").agg(side(benchmark, "close").alias("b"), *[side(s, x).alias(f"{a}_{x}") for a, s in assets.items() for x in ("close", "volume")])
    wide = wide.dropna(subset=["b", *[f"{a}_close" for a in assets]]).withColumn("symbol", F.lit(benchmark)).withColumn("b_ret", change("b"))
    for a in assets:
        p, v = f"{a}_close", f"{a}_volume"
        wide = wide.withColumns({f"{a}_returns": change(p), f"{a}_btc_ratio": ratio(p, "b")})
        wide = wide.withColumns({f"{a}_btc_ratio_chg": change(f"{a}_btc_ratio"), f"{a}_volume_z": (F.col(v) - sma(v, 24)) / (std(v, 24) + 1e-9)})
        wide = wide.withColumns({f"{a}_btc_ret_rel_{n}": change(p, n) - change("b", n) for n in SPANS} | {f"btc_corr_{a}_{n}": corr("b_ret", f"{a}_returns", n) for n in SPANS})
    return wide.select("ts", *[x for a in assets for x in cross_names(a)])


def equity_features(daily: DataFrame) -> DataFrame:
    """Of daily (ts, spy, gld, tlt, uup, vix, hyg, lqd): distances from 20-day means, fear, falling rates, credit stress, risk on and off."""
    df = daily.withColumn("symbol", F.lit("equities"))
    mean = lambda x: sma(x, 20, 1)
    df = df.withColumn("__q", F.col("hyg") / (F.col("lqd") + TINY))
    away = {f"eq_{n}_signal": (F.col(x) - mean(x)) / (F.abs(mean(x)) + TINY) for n, x in (("spy", "spy"), ("gold", "gld"), ("tlt", "tlt"), ("uup", "uup"))}
    df = df.withColumns(away | {"eq_vix_signal": F.greatest(F.col("vix") / (mean("vix") + TINY) - 1, F.lit(0.0)), "eq_rates_falling": F.coalesce(change("tlt", 20) < 0, F.lit(False)).cast("int"), "eq_credit_stress": F.greatest(F.col("__q") - mean("__q"), F.lit(0.0))})
    df = df.withColumn("eq_vix_spike", (F.col("eq_vix_signal") > 0.5).cast("int"))
    calm, up = F.col("eq_vix_spike") == 0, F.coalesce(F.col("eq_spy_signal") > 0, F.lit(False))
    return df.withColumns({"eq_risk_on": (up & calm).cast("int"), "eq_risk_off": (~up | ~calm).cast("int")}).select("ts", *EQUITIES)


def with_series(bars: DataFrame, series: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Bars with the last known row of one series of all symbols, (ts, values), found once for each distinct time."""
    values = [x for x in series.columns if x != "ts"]
    known = asof(bars.select("ts").distinct(), series, [], values, tolerance=tolerance).select("ts", *values)
    return bars.join(small(known), "ts", "left")


def block(bars: DataFrame, benchmark: str, assets: dict[str, str], macro: DataFrame | None = None, micro: DataFrame | None = None, equities: DataFrame | None = None) -> DataFrame:
    """(symbol, ts, the 113 columns) of bars (symbol, ts, open, high, low, close, volume).

    ``macro``: (ts, spy_close, ...); ``equities``: (ts, spy, gld, ...); both are carried on to later bars. ``micro``: (symbol, ts, ...) series
    of each symbol. What is not given is 0. Rows in which a column that has any value has none are left out.
    """
    df = bars.join(small(cross_features(bars, benchmark, assets)), "ts", "left")
    if macro is not None:
        df = with_series(df, macro)
    if equities is not None:
        df = with_series(df, equity_features(equities)).fillna(0, subset=list(EQUITIES))
    if micro is not None:
        values = [x for x in micro.columns if x not in ("symbol", "ts")]
        df = asof(df, micro, ["symbol"], values).drop("matched_ts")
    return settled(resolve(df, CANONICAL))


def settled(df: DataFrame) -> DataFrame:
    """Exactly the block's columns in order, as doubles; absent ones are 0, and rows without a value in a column that has any go."""
    present = [x for x in CANONICAL if x in df.columns]
    counted = df.agg(*[F.count(x).alias(x) for x in present]).first() if present else {}
    live = [x for x in present if counted[x]]
    kept = df.dropna(subset=live) if live else df
    return kept.select("symbol", "ts", *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) if x in live else F.lit(0.0).alias(x) for x in CANONICAL])
