"""Evaluation: splits, cross-section portfolios, returns, performance and tests of significance."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, change, drawdown, frame, lag, roll, sma
from tidemark.operators.align import RANGES, ranges, small


def wf_splits(df: DataFrame, val: int, test: int, purge: int, folds: int) -> DataFrame:
    """symbol, fold, train_end, val_start, test_start, test_end in row numbers; the last fold ends at the last row.

    Training rows lie before train_end, purge rows are left out before validation and before test.
    """
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    k = n.select("symbol", "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    end = F.col("n") - F.col("fold") * test
    out = k.select("symbol", F.col("fold"), (end - test - purge - val - purge).alias("train_end"), (end - test - purge - val).alias("val_start"), (end - test).alias("test_start"), end.alias("test_end"))
    return out.where("train_end > 0")


def wf_overlap(df: DataFrame) -> DataFrame:
    """Overlapping folds whose train, test and step lengths follow the length of the symbol's history."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    size = lambda a, b, c: F.when(F.col("n") >= 1500, a).when(F.col("n") >= 500, b).otherwise(c)
    n = n.withColumn("train", size(500, 200, 60)).withColumn("test", size(100, 50, 20)).withColumn("step", size(50, 25, 10))
    k = n.where("n >= train + test").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - F.col("train") - F.col("test")) / F.col("step")).cast("int"))).alias("fold"))
    start = F.col("fold") * F.col("step")
    return k.select("symbol", "fold", start.alias("first"), (start + F.col("train")).alias("test_start"), (start + F.col("train") + F.col("test")).alias("test_end"))


def wf_slices(bars: DataFrame, train: int = 60, step: int = 12, oos: int = 12) -> DataFrame:
    """Slices of the common calendar: number, first and last time of each out-of-sample stretch."""
    days = bars.select("ts").distinct().withColumn("u", F.lit(1)).withColumn("k", F.dense_rank().over(Window.partitionBy("u").orderBy("ts")) - 1)
    placed = days.where(F.col("k") >= train).select("ts", "k", F.explode(F.expr(f"sequence(cast(greatest(0, ceil((k - {train + oos - 1}) / {step})) as int), cast(floor((k - {train}) / {step}) as int))")).alias("slice"))
    return placed.groupBy("slice").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def chrono_split(df: DataFrame, train: float = 0.8, val: float = 0.05, days: int | None = None) -> DataFrame:
    """part: train, val or test by place in time; with ``days`` training rows so much older than the last one are ``old``."""
    w = Window.partitionBy("symbol")
    share = (F.row_number().over(by_symbol()) - 1) / F.count(F.lit(1)).over(w)
    out = df.withColumn("part", F.when(share < train, "train").when(share < train + val, "val").otherwise("test"))
    if days is None:
        return out
    last = F.max(F.when(F.col("part") == "train", F.col("ts"))).over(w)
    return out.withColumn("part", F.when((F.col("part") == "train") & (F.col("ts") < last - F.expr(f"INTERVAL {days} DAYS")), "old").otherwise(F.col("part")))


def xs_momentum(bars: DataFrame, tiers: DataFrame, lookback: int, hold: int, share: float = 0.1, least: int = 1) -> DataFrame:
    """Per fold and tier: mean return of the top less the bottom share by past return, inverse-volatility weights.

    Folds are every ``hold``-th of the dates that any symbol has, numbered from 1, so that all symbols are ranked on one date.
    """
    days = bars.select("ts").distinct().withColumn("u", F.lit(1)).withColumn("k", F.dense_rank().over(Window.partitionBy("u").orderBy("ts"))).drop("u")  # a row a date
    df = bars.withColumn("r", change("close")).withColumn("mom", change("close", lookback)).withColumn("vol", F.stddev_samp("r").over(frame(lookback))).withColumn("next", F.lead("close", hold).over(by_symbol()) / F.col("close") - 1)
    df = df.join(days, "ts").where((F.col("k") % hold == 0) & F.col("mom").isNotNull() & F.col("next").isNotNull() & (F.col("vol") > 0)).join(tiers, "symbol")
    w = Window.partitionBy("tier", "k")
    n = F.greatest(F.lit(least), F.floor(F.lit(share) * F.count(F.lit(1)).over(w)))
    df = df.withColumn("n", n).withColumn("up", F.row_number().over(w.orderBy(F.col("mom").desc(), "symbol"))).withColumn("down", F.row_number().over(w.orderBy("mom", "symbol")))
    side = F.when(F.col("up") <= F.col("n"), 1).when(F.col("down") <= F.col("n"), -1)
    df = df.withColumn("side", side).where("side IS NOT NULL").withColumn("iv", 1 / F.col("vol"))
    leg = lambda x: F.sum(F.when(F.col("side") == x, F.col("iv") * F.col("next"))) / F.sum(F.when(F.col("side") == x, F.col("iv")))
    return df.groupBy("tier", F.col("k").alias("fold")).agg(leg(1).alias("long"), leg(-1).alias("short")).withColumn("spread", F.col("long") - F.col("short"))


def composite_score(bars: DataFrame) -> DataFrame:
    """score: mean of a channel breakout, an oversold RSI, and how low RSI and 7-bar return stand among all of the symbol's own.

    The own ranks look over the symbol's whole history, its future included; with bars that end at the time of a decision they do not.
    """
    d = F.col("close") - lag("close")
    df = bars.withColumns({"__g": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__l": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), "__m": change("close", 7), "__h": roll(F.max, "high", 20)})
    rsi = 100 - 100 / (1 + sma("__g", 14) / (sma("__l", 14) + 1e-9))
    df = df.withColumns({"__u": F.coalesce(F.col("close") > lag("__h"), F.lit(False)).cast("int"), "__o": F.coalesce(rsi < 30, F.lit(False)).cast("int"), "__r": F.round(F.coalesce(rsi, F.lit(0.0)), 9), "__m": F.coalesce("__m", F.lit(0.0))})
    w = Window.partitionBy("symbol")
    rank = lambda c: (F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("symbol", c)) - 1) / 2) / F.count(F.lit(1)).over(w)
    return df.withColumns({"__a": rank("__r"), "__b": rank("__m")}).withColumn("score", (F.col("__o") + F.col("__u") + (1 - F.col("__a")) + (1 - F.col("__b"))) / 4).drop("__g", "__l", "__h", "__u", "__o", "__r", "__m", "__a", "__b")


def xs_composite(bars: DataFrame, n: int, cost: float) -> DataFrame:
    """Return of the top n by ``composite_score`` at each time, weighted by score and held one bar later, less the cost of turnover, from the
    first time on that all symbols have. At equal scores all that reach the n-th average rank are held."""
    df = composite_score(bars).withColumn("score", F.round("score", 9)).withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    w = Window.partitionBy("ts")
    place = F.rank().over(w.orderBy(F.col("score").desc())) + (F.count(F.lit(1)).over(Window.partitionBy("ts", "score")) - 1) / 2
    df = df.withColumn("__p", F.when(place <= n, F.col("score")).otherwise(0.0))
    total = F.sum("__p").over(w)
    df = df.withColumn("weight", F.when(total != 0, F.col("__p") / total).otherwise(0.0))
    df = df.withColumn("held", F.coalesce(lag("weight"), F.lit(0.0))).withColumn("moved", F.abs(F.col("weight") - F.col("held")))
    every = bars.select("symbol").distinct().agg(F.count("*").alias("__all"))
    start = bars.groupBy("ts").agg(F.count("*").alias("__k")).crossJoin(F.broadcast(every)).where("__k = __all").agg(F.min("ts").alias("__start"))  # one row
    out = df.crossJoin(F.broadcast(start)).where(F.col("ts") >= F.col("__start"))
    return out.groupBy("ts").agg((F.sum(F.col("held") * F.col("r")) - cost * F.sum("moved")).alias("ret"), F.sum("moved").alias("turnover"))


def monthly_topn(bars: DataFrame, n: int) -> DataFrame:
    """Daily mean return of the n symbols with the largest trailing 20-bar mean return at the last month's end."""
    df = bars.withColumn("r", change("close")).withColumn("m20", F.avg("r").over(frame(20))).withColumn("month", F.date_trunc("month", "ts"))
    last = df.where("m20 IS NOT NULL").groupBy("symbol", "month").agg(F.max_by("m20", "ts").alias("score"))
    chosen = last.withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy(F.col("score").desc(), "symbol"))).where(F.col("k") <= n).select("symbol", F.add_months("month", 1).cast("date").alias("next"))
    held = df.withColumn("next", F.to_date("month")).join(chosen, ["symbol", "next"])
    return held.groupBy("ts").agg(F.avg("r").alias("ret"), F.count("r").alias("n"))


def tier_weights(df: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """Weights by regime for tiers 1 to 3, equal within a tier at each time."""
    per = F.coalesce(*[F.when(F.col("regime") == r, F.element_at(F.array(*map(F.lit, w)), F.col("tier"))) for r, w in weights.items()])
    return df.withColumn("weight", per / F.count(F.lit(1)).over(Window.partitionBy("ts", "tier")))


def strategy_returns(positions: DataFrame, cost: float) -> DataFrame:
    """ret: the position of the bar before times the return, less the cost of changing it."""
    held = F.coalesce(lag("pos"), F.lit(0))
    df = positions.withColumn("r", F.coalesce(change("close"), F.lit(0.0))).withColumn("held", held)
    return df.withColumn("moved", F.abs(F.col("held") - F.coalesce(lag("held"), F.lit(0)))).withColumn("ret", F.col("held") * F.col("r") - cost * F.col("moved"))


def strategy_eval(positions: DataFrame, cost: float, periods: int = 365) -> DataFrame:
    df = strategy_returns(positions, cost)
    s = F.stddev_samp("ret")
    active = F.when(F.col("held") != 0, F.col("ret"))
    return df.groupBy("symbol").agg(
        F.when(s != 0, F.avg("ret") / s * F.sqrt(F.lit(float(periods)))).alias("sharpe"), F.sum("ret").alias("total"), F.avg((active > 0).cast("double")).alias("win_rate"), F.sum((F.col("moved") > 0).cast("int")).alias("trades")
    )


def performance(returns: DataFrame, periods: int = 365) -> DataFrame:
    """Per symbol of (ts, ret, held): total return, Sharpe, exposure-adjusted Sharpe, drawdown, Calmar, win share, exposure."""
    df = returns.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("dd", drawdown("equity"))
    s = F.stddev_pop("ret")
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    sharpe = F.when(s != 0, F.avg("ret") / s * F.sqrt(F.lit(float(periods))))
    exposure = F.avg((F.col("held") != 0).cast("double"))
    out = df.groupBy("symbol").agg(total.alias("total_return"), sharpe.alias("sharpe"), F.max("dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_share"), exposure.alias("exposure"))
    return out.withColumn("effective_sharpe", F.when(F.col("exposure") > 0, F.col("sharpe") * F.sqrt("exposure"))).withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("total_return") / F.col("max_drawdown")))


def newey_west(returns: DataFrame, lags: int) -> DataFrame:
    """t of the mean return with a Bartlett-weighted long-run variance."""
    w = Window.partitionBy("symbol")
    df = returns.where("ret IS NOT NULL").withColumn("e", F.col("ret") - F.avg("ret").over(w))
    df = df.withColumns({f"c{k}": F.col("e") * F.lag("e", k).over(by_symbol()) for k in range(1, lags + 1)})
    n = F.count("e")
    variance = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) / n
    return df.groupBy("symbol").agg(n.alias("n"), F.avg("ret").alias("mean"), variance.alias("lrv")).withColumn("t", F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))))


def spa(returns: DataFrame, bench: DataFrame, lags: int = 4, alpha: float = 0.10, strategies: int | None = None) -> DataFrame:
    """Per strategy (symbol): n, mean difference from a benchmark (ts, bench), its variance and studentised value, the threshold, and whether
    it survives. The variance takes the sample variance and twice the unweighted autocovariances; the threshold is Šidák's for the
    number of strategies that have a value, or for ``strategies`` of them, so that one without a value does not ease it for the others."""
    diff = returns.join(bench, "ts").where("ret IS NOT NULL AND bench IS NOT NULL").select("symbol", "ts", (F.col("ret") - F.col("bench")).alias("d"))
    df = diff.withColumns({f"__{k}": F.lag("d", k).over(by_symbol()) for k in range(1, lags + 1)})
    n = F.count("d")
    together = sum((F.coalesce(F.covar_samp("d", f"__{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    out = df.groupBy("symbol").agg(n.alias("n"), F.avg("d").alias("mean"), F.greatest((F.var_samp("d") + 2 * together) / n, F.lit(0.0)).alias("variance"))
    out = out.withColumn("t", F.when((F.col("n") >= 3) & (F.col("variance") > 1e-18), F.col("mean") / F.sqrt("variance")))
    m = strategies or out.agg(F.count("t")).first()[0]  # of one row a strategy
    cut = NormalDist().inv_cdf((1 - alpha) ** (1 / max(1, m)))
    return out.withColumn("threshold", F.lit(cut)).withColumn("survives", F.coalesce(F.col("t") > cut, F.lit(False)))


def spa_summary(tested: DataFrame) -> DataFrame:
    """The step-wise test's one row: whether any strategy survives, which, the largest value, the threshold and how many were tested."""
    return tested.agg(
        F.coalesce(F.max("survives"), F.lit(False)).alias("significant"), F.sort_array(F.collect_list(F.when(F.col("survives"), F.col("symbol")))).alias("survivors"), F.max("t").alias("t_max"), F.max(F.when(F.col("t").isNotNull(), F.col("threshold"))).alias("t_crit"), F.count("t").alias("n_tested")
    )


def _sign_p(wins: int, losses: int) -> float:
    """Exact two-sided binomial p: terms of the tail, from the largest on until they no longer count."""
    n, k = wins + losses, max(wins, losses)
    if 2 * k <= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total, i = 0.0, k
    while i <= n and term > 1e-18 * total:
        total += term
        term *= (n - i) / (i + 1)
        i += 1
    return min(1.0, 2 * total)


def sign_p(wins: str, losses: str) -> Column:
    """``_sign_p`` of result-sized rows."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_sign_p(int(x), int(y)) for x, y in zip(a.fillna(0), b.fillna(0), strict=True)])

    return p_value(wins, losses)


def sign_test(pairs: DataFrame, key: str) -> DataFrame:
    """wins, losses, ties of (x, y) and the exact two-sided p."""
    out = pairs.groupBy(key).agg(*[F.sum(c.cast("int")).alias(n) for n, c in (("wins", F.col("x") > F.col("y")), ("losses", F.col("x") < F.col("y")), ("ties", F.col("x") == F.col("y")))])

    return out.withColumn("p", sign_p("wins", "losses"))


def block_draws(spark: SparkSession, replicates: int, n: int, block: int, seed: int) -> DataFrame:
    """(replicate, start, length): blocks of a stationary resample of n places. A new block begins at each place with chance 1 / block.

    Drawn by hash of seed, replicate and place, so a draw is the same on any machine, and two series of one length share it.
    """
    u = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("replicate"), t), 11) / float(1 << 53)
    at = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda t: (u(t) < 1 / block) & (t < n)))
    cut = spark.range(replicates).withColumnRenamed("id", "replicate").withColumn("at", at)
    blocks = F.transform("at", lambda t, i: F.struct(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("replicate"), t), F.lit(n)).alias("start"), (F.coalesce(F.get("at", i + 1), F.lit(n)) - t).alias("length")))
    return cut.select("replicate", F.explode(blocks).alias("b")).select("replicate", "b.start", "b.length")


def bootstrap(returns: DataFrame, replicates: int, block: int, seed: int) -> DataFrame:
    """(rule, replicate, mean, sharpe) of stationary-block resamples of (rule, ts, ret).

    A block's sum is a difference of running sums at its two ends, so that what is shuffled are the blocks, not the series.
    """
    order = Window.partitionBy("rule").orderBy("ts")
    df = returns.where("ret IS NOT NULL").withColumn("place", F.row_number().over(order)).withColumns({"s": F.sum("ret").over(order.rowsBetween(Window.unboundedPreceding, 0)), "q": F.sum(F.col("ret") * F.col("ret")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    whole = df.groupBy("rule").agg(F.count("*").alias("n"), F.max_by("s", "place").alias("all_s"), F.max_by("q", "place").alias("all_q"))
    sums = df.select("rule", F.col("place").cast("long").alias("place"), "s", "q").unionByName(whole.select("rule", F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
    drawn = None
    for (n,) in whole.select("n").distinct().orderBy("n").collect():  # one draw a length
        one = block_draws(returns.sparkSession, replicates, n, block, seed).withColumn("n", F.lit(n))
        drawn = one if drawn is None else drawn.unionByName(one)
    if drawn is None:
        return returns.sparkSession.createDataFrame([], "rule string, replicate long, mean double, sharpe double")
    blocks = drawn.join(whole, "n").withColumn("end", F.col("start") + F.col("length"))
    blocks = blocks.withColumn("round", F.col("end") > F.col("n")).withColumn("end", F.when(F.col("round"), F.col("end") - F.col("n")).otherwise(F.col("end")))
    side = lambda x: sums.select("rule", F.col("place").alias(x), F.col("s").alias(f"s_{x}"), F.col("q").alias(f"q_{x}"))
    blocks = blocks.join(side("start"), ["rule", "start"]).join(side("end"), ["rule", "end"])
    part = lambda x: F.sum(F.col(f"{x}_end") - F.col(f"{x}_start") + F.when(F.col("round"), F.col(f"all_{x}")).otherwise(0.0))
    out = blocks.groupBy("rule", "replicate").agg(F.max("n").alias("n"), part("s").alias("s"), part("q").alias("q")).withColumn("mean", F.col("s") / F.col("n"))
    variance = (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
    return out.select("rule", "replicate", "mean", F.when((F.col("n") > 1) & (variance > 1e-18), F.col("mean") / F.sqrt(variance)).otherwise(0.0).alias("sharpe"))


def bootstrap_p(resamples: DataFrame) -> DataFrame:
    """Per rule the share of resamples whose Sharpe is not over 0."""
    return resamples.groupBy("rule").agg(F.count("*").alias("replicates"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("p"))


def paired_bootstrap(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per rule of (rule, ts, x, y): shares of resamples of the pairs in which the mean of x less y is over, and under, 0."""
    out = bootstrap(pairs.select("rule", "ts", (F.col("x") - F.col("y")).alias("ret")), replicates, 1, seed)
    return out.groupBy("rule").agg(F.count("*").alias("replicates"), F.avg((F.col("mean") > 0).cast("double")).alias("p_over"), F.avg((F.col("mean") < 0).cast("double")).alias("p_under"))


def sharpe_moments(returns: DataFrame) -> DataFrame:
    """n, Sharpe per period, bias-corrected skewness and excess kurtosis of each symbol's returns."""
    n = F.count("ret")
    k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ret") + 6)
    return returns.groupBy("symbol").agg(n.alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), (F.skewness("ret") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), k.alias("kurt"))


def psr(moments: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """z of the probabilistic Sharpe ratio, and its probability on result-sized rows."""
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") * F.col("sr"))

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return x.map(lambda v: NormalDist().cdf(v) if pd.notna(v) else None).astype(float)

    return moments.withColumn("z", z).withColumn("psr", probability("z"))


def dsr(moments: DataFrame) -> DataFrame:
    """psr against the Sharpe expected of the best of as many unskilled trials with the same spread."""
    m = moments.agg(F.count("*").alias("m"), F.stddev_samp("sr").alias("s")).first()
    q = NormalDist().inv_cdf
    top = (m["s"] or 0.0) * ((1 - 0.5772156649015329) * q(1 - 1 / max(2, m["m"])) + 0.5772156649015329 * q(1 - 1 / (max(2, m["m"]) * math.e)))
    return psr(moments, top).withColumnRenamed("psr", "dsr")


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values of tests (name, p, family)."""
    w = Window.partitionBy("family").orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy("family"))
    df = tests.withColumn("__x", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p")))
    return df.withColumn("adjusted", F.max("__x").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("reject", F.col("adjusted") <= alpha).drop("__x")


def scorecard(results: DataFrame, base: str) -> DataFrame:
    """Candidates over slices (candidate, slice, ret): mean, worst, positive slices, and paired difference from a base with its exact sign test."""
    b = results.where(F.col("candidate") == base).select("slice", F.col("ret").alias("base"))
    df = results.join(b, "slice", "left")
    beaten = lambda c: F.sum(c.cast("int"))
    out = df.groupBy("candidate").agg(
        F.count("*").alias("slices"), F.avg("ret").alias("mean"), F.min("ret").alias("worst"), F.percentile("ret", F.lit(0.5)).alias("median"), beaten(F.col("ret") > 0).alias("positive"), F.avg(F.col("ret") - F.col("base")).alias("delta"),
        beaten(F.col("ret") > F.col("base")).alias("wins"), beaten(F.col("ret") < F.col("base")).alias("losses"),
    )
    return out.withColumn("p", sign_p("wins", "losses"))


def verdict(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per family of (family, score, p): tested, skipped, mean, and whether p and mean both pass."""
    out = results.groupBy("family").agg(F.count("score").alias("tested"), F.sum(F.col("score").isNull().cast("int")).alias("skipped"), F.avg("score").alias("mean"), F.max("p").alias("p"))
    return out.withColumn("verdict", F.when((F.col("p") < alpha) & (F.col("mean") > 0.5), "pass").otherwise("fail"))


def directional_accuracy(predictions: DataFrame) -> DataFrame:
    """Share right among predictions (fold, cls, label, ret) that are not flat, and the long side's mean return."""
    live = F.col("cls") != 2
    return predictions.groupBy("fold").agg(F.sum(live.cast("int")).alias("n"), F.avg(F.when(live, (F.col("cls") == F.col("label")).cast("double"))).alias("accuracy"), F.avg(F.when(F.col("cls") == 1, F.col("ret"))).alias("long_return"))


def class_metrics(predictions: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Accuracy, macro-F1 and share not flat from one pass of counts."""
    both = predictions.groupBy("cls", "label").agg(F.count("*").alias("n"))
    out = both.agg(
        F.sum("n").alias("n"), (F.sum(F.when(F.col("cls") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum(F.when(F.col("cls") != 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("directional"),
        *[F.sum(F.when((F.col("cls") == k) & (F.col("label") == k), F.col("n")).otherwise(0)).alias(f"tp{k}") for k in classes],
        *[(F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)) + F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))).alias(f"s{k}") for k in classes],
    )
    f1 = sum((F.when(F.col(f"s{k}") > 0, 2 * F.col(f"tp{k}") / F.col(f"s{k}")).otherwise(0.0) for k in classes), F.lit(0.0)) / len(classes)
    return out.select("n", "accuracy", f1.alias("macro_f1"), "directional")


def period_metrics(predictions: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Accuracy of periods, named by the first cut (name, end) after the time, and its lift over the whole."""
    name = F.coalesce(*[F.when(F.col("ts") < F.lit(end).cast("timestamp_ntz"), n) for n, end in cuts], F.lit("later"))
    hit = (F.col("cls") == F.col("label")).cast("double")
    whole = predictions.agg(F.avg(hit).alias("all"))
    return predictions.groupBy(name.alias("period")).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).crossJoin(F.broadcast(whole)).withColumn("lift", F.col("accuracy") - F.col("all")).drop("all")


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, __rank): the average rank of each distinct value among all rows of the table.

    Values are counted, the counts dealt into ranges of values, and each range starts where those before it end: sums of
    ranges, a few rows, are sent to all tasks, and only one range is sorted in a task.
    """
    counted = ranges(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")), column)
    totals = counted.groupBy("__b").agg(F.sum("__n").alias("n")).agg(F.collect_list(F.struct("__b", "n")).alias("t"))
    before = F.aggregate(F.filter("t", lambda x: x["__b"] < F.col("__b")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    starts = totals.select("t", F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("__b")).select("__b", before.alias("__before"))
    within = F.sum("__n").over(Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("__w", within).join(F.broadcast(starts), "__b").select(column, (F.col("__before") + F.col("__w") - (F.col("__n") - 1) / 2).alias("__rank"))


def _average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    df = df.dropna(subset=columns)
    whole = df.select(*columns)
    out = whole
    for c in columns:
        out = out.join(small(value_ranks(whole, c)).withColumnRenamed("__rank", f"__rank_{c}"), c)
    return out.select(*[F.col(f"__rank_{c}").alias(c) for c in columns])


def corr_matrix(df: DataFrame, columns: list[str], ranks: bool = False) -> list[list[float]]:
    """Correlations from one pass of sums; with ``ranks`` of average ranks."""
    df = _average_ranks(df, columns) if ranks else df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = [[0.0] * len(columns) for _ in columns]
    for i, j in pairs:
        out[i][j] = out[j][i] = 1.0 if i == j else (row[f"c{i}_{j}"] or 0.0)
    return out


def corr_pairs(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    m = corr_matrix(df, columns, ranks=True)
    rows = [(columns[i], columns[j], float(m[i][j])) for i in range(len(columns)) for j in range(i + 1, len(columns)) if abs(m[i][j]) > threshold]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def vif(df: DataFrame, columns: list[str], threshold: float = 10.0, protected: tuple[str, ...] = ()) -> DataFrame:
    """Variance inflation factors from the inverse of the columns' correlation matrix, and which to drop."""
    import numpy as np

    inverse = np.linalg.pinv(np.array(corr_matrix(df, columns)))
    rows = [(c, float(inverse[i, i]), bool(inverse[i, i] > threshold and c not in protected)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, drop boolean")


def attribution(results: DataFrame) -> DataFrame:
    """What entry and exit add, from results of variants full, entry and exit."""
    wide = results.groupBy("symbol").pivot("variant", ["full", "entry", "exit"]).agg(F.first("total"))
    return wide.withColumn("exit_adds", F.col("full") - F.col("entry")).withColumn("entry_adds", F.col("full") - F.col("exit"))


def vol_scale(returns: DataFrame, target: float = 0.15, window: int = 20, least: float = 0.25, most: float = 1.5, periods: int = 365, only_in: str | None = None) -> DataFrame:
    """scale: the target over the past window's annualised deviation, within bounds; 1 while the window is short or still, and with
    ``only_in`` wherever the row's ``regime`` is another."""
    s = F.when(F.count("ret").over(frame(window)) >= window, F.stddev_pop("ret").over(frame(window)) * math.sqrt(periods))
    scale = F.when(F.coalesce(s > 0, F.lit(False)), F.least(F.lit(most), F.greatest(F.lit(least), target / s))).otherwise(1.0)
    return returns.withColumn("scale", scale if only_in is None else F.when(F.col("regime") == only_in, scale).otherwise(1.0))


def sizing(trades: DataFrame, scheme: str, fraction: float, cap: int = 5) -> DataFrame:
    """Equity after each trade (symbol, trade, ret): fixed; doubling after losses, at most ``cap`` units; or 1 unit after a win, 2 after a loss."""
    w = Window.partitionBy("symbol").orderBy("trade")
    df = trades.withColumn("__loss", (F.col("ret") <= 0).cast("int"))
    df = df.withColumn("__wins", F.sum(1 - F.col("__loss")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.sum("__loss").over(Window.partitionBy("symbol", "__wins").orderBy("trade").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__streak", after)
    before = F.coalesce(F.lag("__streak").over(w), F.lit(0))
    units = {"fixed": F.lit(1.0), "doubling": F.least(F.pow(F.lit(2.0), before), F.lit(float(cap))), "grid": F.when(before > 0, 2.0).otherwise(1.0)}[scheme]
    df = df.withColumn("units", units).withColumn("__g", 1 + fraction * F.col("units") * F.col("ret"))
    ruined = F.max((F.col("__g") <= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    equity = F.exp(F.sum(F.ln(F.when(F.col("__g") > 0, F.col("__g")))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("equity", F.when(ruined, 0.0).otherwise(equity)).drop("__loss", "__wins", "__streak", "__g")


def monthly_returns(equity: DataFrame) -> DataFrame:
    m = equity.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("equity", "ts").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy("symbol").orderBy("month"))
    return m.withColumn("ret", F.col("equity") / before - 1)


def describe_returns(monthly: DataFrame) -> DataFrame:
    q: Column = F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return monthly.groupBy("symbol").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("least"), F.max("ret").alias("most"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))
