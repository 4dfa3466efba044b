"""Ticks and bars: building, resampling, deduplicating, extending, labelling, positions and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, col, flag, lag, roll


def ohlcv(ticks: DataFrame, rule: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of ticks (keys, ts, price, size, tie) in left-closed buckets; ties of time are broken by ``tie``."""
    order = F.struct("ts", "tie")
    made = ticks.groupBy(*keys, F.window("ts", rule).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume")
    )
    return made.select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, rule: str, closed: str = "left", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars; ``closed='right'`` takes buckets (start, end] and labels them with their end."""
    at = F.col("ts") if closed == "left" else F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")
    made = bars.withColumn("at", at).groupBy(*keys, F.window("at", rule).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return made.select(*keys, F.col("w.start" if closed == "left" else "w.end").alias("ts"), "open", "high", "low", "close", "volume")


def dedup(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row of each key, the first or last in an order that must be total for the result to be determined."""
    directed = order if keep == "first" else [c.desc() for c in order]
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*directed)))
    return ranked.where("__n = 1").drop("__n")


def append_newer(old: DataFrame, new: DataFrame, key: str = "symbol") -> DataFrame:
    """``old`` and the rows of ``new`` after the last stored time of their key."""
    last = old.groupBy(key).agg(F.max("ts").alias("__last"))
    later = new.join(last, key, "left").where(F.col("__last").isNull() | (F.col("ts") > F.col("__last"))).drop("__last")
    return old.unionByName(later, allowMissingColumns=True)


def merge_append(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), keep: str = "first") -> DataFrame:
    """Union with one row of each key: the old one ('first') or the new one ('last')."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return dedup(both, list(keys), [F.col("__new")], keep).drop("__new")


def extend_history(deep: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived bars strictly after the last date of a symbol's deep history."""
    last = deep.groupBy("symbol").agg(F.to_date(F.max("ts")).alias("__last"))
    later = derived.join(last, "symbol", "left").where(F.col("__last").isNull() | (F.to_date("ts") > F.col("__last"))).drop("__last")
    return deep.unionByName(later)


def manifest(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def query_manifest(table: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        table = table.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return table


def volume_bars(bars: DataFrame, target: float | None = None, n_bars: int | None = None, volume: str = "volume") -> DataFrame:
    """Information bars: a new one whenever the cumulative volume passes a multiple of the target."""
    total = F.sum(volume).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    size = F.lit(target) if target is not None else F.sum(volume).over(Window.partitionBy("symbol")) / F.lit(n_bars)
    numbered = bars.withColumn("bar", F.greatest(F.ceil(total / size) - 1, F.lit(0)))
    return numbered.groupBy("symbol", "bar").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum(volume).alias("volume")
    )


def grid_fill(df: DataFrame, step: str, values: list[str]) -> DataFrame:
    """A row at every step between each symbol's first and last time, values carried forward."""
    ends = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("ts"))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    both = grid.withColumn("__grid", F.lit(True)).join(df, ["symbol", "ts"], "left")
    return both.select("symbol", "ts", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def snapshot_bars(polls: DataFrame) -> DataFrame:
    """A one-price bar a minute from polls (symbol, ts, price, tie); the last poll of the minute stands."""
    minute = polls.withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    last = dedup(minute, ["symbol", "minute"], [F.col("ts"), F.col("tie")], "last")
    p = F.col("price")
    return last.select("symbol", F.col("minute").alias("ts"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(0.0).alias("volume"))


def _barrier(horizon: int, up: Column, down: Column, stop_first: bool) -> Column:
    w = by_symbol()
    hits = []
    for j in range(1, horizon + 1):
        top, low = F.lead("high", j).over(w) >= up, F.lead("low", j).over(w) <= down
        first, second = ((low, 0), (top, 1)) if stop_first else ((top, 1), (low, 0))
        hits.append(F.when(first[0], first[1]).when(second[0], second[1]))
    return F.coalesce(*hits, F.lit(2))


def triple_barrier(bars: DataFrame, horizon: int, take: float, stop: float) -> DataFrame:
    """label: 1 if the high first reaches the take level within the horizon, 0 if the low first reaches the stop, else 2."""
    c = F.col("close")
    label = _barrier(horizon, c * (1 + take), c * (1 - stop), False)
    return bars.withColumn("label", F.when(F.lead("ts", horizon).over(by_symbol()).isNotNull(), label).otherwise(2))


def triple_barrier_atr(bars: DataFrame, horizon: int, take: float = 1.5, stop: float = 1.5, n: int = 14, fixed: float = 0.004) -> DataFrame:
    """The same with levels at multiples of each row's mean true range over n full bars; of ``fixed`` times the close where there is none or it is 0."""
    c = F.col("close")
    df = bars.withColumn("__tr", true_range()).withColumn("__a", roll(F.avg, "__tr", n) / (c + 1e-10) * c)
    df = df.withColumn("__a", F.when(F.col("__a") > 0, F.col("__a")).otherwise(c * fixed))
    label = _barrier(horizon, c + take * F.col("__a"), c - stop * F.col("__a"), False)
    return df.withColumn("label", F.when(F.lead("ts", horizon).over(by_symbol()).isNotNull(), label).otherwise(2)).drop("__tr", "__a")


def label_grid(bars: DataFrame, grid: list[tuple[float, float]], horizon: int) -> DataFrame:
    """Shares of labels for each (take, stop); a bar that touches both counts as stopped, and last rows use what remains. All cells in one pass."""
    c = F.col("close")
    labels = bars.select(*[_barrier(horizon, c * (1 + take), c * (1 - stop), True).alias(f"__{k}") for k, (take, stop) in enumerate(grid)])
    share = lambda k, side: F.avg((F.col(f"__{k}") == side).cast("double"))
    cells = labels.agg(F.array(*[F.struct(F.lit(t).alias("take"), F.lit(s).alias("stop"), share(k, 1).alias("long_share"), share(k, 0).alias("short_share"), share(k, 2).alias("flat_share")) for k, (t, s) in enumerate(grid)]).alias("cells"))
    out = cells.select(F.explode("cells").alias("c")).select("c.*").where("flat_share IS NOT NULL")
    return out.withColumns({"trade_rate": 1 - F.col("flat_share"), "imbalance": F.abs(F.col("long_share") - F.col("short_share"))})


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """Profile of returns over the horizon; skewness is bias-corrected."""
    r = F.lead("close", horizon).over(by_symbol()) / F.col("close") - 1
    n = F.count("r")
    return bars.withColumn("r", r).groupBy("symbol").agg(
        n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.avg((F.col("r") > 0).cast("double")).alias("positive"), F.percentile("r", F.lit(0.5)).alias("median"),
        (F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
    )


def positions(signals: DataFrame) -> DataFrame:
    """pos: 1 while held. Flat and entry: held; held and exit: flat; both on one bar: the state turns over.

    The state after a bar is that of the last bar with only one of the two, turned over as often as both came since.
    """
    e, x = F.col("entry") == 1, F.col("exit") == 1
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    both = F.when(e & x, 1).otherwise(0)
    df = signals.withColumn("__both", F.sum(both).over(w))
    df = df.withColumn("__last", F.last(F.when(e & ~x, F.struct(F.lit(1).alias("s"), F.col("__both").alias("n"))).when(x & ~e, F.struct(F.lit(0).alias("s"), F.col("__both").alias("n"))), ignorenulls=True).over(w))
    turned = F.coalesce("__last.s", F.lit(0)) + F.col("__both") - F.coalesce("__last.n", F.lit(0))
    return df.withColumn("pos", (turned % 2).cast("int")).drop("__both", "__last")


def episodes(pos: DataFrame, cost: float = 0.0, close_last: bool = True) -> DataFrame:
    """Trades: a run of held bars, entered at its first close and left at the close of the bar after, or at the last bar."""
    df = pos.withColumn("__start", flag((F.col("pos") == 1) & (F.coalesce(lag("pos"), F.lit(0)) == 0)))
    df = df.withColumn("__run", F.sum("__start").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    w = by_symbol()
    df = df.withColumn("__next", F.struct(F.lead("ts").over(w).alias("ts"), F.lead("close").over(w).alias("close")))
    held = df.where("pos = 1").groupBy("symbol", "__run").agg(F.min("ts").alias("entry_ts"), F.min_by("close", "ts").alias("entry_price"), F.max_by(F.struct("ts", "close", "__next"), "ts").alias("z"))
    out = held.select(
        "symbol", F.col("__run").alias("trade"), "entry_ts", "entry_price", F.coalesce("z.__next.ts", "z.ts").alias("exit_ts"), F.coalesce("z.__next.close", "z.close").alias("exit_price"), F.col("z.__next.ts").isNull().alias("open")
    )
    out = out.withColumn("ret", F.col("exit_price") / F.col("entry_price") - 1 - cost)
    return out if close_last else out.where(~F.col("open"))


def tail_fraction(df: DataFrame, start: float) -> DataFrame:
    """Rows of each symbol from the given share of its length on."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("__r", F.row_number().over(by_symbol()) - 1).withColumn("__n", n).where(F.col("__r") >= F.floor(F.col("__n") * start)).drop("__r", "__n")


def dropoff_events(pos: DataFrame, screens: DataFrame) -> DataFrame:
    """Held symbols that leave the screen: first such bar of each run, its close, and the close at which the run ends."""
    df = pos.withColumn("__start", flag((F.col("pos") == 1) & (F.coalesce(lag("pos"), F.lit(0)) == 0)))
    df = df.withColumn("run", F.sum("__start").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    later = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("exit_price", F.first(F.when(F.col("pos") == 0, F.col("close")), ignorenulls=True).over(later))
    out = df.where("pos = 1").join(screens.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    first = dedup(out, ["symbol", "run"], [F.col("ts")])
    return first.select("symbol", "run", F.col("ts").alias("drop_ts"), F.col("close").alias("drop_price"), "exit_price", (F.col("exit_price") / F.col("close") - 1).alias("missed"))


def true_range() -> Column:
    """The first row's is 0, as its previous close is unknown."""
    p = lag("close")
    return F.when(p.isNull(), F.lit(0.0)).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)))
