"""Rolling and recursive primitives over the bars of a symbol.

Every window has the same partitioning and order, so that one exchange and one sort serve all of them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(col(c), n).over(by_symbol())


def frame(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def roll(f, c: Column | str, n: int, least: int | None = None) -> Column:
    """f over the last n rows; null until ``least`` (n by default) of them are not null."""
    least = n if least is None else least
    return F.when(F.count(col(c)).over(frame(n)) >= least, f(col(c)).over(frame(n)))


def sma(c: Column | str, n: int, least: int | None = None) -> Column:
    return roll(F.avg, c, n, least)


def std(c: Column | str, n: int, least: int | None = None) -> Column:
    return roll(F.stddev_samp, c, n, least)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as floating point has it: infinite for a base of 0, NaN for 0 / 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    beyond = F.when(F.isnan(a) | (a == 0), math.nan).when(a > 0, math.inf).when(a < 0, -math.inf)
    return F.when(b == 0, beyond).otherwise(F.try_divide(a, b))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """Logarithm of ``ratio``; minus infinity for a ratio of 0."""
    r = ratio(a, b)
    return F.when(r == 0, -math.inf).otherwise(F.ln(r))


def change(c: Column | str, n: int = 1) -> Column:
    """Relative change over n rows; null at a zero base."""
    before = lag(c, n)
    return F.when(before != 0, col(c) / before - 1)


def diff(c: Column | str, n: int = 1) -> Column:
    return col(c) - lag(c, n)


def zscore(c: Column | str, n: int) -> Column:
    s = std(c, n)
    return F.when(s != 0, (col(c) - sma(c, n)) / s)


def quantile(c: Column | str, q: float, n: int, least: int | None = None) -> Column:
    return roll(lambda x: F.percentile(x, F.lit(q)), c, n, least)


def sliding_quantiles(before: list, own: list, q: float, n: int) -> list:
    """Interpolated quantile q of the last n values at each of ``own``, which follow ``before``; nulls do not count, NaN is the greatest.

    The frame is kept in order: one value comes in and one goes out a row. Null while the frame holds no value.
    """
    past, shift = before + own, len(before)
    first = past[max(0, shift - n + 1) : shift]
    held, nans, out = sorted(x for x in first if x is not None and x == x), sum(x is not None and x != x for x in first), []
    for i, x in enumerate(own, shift):
        gone = past[i - n] if i >= n and i - n >= shift - n + 1 else None
        if gone is not None:
            if gone == gone:
                del held[bisect_left(held, gone)]
            else:
                nans -= 1
        if x is not None:
            if x == x:
                insort(held, x)
            else:
                nans += 1
        size = len(held) + nans
        if not size:
            out.append(None)
            continue
        at = (size - 1) * q
        low, high = math.floor(at), math.ceil(at)
        a, b = (held[k] if k < len(held) else math.nan for k in (low, high))
        out.append(a if a == b or low == high else (high - at) * a + (at - low) * b)
    return out


def with_quantile(df: DataFrame, source: str, out: str, q: float, n: int) -> DataFrame:
    """Adds the quantile of the last n rows as ``quantile`` with least 1 has it, at a cost that hardly depends on n.

    Rows meet in blocks of n of a symbol, each beside the values of the block before, so no symbol is held whole.
    """

    @F.arrow_udf("array<double>")
    def quantiles(before: pa.Array, own: pa.Array) -> pa.Array:
        pairs = zip(before.to_pylist(), own.to_pylist(), strict=True)
        return pa.array([sliding_quantiles(b or [], o, q, n) for b, o in pairs], pa.list_(pa.float64()))

    rest = [c for c in df.columns if c not in ("symbol", "ts")]
    block = F.floor((F.row_number().over(by_symbol()) - 1) / n).alias("__b")
    blocks = df.select("symbol", block, F.struct("ts", F.col(source).cast("double").alias("__x"), *rest).alias("__r")).groupBy("symbol", "__b").agg(F.sort_array(F.collect_list("__r")).alias("__r"))
    blocks = blocks.withColumn("__x", F.col("__r.__x")).withColumn("__before", F.lag("__x").over(Window.partitionBy("symbol").orderBy("__b")))
    made = blocks.select("symbol", F.explode(F.arrays_zip(F.col("__r"), quantiles("__before", "__x").alias("__q"))).alias("__z"))
    return made.select("symbol", *[F.col("__z.__r")[c].alias(c) for c in df.columns if c != "symbol"], F.col("__z")["__q"].alias(out))


def corr(x: Column | str, y: Column | str, n: int) -> Column:
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), 1)
    spread = F.stddev_pop(col(x)).over(frame(n)) * F.stddev_pop(col(y)).over(frame(n))
    return F.when((F.count(both).over(frame(n)) >= n) & (spread != 0), F.covar_pop(col(x), col(y)).over(frame(n)) / spread)


def mean_deviation(c: Column | str, n: int, least: int | None = None) -> Column:
    """Mean absolute deviation from the frame's own mean; null until ``least`` (n by default) rows are not null."""
    values = F.collect_list(col(c)).over(frame(n))
    mean = F.avg(col(c)).over(frame(n))
    return F.when(F.count(col(c)).over(frame(n)) >= (n if least is None else least), F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / F.size(values))


def percent_rank(c: Column | str, n: int, least: int) -> Column:
    """Share of the frame's rows, nulls among them, that are at most the present value."""
    values = F.collect_list(col(c)).over(frame(n))
    here = F.size(F.filter(values, lambda x: x <= col(c)))
    return F.when((F.count(col(c)).over(frame(n)) >= least) & col(c).isNotNull(), here / F.count(F.lit(1)).over(frame(n)))


def running(f, c: Column | str) -> Column:
    return f(col(c)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def drawdown(equity: Column | str) -> Column:
    peak = running(F.max, equity)
    return F.when(peak != 0, 1 - col(equity) / peak)


def fill_forward(c: Column | str) -> Column:
    return F.last(col(c), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: Column | str) -> Column:
    return F.first(col(c), ignorenulls=True).over(by_symbol().rowsBetween(0, Window.unboundedFollowing))


def cross_up(c: Column | str, level: float) -> Column:
    return (lag(c) <= level) & (col(c) > level)


def cross_down(c: Column | str, level: float) -> Column:
    return (lag(c) >= level) & (col(c) < level)


def up_share(c: Column | str, n: int) -> Column:
    return F.when(F.count(col(c)).over(frame(n)) >= n, F.avg((col(c) > 0).cast("double")).over(frame(n)))


def flag(c: Column) -> Column:
    """1 where true; 0 where false or unknown."""
    return F.coalesce(c, F.lit(False)).cast("int")


def ewm(df: DataFrame, source: str, out: str, alpha: float | None = None, span: float | None = None) -> DataFrame:
    """Adds the recursion y = alpha * x + (1 - alpha) * y', started at the first value; leading nulls stay null.

    Rows are numbered in blocks so long that what happened before the block before last weighs under 1e-18. Within a block
    y is a prefix sum with weights that grow by bounded powers; the block before adds its last value, decayed. Windows
    only: no join, no group in one array, one pass per symbol. Rows without a value between others keep the last y.
    """
    a = alpha if alpha is not None else 2 / (span + 1)
    if a >= 1:
        return df.withColumn(out, F.col(source))
    r = 1 - a
    block = max(2, math.ceil(42 / -math.log(r)))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    n, j, b, local = (f"__{out}_{x}" for x in "njbl")
    x = F.col(source).cast("double")
    df = df.withColumn(n, F.when(x.isNotNull(), F.count(x).over(w) - 1))
    df = df.withColumn(b, F.floor(F.col(n) / block)).withColumn(j, F.col(n) % block)
    weight = F.when(F.col(n) == 0, 1.0).otherwise(F.lit(a)) * F.pow(F.lit(r), -F.col(j))
    own = Window.partitionBy("symbol", b).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    same = F.sum(F.when(F.col(n).isNotNull(), weight * x)).over(own)
    df = df.withColumn(local, F.when(F.col(n).isNotNull(), same * F.pow(F.lit(r), F.col(j))))
    before = F.last(F.when(F.col(j) == block - 1, F.col(local)), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn(out, F.col(local) + F.coalesce(F.pow(F.lit(r), F.col(j) + 1) * before, F.lit(0.0)))
    return df.withColumn(out, fill_forward(out)).drop(n, j, b, local)
