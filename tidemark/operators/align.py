"""Joins and alignment in time, without range joins: as-of by union and the last known row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import dedup

#: Rows up to which a table counts as small enough to send to every task; checked where it is used.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count shows it to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


#: Most ranges of time into which a series without a key is dealt.
RANGES = 1000


def ranges(both: DataFrame, on: str) -> DataFrame:
    """Adds __b, the number of the range of ``on`` (times or numbers) a row is in; ranges hold about equally many rows, equal values stay together."""
    spark = both.sparkSession
    n = min(RANGES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = dict(both.dtypes)[on]
    at = F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(on).cast("long") if kind == "date" else F.col(on)
    edges = both.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10000)).first()[0] or []
    edges = sorted(set(edges))
    steps, k = [], 1
    while k <= len(edges):
        steps.insert(0, k)
        k *= 2
    if not edges:
        return both.withColumn("__b", F.lit(0))
    # binary search: the edges at or before the row's time
    table, m = F.array(*[F.lit(x) for x in edges]), len(edges)
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when((low + s <= m) & (F.get(table, low + s - 1) <= at), low + s).otherwise(low))
    return both.withColumn("__b", F.coalesce(found, F.lit(0)))


def _carried(both: DataFrame, on: str, forward: bool) -> DataFrame:
    """(__b, __c) for each time range: the last right row of the ranges before it, or the first of those after it. One small row a range."""
    ends = both.where("__side = 0").groupBy("__b").agg((F.min_by if forward else F.max_by)("__r", on).alias("r"))
    whole = ends.agg(F.sort_array(F.collect_list(F.struct("__b", "r"))).alias("ends"))
    beside = (lambda b: F.get(F.filter("ends", lambda x: x["__b"] > b), F.lit(0))) if forward else (lambda b: F.element_at(F.concat(F.array(F.lit(None).cast(whole.schema["ends"].dataType.elementType)), F.filter("ends", lambda x: x["__b"] < b)), -1))
    return whole.select("ends", F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("__b")).select("__b", beside(F.col("__b"))["r"].alias("__c"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: str | None = None, direction: str = "backward", on: str = "ts") -> DataFrame:
    """Each left row with the right values of its key at the nearest time at or before it (or at or after it).

    Both sides are laid into one sequence per key, so one shuffle serves and no pair is made. Without keys the one sequence is
    dealt into ranges of time, and each takes over the row known from the ranges before it. Right rows that share key and
    time must be unique (see ``dedup``). ``tolerance`` is an interval beyond which nothing is taken.
    """
    spare = [c for c in left.columns if c not in (*keys, on)]
    one = left.select(*keys, on, F.struct(*[F.col(c) for c in spare] or [F.lit(0).alias("_")]).alias("__l"), F.lit(None).cast(right.select(F.struct(on, *values)).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    two = right.select(*keys, on, F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.struct(on, *values).alias("__r"), F.lit(0).alias("__side"))
    both = one.unionByName(two)
    if not keys:
        both = ranges(both, on)
    w = Window.partitionBy(*(keys or ["__b"])).orderBy(on if direction == "backward" else F.col(on).desc(), "__side")
    found = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if keys:
        both = both.withColumn("__f", found).where("__side = 1")
    else:
        carried = F.broadcast(_carried(both, on, direction != "backward"))  # RANGES rows at most
        both = both.withColumn("__f", found).where("__side = 1").join(carried, "__b", "left").withColumn("__f", F.coalesce("__f", "__c"))
    if tolerance:
        far = F.col(on) - F.expr(f"INTERVAL {tolerance}") > F.col(f"__f.{on}") if direction == "backward" else F.col(on) + F.expr(f"INTERVAL {tolerance}") < F.col(f"__f.{on}")
        both = both.withColumn("__f", F.when(~far, F.col("__f")))
    return both.select(*keys, on, *[F.col(f"__l.{c}").alias(c) for c in spare], *[F.col(f"__f.{v}").alias(v) for v in values], F.col(f"__f.{on}").alias(f"matched_{on}"))


def asof_columns(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: str | None = None, on: str = "ts") -> DataFrame:
    """Each left row with the last known value of every column on its own: many named series, each with times of its own, in one pass.

    ``right`` holds a series in each of ``values``, null at the times of the others; of one series' rows of one key and time any may be
    taken, so make them unique. A column's value is dropped where it is older than ``tolerance``.
    """
    spare = [c for c in left.columns if c not in (*keys, on)]
    parts = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(on).alias("at"), F.col(v).alias("value"))) for v in values}
    shapes = {v: right.select(F.struct(F.col(on).alias("at"), F.col(v).alias("value")).alias("x")).schema["x"].dataType for v in values}
    one = left.select(*keys, on, F.struct(*[F.col(c) for c in spare] or [F.lit(0).alias("_")]).alias("__l"), *[F.lit(None).cast(shapes[v]).alias(f"__{v}") for v in values], F.lit(1).alias("__side"))
    two = right.select(*keys, on, F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), *[parts[v].alias(f"__{v}") for v in values], F.lit(0).alias("__side"))
    both = one.unionByName(two)
    if not keys:
        both = ranges(both, on)
    w = Window.partitionBy(*(keys or ["__b"])).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({f"__{v}": F.last(f"__{v}", ignorenulls=True).over(w) for v in values}).where("__side = 1")
    if not keys:
        ends = both.where("__side = 0").groupBy("__b").agg(*[F.max_by(f"__{v}", F.when(F.col(f"__{v}").isNotNull(), F.col(on))).alias(v) for v in values])
        whole = ends.agg(F.sort_array(F.collect_list(F.struct("__b", *values))).alias("ends"))
        before = lambda v: F.element_at(F.concat(F.array(F.lit(None).cast(shapes[v])), F.transform(F.filter("ends", lambda x: (x["__b"] < F.col("__b")) & x[v].isNotNull()), lambda x: x[v])), -1)
        carried = whole.select("ends", F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("__b")).select("__b", *[before(v).alias(f"__c_{v}") for v in values])
        found = found.join(F.broadcast(carried), "__b", "left").withColumns({f"__{v}": F.coalesce(f"__{v}", f"__c_{v}") for v in values})  # RANGES rows at most
    fresh = lambda v: F.col(f"__{v}.value") if tolerance is None else F.when(F.col(f"__{v}.at") >= F.col(on) - F.expr(f"INTERVAL {tolerance}"), F.col(f"__{v}.value"))
    return found.select(*keys, on, *[F.col(f"__l.{c}").alias(c) for c in spare], *[fresh(v).alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, on: str = "ts") -> DataFrame:
    """The value at the nearest time on either side; the earlier one at equal distance."""
    b = asof(left, right, keys, [value], on=on).withColumnsRenamed({value: "__bv", f"matched_{on}": "__bt"})
    f = asof(b, right, keys, [value], direction="forward", on=on).withColumnsRenamed({value: "__fv", f"matched_{on}": "__ft"})
    back = F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(F.col("__bt").cast("timestamp"))
    ahead = F.unix_micros(F.col("__ft").cast("timestamp")) - F.unix_micros(F.col(on).cast("timestamp"))
    take = F.when(F.col("__ft").isNull() | (back <= ahead), F.col("__bv")).otherwise(F.col("__fv"))
    return f.withColumn(value, take).drop("__bv", "__bt", "__fv", "__ft")


def attach(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join on keys that are first made unique on the right, so that no row is multiplied."""
    return left.join(dedup(right, keys, [F.col(order)]), keys, "left")


def merge_full(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "full")


def common_times(bars: DataFrame) -> DataFrame:
    """Bars at times that all symbols have."""
    n = bars.select("symbol").distinct().agg(F.count("*").alias("n"))
    full = bars.select("symbol", "ts").distinct().groupBy("ts").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("ts")
    return bars.join(full, "ts", "left_semi")


def best_of(df: DataFrame, key: str, priority: dict[str, int], by: str, then: str) -> DataFrame:
    """One row of each key: the best priority, then the least of ``then``."""
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])[F.col(by)]
    return dedup(df.withColumn("__p", F.coalesce(rank, F.lit(len(priority)))), [key], [F.col("__p"), F.col(then)]).drop("__p")


def prefix_match(names: DataFrame, stems: DataFrame, k: int = 3) -> DataFrame:
    """The longest stem that each name starts with; stems of at least k characters meet names on their first k."""
    n = names.withColumn("__k", F.substring("name", 1, k))
    s = stems.where(F.length("stem") >= k).withColumn("__k", F.substring("stem", 1, k))
    met = n.join(s, "__k").where(F.col("name").startswith(F.col("stem"))).drop("__k")
    return dedup(met, ["name"], [-F.length("stem"), F.col("stem")])


def assign_folds(rows: DataFrame, splits: DataFrame, number: str = "rn") -> DataFrame:
    """Rows with the fold whose [first, last) holds their number; ``splits`` (fold, first, last) is small and checked."""
    return rows.join(small(splits), (F.col(number) >= F.col("first")) & (F.col(number) < F.col("last")))


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones and nulls are 0, others are dropped."""
    return df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])
