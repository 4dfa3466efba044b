"""Data quality: spikes, agreement of venues, repairs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import change
from tidemark.operators.bars import dedup


def spikes(bars: DataFrame, most: float) -> DataFrame:
    df = bars.withColumn("move", change("close"))
    return df.where(F.abs("move") > most).withColumn("direction", F.when(F.col("move") > 0, "up").otherwise("down"))


def reconcile(venues: DataFrame, tolerance: float, tail: int = 5000) -> DataFrame:
    """Each venue's last bars against the median of two or more venues at the same time; ``worst`` marks the farthest off."""
    w = Window.partitionBy("symbol", "venue").orderBy(F.col("ts").desc())
    recent = venues.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= tail).drop("__n")
    middle = recent.groupBy("symbol", "ts").agg(F.percentile("close", F.lit(0.5)).alias("consensus"), F.countDistinct("venue").alias("n_venues")).where("n_venues >= 2")
    df = recent.join(middle, ["symbol", "ts"]).withColumn("deviation", F.abs(F.col("close") / F.col("consensus") - 1))
    top = F.max("deviation").over(Window.partitionBy("symbol", "ts"))
    return df.withColumn("flagged", F.col("deviation") > tolerance).withColumn("worst", (F.col("deviation") == top) & F.col("flagged"))


def consensus_check(bars: DataFrame, venues: DataFrame, tolerance: float, repair: bool = False) -> DataFrame:
    """Stored closes against the venues' median; repaired ones take the median."""
    middle = venues.groupBy("symbol", "ts").agg(F.percentile("close", F.lit(0.5)).alias("consensus"), F.countDistinct("venue").alias("n")).where("n >= 2").drop("n")
    off = F.abs(F.col("close") / F.col("consensus") - 1) > tolerance
    df = bars.join(middle, ["symbol", "ts"], "left").withColumn("flagged", F.coalesce(off, F.lit(False)))
    return df.withColumn("repaired", F.when(F.col("flagged"), F.col("consensus")).otherwise(F.col("close"))) if repair else df


def last_bar_check(bars: DataFrame, quotes: DataFrame, tolerance: float) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"))
    off = F.abs(F.col("close") / F.col("quote") - 1)
    return last.join(quotes, "symbol", "left").withColumn("deviation", off).withColumn("flagged", F.coalesce(off > tolerance, F.lit(False)))


def micro_anomalies(micro: DataFrame, far: float = 1.0, repair: bool = False) -> DataFrame:
    """Snapshots (token, ts, liquidity, fdv): liquidity null or under 0, or valuation far off the token's median."""
    middle = micro.groupBy("token").agg(F.percentile("fdv", F.lit(0.5)).alias("mid"))
    bad = F.col("liquidity").isNull() | (F.col("liquidity") < 0)
    df = micro.join(middle, "token").withColumn("bad_liquidity", bad).withColumn("far_value", F.coalesce(F.abs(F.col("fdv") / F.col("mid") - 1) > far, F.lit(False)))
    return df.where(~F.col("bad_liquidity")) if repair else df


def quality_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("symbol").agg(F.count("*").alias("checked"), F.sum(F.col("flagged").cast("int")).alias("flagged"), F.sum((F.col("repaired") != F.col("close")).cast("int")).alias("repaired"))


def discover(feeds: list[DataFrame], known: DataFrame | None = None, key: str = "address") -> DataFrame:
    """Union of sources, the first source winning each address; addresses known already are left out."""
    both = None
    for i, feed in enumerate(feeds):
        own = feed.withColumn("source", F.lit(i))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    new = dedup(both, [key], [F.col("source")])
    return new if known is None else new.join(known.select(key), key, "left_anti")


def log_class(line: Column, benign: list[str], alert: list[str], worker: list[str], suspect: list[str]) -> Column:
    """benign, alert, worker, suspect or other, the first that matches in this order."""
    out = F.lit("other")
    for name, patterns in reversed([("benign", benign), ("alert", alert), ("worker", worker), ("suspect", suspect)]):
        out = F.when(line.rlike("(?i)" + "|".join(patterns)), name).otherwise(out)
    return out
