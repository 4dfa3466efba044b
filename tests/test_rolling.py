import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rolling as R


def series(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, i, None if v is None else float(v), 1.0) for i, v in enumerate(values)], "symbol string, ts long, close double, volume double")


@pytest.mark.parametrize("alpha", [0.9, 2 / 13, 0.05, 0.004])
def test_ewm_equals_pandas(spark, alpha):
    rng = np.random.default_rng(0)
    x = [None, None, *rng.normal(size=1500).cumsum()]
    got = R.ewm(series(spark, x), "close", "y", alpha=alpha).orderBy("ts").toPandas()["y"]
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False).mean()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9, atol=1e-12)


def test_span_of_one_is_the_series(spark):
    assert [r.y for r in R.ewm(series(spark, [1, 2, 3]), "close", "y", span=1).orderBy("ts").collect()] == [1, 2, 3]


def test_rolling_counts_only_values(spark):
    rows = series(spark, [1, None, 3, 4]).withColumn("y", R.sma("close", 2)).withColumn("z", R.sma("close", 3, 1)).orderBy("ts").collect()
    assert [r.y for r in rows] == [None, None, None, 3.5]
    assert [r.z for r in rows] == [1, 1, 2, 3.5]


def test_mean_deviation_and_rank_equal_pandas(spark):
    x = np.random.default_rng(1).normal(size=120)
    df = series(spark, x).withColumn("m", R.mean_deviation("close", 20)).withColumn("p", R.percent_rank("close", 50, 5)).orderBy("ts").toPandas()
    s = pd.Series(x)
    assert np.allclose(df.m, s.rolling(20).apply(lambda v: np.abs(v - v.mean()).mean()), equal_nan=True)
    assert np.allclose(df.p, s.rolling(50, min_periods=5).apply(lambda v: (v <= v[-1]).sum() / len(v), raw=True), equal_nan=True)


def test_correlation_of_a_flat_series_is_null(spark):
    assert {r.y for r in series(spark, range(9)).withColumn("y", R.corr("close", "volume", 3)).collect()} == {None}


def test_flags_are_never_null(spark):
    rows = series(spark, [None, 1, math.pi]).withColumn("y", R.flag(F.col("close") > 2)).orderBy("ts").collect()
    assert [r.y for r in rows] == [0, 0, 1]


@pytest.mark.parametrize("q", [0.5, 0.3])
def test_sliding_quantile_equals_the_frame_s_own(spark, q):
    rng = np.random.default_rng(5)
    values = [None, None, *(None if i % 11 == 3 else math.nan if i % 29 == 5 else round(float(v), 1) for i, v in enumerate(rng.normal(size=90)))]
    df = series(spark, values).unionByName(series(spark, [4, None, 2], "b"))
    got = R.with_quantile(df.withColumn("want", R.quantile("close", q, 7, 1)), "close", "got", q, 7)
    assert got.columns == ["symbol", "ts", "close", "volume", "want", "got"]
    rows = got.collect()
    assert len(rows) == len(values) + 3
    assert all(r.got is None if r.want is None else (r.got == r.want or r.got != r.got and r.want != r.want) for r in rows)


def test_no_regime_sorts_its_long_frame_for_each_row(spark):
    from tidemark.operators import canonical, regimes

    df = series(spark, [1, 2, 3]).withColumn("ts", F.timestamp_seconds("ts"))
    for out in (regimes.four_state(df), canonical.resolve(df, ["regime_high_vol"])):
        assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
