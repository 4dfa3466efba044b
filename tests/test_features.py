"""Feature blocks on bars that are out of the common."""

import math
from datetime import datetime, timedelta

from tidemark.operators import features

T0 = datetime(2024, 1, 1)


def test_frames_with_a_close_of_zero(spark):
    closes = [4.0, 0.0, 0.0, 2.0, 1.0]
    rows = [("a", T0 + timedelta(hours=i), c, c + 1, c, c, 1.0) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = features.timeframes(bars, {"1h": "1 hour"}, lags=0).orderBy("ts").collect()
    ret, log_ret, atr_pct = ([r[f"ht_1h_{x}"] for r in got] for x in ("ret", "log_ret", "atr_pct"))
    assert [r["ht_1h_close"] for r in got] == closes
    assert ret[:2] == [None, -1.0] and math.isnan(ret[2]) and ret[3:] == [math.inf, -0.5]
    assert log_ret[:2] == [None, -math.inf] and math.isnan(log_ret[2]) and log_ret[3:] == [math.inf, math.log(0.5)]
    assert atr_pct[0] is None and atr_pct[1:3] == [math.inf, math.inf] and 0 < atr_pct[3] < math.inf
