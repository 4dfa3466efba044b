"""The frozen block's contract, and as-of joins without a key."""

import bisect
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, canonical

T0 = datetime(2024, 1, 1)


def bars(spark, n=80, symbols=("btc", "eth")):
    rng, rows = random.Random(5), []
    for s in symbols:
        c = 100.0
        for i in range(n):
            c *= 1 + rng.uniform(-0.02, 0.02)
            rows.append((s, T0 + timedelta(minutes=30 * i), c, c * 1.01, c * 0.99, c, rng.uniform(1, 9)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)


def test_names_are_frozen():
    names = canonical.CANONICAL
    assert len(names) == 113 and len(set(names)) == 113
    assert names[:2] == ("year", "month") and names[37] == "ret_1h" and names[-2:] == ("regime_high_vol", "regime_trending")
    assert [x for x in names if x.startswith("ETHUSDT") or "_ETHUSDT_" in x] == canonical.cross_names("ETHUSDT")
    assert {x for x in names if x not in canonical.GRAPH} == {"funding_rate", "open_interest", "insurance_balance", "taker_buy_vol", "taker_sell_vol", "trade_count", "imbalance", "spread", *canonical.EQUITIES, *(x for a in canonical.ASSETS for x in canonical.cross_names(a))}


def test_missing_series_are_zero_and_extra_columns_go(spark):
    df = bars(spark).withColumn("unknown_feature", F.lit(1.0))
    out = canonical.block(df, "btc", {"ETHUSDT": "eth"})
    assert out.columns == ["symbol", "ts", *canonical.CANONICAL]
    rows = out.collect()
    assert rows and all(r[x] == 0.0 for r in rows for x in (*canonical.MACRO, *canonical.MICRO, *canonical.EQUITIES, *canonical.cross_names("DOGEUSDT")))
    assert all(r[x] is not None for r in rows for x in canonical.CANONICAL)
    assert min(r.ts for r in rows) == T0 + timedelta(minutes=30 * 48)  # the longest window of what is there: 48 returns, or 24 closed hours
    assert len(rows) == 2 * (80 - 48)


def test_a_column_that_is_given_stands_for_its_feature(spark):
    df = bars(spark, 5).withColumn("ret_1", F.lit(2.0))
    assert {r.ret_3 for r in canonical.resolve(df, ["ret_3"]).collect()} == {None, 6.0}
    assert "funding_rate" not in canonical.resolve(df, ["funding_rate", "hour"]).columns  # its series is not there


def test_empty_bars_give_no_rows(spark):
    assert canonical.block(bars(spark, 3).limit(0), "btc", {"ETHUSDT": "eth"}).collect() == []


def test_one_exchange_serves_all_windows(spark):
    wanted = (*canonical.CALENDAR, *canonical.PRICE, *canonical.FRAMES, *canonical.REGIME)
    plan = canonical.resolve(bars(spark), wanted)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == 1


def test_closed_frames_by_hand(spark):
    rows = [("a", T0 + timedelta(minutes=30 * i), 1.0, float(i + 2), 1.0, float(i + 1), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = canonical.resolve(df, ["ret_1h", "range_4h_pct"]).orderBy("ts").collect()
    # hourly closes 2, 4, 6, ...; an hour is seen once it has closed
    assert [r.ret_1h for r in got] == [None] * 4 + [pytest.approx(x) for x in (1, 1, 1 / 2, 1 / 2, 1 / 3, 1 / 3, 1 / 4, 1 / 4)]
    assert [r.range_4h_pct for r in got] == [None] * 8 + [pytest.approx(1.0)] * 4


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_without_a_key_equals_a_search(spark, direction):
    rng = random.Random(2)
    left = [(rng.choice([5, 5, 5, rng.randint(0, 400)]), i) for i in range(300)]
    right = [(t, f"r{t}") for t in sorted(rng.sample(range(0, 500), 60))]
    df = align.asof(spark.createDataFrame(left, "ts long, n int"), spark.createDataFrame(right, "ts long, v string"), [], ["v"], direction=direction)
    times, want = [t for t, _ in right], []
    for t, n in left:
        i = bisect.bisect_right(times, t) - 1 if direction == "backward" else bisect.bisect_left(times, t)
        want.append((n, right[i][1] if 0 <= i < len(right) else None))
    assert sorted((r.n, r.v) for r in df.collect()) == sorted(want)
    assert "Exchange SinglePartition" not in df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_asof_without_a_key_on_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a")], "ts long, n string"), spark.createDataFrame([(1, 2.0)], "ts long, v double")
    assert [(r.n, r.v) for r in align.asof(left, right.limit(0), [], ["v"]).collect()] == [("a", None)]
    assert align.asof(left.limit(0), right, [], ["v"]).collect() == []
    assert align.asof(left.limit(0), right.limit(0), [], ["v"]).collect() == []


def test_many_series_each_with_its_own_last_value(spark):
    rng = random.Random(7)
    left = [(k, t, n) for n, (k, t) in enumerate((rng.choice("ab"), rng.randint(0, 60)) for _ in range(120))]
    right = [(k, t, float(t) if x == "v" else None, f"w{t}" if x == "w" else None) for k in "ab" for x in "vw" for t in sorted(rng.sample(range(60), 9))]
    rows = spark.createDataFrame(left, "k string, ts long, n int").repartition(3)
    series = spark.createDataFrame(right, "k string, ts long, v double, w string").repartition(2)
    for keys in (["k"], []):
        own = [r for r in right if keys or r[0] == "a"]
        df = align.asof_columns(rows, series if keys else series.where("k = 'a'").drop("k"), keys, ["v", "w"])
        got = {r.n: (r.v, r.w) for r in df.collect()}
        for k, t, n in left:
            v = max((r[1:] for r in own if r[1] <= t and r[2] is not None and (not keys or r[0] == k)), default=(None,) * 3)
            w = max(((r[1], r[3]) for r in own if r[1] <= t and r[3] is not None and (not keys or r[0] == k)), default=(None,) * 2)
            assert got[n] == (v[1], w[1])
    assert align.asof_columns(rows, series.limit(0), ["k"], ["v"]).where("v IS NOT NULL").count() == 0


def test_chain_features_stay_on_their_chain(spark):
    from tidemark.operators import features

    b = spark.createDataFrame([(s, T0 + timedelta(days=d)) for s in ("btc", "eth", "dog") for d in range(4)], "symbol string, ts timestamp_ntz")
    daily = spark.createDataFrame([("c1", T0 + timedelta(days=1), 5.0), ("c2", T0, 7.0)], "chain string, ts timestamp_ntz, tx double")
    of = spark.createDataFrame([("btc", "c1"), ("eth", "c2")], "symbol string, chain string")
    got = {(r.symbol, (r.ts - T0).days): (r.oc_c1_tx, r.oc_c2_tx) for r in features.onchain(b, daily, of, ["c1", "c2"], ["tx"], "2 DAYS").collect()}
    assert [got["btc", d] for d in range(4)] == [(None, None), (5.0, None), (5.0, None), (5.0, None)]
    assert [got["eth", d] for d in range(4)] == [(None, 7.0), (None, 7.0), (None, 7.0), (None, None)]
    assert {got["dog", d] for d in range(4)} == {(None, None)}


def test_a_tie_is_rounded_as_the_sql_rounds_it(spark):
    import duckdb

    from tidemark.plans.canonical import round4

    # 57.1 / 16 and the like: just under a tie in binary, a tie once scaled
    x = [57.1 / 16, -57.1 / 16, 1.00005, 2.00015, 0.00005, 3.0, None, float("inf")]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(round4("x").alias("y")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in x]
    assert got == want and got[0] == 3.5688
