"""Streams against batch results, and replays of batches."""

import random
from datetime import datetime, timedelta

from tidemark.operators import signals
from tidemark.streaming import jobs

T0 = datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def rows(symbols, start, n, seed):
    rng = random.Random(seed)
    return [(s, T0 + timedelta(hours=i), c, c + 1, c - 1, c, 1.0) for s in symbols for i in range(start, start + n) for c in [100 + rng.gauss(0, 3)]]


def read(spark, path):
    return sorted((r.symbol, r.ts, r.entry, r.exit, r.batch) for r in spark.read.parquet(path).collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    state, out = f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    run = jobs.latest_signals(state, out, signals.donchian, 60)
    batches = [rows("abc", 0, 50, 1), rows("ab", 50, 30, 2) + rows("b", 40, 5, 3), rows("c", 50, 3, 4), rows("abcd", 80, 2, 5)]
    frames = [spark.createDataFrame(b, BARS) for b in batches]
    for k, f in enumerate(frames):
        run(f, k)
        before = read(spark, out), spark.read.parquet(state).count()
        run(f, k)  # as after a failure between the write and the commit
        assert (read(spark, out), spark.read.parquet(state).count()) == before
    got = {r.symbol: r for r in jobs.newest_signals(spark.read.parquet(out)).collect()}
    # late bars of b come after newer ones and are left out
    whole = spark.createDataFrame([r for k, b in enumerate(batches) for r in b if not (k == 1 and r[0] == "b" and r[1] < T0 + timedelta(hours=50))], BARS)
    want = {}
    for r in signals.donchian(whole).collect():
        if r.symbol not in want or r.ts > want[r.symbol].ts:
            want[r.symbol] = r
    assert {s: (r.ts, r.entry, r.exit) for s, r in got.items()} == {s: (r.ts, r.entry, r.exit) for s, r in want.items()}
    assert got["c"].batch == 3 and len(got) == 4


def test_repeated_rows_in_a_batch_count_once(spark, tmp_path):
    run = jobs.latest_signals(f"file://{tmp_path}/state", f"file://{tmp_path}/out", signals.donchian, 60)
    f = spark.createDataFrame(rows("a", 0, 10, 1) * 2, BARS)
    run(f, 0)
    assert spark.read.parquet(f"file://{tmp_path}/state").count() == 10
    run(f.limit(0), 1)
    assert len(read(spark, f"file://{tmp_path}/out")) == 1


def test_spikes_from_a_price_of_zero(spark, tmp_path):
    prices = [5.0, 0.0, 0.0, 3.0, 3.0, 6.0, 6.5]
    ticks = spark.createDataFrame([("a", T0 + timedelta(minutes=i), float(p), i) for i, p in enumerate(prices)], "symbol string, ts timestamp, price double, tie long")
    ticks.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"file://{tmp_path}/in")
    out = jobs.drained(jobs.spike_alerts(stream, 0.8), f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/out")
    got = [(r.price, r.move) for r in out.orderBy("ts").collect()]
    assert [p for p, _ in got] == [0.0, 0.0, 3.0, 6.0]
    assert got[0][1] == -1.0 and got[1][1] != got[1][1] and got[2][1] == float("inf") and got[3][1] == 1.0


def test_moves_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    import duckdb

    from tidemark.plans import jobs as plans

    # 12.81 / 6.4 - 1 = 1.0015625 and the like are ties; from zero a move is infinite or NaN
    prices = [6.4, 12.81, 6.4, 19.37, 6.4, 32.29, 0.0, 0.0, 6.4, 13.01]
    rows = [(i, T0 + timedelta(minutes=i), 1, "a", p) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = plans.QUERIES["H05_spike_alerts"](spark, f"file://{tmp_path}").orderBy("ts").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"{plans.SQL['H05_spike_alerts']} ORDER BY ts").fetchall()
    assert [(r.ts, r.price, str(r.move)) for r in got] == [(ts, price, str(move)) for _, ts, price, move in want]
    assert got[0].move == 1.001562 and len(got) == 7
