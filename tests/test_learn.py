import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluate, learn


def series(spark, lengths, flip):
    """Rows whose class follows x, the other way round for the symbols in ``flip``."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in lengths.items():
        x = rng.normal(size=n)
        rows += [(s, i, float(v), float(rng.normal()), int(v > 0) ^ int(s in flip) if i % 9 else 2) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol int, rn int, a double, b double, label int")


def test_folds_reach_the_last_row_of_every_symbol(spark):
    lengths = {1: 130, 2: 200}
    df = series(spark, lengths, ())
    got = learn.walk_forward(df, ["a", "b"], evaluate.wf_splits(df, 10, 30, 5, 2), trees=3, depth=2).collect()
    for s, n in lengths.items():
        assert sorted(r.rn for r in got if r.symbol == s) == list(range(n - 60, n))


def test_every_symbol_has_its_own_model(spark, tmp_path):
    df = series(spark, dict.fromkeys(range(4), 120) | {9: 5}, flip=(2, 3))
    df = df.where("symbol <> 9").unionByName(df.where("symbol = 9").withColumn("label", F.lit(1)))  # one class alone: no model of its own
    got = learn.pooled_against_own(df, ["a", "b"], f"file://{tmp_path}/own", trees=5, depth=2).collect()
    assert len(got) == 1 and got[0].wins + got[0].losses + got[0].ties == 4
    assert got[0].losses >= 2  # the own models of the symbols that go the other way are right


def test_no_number_of_symbols_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learn, "MOST_OWN", 1, raising=False)
    got = learn.pooled_against_own(series(spark, dict.fromkeys(range(3), 60), ()), ["a", "b"], f"file://{tmp_path}/own", trees=2, depth=2).collect()
    assert got[0].wins + got[0].losses + got[0].ties == 3


def test_both_sides_are_one_estimator(spark, tmp_path):
    """With one symbol the pooled model is its own."""
    got = learn.pooled_against_own(series(spark, {1: 150}, ()), ["a", "b"], f"file://{tmp_path}/own", trees=5, depth=2).collect()
    assert (got[0].wins, got[0].losses, got[0].ties) == (0, 0, 1)


def test_own_fits_share_weights_and_files(spark, tmp_path, monkeypatch):
    """Weights of all symbols are made at once, and symbols share files, so neither plans nor files grow by one each for a symbol."""
    monkeypatch.setattr(learn, "at_once", lambda spark, jobs, most=8: [[(s, 0.5) for s in range(6)]])  # the fits themselves are not run
    df = series(spark, dict.fromkeys(range(6), 90), ())
    learn.pooled_against_own(df, ["a", "b"], f"file://{tmp_path}/own", trees=2, depth=2)
    assert len([x for x in (tmp_path / "own" / "rows").iterdir() if "=" in x.name]) == 1
    rows = spark.read.parquet(f"file://{tmp_path}/own/rows").where("early")
    for s in range(6):
        want = {r.label: r.weight for r in learn.weighted(df.where((F.col("symbol") == s) & (F.col("rn") < 63))).select("label", "weight").distinct().collect()}
        assert {(r.label, r.weight) for r in rows.where(F.col("symbol") == s).select("label", "weight").distinct().collect()} == set(want.items()) and len(want) == 3


def test_search_is_chronological_and_prunes(spark):
    df = series(spark, {1: 300}, ()).withColumn("late", F.when(F.col("rn") >= 250, F.col("label")).otherwise(0).cast("double"))
    got = {r.case: r for r in learn.model_search(df, ["a", "b", "late"], 200, 250, {"maxDepth": [1, 3], "numTrees": [4]}, least=1).collect()}
    assert set(got) == {"baseline", "tuned", "class_weighted", "pruned"}
    assert got["pruned"].columns == 1 and got["tuned"].columns == 3
    assert got["pruned"].accuracy > 0.8  # the column that tells the class is kept; what shows only in test rows is not learnt from
    assert got["tuned"].val_score >= 0.8 and got["tuned"].gated_trades <= got["tuned"].raw_trades


def test_threads_keep_the_order_of_jobs(spark):
    assert learn.at_once(spark, [lambda k=k: spark.range(k).count() for k in range(5)], 3) == [0, 1, 2, 3, 4]
    assert learn.at_once(spark, []) == []


def test_the_search_s_panel_holds_only_what_is_fitted(spark, monkeypatch):
    from tidemark.plans import jobs

    seen = []
    monkeypatch.setattr(jobs.L, "model_search", lambda df, *_: seen.append(df.columns))
    jobs.QUERIES["M04_model_search"](spark, "/root/testdata/sf0.001")
    assert seen == [["rn", "label", *jobs.COLS]]
