"""How the learners' queries lay out their rows."""

import pytest

from tidemark.operators import learn
from tidemark.plans import _data, jobs

SMALL = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bars_of_many_symbols_need_one_exchange(spark):
    assert exchanges(jobs.numbered(spark, SMALL)) == 1


@pytest.mark.parametrize("rows", [500_000, 300])
def test_parts_grow_with_the_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(_data, "ROWS_A_TASK", rows)
    bars = _data.part_bars(spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert bars.rdd.getNumPartitions() <= 4 if rows > n else bars.rdd.getNumPartitions() == n // rows


def test_the_panel_is_written_once(spark):
    df = jobs.panel(spark, SMALL)
    assert exchanges(df) == 0 and len(df.inputFiles()) > 0 and "panel-" in df.inputFiles()[0]


def test_large_fits_run_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(learn, "ALONE", 10)
    assert learn.together(spark.range(10)) == 8 and learn.together(spark.range(11)) == 1
