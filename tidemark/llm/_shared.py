"""Tables cut from their lineage in the folder that all machines share, and reading the input tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables that the stage at work, and the stages before it, have written for themselves; None outside of stages.
_own: list[str] | None = None
_left: list[str] = []


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a folder of this machine where that setting is absent and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder that all machines share is known")
        base = f"file://{_own_folder()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _database(spark: SparkSession) -> str:
    """A database whose tables lie in the shared folder, so that dropping one deletes its files."""
    name = f"tidemark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark, 'tables')}'")
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, reread: later failures start from there."""
    spark = df.sparkSession
    table = f"{_database(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").saveAsTable(table)
    if _own is not None:
        _own.append(table)
    return spark.table(table)


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline's stage: when it begins, what earlier stages wrote for themselves is dropped, as their results are written by then."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args) -> DataFrame:
        global _own
        while _left:
            spark.sql(f"DROP TABLE IF EXISTS {_left.pop()}")
        _own = _left
        try:
            return f(spark, *args)
        finally:
            _own = None

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
