"""Reading the tables of a data directory."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``base``: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a folder of this machine serves a
    session that runs on this machine alone; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "quarrygraph-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for what is executed, not only planned, within; for rows of a few bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Batches of whole files sent to Python hold at most BATCH_ROWS rows. The same bound for every operator, and never
    more than the session asks for, so that it does not matter which plan is built last."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
