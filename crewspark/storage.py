"""Folders that all machines of a cluster see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; in local mode, without that, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="crewspark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows that a task takes when a table is dealt by its keys.
ROWS_A_TASK = 500_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks keep one of them within ROWS_A_TASK rows of df, a table as read; no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))


def rewritten(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that it is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
