"""Registry of queries, and the tables as planning entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time entries: events, from their time for their value in minutes, ended by midnight."""
    e = table(spark, sf_dir, "events")
    s = cal.seconds_of_day(F.col("ts")).cast("bigint")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("person"),
        F.to_date("ts").alias("day"),
        s.alias("s"),
        F.least(F.lit(86400).cast("bigint"), s + F.floor(F.col("value") * 60)).alias("e"),
        F.col("event_type").alias("status"),
        F.floor(F.col("value") * 100 + 0.5).alias("cents"),
    )


#: The same entries for DuckDB.
ENTRIES = """entries AS (
  SELECT event_id AS id, user_id AS person, CAST(ts AS DATE) AS day, s,
         LEAST(86400, s + CAST(floor(value * 60) AS BIGINT)) AS e, event_type AS status,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents
  FROM (SELECT *, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s FROM events))"""


def money(c: str):
    return F.col(c).cast("decimal(12,2)")
