"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.plans.registry import ENTRIES, query
from crewspark.streaming import weeks


@query(f"""WITH {ENTRIES} SELECT person, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM entries GROUP BY 1, 2""")
def stream_week_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weeks.run_once(weeks.week_totals(weeks.event_stream(spark, sf_dir)))
    return weeks.newest(rows, ["person", "week"]).withColumn("week", F.col("week").cast("string"))


@query("""SELECT user_id AS person, max_by(event_type, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS status, count(*) AS changes FROM events GROUP BY 1""")
def stream_latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weeks.run_once(weeks.latest_states(weeks.event_stream(spark, sf_dir)))
    return weeks.newest(rows, ["person"]).select("person", "status", "changes")
