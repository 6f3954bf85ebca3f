"""Weekly totals and latest states of time entries as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.storage import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def week_totals(entries: DataFrame, late: str = "7 days") -> DataFrame:
    """person, week (its Monday), n, cents: totals over tumbling weeks from Monday on; entries later
    than the watermark are left out of a week that is closed.

    Weeks are cut on days as they are written, whatever the session's time zone.
    """
    cents = F.floor(F.col("value") * 100 + 0.5)
    dated = entries.withColumn("at", F.timestamp_seconds(F.unix_date(F.to_date("ts")) * 86400))
    week = F.window("at", "7 days", "7 days", "4 days")  # the epoch was a Thursday
    own = dated.withWatermark("at", late).groupBy(week.alias("w"), F.col("user_id").alias("person"))
    monday = F.date_from_unix_date((F.unix_seconds("w.start") / 86400).cast("int"))
    return own.agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select("person", monday.alias("week"), "n", "cents")


def latest_states(entries: DataFrame) -> DataFrame:
    """person, status, ts, changes: the state after each person's latest event."""
    latest = F.max(F.struct("ts", "event_id", F.col("event_type").alias("status"))).alias("x")
    return entries.groupBy(F.col("user_id").alias("person")).agg(latest, F.count("*").alias("changes")).select("person", "x.status", "x.ts", "changes")


def run_once(df: DataFrame, mode: str = "update") -> DataFrame:
    """Works off all that has arrived and gives the rows that the sink holds.

    Each batch's rows are written as Parquet in a folder of their own, named by the batch, so that
    a batch that is done again after a loss replaces itself.
    """
    spark, base = df.sparkSession, shared_dir(df.sparkSession)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that an updating query has written, each key's last."""
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("x")).select(*keys, "x.*")
