"""Streams that get their files in two goes."""

from crewspark.streaming import weeks


def test_weeks_and_states_over_two_files(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    import datetime as dt

    first = [(1, dt.datetime(2024, 1, 3, 8), 7, "view", 1.5, None), (2, dt.datetime(2024, 1, 7, 23), 7, "click", 2.0, None)]
    second = [(3, dt.datetime(2024, 1, 8, 0), 7, "purchase", 4.0, None), (4, dt.datetime(2024, 1, 5, 9), 8, "view", 1.0, None)]
    for name, rows in (("events.parquet", first), ("events2.parquet", second)):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = weeks.newest(weeks.run_once(weeks.week_totals(stream)), ["person", "week"])
    assert {(r.person, str(r.week), r.n, r.cents) for r in got.collect()} == {(7, "2024-01-01", 2, 350), (7, "2024-01-08", 1, 400), (8, "2024-01-01", 1, 100)}
    states = weeks.newest(weeks.run_once(weeks.latest_states(stream)), ["person"])
    assert {(r.person, r.status, r.changes) for r in states.collect()} == {(7, "purchase", 3), (8, "view", 1)}
