"""Retries are due by time, whatever their ids."""

import datetime

from memquarry.queries.tenancy import R


def test_due_by_time_not_by_id(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    late = at + datetime.timedelta(hours=1)
    rows = [(1, at, 0, "error"), (9_000_000, at, 3, "error"), (2, late, 11, "error"), (3, late, 0, "view"), (8_000_000, None, 0, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in R.queries["retry_due"](spark, str(tmp_path)).collect()} == {(1, 100), (9_000_000, 800)}
