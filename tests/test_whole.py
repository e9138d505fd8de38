"""Queries over all of their rows, on tables made by hand."""

from datetime import datetime, timedelta

from tracemill import catalog

MONDAY = datetime(2024, 1, 1, 10)


def events_table(spark, tmp_path, rows):
    """events of (user_id, ts, k)."""
    made = [(i, ts, user, "click", 1.0, f'{{"k": {k}}}') for i, (user, ts, k) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_session_spans_all_its_events(spark, tmp_path):
    hour = lambda h: MONDAY + timedelta(hours=h)
    # 3 runs from 0 to 9 and 13 starts at 5; of k < 20 there is only 3 at 1 and 13 at 8.
    d = events_table(spark, tmp_path, [(3, hour(0), 99), (3, hour(1), 5), (3, hour(9), 50), (13, hour(5), 70), (13, hour(8), 1)])
    assert [tuple(r) for r in catalog.QUERIES["subagent_time_window"](spark, d).collect()] == [(13, 3)]


def test_low_days_are_the_lowest_two_with_fewer_than_three(spark, tmp_path):
    # Monday 5 with k < 3, Tuesday 1, Wednesday and Thursday 2, Friday to Sunday 4.
    days = [0] * 5 + [1] + [2] * 2 + [3] * 2 + [4, 5, 6] * 4
    d = events_table(spark, tmp_path / "low", [(1, MONDAY + timedelta(days=day, seconds=i), 0 if day == 0 else 50) for i, day in enumerate(days)])
    assert sorted(tuple(r) for r in catalog.QUERIES["advisor_low_days"](spark, d).collect()) == [(1, 1), (2, 2)]
    d = events_table(spark, tmp_path / "busy", [(1, MONDAY + timedelta(days=day, seconds=i), 1) for i, day in enumerate([*range(7)] * 3)])
    assert catalog.QUERIES["advisor_low_days"](spark, d).collect() == []
