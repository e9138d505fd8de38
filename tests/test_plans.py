from datetime import datetime

import pytest

from tracemill.plans.aggregate import DOMAINS, Metric, Predicate, Spec, SpecError, buckets, parse_metric, parse_predicate, parse_since, partitioned, summary

NOW = datetime(2026, 4, 22, 10, 30)  # a Wednesday
EVENTS = "session_key string, client string, type string, confidence string, source string, lossiness string, event_at timestamp"


def events(spark, counts):
    rows = [(f"claude:ws:{s}", "claude", t, "high", "x", None, NOW) for (s, t), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_order_and_other(spark):
    frame = events(spark, {("s", f"t{i}"): 1 for i in range(7)} | {("s", "a"): 3, ("s", "b"): 3, ("s", "c"): 3})
    spec = Spec(DOMAINS["events"], ("type",), limit=3)
    assert [(r["type"], r["count"]) for r in buckets(spec, frame).collect()] == [("a", 3), ("b", 3), ("c", 3)]
    assert summary(spec, frame).first().asDict() == {"total": 16, "rows_scanned": 16, "other_count": 7}


def test_nulls_come_last(spark):
    frame = events(spark, {("s", "a"): 1, ("s", None): 1})
    assert [r["type"] for r in buckets(Spec(DOMAINS["events"], ("type",)), frame).collect()] == ["a", None]


def test_values_are_literals(spark):
    frame = events(spark, {("s", "a"): 1})
    spec = Spec(DOMAINS["events"], ("type",), predicates=(parse_predicate("type=a' OR '1'='1"),))
    assert buckets(spec, frame).count() == 0


def test_cost_is_split_by_source(spark):
    rows = [("api", "m", 100), ("estimated", "m", 200), ("api", "m", None)]
    frame = spark.createDataFrame(rows, "data_source string, model string, input long")
    spec = Spec(DOMAINS["cost"], ("model",), metric=parse_metric("sum:input_tokens"))
    assert {(r["data_source"], r["sum_input_tokens"]) for r in buckets(spec, frame).collect()} == {("api", 100), ("estimated", 200)}
    assert partitioned(Spec(DOMAINS["cost"], ("model",), predicates=(parse_predicate("data_source=api"),))).dimensions == ("model",)
    with pytest.raises(SpecError):
        partitioned(Spec(DOMAINS["cost"], ("model", "session", "date")))


@pytest.mark.parametrize(("text", "made"), [("a=b", Predicate("a", "=", "b")), ("a>=1", Predicate("a", ">=", "1")), ("a!=b=c", Predicate("a", "!=", "b=c")), ("a in: x | |y", Predicate("a", "in", ("x", "y")))])
def test_predicates(text, made):
    assert parse_predicate(text) == made


def test_windows():
    assert parse_since("today", NOW) == datetime(2026, 4, 22)
    assert parse_since("thisweek", NOW) == datetime(2026, 4, 20)
    assert parse_since("2d", NOW) == datetime(2026, 4, 20, 10, 30)
    for bad in ("0d", "-1d", "x", "3w"):
        with pytest.raises(SpecError):
            parse_since(bad, NOW)


@pytest.mark.parametrize("make", [lambda d: Spec(d, ()), lambda d: Spec(d, ("type", "type")), lambda d: Spec(d, ("nope",)), lambda d: Spec(d, ("type",), limit=1001), lambda d: Spec(d, ("type",), metric=Metric("sum", "type")), lambda d: Spec(d, ("type",), predicates=(Predicate("lossiness", "=", "x"),)), lambda d: Spec(d, ("type",), predicates=(Predicate("event_at", ">", "x"),), since=NOW)])
def test_refused(make):
    with pytest.raises(SpecError):
        make(DOMAINS["events"])
