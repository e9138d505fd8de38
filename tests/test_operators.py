from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.columns import effective_hold, normalised_outcome, task_type, visible, week_label, workspace
from tracemill.operators import canonical as C
from tracemill.operators import curation as K
from tracemill.operators import joins as J
from tracemill.operators import search as X
from tracemill.operators import segments as G
from tracemill.operators import sequences as S

T0 = datetime(2026, 4, 21, 10)
at = lambda i: T0 + timedelta(seconds=i)


def stream(spark, rows):
    return spark.createDataFrame([(1, i, at(i), t, f) for i, (t, f) in enumerate(rows)], "session_id long, id long, event_at timestamp, type string, fp string")


def runs(spark, rows):
    found = S.repeat_runs(stream(spark, rows), "type", "fp", S.ordered())
    return [(r["kind"], r["first_id"], r["last_id"], r["count"]) for r in found.collect()]


def test_repeat_runs(spark):
    call = ("command_start", "x")
    assert runs(spark, [call] * 3) == [("command_start", 0, 2, 3)]
    assert runs(spark, [call] * 2) == []
    assert runs(spark, [call, call, ("user_message", None), call, call]) == []
    assert runs(spark, [call, call, ("command_start", None), call]) == []
    assert runs(spark, [call, ("file_read", None), call, ("tool_call", "y"), call]) == [("command_start", 0, 4, 3)]
    assert runs(spark, [("tool_call", "y")] * 5) == [("tool_call", 0, 4, 5)]


def test_spikes_need_a_full_window(spark):
    rows = spark.createDataFrame([(1, i, at(i), v) for i, v in enumerate([10, 10, 10, 10, 100, 10, 10, 10, 10, 85])], "session_id long, id long, event_at timestamp, v long")
    assert [r["id"] for r in S.input_spikes(rows, "v", S.ordered()).collect()] == [9]
    more = rows.withColumn("v", F.when(F.col("id") == 5, 200).otherwise(F.col("v")))
    assert [r["id"] for r in S.input_spikes(more, "v", S.ordered()).collect()] == [5]


def test_collapse_is_broken_by_an_estimate(spark):
    rows = spark.createDataFrame([(1, 0, at(0), 100, 10, "api"), (1, 1, at(1), 40, 10, "api"), (1, 2, at(2), 100, 10, "estimated"), (1, 3, at(3), 1, 10, "api")], "session_id long, id long, event_at timestamp, cache long, size long, src string")
    assert [r["id"] for r in S.cache_collapses(rows, "cache", "size", S.ordered(), F.col("src") == "api").collect()] == [1]


def base(spark, rows):
    return spark.createDataFrame([(1, k, i, "t", at(i), c, "s", "p", i, 0) for i, (k, c) in enumerate(rows)], "session_id long, event_key string, id long, type string, event_at timestamp, confidence string, source string, source_path string, source_offset long, seq int")


def override(spark, rows):
    return spark.createDataFrame([(1, k, "o", at(9), c, "hook", i) for i, (k, c) in enumerate(rows)], "session_id long, event_key string, type string, event_at timestamp, confidence string, source string, write_seq long")


def test_canonical_view(spark):
    view = C.canonical(base(spark, [("a", "medium"), ("a", "high"), ("b", "high"), (None, "low"), (None, "low")]), override(spark, [("a", "medium"), ("b", "low"), ("c", "low")]))
    assert sorted((r["event_key"] or "", r["origin"], r["id"] is None) for r in view.collect()) == [("", "base", False), ("", "base", False), ("a", "override", False), ("b", "base", False), ("c", "hook", True)]


def test_first_of_the_highest_rank_stays(spark):
    folded = C.fold_overrides(override(spark, [("a", "low"), ("a", "high"), ("a", "high"), ("a", "medium")]))
    assert [r["write_seq"] for r in folded.collect()] == [1]


def test_upsert_keeps_reviews_and_freezes_costs(spark):
    old = spark.createDataFrame([("a", "ended", 1.0, "approved", "t1"), ("b", "open", 2.0, None, "t1")], "id string, status string, cost double, review string, title string")
    new = spark.createDataFrame([("a", "open", 9.0, "new", "t2"), ("b", "open", 9.0, "new", "t2"), ("c", "open", 3.0, "new", "t2")], old.schema)
    out = {r["id"]: tuple(r) for r in C.merged_sessions(old, new, "id", ["cost"], ["review"], ["title"]).select("id", "status", "cost", "review", "title").collect()}
    assert out == {"a": ("a", "ended", 1.0, "approved", "t2"), "b": ("b", "open", 9.0, "new", "t2"), "c": ("c", "open", 3.0, "new", "t2")}


def test_hierarchy(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    assert {r["id"]: (r["root"], r["depth"]) for r in J.hierarchy_roots(nodes, "id", "parent").collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (None, None), 6: (None, None)}


def test_longest_prefix(spark):
    prices = spark.createDataFrame([("gpt", 1.0), ("gpt-4", 2.0)], "p string, price double")
    rows = spark.createDataFrame([("gpt-4o",), ("gpt-3",), ("o3",), (None,)], "m string")
    assert {r["m"]: r["price"] for r in J.longest_prefix(rows, "m", prices, "p").collect()} == {"gpt-4o": 2.0, "gpt-3": 1.0, "o3": None, None: None}


@pytest.mark.parametrize("text", ["", '"a', "a AND", "NOT a", "(a", "a-b", "a )"])
def test_unreadable_queries(text):
    with pytest.raises(X.QueryError):
        X.parse(text)


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green red"), (3, "Red GREEN"), (4, None), (5, "Café x y z noir cafe")], "id long, text string")
    index = X.write_index(docs, "id", "text", str(tmp_path / "index"), buckets=4)
    hits = lambda q: sorted(r["doc_id"] for r in X.matching(index, X.parse(q)).collect())
    assert hits('"red green"') == [1, 3]
    assert hits("red blue") == [1]
    assert hits("red NOT blue") == [2, 3]
    assert hits("bl* OR green") == [1, 2, 3]
    assert hits("cafe") == hits("CAFÉ") == [5]
    assert (hits("NEAR(cafe noir, 3)"), hits("NEAR(noir cafe, 0)"), hits("NEAR(cafe noir, 2)"), hits("NEAR(x noir, 1)")) == ([5], [5], [5], [])
    ranked = lambda q: [(r["doc_id"], r["score"] < 0) for r in X.search(index, q).collect()]
    assert ranked("blue OR red")[0] == (1, True)
    assert ranked("bl*") == [(1, True)] and ranked('"green red"') == [(2, True)]
    assert X.total_matches(index, "red").first()["total"] == 3
    with pytest.raises(X.QueryError):
        X.parse("NEAR(a, x)")
    changed = X.updated_postings(spark.read.parquet(str(tmp_path / "index/postings")), docs.filter("id = 2").selectExpr("id as doc_id"), spark.createDataFrame([(1, "black")], "id long, text string"), "id", "text")
    assert sorted((r["term"], r["doc_id"]) for r in changed.filter("doc_id < 4").collect()) == [("black", 1), ("green", 3), ("red", 3)]


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(40))
    row = spark.createDataFrame([(text,)], "t string").select(X.snippet(F.col("t"), "w20", 4).alias("s")).first()
    assert row["s"] == "...w18 w19 w20 w21..."


def test_boundaries(spark):
    signals = spark.createDataFrame([(1, 5, "time_gap"), (1, 6, "tool_mode"), (1, 20, "tool_mode")], "s long, idx long, signal string")
    got = {r["idx"]: (round(r["confidence"], 2), r["reason"]) for r in G.scored(signals, "s").collect()}
    assert got == {5: (1.0, "time_gap + tool_mode"), 6: (1.0, "time_gap + tool_mode"), 20: (0.5, "tool_mode")}


def test_small_segments_go_but_not_the_last(spark):
    messages = spark.createDataFrame([(1, i, "user" if i in (0, 4, 8) else "assistant") for i in range(9)], "s long, i long, r string")
    cuts = spark.createDataFrame([(1, 2), (1, 4), (1, 8)], "s long, idx long")
    assert sorted(r["idx"] for r in G.kept_boundaries(cuts, messages, "s", "i", "r").collect()) == [4, 8]


def test_pii(spark):
    docs = spark.createDataFrame([(1, "mail bob@example.com or noreply@x.org, ip 10.1.2.3, 123-45-6789 and 000-12-3456"), (2, None)], "id long, text string")
    assert [(r["rule"], r["entity"]) for r in K.pii_spans(docs, "id", "text").orderBy("start").collect()] == [("email", "bob@example.com"), ("private_ip_10", "10.1.2.3"), ("ssn_us", "123-45-6789")]
    assert K.without_overlaps([(0, 5, 0.5, "a"), (2, 9, 0.1, "b"), (9, 10, 0.1, "c")]) == [(2, 9, 0.1, "b"), (9, 10, 0.1, "c")]


def test_columns(spark):
    frame = spark.createDataFrame([("claude:proj:a:b", "2024-01-07", "embargoed", at(0), "at 2026-04-21T10:00:00Z in /home/u/x pid 77 [123]  ok", "please fix the failing test")], "k string, d string, st string, u timestamp, o string, t string")
    now = F.lit(at(1)).cast("timestamp")
    r = frame.select(workspace(F.col("k")).alias("w"), week_label(F.to_date("d")).alias("d"), effective_hold(F.col("st"), F.col("u"), now).alias("h"), visible(F.col("st"), F.col("u"), now).alias("v"), normalised_outcome(F.col("o")).alias("o"), task_type(F.col("t"), F.col("t")).alias("t")).first()
    assert (r["w"], r["d"], r["h"], r["v"], r["t"]) == ("proj", "2024-W01", "released", True, "debugging")
    assert "<TS>" in r["o"] and "<PATH>" in r["o"] and "[<PID>]" in r["o"]


def test_first_and_last_result(spark):
    calls = spark.createDataFrame([("a",), ("b",)], "k string")
    results = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(2))], "k string, id long, t timestamp")
    assert {r["k"]: r["id"] for r in S.paired_results(calls, results, ["k"], "t", "id").collect()} == {"a": 1, "b": None}
    assert {r["k"]: r["id"] for r in S.paired_results(calls, results, ["k"], "t", "id", last=True).collect()} == {"a": 2, "b": None}


def test_turns_start_at_zero(spark):
    m = spark.createDataFrame([(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user")], "s long, i long, r string")
    w = Window.partitionBy("s").orderBy("i")
    assert [r["turn"] for r in S.numbered_turns(m, F.col("r") == "user", w).orderBy("i").collect()] == [0, 1, 1, 2]
