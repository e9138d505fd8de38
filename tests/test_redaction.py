"""Findings and their decisions, replacement, names and paths, files that leave and come back."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import redaction as R
from tracemill.operators import workbench as W
from tracemill.sources import sinks, vendors
from tracemill.streaming.ingest import EventTable, SessionTable, drained, ingest_with_overrides

FINDING = "session_id string, idx int, field string, engine string, rule string, entity_type string, entity string, offset int, length int, confidence double"


def finding(entity, kind="email", session="s", idx=0, confidence=0.9):
    return (session, idx, "content", "pii", "r", kind, entity, 0, len(entity), confidence)


def test_decisions(spark):
    f = spark.createDataFrame([finding("a@b.cc"), finding("bob", "person_name"), finding("bob", "username", idx=1)], FINDING)
    entries = spark.createDataFrame([("any", "bob", None, 1), ("typed", "bob", "username", 5)], "allowlist_id string, t string, entity_type string, added_at long").select("allowlist_id", R.hashed(F.col("t"), "salt").alias("entity_hash"), "entity_type", "added_at")
    stored = R.recorded(f, entries, "salt", "r1")
    state = lambda x: {(r["entity_type"], r["idx"]): (r["status"], r["decided_by"], r["source_id"]) for r in x.collect()}
    assert state(stored) == {("email", 0): ("open", "auto", None), ("person_name", 0): ("ignored", "allowlist", "any"), ("username", 1): ("ignored", "allowlist", "typed")}
    left = entries.filter("allowlist_id = 'any'")
    after = R.entry_removed(stored, entries.filter("allowlist_id = 'typed'"), left)
    assert state(after)[("username", 1)] == ("ignored", "allowlist", "any")
    assert state(R.entry_removed(after, left, left.limit(0)))[("username", 1)] == ("open", "auto", None)
    mine = stored.withColumn("status", F.when(F.col("entity_type") == "email", "accepted").otherwise("open")).withColumn("source_id", F.lit(None).cast("string"))
    assert {k: v[0] for k, v in state(R.entry_added(mine, entries)).items()} == {("email", 0): "accepted", ("person_name", 0): "ignored", ("username", 1): "ignored"}
    assert "entity" not in stored.columns
    assert {r["finding_id"] for r in stored.collect()} == {r["finding_id"] for r in R.recorded(f.repartition(3), entries, "salt", "r1").collect()}


def test_allowed(spark):
    f = spark.createDataFrame([finding("a@b.cc"), finding("bob", "person_name"), finding("x-1", "path")], FINDING)
    assert [r["entity"] for r in R.allowed(f, exact=["bob"], kinds=["path"], patterns=["("]).collect()] == ["a@b.cc"]
    assert R.allowed(f, patterns=["^x-"]).count() == 2


def test_merge_and_apply(spark):
    f = spark.createDataFrame([finding("Ann Lee", "person_name"), finding("ann", "person_name"), finding("ANN LEE", "username", confidence=0.2), finding("lee", idx=1), finding("no", idx=2, confidence=0.1)], FINDING)
    assert sorted(r["entity"] for r in R.merged_findings(f, 0.15).collect()) == ["Ann Lee", "lee"]
    texts = spark.createDataFrame([("s", 0, "content", "ann lee met ANN and annabel; a.b+c (x"), ("t", 0, "content", "ann")], "session_id string, idx int, field string, text string")
    g = spark.createDataFrame([finding("Ann Lee", "person_name"), finding("ann", "username"), finding("a.b+c", "email"), finding("zz", "email")], FINDING)
    out = {r["session_id"]: (r["text"], r["n"]) for r in R.apply_findings(texts, g).collect()}
    assert out == {"s": ("[REDACTED_NAME] met [REDACTED_USERNAME] and annabel; [REDACTED_EMAIL] (x", 3), "t": ("ann", 0)}


def test_names_and_times(spark):
    frame = spark.createDataFrame([("/Users/jane_doe/a.txt", "-Users-jane-doe-x", "2026-03-21T09:15:30.123+05:30")], "p string, h string, t string")
    r = frame.select(R.anonymised_path(F.col("p"), "jane_doe"), R.scrubbed(F.concat(F.lit("proj "), "h"), "jane_doe"), R.to_the_hour(F.col("t")), R.anonymised(F.lit("jane_doe's"), "jane_doe"), R.to_the_hour(F.lit("noon")), R.scrubbed(F.lit("doe-jane work"), "jane_doe")).first()
    assert tuple(r) == ("[REDACTED_PATH]", "proj [REDACTED_PATH]-x", "2026-03-21T09:00:00+05:30", "[REDACTED_USERNAME]'s", "noon", "doe-[REDACTED_USERNAME] work")


def test_previews_and_policies(spark):
    r = spark.range(1).select(R.preview(F.lit("x" * 70 + "SECRET" + "y" * 70), F.lit(70), F.lit(6)).alias("p"), R.preview(F.lit("ab"), F.lit(9), F.lit(1)).alias("q"), R.order_preserving(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"))).alias("o")).first()
    assert (r["p"]["before"], r["p"]["after"], tuple(r["q"]), r["o"]) == ("x" * 60, "y" * 60, ("", ""), ["b", "a"])
    sessions = spark.createDataFrame([("a", "new", 3)], "session_id string, review_status string, ai_quality_score long")
    with pytest.raises(Exception, match="1 to 5"):
        W.reviewed(sessions, spark.createDataFrame([("a", None, 7)], "session_id string, status string, score long")).collect()


def test_share_and_bundle_files(spark, tmp_path):
    sessions = spark.createDataFrame([("a", "p", "m", "x"), ("b", "p", "<synthetic>", "y")], "session_id string, project string, model string, files_touched string")
    manifest = sinks.write_share(sessions, str(tmp_path / "share"), "sh1").first()
    again = sinks.write_share(sessions.repartition(2), str(tmp_path / "share2"), "sh1").first()
    assert manifest["sessions"] == 2 and manifest["digest"] == again["digest"]
    assert "files_touched" not in spark.read.json(str(tmp_path / "share/sessions")).columns
    sinks.write_sessions(sessions, str(tmp_path / "lines"), "jane")
    assert [r["session_id"] for r in spark.read.json(str(tmp_path / "lines")).collect()] == ["a"]
    events = spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "a"), ("k2", 1, None)], "session_key string, ref long, type string")
    made = sinks.bundles(events, events.limit(0), events.limit(0), events.limit(0))
    sinks.write_bundles(made, str(tmp_path / "bundles"))
    read = sinks.read_bundles(spark, str(tmp_path / "bundles"))
    assert [(r["session_key"], r["type"]) for r in sinks.bundle_section(read, "events", "type string").filter("session_key = 'k1'").collect()] == [("k1", "a"), ("k1", "b")]
    assert read.filter("problem is not null").count() == 0
    sinks.write_bundles(made.withColumn("digest", F.lit("x")), str(tmp_path / "bad"))
    assert {r["problem"] for r in sinks.read_bundles(spark, str(tmp_path / "bad")).collect()} == {"digest"}


def test_upsert(spark):
    old = spark.createDataFrame([("a", "m1", "approved", 1.0, "t"), ("b", "m1", None, 2.0, None)], "session_id string, model string, review_status string, estimated_cost_usd double, end_time string")
    new = spark.createDataFrame([("a", "m2", "new", 9.0, "t"), ("b", "m2", "new", 9.0, "t"), ("c", "m3", "new", 3.0, None)], old.schema)
    got = {r["session_id"]: (r["model"], r["review_status"], r["estimated_cost_usd"]) for r in sinks.upserted(old, new, ("review_status",)).collect()}
    assert got == {"a": ("m2", "approved", 1.0), "b": ("m2", "new", 9.0), "c": ("m3", "new", 3.0)}


def test_messages_table(spark, tmp_path):
    s = spark.createDataFrame([(f"s{i}", [i]) for i in range(20)], "session_id string, messages array<int>")
    sinks.write_messages(s, str(tmp_path / "m"), 4)
    found = sinks.read_messages(spark, str(tmp_path / "m"), "s7", 4)
    assert [r["messages"] for r in found.collect()] == [[7]]


def test_vendor_lines(spark):
    lines = [
        {"type": "user", "cwd": "/home/x/app", "sessionId": "S", "gitBranch": "dev", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "[Request interrupted by user]"}},
        {"type": "assistant", "timestamp": 1767225600000, "message": {"model": "m", "content": [{"type": "text", "text": " a "}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 3}}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
        {"type": "assistant", "message": {"content": "plain text isn't a list"}},
        {"type": "assistant", "message": {"content": []}},
    ]
    rows = [("/p/f.jsonl", i, json.dumps(x)) for i, x in enumerate(lines)] + [("/p/f.jsonl", 9, "no json")]
    s = vendors.parse(spark.createDataFrame(rows, "source_path string, line long, raw_json string"), "claude").first()
    assert (s["session_id"], s["project"], s["git_branch"], s["model"], s["user_interrupts"], s["input_tokens"], s["user_messages"], s["assistant_messages"]) == ("S", "claude:app", "dev", "m", 1, 3, 1, 1)
    assert s["end_time"].startswith("2026-01-01T00:00:00")
    call = s["messages"][1]["tools"][0]
    assert (s["messages"][1]["content"], call["output"], call["status"]) == ("a\n\nb", "x\n\ny", "error")


def test_codex_pending_items(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    event = lambda at, **p: {"type": "event_msg", "timestamp": at, "payload": p}
    lines = [{"type": "session_meta", "payload": {"id": "K", "cwd": "/a/b"}}, event("1", type="user_message", message="hi"), item(type="reasoning", summary=[{"text": "think"}]), event("2", type="agent_reasoning", text="think"),
             item(type="custom_tool_call", name="patch", call_id="c", input="diff"), event("3", type="user_message", message="more"), item(type="custom_tool_call_output", call_id="c", output='{"output": "ok"}'), item(type="function_call", name="sh", call_id="d", arguments="{}")]
    rows = [("/p/r.jsonl", i, json.dumps(x)) for i, x in enumerate(lines)]
    s = vendors.parse(spark.createDataFrame(rows, "source_path string, line long, raw_json string"), "codex").first()
    got = [(m["role"], m["content"], m["thinking"], m["at"], [(t["tool"], t["output"]) for t in m["tools"] or []]) for m in s["messages"]]
    assert got[:3] == [("user", "hi", None, got[0][3], []), ("assistant", None, "think", got[1][3], [("patch", "ok")]), ("user", "more", None, got[2][3], [])]
    assert got[3][0] == "assistant" and got[3][4] == [("sh", None)] and (s["session_id"], s["model"], s["project"]) == ("K", "codex-unknown", "codex:b")


def test_subagents_and_sqlite(spark, tmp_path):
    import sqlite3

    lines = [("/p/s1/subagents/agent-1.jsonl", 0, '{"timestamp": "2"}'), ("/p/s1/subagents/agent-2.jsonl", 0, '{"timestamp": "1"}'), ("/p/s2/subagents/agent-1.jsonl", 0, "{}"), ("/p/s2.jsonl", 0, "{}")]
    own = vendors.subagent_lines(spark.createDataFrame(lines, "source_path string, line long, raw_json string")).orderBy("line").collect()
    assert [(r["source_path"], r["raw_json"]) for r in own] == [("/p/s1", '{"timestamp": "1"}'), ("/p/s1", '{"timestamp": "2"}')]
    base = sqlite3.connect(tmp_path / "o.db")
    base.execute("create table session (id, directory, time_created, time_updated)")
    base.execute("create table message (id, session_id, time_created, data)")
    base.execute("create table part (id, message_id, time_created, data)")
    base.execute("insert into session values ('o1', '/w/x', 1767225600000, 1767225600000)")
    base.execute("insert into message values ('m1', 'o1', 1, '{\"role\": \"user\"}'), ('m2', 'o1', 2, ?)", (json.dumps({"role": "assistant", "model": {"providerID": "p", "modelID": "m"}, "tokens": {"input": 1, "output": 2, "cache": {"read": 3, "write": 4}}}),))
    parts = [("p2", "m2", 2, {"type": "tool", "tool": "ls", "state": {"status": "completed", "input": {"a": 1}, "output": "out"}}), ("p1", "m2", 1, {"type": "text", "text": "yes"}), ("p0", "m1", 1, {"type": "text", "text": "do"})]
    base.executemany("insert into part values (?, ?, ?, ?)", [(a, b, c, json.dumps(d)) for a, b, c, d in parts])
    base.commit()
    base.close()
    t = vendors.read_sqlite(spark, str(tmp_path / "o.db"), vendors.OPENCODE_TABLES)
    s = vendors.session_table(*vendors.opencode(t["session"], t["message"], t["part"]), "opencode").first()
    assert (s["session_id"], s["project"], s["model"], s["input_tokens"], s["output_tokens"], [m["content"] for m in s["messages"]], s["messages"][1]["tools"][0]["status"]) == ("o1", "opencode:x", "p/m", 8, 2, ["do", "yes"], "success")


def test_files_by_layout(spark):
    files = spark.createDataFrame([("/h/.claude/projects/-Users-al-Documents-my-app/x.jsonl", 3), ("/h/.claude/projects/-home-bob/y.jsonl", 4), ("/h/.copilot/session-state/abcdefghijklmnop/events.jsonl", 5), ("/h/other.txt", 6)], "path string, size long")
    assert [(r["display_name"], r["size"]) for r in vendors.discover_projects(files).collect()] == [("claude:my-app", 3), ("claude:~home", 4), ("copilot:abcdefghijkl", 5)]
    assert vendors.discover_projects(files, "copilot").count() == 1


def test_two_frontiers_equal_a_batch(spark, tmp_path):
    schema, over = "id long, session_id long", "session_id long, write_seq long, mark string"
    spark.createDataFrame([(1, 1), (2, 2)], schema).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(1, 1, "x"), (9, 2, "y")], over).write.parquet(str(tmp_path / "o"))
    events, overrides = EventTable(spark, str(tmp_path / "et"), schema, ["id"]), EventTable(spark, str(tmp_path / "ot"), over, ["write_seq"])
    derived = SessionTable(spark, str(tmp_path / "d"))
    derive = lambda e, o: e.join(o, "session_id", "left").groupBy("session_id").agg(F.count("id").alias("n"), F.max("mark").alias("mark"))

    def run():
        ingest_with_overrides(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), spark.readStream.schema(over).parquet(str(tmp_path / "o")), events, overrides, derived, derive, str(tmp_path / "c"))

    run()
    spark.createDataFrame([(3, 1), (4, 3)], schema).write.mode("append").parquet(str(tmp_path / "e"))
    run()
    spark.createDataFrame([(2, 3, "z")], over).write.mode("append").parquet(str(tmp_path / "o"))
    run()
    assert sorted(map(tuple, derived.read().select("session_id", "n", "mark").collect())) == [(1, 2, "x"), (2, 1, "z"), (3, 1, None)]


def test_drain_resumes(spark, tmp_path):
    flagged = spark.createDataFrame([(i,) for i in range(5)], "session_id long")
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows.withColumn("done", F.lit(True))

    path = str(tmp_path / "done")
    drained(flagged.filter("session_id < 2"), work, path)
    assert drained(flagged, work, path).count() == 5 and seen == [2, 3]
