import json

from pyspark.sql import functions as F

from tracemill.operators.sequences import session_bounds
from tracemill.sources import classify as V
from tracemill.sources import jsonl, vendors
from tracemill.streaming.ingest import EventTable, SessionTable, ingest

Z = "2026-04-21T10:00:00Z"


def lines(spark, client, *objects):
    return spark.createDataFrame([(client, "f", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(objects)], "client string, source_path string, source_offset long, raw_json string")


def kinds(spark, client, line):
    return [(r["type"], r["event_key"], r["confidence"], r["lossiness"]) for r in V.classified(lines(spark, client, line)).orderBy("seq").collect()]


def test_chat_lines(spark):
    user = {"type": "user", "timestamp": Z, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1"}, {"type": "text", "text": "hi"}]}}
    assert kinds(spark, "claude", user) == [("user_message", None, "high", "none"), ("tool_result", "tool_result:t1", "high", "none")]
    call = {"type": "assistant", "timestamp": Z, "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t2", "name": "Bash"}, {"type": "tool_use", "id": "t3", "name": "apply-patch"}]}}
    assert [x[:2] for x in kinds(spark, "claude", call)] == [("assistant_message", None), ("tool_call", "tool_call:t2"), ("command_start", "command_start:t2"), ("tool_call", "tool_call:t3"), ("patch", "patch:t3")]
    assert kinds(spark, "claude", {"type": "user", "message": {"content": "hello"}}) == [("user_message", None, "high", "none")]
    assert kinds(spark, "claude", {"type": "compaction"}) == [("compaction", None, "high", "compacted")]
    assert kinds(spark, "claude", {"type": "x"}) == [("schema_unknown", None, "low", "none")]
    assert kinds(spark, "claude", "{broken") == [("schema_unknown", None, "low", "unknown")]
    assert kinds(spark, "claude", {"type": "user", "timestamp": "2026-04-21T10:00:00", "message": {"content": "a"}}) == [("user_message", None, "low", "unknown")]


def test_rollout_lines(spark):
    item = lambda **p: {"type": "response_item", "timestamp": Z, "payload": p}
    assert [x[:2] for x in kinds(spark, "codex", item(type="function_call", name="shell", call_id="c"))] == [("tool_call", "tool_call:c"), ("command_start", "command_start:c")]
    assert [x[0] for x in kinds(spark, "codex", item(type="function_call_output", call_id="c", exit_code=0))] == ["tool_result", "command_exit"]
    assert kinds(spark, "codex", item(type="reasoning")) == [("assistant_message", None, "medium", "partial")]
    assert kinds(spark, "codex", {"type": "turn_context"}) == [("schema_unknown", None, "low", "none")]


def test_times(spark):
    frame = spark.createDataFrame([("1776765600000",), (Z,), ("2026-04-21T12:00:00+02:00",), ("2026-04-21T10:00:00",), ("?",), (None,)], "t string")
    time, naive = V.vendor_time(F.col("t"))
    assert [(r[0] is not None and r[0].hour, r[1]) for r in frame.select(time, naive).collect()] == [(10, False), (10, False), (10, False), (False, True), (False, False), (False, False)]


def test_usage(spark):
    chat = {"type": "assistant", "message": {"model": "anthropic/claude-opus-4", "usage": {"input_tokens": 1000000, "output_tokens": 0, "cache_read_input_tokens": 2.0}}}
    none = {"type": "assistant", "message": {"usage": {"service_tier": "x"}}}
    found = V.token_usage(lines(spark, "claude", chat, none), ["source_offset"]).collect()
    assert [(r["family"], r["tier"], r["input"], r["cache_read"], r["cache_write"], round(r["cost_estimate"], 5)) for r in found] == [("claude", "opus", 1000000, 2, None, 15.0)]
    rollout = [{"type": "turn_context", "payload": {"model": "gpt-5-codex"}}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5}}}}]
    assert [(r["model"], r["tier"], r["input"]) for r in V.token_usage(lines(spark, "codex", *rollout), ["source_offset"]).collect()] == [("gpt-5-codex", "5-codex", 5)]


def test_models(spark):
    names = {"o3-mini-2025": ("o", "3-mini"), "o4": ("o", "4"), "gpt-5.1-codex-max": ("gpt", "5.1-codex-max"), "gpt-4o": ("gpt", "4o"), "gemini-2-flash": ("gemini", "flash"), "odd": ("unknown", "odd"), "gpt-9": ("gpt", "gpt-9")}
    frame = spark.createDataFrame([(x,) for x in names], "m string")
    family, tier = V.model_info(F.col("m"))
    assert {r["m"]: (r["f"], r["t"]) for r in frame.select("m", family.alias("f"), tier.alias("t")).collect()} == names


def test_files(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "a.jsonl").write_text('{"session_id": "s", "model": "m", "messages": [{"role": "user"}]}\n\nnot json\n{"session_id": "t"}\n')
    assert [tuple(r)[:2] + (r["project"],) for r in jsonl.read_custom_sessions(spark, str(tmp_path / "proj")).collect()] == [("s", "m", "custom:proj")]
    assert jsonl.valid(jsonl.read_lines(spark, str(tmp_path / "proj"), "claude")).count() == 2
    (tmp_path / "f.json").write_text('{"findings": [{"entity_text": "x", "entity_type": "email", "confidence": 0.5}]}')
    assert jsonl.read_findings(spark, str(tmp_path / "f.json")).count() == 1


def test_chat_log(spark):
    texts = spark.createDataFrame([("/w/p/.aider.chat.history.md", "# aider chat started at 2026-01-01 10:00:00\n#### do it\n>\n> now\nok then\n# a heading\n\nmore\n# aider chat started at 2026-01-02 10:00:00\n> x\n")], "source_path string, raw_json string")
    found = vendors.parse(texts, "aider").orderBy("start_time").collect()
    assert [[(m["role"], m["content"]) for m in r["messages"]] for r in found] == [[("user", "do it\n\nnow"), ("assistant", "ok then\n\nmore")], [("user", "x")]]
    assert [(r["project"], r["start_time"][:19], r["input_tokens"], r["output_tokens"]) for r in found] == [("aider:p", "2026-01-01T10:00:00", 1, 3), ("aider:p", "2026-01-02T10:00:00", 0, 0)]
    assert len({r["session_id"] for r in found}) == 2 and len(found[0]["session_id"]) == 16


def test_stream_is_idempotent_and_takes_late_rows(spark, tmp_path):
    schema = "id long, session_id long, event_at timestamp"
    source = str(tmp_path / "in")
    frame = lambda rows: spark.createDataFrame(rows, "id long, session_id long, t string").select("id", "session_id", F.col("t").cast("timestamp").alias("event_at"))
    store, derived = EventTable(spark, str(tmp_path / "events"), schema, ["id"]), SessionTable(spark, str(tmp_path / "sessions"))
    first = frame([(1, 1, "2026-01-01 10:00:00"), (2, 2, "2026-01-01 11:00:00")])
    first.write.mode("append").parquet(source)
    run = lambda: ingest(spark.readStream.schema(schema).parquet(source), store, derived, session_bounds, str(tmp_path / "check")).awaitTermination()
    run()
    frame([(1, 1, "2026-01-01 10:00:00"), (3, 1, "2020-01-01 00:00:00")]).write.mode("append").parquet(source)
    run()
    assert store.read().count() == 3
    batch = session_bounds(store.read())
    assert sorted(map(tuple, derived.read().select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
