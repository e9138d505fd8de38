"""Sessions parsed from vendors' lines, what their messages say, and what of them may leave.

conversations stand for logs: each query writes its rows as a vendor's JSON lines, column by
column, and reads these with the vendor's parser, so that its SQL can start from the table.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import curation as K
from ..operators import redaction as R
from ..operators import segments as G
from ..operators import sequences as S
from ..operators import transcripts as M
from ..operators import workbench as W
from ..operators.search import search_sessions, write_index
from ..session import exists, shared_folder
from ..sources import sinks, vendors
from ..sources.fixtures import EVENTS_SQL, events, table
from ..streaming.ingest import closed_when_idle, touched_sessions

NOW = "2024-01-30 12:00:00"


def _chats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    path = F.concat(F.lit("/logs/conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    return c.select(path.alias("source_path"), F.col("turn").alias("line"), "conv_id", "turn", "role", "text", _at().alias("at"))


def _at() -> Column:
    return F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("conv_id") % 20).cast("int"), mins=(F.col("turn") * F.col("turn") * 7).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")


def _obj(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _lit(s: str) -> Column:
    return F.lit(s)


def _lines(rows: DataFrame, json: Column) -> DataFrame:
    return rows.select("source_path", "line", F.to_json(json).alias("raw_json"))


def claude_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line for each message; assistants also run a command, whose result is the next line, given twice with the last one counting."""
    c = _chats(spark, d).filter("role <> 'system'").withColumn("line", F.col("line") * 3)
    call = F.concat(F.lit("t"), F.col("turn").cast("string"))
    user = _lines(c.filter("role = 'user'"), _obj(type=_lit("user"), timestamp=F.col("at"), cwd=_lit("/home/x/proj"), gitBranch=_lit("main"), sessionId=F.concat(F.lit("c"), F.col("conv_id").cast("string")), message=_obj(role=_lit("user"), content=F.col("text"))))
    blocks = F.array(F.to_json(_obj(type=_lit("text"), text=F.col("text"))), F.to_json(_obj(type=_lit("thinking"), thinking=_lit("hm"))), F.to_json(_obj(type=_lit("tool_use"), id=call, name=_lit("Bash"), input=_obj(command=F.concat(F.lit("run "), F.col("turn").cast("string"))))))
    agent = c.filter("role = 'assistant'")
    head = F.to_json(_obj(type=_lit("assistant"), timestamp=F.col("at")))
    usage = F.to_json(_obj(input_tokens=F.length("text"), output_tokens=F.lit(7), cache_read_input_tokens=F.col("turn")))
    body = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("h")), F.lit(',"message":{"model":"m1","usage":'), F.col("u"), F.lit(',"content":['), F.array_join("b", ","), F.lit("]}}"))
    agent_lines = agent.withColumn("h", head).withColumn("u", usage).withColumn("b", blocks).select("source_path", "line", body.alias("raw_json"))
    result = lambda text, error: _obj(type=_lit("user"), message=_obj(content=F.array(_obj(type=_lit("tool_result"), tool_use_id=call, is_error=F.lit(error), content=text))))
    first = _lines(agent.withColumn("line", F.col("line") + 1), result(_lit("early"), True))
    last = _lines(agent.withColumn("line", F.col("line") + 2), result(F.when(F.col("turn") % 4 == 1, "3 passed").otherwise("1 failed"), False))
    return user.union(agent_lines).union(first).union(last)


def _claude(spark: SparkSession, d: str) -> DataFrame:
    """The parsed sessions of d's conversations; a context's first query of them writes them, later ones read them."""
    path = f"{shared_folder(spark)}/tracemill/parsed-{hashlib.md5(d.encode()).hexdigest()}-{spark.sparkContext.applicationId}"
    if not exists(spark, f"{path}/_SUCCESS"):
        vendors.parse(claude_lines(spark, d), "claude").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """session_id, idx and what else messages have, of the parsed sessions."""
    s = _claude(spark, d).select("session_id", F.posexplode("messages").alias("idx", "m"))
    return s.select("session_id", "idx", "m.role", "m.content", "m.thinking", "m.at", "m.tools", "m.compaction")


def _facts(s: DataFrame, *more: Column) -> DataFrame:
    return s.select("session_id", "project", "model", "start_time", "end_time", "user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens", *more)


def parse_claude(spark: SparkSession, d: str) -> DataFrame:
    s = vendors.parse(claude_lines(spark, d), "claude")
    done = F.aggregate(F.flatten(F.transform("messages", lambda m: F.coalesce(m["tools"], F.array().cast(vendors.TOOLS)))), F.lit(0), lambda n, t: n + F.when((t["output"] == "3 passed") & (t["status"] == "success"), 1).otherwise(0))
    return _facts(s, done.alias("passed"), F.col("git_branch"), F.col("cache_read_tokens"))


def parse_codex(spark: SparkSession, d: str) -> DataFrame:
    """Thoughts and a call before every reply; totals that grow."""
    c = _chats(spark, d).filter("role <> 'system'").withColumn("line", F.col("line") * 5 + 10)
    event = lambda rows, shift, **p: _lines(rows.withColumn("line", F.col("line") + shift), _obj(type=_lit("event_msg"), timestamp=F.col("at"), payload=_obj(**p)))
    item = lambda rows, shift, **p: _lines(rows.withColumn("line", F.col("line") + shift), _obj(type=_lit("response_item"), timestamp=F.col("at"), payload=_obj(**p)))
    agent, call = c.filter("role = 'assistant'"), F.concat(F.lit("x"), F.col("turn").cast("string"))
    heads = c.select("source_path", "conv_id").distinct().withColumn("line", F.lit(0).cast("long"))
    meta = _lines(heads, _obj(type=_lit("session_meta"), payload=_obj(id=F.concat(F.lit("k"), F.col("conv_id").cast("string")), cwd=_lit("/home/x/api"), model_provider=_lit("lab"))))
    total = _obj(total_token_usage=_obj(input_tokens=F.col("turn") * 100, cached_input_tokens=F.col("turn") * 30, output_tokens=F.col("turn") * 10))
    lines = meta.union(event(c.filter("role = 'user'"), 4, type=_lit("user_message"), message=F.col("text"))).union(event(agent, 0, type=_lit("agent_reasoning"), text=_lit("think")))
    lines = lines.union(item(agent, 1, type=_lit("function_call"), name=_lit("shell"), call_id=call, arguments=_lit('{"command":"ls"}'))).union(item(agent, 2, type=_lit("function_call_output"), call_id=call, output=_lit("Exit code: 0\nWall time: 1\nOutput:\nfine\n")))
    lines = lines.union(event(agent, 3, type=_lit("token_count"), info=total)).union(event(agent, 4, type=_lit("agent_message"), message=F.col("text")))
    s = vendors.parse(lines, "codex")
    fine = F.size(F.filter("messages", lambda m: (m["role"] == "assistant") & (m["thinking"] == "think") & (m["tools"][0]["output"] == "fine")))
    return _facts(s, F.col("cache_read_tokens"), fine.alias("fine"))


def parse_openclaw(spark: SparkSession, d: str) -> DataFrame:
    """System rows are compactions; a header, a change of model, replies with usage."""
    c = _chats(spark, d).withColumn("line", F.col("line") + 10)
    heads = c.select("source_path", "conv_id").distinct()
    head = _lines(heads.withColumn("line", F.lit(0).cast("long")), _obj(type=_lit("session"), id=F.concat(F.lit("o"), F.col("conv_id").cast("string")), timestamp=_lit("2024-01-01T00:00:00"), cwd=_lit("/w/claw")))
    change = _lines(heads.withColumn("line", F.lit(1).cast("long")), _obj(type=_lit("model_change"), provider=_lit("p"), modelId=_lit("m")))
    user = _lines(c.filter("role = 'user'"), _obj(type=_lit("message"), timestamp=F.col("at"), message=_obj(role=_lit("user"), content=F.array(_obj(type=_lit("text"), text=F.col("text"))))))
    agent = _lines(c.filter("role = 'assistant'"), _obj(type=_lit("message"), timestamp=F.col("at"), message=_obj(role=_lit("assistant"), content=F.array(_obj(type=_lit("text"), text=F.col("text"))), usage=_obj(input=F.lit(5), cacheRead=F.lit(2), output=F.lit(3)))))
    pack = _lines(c.filter("role = 'system'"), _obj(type=_lit("compaction"), timestamp=F.col("at"), summary=_lit("short")))
    s = vendors.parse(head.union(change).union(user).union(agent).union(pack), "openclaw")
    return _facts(s, F.size(F.filter("messages", lambda m: m["compaction"])).alias("compactions"))


def parse_others(spark: SparkSession, d: str) -> DataFrame:
    """Gemini, Kimi, Cursor and Copilot logs of the same conversations, in one table."""
    c = _chats(spark, d).filter("role <> 'system'")
    user = F.col("role") == "user"
    one = lambda **f: F.to_json(_obj(**f))
    part = F.when(user, one(type=_lit("user"), timestamp=F.col("at"), content=F.col("text"))).otherwise(one(type=_lit("gemini"), timestamp=F.col("at"), content=F.col("text"), model=_lit("g"), tokens=_obj(input=F.lit(4), cached=F.lit(2), output=F.lit(1)), toolCalls=F.array(_obj(name=_lit("ls"), args=_obj(path=_lit("/a")), status=_lit("success")))))
    whole = c.groupBy("source_path", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", part.alias("p")))), lambda x: x["p"]), ",").alias("parts"))
    files = whole.select("source_path", F.concat(F.lit('{"sessionId":"g'), F.col("conv_id").cast("string"), F.lit('","startTime":"2024-01-01T00:00:00","messages":['), "parts", F.lit("]}")).alias("raw_json"))
    folder = F.concat(F.lit("/kimi/q"), F.col("conv_id").cast("string"), F.lit("/context.jsonl"))
    k = c.withColumn("source_path", folder)
    kimi = _lines(k.filter(user), _obj(role=_lit("user"), content=F.col("text"))).union(_lines(k.filter(~user), _obj(role=_lit("assistant"), content=F.array(_obj(type=_lit("text"), text=F.col("text"))), tool_calls=F.array(_obj(function=_obj(name=_lit("f"), arguments=_lit("{}")))))))
    kimi = kimi.union(_lines(k.withColumn("line", F.col("line") + 1000), _obj(role=_lit("_usage"), token_count=F.col("turn") * 9)))
    cursor = _lines(c.filter(user), _obj(type=_lit("user"), timestamp=F.col("at"), message=_obj(content=F.col("text")))).union(_lines(c.filter(~user), _obj(type=_lit("assistant"), timestamp=F.col("at"), message=_obj(content=F.col("text"), model=_lit("cm")), usage=_obj(input_tokens=F.lit(11), output_tokens=F.lit(6)))))
    e = c.withColumn("source_path", F.concat(F.lit("/copilot/p"), F.col("conv_id").cast("string"), F.lit("/events.jsonl"))).withColumn("line", F.col("line") * 3)
    event = lambda rows, shift, kind, **data: _lines(rows.withColumn("line", F.col("line") + shift), _obj(type=_lit(kind), timestamp=F.col("at"), data=_obj(**data)))
    copilot = event(e.filter(user), 0, "userPromptSubmitted", prompt=F.col("text")).union(event(e.filter(~user), 0, "assistantResponse", content=F.col("text"), model=_lit("pm"))).union(event(e.filter(~user), 1, "preToolUse", toolName=_lit("sh"), input=_lit("ls"))).union(event(e.filter(~user), 2, "postToolUse", output=_lit("ok")))
    s = vendors.parse_all({"gemini": files, "kimi": kimi, "cursor": cursor, "copilot": copilot})
    done = F.aggregate(F.flatten(F.transform("messages", lambda m: F.coalesce(m["tools"], F.array().cast(vendors.TOOLS)))), F.lit(0), lambda n, t: n + F.when(t["status"] == "success", 1).otherwise(0))
    return s.select("source", "session_id", "model", "user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens", done.alias("done"))


def local_agents(spark: SparkSession, d: str) -> DataFrame:
    s = _claude(spark, d)
    num = F.substring("session_id", 2, 20).cast("long")
    wrappers = s.select("session_id", F.concat(F.lit("outer-"), "session_id").alias("outer_session_id"), F.lit("w").alias("model"))
    out = vendors.with_local_agents(s.filter(num % 3 != 0), s.filter(num % 2 == 0), wrappers)
    return out.select("session_id", "client_origin", "runtime_channel", "outer_session_id")


def discover_projects(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    path = F.when(F.col("client") == "claude", F.concat(F.lit("/home/u/.claude/projects/-home-u-app"), (F.col("session_id") % 5).cast("string"), F.lit("/s"), F.col("session_id").cast("string"), F.lit(".jsonl")))
    path = path.when(F.col("client") == "openclaw", F.concat(F.lit("/home/u/.openclaw/agents/a"), (F.col("session_id") % 3).cast("string"), F.lit("/sessions/"), F.col("session_id").cast("string"), F.lit(".jsonl"))).otherwise("/elsewhere/x.txt")
    return vendors.discover_projects(e.groupBy(path.alias("path")).agg(F.sum("k").alias("size")))


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d).groupBy(F.concat(F.lit("/home/u/.claude/projects/p/s"), (F.col("session_id") % 40).cast("string"), F.when(F.col("session_id") % 3 == 0, "/subagents/agent-1").otherwise(""), F.lit(".jsonl")).alias("path")).agg(F.sum("k").alias("size"), F.max("id").alias("modified"))
    known = f.filter("modified % 4 <> 0").withColumn("size", F.when(F.col("modified") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return vendors.families(f, vendors.changed_files(f, known)).select("path", "source", "project")


def outcome_badges(spark: SparkSession, d: str) -> DataFrame:
    return M.outcome_badges(_messages(spark, d))


def session_value_badges(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    v = M.value_badges(m, m.select("session_id").distinct().withColumn("tokens", F.lit(1)))
    return v.select("session_id", F.array_join("value_badges", ",").alias("value_badges"))


def session_risk_badges(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("content", F.when(F.col("idx") % 5 == 0, F.concat("content", F.lit(" see http://box.local and Ada Lovelace"))).otherwise(F.col("content")))
    secrets = m.groupBy("session_id").agg(F.sum(F.when(F.contains("content", F.lit("AKIA")), 1).otherwise(0)).alias("secrets"))
    return M.risk_badges(m, secrets).select("session_id", F.array_join("risk_badges", ",").alias("risk_badges"), F.round("sensitivity", 6).alias("sensitivity"))


def session_task_types(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    num = F.substring("session_id", 2, 20).cast("long")
    word = F.when(num % 4 == 0, "fix the bug in it").when(num % 4 == 1, "add a test case and build").otherwise("nothing")
    return M.task_types(m.withColumn("content", F.concat(word, F.lit(" "), F.col("idx").cast("string"))))


def display_titles(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    num = F.substring("session_id", 2, 20).cast("long")
    said = F.when(num % 3 == 0, "init").when(num % 3 == 1, F.concat(F.lit("Please <b>look</b> at "), F.col("idx").cast("string"), F.lit("\nmore"))).otherwise("a task of words that goes on and on and on until it is far too long to be shown whole")
    return M.display_titles(m.withColumn("content", said), _claude(spark, d))


def tool_digest(spark: SparkSession, d: str) -> DataFrame:
    t = M.tool_digest(_messages(spark, d))
    return t.select("session_id", F.size("files_touched").alias("files"), F.array_join("commands_run", ";").alias("commands"), F.col("tool_counts")["Bash"].alias("bash"))


def flattened(spark: SparkSession, d: str) -> DataFrame:
    return M.flattened(_messages(spark, d)).select("session_id", F.md5("transcript").alias("md5"))


def session_search(spark: SparkSession, d: str) -> DataFrame:
    f = M.flattened(_messages(spark, d))
    index = write_index(f, "session_id", "transcript", f"{shared_folder(spark)}/tracemill/sessions-{uuid.uuid4().hex}", extra="")
    return search_sessions(index, _claude(spark, d).select("session_id", "project"), "run, 1 passed!", 30, 5).select("session_id", "project", F.round("score", 9).alias("score"))


def late_error_scan(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    odd = F.transform("tools", lambda t: t.withField("output", F.when(F.col("idx") % 3 == 1, F.lit("Error: no")).otherwise(t["output"])))
    return M.late_errors(m.withColumn("tools", odd)).select("session_id", F.col("idx").cast("long").alias("idx"))


def judge_validation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    json = F.to_json(_obj(substance=F.col("k") % 8, resolution=F.element_at(F.array(*map(F.lit, ("Resolved", "tests-passed", "odd", "abandoned"))), (F.col("k") % 4 + 1).cast("int")), effort_estimate=F.col("k") % 5 / F.lit(2.0), task_type=F.lit("Bug Fix"), session_tags=F.array(F.lit("A b"), F.lit(" "))))
    return M.judged(c.withColumn("json", json)).select("k", "substance", "resolution", "effort", "task_type", F.array_join("tags", ",").alias("tags"))


def judge_steps(spark: SparkSession, d: str) -> DataFrame:
    return M.judge_steps(_messages(spark, d)).select("session_id", F.col("segment").cast("long").alias("segment"), F.col("step").cast("long").alias("step"), "tool", "input", "output", F.md5("plan").alias("plan"), "reflect")


def workflow(spark: SparkSession, d: str) -> DataFrame:
    return M.workflow_lines(M.workflow_steps(_messages(spark, d), "full"))


def training(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    last = F.max("idx").over(Window.partitionBy("session_id"))
    t = M.training_rows(m.withColumn("last", last).withColumn("content", F.when((F.col("idx") == F.col("last")) & (F.col("role") == "assistant"), F.concat(F.lit("[[reply_to_current]] "), "content")).otherwise(F.col("content"))))
    return t.select("turn_id", F.md5("input").alias("input"), F.size(F.from_json("output", "array<struct<type:string>>")).alias("n"))


def segment_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    cut = m.filter("role = 'user' and idx > 0 and idx % 4 = 0").select("session_id", "idx", F.lit("time_gap").alias("reason"))
    s = M.segment_table(G.split(m, cut, "session_id", "idx"), cut)
    return s.select("segment_id", F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"), "start_time", "user_messages", "assistant_messages", "tool_uses", "reason")


def compactions(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("compaction", F.col("idx") % 3 == 1)
    return M.compaction_boundaries(m).select("session_id", F.col("idx").cast("long").alias("idx"))


def workspace_switches(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    to = F.concat(F.lit('{"command":"cd /w/team/p'), F.floor(F.col("idx") / 4).cast("string"), F.lit('/src && ls"}'))
    m = m.withColumn("tools", F.transform("tools", lambda t: t.withField("tool", F.lit("bash")).withField("input", to)))
    return M.workspace_switches(m).select("session_id", F.col("idx").cast("long").alias("idx"))


def text_locations(spark: SparkSession, d: str) -> DataFrame:
    return R.text_locations(_messages(spark, d)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses of documents as findings of two engines."""
    e = K.emails_of(table(spark, d, "documents"), "doc_id", "text")
    row = lambda engine, kind, sure: e.select(F.col("doc_id").cast("string").alias("session_id"), (F.col("doc_id") % 3).cast("int").alias("idx"), F.lit("content").alias("field"), F.lit(engine).alias("engine"), F.lit("email").alias("rule"), F.lit(kind).alias("entity_type"), "entity", F.length("entity").alias("offset"), F.length("entity").alias("length"), F.lit(sure).alias("confidence"))
    return R.union_engines(row("pii", "email", 0.9), row("secrets", "custom_sensitive", 0.5).filter("length(entity) % 2 = 0"))


def _allowlist(f: DataFrame) -> DataFrame:
    one = f.select("entity").distinct()
    any_type = one.filter("length(entity) % 3 = 0").select(F.concat(F.lit("any-"), "entity").alias("allowlist_id"), R.hashed(F.col("entity"), "s").alias("entity_hash"), F.lit(None).cast("string").alias("entity_type"), F.lit(1).alias("added_at"))
    typed = one.filter("length(entity) % 5 = 0").select(F.concat(F.lit("mail-"), "entity").alias("allowlist_id"), R.hashed(F.col("entity"), "s").alias("entity_hash"), F.lit("email").alias("entity_type"), F.lit(2).alias("added_at"))
    return any_type.union(typed)


def findings_recorded(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return R.recorded(f, _allowlist(f), "s", "r1").select("finding_id", "entity_hash", "status", "decided_by", "source_id")


def allowlist_removed(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    a = _allowlist(f)
    out = R.entry_removed(R.recorded(f, a, "s", "r1"), a.filter("allowlist_id like 'mail-%'"), a.filter("allowlist_id like 'any-%'"))
    return out.groupBy("engine", "status", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def allowlist_added(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    a = _allowlist(f)
    out = R.entry_added(R.recorded(f, a.limit(0), "s", "r1"), a.filter("allowlist_id like 'mail-%'"))
    return out.groupBy("engine", "status", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def findings_merged(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    part = f.withColumn("entity", F.substring_index("entity", "@", 1)).withColumn("confidence", F.lit(0.4))
    return R.merged_findings(f.union(part)).select("session_id", "entity", "confidence")


def findings_applied(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.lit(0).alias("idx"), F.lit("content").alias("field"), F.coalesce("text", F.lit("")).alias("text"))
    return R.apply_findings(docs, _findings(spark, d)).select("session_id", (F.col("n") > 0).alias("changed"), F.contains("text", F.lit("@example.")).alias("left"))


def findings_ordered(spark: SparkSession, d: str) -> DataFrame:
    return R.ordered_findings(R.recorded(_findings(spark, d), _allowlist(_findings(spark, d)).limit(0), "s", "r1")).limit(40).select("session_id", "confidence", "idx", "offset")


def decision_map(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return R.decision_map(R.recorded(f, _allowlist(f), "s", "r1")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def redaction_counters(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return R.redaction_counts(R.recorded(f, _allowlist(f), "s", "r1"))


def findings_rescan(spark: SparkSession, d: str) -> DataFrame:
    c = _chats(spark, d).select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("idx"), F.lit("content").alias("field"), "text")
    now = R.revisions(c, "e1")
    old = R.revisions(c.filter("not (session_id % 5 = 0 and idx = 1)"), "e1").withColumnRenamed("revision", "findings_revision")
    s = old.withColumn("end_time", F.when(F.col("session_id") % 2 == 0, F.lit("2024-01-30 11:59:30")).otherwise("2024-01-30 11:00:00").cast("timestamp_ntz"))
    return R.to_rescan(s, now, F.lit(NOW).cast("timestamp_ntz")).select("session_id")


def anonymised_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("see /home/jane_doe/x"), F.col("c_custkey").cast("string"), F.lit(" or -home-jane-doe-app of jane_doe, Bob and /opt/y")).alias("t"))
    return c.select("c_custkey", R.anonymised(F.col("t"), "jane_doe", ("bob",)).alias("text"), R.scrubbed(F.lit("jane-doe-work"), "jane_doe").alias("project"))


def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/home/jane/f"), (F.col("c_custkey") % 9).cast("string"))).otherwise("/srv/x")
    return R.path_tokens(c.select(F.concat(F.lit("k"), (F.col("c_custkey") % 4).cast("string")).alias("session_key"), path.alias("path")), "jane")


def scrubbed_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = _claude(spark, d).withColumn("project", F.concat(F.lit("claude:jane-"), "session_id")).withColumn("git_branch", F.lit("jane/ACME-1"))
    return R.scrubbed_sessions(s, "jane", ("acme",)).select("session_id", "project", "git_branch", "start_time")


def share_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.lit(0).alias("idx"), F.lit("content").alias("field"), F.coalesce("text", F.lit("")).alias("text"))
    f = _findings(spark, d)
    out = R.share_redacted(docs, f.withColumn("status", F.when(F.length("entity") % 3 == 0, "ignored").otherwise("open")), "jane", ("license",), ("example.org",))
    return out.select("session_id", F.contains(F.lower("text"), F.lit("license")).alias("has_license"))


def replay_bundles(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    ev = e.select("session_key", F.col("id").alias("ref"), "type", "k")
    use = e.filter("type = 'purchase'").select("session_key", F.col("id").alias("ref"), F.col("k").alias("input"))
    odd = e.filter("k > 97").select("session_key", F.col("id").alias("ref"), F.lit("input_spike").alias("kind"))
    return sinks.bundles(ev, use, odd, odd).select("session_key", F.get_json_object("body", "$.events[0].type").alias("first"), F.size(F.from_json(F.get_json_object("body", "$.events"), "array<struct<k:long>>")).alias("events"), F.size(F.from_json(F.get_json_object("body", "$.token_usage"), "array<struct<input:long>>")).alias("usage"))


def idle_closing(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("session_id").agg(F.max("event_at").alias("last_seen"), F.max(F.col("k") == 99).alias("closed")).withColumn("status", F.lit("active"))
    return closed_when_idle(s, F.lit(NOW).cast("timestamp_ntz")).select("session_id", "status")


def touched(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return touched_sessions(e, e.withColumn("write_seq", F.col("k")), 9900, 98)


def write_sequences(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("session_id", "event_key", F.when(F.col("k") % 5 != 0, F.col("event_at")).alias("created_at"), "id")
    return S.numbered_after(e, ["created_at", "session_id", "event_key", "id"], 100).select("id", "write_seq")


def hook_order(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("mark", F.col("id")).withColumn("position", F.row_number().over(S.ordered()))
    e = e.withColumn("type", F.when(F.col("k") % 10 == 0, "tool_call").otherwise(F.col("type"))).withColumn("id", F.when(F.col("k") % 10 != 0, F.col("id")))
    return S.with_hooks_in_place(e).select("mark", F.col("place").cast("long").alias("place"))


def timeline_order(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("mark", F.col("id")).withColumn("id", F.when(F.col("k") % 7 != 0, F.col("id"))).withColumn("event_at", F.when(F.col("k") % 11 != 0, F.col("event_at")))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*S.chronological())).cast("long")).select("mark", "place")


def call_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("tool", F.when(F.col("type") == "click", "Bash").otherwise("Read"))
    kind = F.when(F.col("k") % 2 == 0, "command_start").otherwise("tool_call")
    e = e.withColumn("type", kind).withColumn("input", F.format_string('{"z":1,"command":"c%d"}', F.col("k") % 3)).withColumn("outcome", F.when(F.col("k") % 5 != 0, F.lit("")))
    return S.fingerprints(e, ("bash", "shell")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).select((F.col("fingerprint").isNull()).alias("none"), F.split("fingerprint", r"\|")[0].alias("kind"), F.split("fingerprint", r"\|")[3].alias("outcome"), "n")


def cumulative_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.greatest_counts(events(spark, d).withColumn("cached", F.col("k") % 40).withColumn("out", F.col("k") * 2), "session_id", "k", "cached", "out")


QUERIES = {
    f.__name__: f
    for f in (
        parse_claude, parse_codex, parse_openclaw, parse_others, local_agents, discover_projects, file_changes, outcome_badges, session_value_badges, session_risk_badges, session_task_types, display_titles, tool_digest, flattened, session_search,
        late_error_scan, judge_validation, judge_steps, workflow, training, segment_metadata, compactions, workspace_switches, text_locations, findings_recorded, allowlist_removed, allowlist_added, findings_merged, findings_applied, findings_ordered,
        decision_map, redaction_counters, findings_rescan, anonymised_texts, path_tokens, scrubbed_metadata, share_redacted, replay_bundles, idle_closing, touched, write_sequences, hook_order, timeline_order, call_fingerprints, cumulative_tokens,
    )
}

_AT = "strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 20 AS INT)) + to_minutes(CAST(turn * turn * 7 AS INT)), '%Y-%m-%dT%H:%M:%S')"
_C = f"cv AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role, text, {_AT} AS stamp FROM conversations), ch AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM cv WHERE role <> 'system' AND (role = 'assistant' OR trim(text) <> ''))"
_COUNTS = "CAST(count(*) FILTER (role = 'user') AS BIGINT) AS user_messages, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS assistant_messages"
_BASH = "role = 'assistant'"
_MAIL = rf"em AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{K.EMAIL}')) AS entity FROM documents), fd AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, doc_id % 3 AS idx, 'pii' AS engine, 'email' AS entity_type, entity, length(entity) AS len, .9 AS confidence FROM em UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id % 3, 'secrets', 'custom_sensitive', entity, length(entity), .5 FROM em WHERE length(entity) % 2 = 0)"
_ID = "substr(sha256(session_id || '|r1|' || engine || '|email|content|' || idx || '|' || len || '|' || len), 1, 32)"
_RECORDED = f"rc AS (SELECT *, {_ID} AS finding_id, CASE WHEN entity_type = 'email' AND len % 5 = 0 THEN 'mail-' || entity WHEN len % 3 = 0 THEN 'any-' || entity END AS source_id FROM fd)"

SQL = {
    "parse_claude": f"WITH {_C} SELECT 'c' || conv_id AS session_id, 'claude:proj' AS project, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'm1' END AS model, min(stamp) AS start_time, max(stamp) AS end_time, {_COUNTS}, CAST(count(*) FILTER ({_BASH}) AS BIGINT) AS tool_uses, CAST(sum(CASE WHEN {_BASH} THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(7 * count(*) FILTER ({_BASH}) AS BIGINT) AS output_tokens, CAST(count(*) FILTER ({_BASH} AND turn % 4 = 1) AS INT) AS passed, 'main' AS git_branch, CAST(sum(CASE WHEN {_BASH} THEN turn ELSE 0 END) AS BIGINT) AS cache_read_tokens FROM ch GROUP BY conv_id",
    "parse_codex": f"WITH {_C} SELECT 'k' || conv_id AS session_id, 'codex:api' AS project, 'lab-codex' AS model, min(stamp) AS start_time, max(stamp) AS end_time, {_COUNTS}, CAST(count(*) FILTER ({_BASH}) AS BIGINT) AS tool_uses, coalesce(70 * max(turn) FILTER ({_BASH}), 0) AS input_tokens, coalesce(10 * max(turn) FILTER ({_BASH}), 0) AS output_tokens, coalesce(30 * max(turn) FILTER ({_BASH}), 0) AS cache_read_tokens, CAST(count(*) FILTER ({_BASH}) AS INT) AS fine FROM ch GROUP BY conv_id",
    "parse_openclaw": f"WITH {_C} SELECT 'o' || conv_id AS session_id, 'openclaw:claw' AS project, 'p/m' AS model, '2024-01-01T00:00:00' AS start_time, max(stamp) AS end_time, {_COUNTS}, CAST(0 AS BIGINT) AS tool_uses, CAST(7 * count(*) FILTER ({_BASH}) AS BIGINT) AS input_tokens, CAST(3 * count(*) FILTER ({_BASH}) AS BIGINT) AS output_tokens, CAST(count(*) FILTER (role = 'system') AS INT) AS compactions FROM cv GROUP BY conv_id",
    "parse_others": f"""WITH {_C}, g AS (SELECT conv_id, {_COUNTS}, max(turn) AS last FROM ch GROUP BY 1) SELECT 'gemini' AS source, 'g' || conv_id AS session_id, CASE WHEN assistant_messages > 0 THEN 'g' END AS model, user_messages, assistant_messages, assistant_messages AS tool_uses, 6 * assistant_messages AS input_tokens, assistant_messages AS output_tokens, CAST(assistant_messages AS INT) AS done FROM g
        UNION ALL SELECT 'kimi', 'q' || conv_id, NULL, user_messages, assistant_messages, assistant_messages, 0, 9 * last, 0 FROM g
        UNION ALL SELECT 'cursor', 'conv-' || conv_id, CASE WHEN assistant_messages > 0 THEN 'cm' END, user_messages, assistant_messages, 0, 11 * assistant_messages, 6 * assistant_messages, 0 FROM g
        UNION ALL SELECT 'copilot', 'p' || conv_id, CASE WHEN assistant_messages > 0 THEN 'pm' END, user_messages, 2 * assistant_messages, assistant_messages, 0, 0, CAST(assistant_messages AS INT) FROM g""",
    "local_agents": f"WITH {_C}, g AS (SELECT DISTINCT conv_id FROM ch) SELECT 'c' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'desktop' END AS client_origin, CASE WHEN conv_id % 3 = 0 THEN 'local-agent' END AS runtime_channel, CASE WHEN conv_id % 3 = 0 THEN 'outer-c' || conv_id END AS outer_session_id FROM g WHERE conv_id % 3 <> 0 OR conv_id % 2 = 0",
    "discover_projects": f"WITH {EVENTS_SQL}, f AS (SELECT client, session_id, sum(k) AS size FROM ev WHERE client <> 'codex' GROUP BY 1, 2) SELECT CASE WHEN client = 'claude' THEN 'claude:app' || (session_id % 5) ELSE 'openclaw:a' || (session_id % 3) END AS display_name, client AS source, CASE WHEN client = 'claude' THEN '-home-u-app' || (session_id % 5) ELSE 'a' || (session_id % 3) END AS project, count(*) AS sessions, CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY 1, 2, 3",
    "file_changes": f"WITH {EVENTS_SQL}, f AS (SELECT session_id % 40 AS s, session_id % 3 = 0 AS sub, sum(k) AS size, max(id) AS m FROM ev GROUP BY 1, 2), c AS (SELECT DISTINCT s FROM f WHERE m % 4 = 0 OR m % 5 = 0) SELECT '/home/u/.claude/projects/p/s' || s || CASE WHEN sub THEN '/subagents/agent-1' ELSE '' END || '.jsonl' AS path, CASE WHEN NOT sub THEN 'claude' END AS source, CASE WHEN NOT sub THEN 'p' END AS project FROM f JOIN c USING (s)",
    "outcome_badges": f"WITH {_C} SELECT 'c' || conv_id AS session_id, CASE WHEN count(*) FILTER ({_BASH}) = 0 THEN 'analysis_only' WHEN count(*) FILTER ({_BASH} AND turn % 4 <> 1) > 0 THEN 'tests_failed' ELSE 'tests_passed' END AS outcome_badge FROM ch GROUP BY conv_id",
    "session_task_types": f"WITH {_C} SELECT 'c' || conv_id AS session_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'trivial' WHEN conv_id % 4 = 0 THEN 'debugging' WHEN conv_id % 4 = 1 THEN 'feature' ELSE 'unknown' END AS task_type FROM ch GROUP BY conv_id",
    "display_titles": f"WITH {_C} SELECT 'c' || conv_id AS session_id, CASE WHEN min(idx) FILTER (role = 'user') IS NULL OR conv_id % 3 = 0 THEN 'claude:proj' WHEN conv_id % 3 = 1 THEN 'Look at ' || min(idx) FILTER (role = 'user') ELSE 'a task of words that goes on and on and on until it is far too long to be...' END AS display_title FROM ch GROUP BY conv_id",
    "tool_digest": f"WITH {_C} SELECT 'c' || conv_id AS session_id, 0 AS files, coalesce(string_agg('run ' || turn, ';' ORDER BY turn) FILTER ({_BASH}), '') AS commands, nullif(count(*) FILTER ({_BASH}), 0) AS bash FROM ch GROUP BY conv_id",
    "flattened": f"WITH {_C}, p AS (SELECT conv_id, idx, 0 AS r, text AS t FROM ch WHERE text <> '' UNION ALL SELECT conv_id, idx, 1, 'run ' || turn FROM ch WHERE {_BASH} UNION ALL SELECT conv_id, idx, 2, CASE WHEN turn % 4 = 1 THEN '3 passed' ELSE '1 failed' END FROM ch WHERE {_BASH}) SELECT 'c' || conv_id AS session_id, md5(string_agg(t, chr(10) ORDER BY idx, r)) AS md5 FROM p GROUP BY 1",
    "late_error_scan": f"WITH {_C} SELECT 'c' || conv_id AS session_id, idx FROM ch WHERE {_BASH} AND idx % 3 = 1 AND idx >= floor(n * 2 / 3)",
    "judge_validation": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 BETWEEN 1 AND 5 THEN o_orderkey % 8 ELSE 3 END AS substance, CASE o_orderkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN '' ELSE 'abandoned' END AS resolution, least(o_orderkey % 5 / 2, 1) AS effort, 'bug_fix' AS task_type, 'a_b' AS tags FROM orders",
    "judge_steps": f"WITH {_C}, s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS segment FROM ch) SELECT 'c' || conv_id AS session_id, CAST(segment AS BIGINT) AS segment, row_number() OVER (PARTITION BY conv_id, segment ORDER BY idx) - 1 AS step, 'Bash' AS tool, 'run ' || turn AS input, CASE WHEN turn % 4 = 1 THEN '3 passed' ELSE '1 failed' END AS output, md5(text) AS plan, '' AS reflect FROM s WHERE {_BASH}",
    "workflow": f"WITH {_C} SELECT 'c' || conv_id AS session_id, string_agg('Other run ' || turn, ' → ' ORDER BY idx) AS line FROM ch WHERE {_BASH} GROUP BY conv_id",
    "training": f"WITH {_C}, t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS turn_no FROM ch), g AS (SELECT conv_id, turn_no, max(text) FILTER (role = 'user') AS q, sum(CASE WHEN role = 'user' THEN 0 WHEN idx = n - 1 THEN 2 ELSE 3 END) AS k FROM t GROUP BY 1, 2) SELECT 'c' || conv_id || '_' || lpad(CAST(CAST(turn_no - 1 AS INT) AS VARCHAR), 3, '0') AS turn_id, md5(trim(q)) AS input, CAST(k AS INT) AS n FROM g WHERE k > 0 AND turn_no > 0",
    "segment_metadata": f"WITH {_C}, b AS (SELECT *, sum(CASE WHEN role = 'user' AND idx > 0 AND idx % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS seg FROM ch), t AS (SELECT conv_id, seg, min(idx) AS f, max(idx) AS l, min(stamp) AS a, {_COUNTS}, CAST(count(*) FILTER ({_BASH}) AS BIGINT) AS u FROM b GROUP BY 1, 2) SELECT 'c' || conv_id || '_seg-' || lpad(CAST(CAST(seg AS INT) AS VARCHAR), 2, '0') AS segment_id, f AS first_idx, l AS last_idx, a AS start_time, user_messages, assistant_messages, u AS tool_uses, CASE WHEN seg > 0 THEN 'time_gap' ELSE 'initial_segment' END AS reason FROM t",
    "compactions": f"WITH {_C} SELECT 'c' || conv_id AS session_id, idx FROM ch WHERE idx > 0 AND (idx - 1) % 3 = 1",
    "workspace_switches": f"WITH {_C}, a AS (SELECT conv_id, idx, floor(idx / 4) AS p, lag(floor(idx / 4)) OVER (PARTITION BY conv_id ORDER BY idx) AS q FROM ch WHERE {_BASH}) SELECT 'c' || conv_id AS session_id, idx FROM a WHERE p <> q",
    "text_locations": f"WITH {_C}, p AS (SELECT 'content' AS field, text AS t FROM ch UNION ALL SELECT 'thinking', 'hm' FROM ch WHERE {_BASH} UNION ALL SELECT 'tool_uses[0].input.command', 'run ' || turn FROM ch WHERE {_BASH} UNION ALL SELECT 'tool_uses[0].output', CASE WHEN turn % 4 = 1 THEN '3 passed' ELSE '1 failed' END FROM ch WHERE {_BASH}) SELECT field, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM p WHERE trim(t) <> '' GROUP BY 1",
    "findings_recorded": f"WITH {_MAIL}, {_RECORDED} SELECT finding_id, sha256('s' || entity) AS entity_hash, CASE WHEN source_id IS NULL THEN 'open' ELSE 'ignored' END AS status, CASE WHEN source_id IS NULL THEN 'auto' ELSE 'allowlist' END AS decided_by, source_id FROM rc",
    "allowlist_removed": f"WITH {_MAIL} SELECT engine, CASE WHEN len % 3 = 0 THEN 'ignored' ELSE 'open' END AS status, CASE WHEN len % 3 = 0 THEN 'allowlist' ELSE 'auto' END AS decided_by, count(*) AS n FROM fd GROUP BY 1, 2, 3",
    "allowlist_added": f"WITH {_MAIL} SELECT engine, CASE WHEN entity_type = 'email' AND len % 5 = 0 THEN 'ignored' ELSE 'open' END AS status, CASE WHEN entity_type = 'email' AND len % 5 = 0 THEN 'allowlist' ELSE 'auto' END AS decided_by, count(*) AS n FROM fd GROUP BY 1, 2, 3",
    "findings_ordered": f"WITH {_MAIL} SELECT session_id, CAST(confidence AS DOUBLE) AS confidence, CAST(idx AS INT) AS idx, CAST(len AS INT) AS \"offset\" FROM (SELECT *, {_ID} AS finding_id FROM fd) ORDER BY confidence DESC, idx, len, finding_id LIMIT 40",
    "decision_map": f"WITH {_MAIL}, {_RECORDED}, m AS (SELECT session_id, entity, bool_or(source_id IS NOT NULL) AS i FROM rc GROUP BY 1, 2) SELECT CASE WHEN i THEN 'ignored' ELSE 'open' END AS status, count(*) AS n FROM m GROUP BY 1",
    "redaction_counters": f"WITH {_MAIL}, {_RECORDED} SELECT entity_type, CAST(count(*) FILTER (source_id IS NULL) AS BIGINT) AS applied, CAST(count(*) FILTER (source_id IS NOT NULL) AS BIGINT) AS ignored FROM rc GROUP BY 1",
    "findings_rescan": f"WITH {_C} SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM cv WHERE conv_id % 5 = 0 AND conv_id % 2 <> 0 AND turn = 1 AND trim(text) <> '' AND conv_id IN (SELECT conv_id FROM cv GROUP BY 1 HAVING count(*) > 1)",
    "anonymised_texts": "SELECT c_custkey, 'see [REDACTED_PATH] or [REDACTED_PATH]-app of [REDACTED_USERNAME], [REDACTED_USERNAME] and /opt/y' AS text, '[REDACTED_USERNAME]-work' AS project FROM customer",
    "path_tokens": "SELECT DISTINCT 'k' || (c_custkey % 4) AS session_key, CASE WHEN c_custkey % 2 = 0 THEN '/home/jane/f' || (c_custkey % 9) ELSE '/srv/x' END AS path, CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED_PATH_' || substr(sha256('redacted-path:v1' || chr(0) || 'k' || (c_custkey % 4) || chr(0) || '/home/jane/f' || (c_custkey % 9)), 1, 16) || ']' ELSE '/srv/x' END AS token FROM customer",
    "scrubbed_metadata": f"WITH {_C} SELECT 'c' || conv_id AS session_id, 'claude:[REDACTED_USERNAME]-c' || conv_id AS project, '[REDACTED_USERNAME]/[REDACTED]-1' AS git_branch, left(min(stamp), 13) || ':00:00' AS start_time FROM ch GROUP BY conv_id",
    "share_redacted": "SELECT CAST(doc_id AS VARCHAR) AS session_id, false AS has_license FROM documents",
    "replay_bundles": f"WITH {EVENTS_SQL} SELECT session_key, arg_min(type, id) AS first, CAST(count(*) AS INT) AS events, CAST(count(*) FILTER (type = 'purchase') AS INT) AS usage FROM ev GROUP BY 1",
    "idle_closing": f"WITH {EVENTS_SQL} SELECT session_id, CASE WHEN max(event_at) <= TIMESTAMP '2024-01-30 11:00:00' OR bool_or(k = 99) THEN 'ended' ELSE 'active' END AS status FROM ev GROUP BY 1",
    "touched": f"WITH {EVENTS_SQL} SELECT DISTINCT session_id FROM ev WHERE id > 9900 OR k > 98",
    "write_sequences": f"WITH {EVENTS_SQL} SELECT id, 100 + row_number() OVER (ORDER BY CASE WHEN k % 5 <> 0 THEN event_at END NULLS LAST, session_id, event_key, id) AS write_seq FROM ev",
    "hook_order": f"WITH {EVENTS_SQL} SELECT id AS mark, row_number() OVER (PARTITION BY session_id ORDER BY event_at, id) AS place FROM ev",
    "timeline_order": f"WITH {EVENTS_SQL} SELECT id AS mark, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN k % 11 <> 0 THEN event_at END NULLS LAST, k % 7 = 0, CASE WHEN k % 7 <> 0 THEN id END NULLS LAST, id) AS place FROM ev",
    "call_fingerprints": f"WITH {EVENTS_SQL}, f AS (SELECT CASE WHEN k % 2 = 0 THEN 'command_start' ELSE 'tool_call' END AS kind, CASE WHEN k % 5 <> 0 THEN 'present' ELSE 'missing' END AS outcome, k % 3 AS c, k % 2 = 1 AND type = 'click' AS none FROM ev) SELECT none, CASE WHEN NOT none THEN kind END AS kind, CASE WHEN NOT none THEN outcome END AS outcome, count(*) AS n FROM f GROUP BY none, CASE WHEN NOT none THEN kind END, CASE WHEN NOT none THEN outcome END, CASE WHEN NOT none THEN c END",
    "cumulative_tokens": f"WITH {EVENTS_SQL} SELECT session_id, max(k - k % 40) AS input_tokens, 2 * max(k) AS output_tokens, max(k % 40) AS cache_read_tokens FROM ev GROUP BY 1",
}
