"""Vendor session logs to one shape: a row for each message, and a row for each session.

A parser takes lines (source_path, line, raw_json) and returns MESSAGES; `session_table`
folds these to sessions.  All is column expressions: a line is read once by from_json, in
which a nested value that may be a text or an object is taken as text and read again where
it is an object.  What the formats express by order (a call before its result, thoughts
before the message that they lead to) are joins and running counts over (source_path, line),
so a file is never folded line by line, and only its keys are shuffled together.

Lines that aren't JSON, or lack what a message needs, give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOOLS = "array<struct<tool:string,id:string,input:string,output:string,status:string>>"
MESSAGES = f"source_path string, line long, role string, content string, thinking string, at string, tools {TOOLS}, compaction boolean"
#: What parsers tell of a line beside its message; session_table folds it.
FACTS = "model string, effort string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, interrupts long"
INTERRUPT = "[Request interrupted by user"

# Names by which logs give the effort, and objects that may hold it.
EFFORT_NAMES, EFFORT_HOLDERS = ("effort", "reasoningEffort", "reasoning_effort", "reasoning_effort_level"), ("options", "providerOptions", "params", "config")

_BLOCK = "array<struct<type:string,text:string,thinking:string,think:string,id:string,name:string,input:string,arguments:string,tool_use_id:string,is_error:boolean,content:string>>"


def _text(column: Column) -> Column:
    """A text without white space around it; null if nothing is left."""
    bare = F.regexp_replace(column, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def _listed(content: Column) -> Column:
    """Blocks of a content that is a list; null for a plain text."""
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, _BLOCK))


def _joined(blocks: Column, kind: str, field: str, by: str, strip: bool = True) -> Column:
    """The texts of one kind of blocks, joined; null if there are none."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: _text(b[field]) if strip else F.coalesce(b[field], F.lit("")))
    texts = F.filter(texts, lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, by))


def _tool(tool: Column, id: Column, input: Column, output: Column | None = None, status: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(tool.alias("tool"), id.alias("id"), input.alias("input"), (none if output is None else output).alias("output"), (none if status is None else status).alias("status"))


def _effort(json: Column) -> Column:
    """The effort that a JSON object names itself, or else in one of its holders."""
    own = [_text(F.get_json_object(json, f"$.{n}")) for n in EFFORT_NAMES]
    held = [_text(F.get_json_object(json, f"$.{h}.{n}")) for h in EFFORT_HOLDERS for n in EFFORT_NAMES]
    return F.coalesce(*own, *held)


def normalised_at(at: Column) -> Column:
    """A time as text; milliseconds since 1970 become ISO 8601."""
    millis = F.expr("1")  # a literal, so that the cast below is only met by digits
    number = F.regexp_like(at, F.lit(r"^[0-9]+([.][0-9]+)?$"))
    moment = F.timestamp_millis(F.when(number, at.cast("double").cast("long")) * millis)
    return F.when(number, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).otherwise(at)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _last_name(path: Column) -> Column:
    """The last part of a path; the path itself where there is none."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(name != "", name).otherwise(path)


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as MESSAGES and FACTS; what isn't given is null."""
    out = ["source_path", "line"]
    for field in (MESSAGES + ", " + FACTS).replace(TOOLS, "TOOLS").split(", ")[2:]:
        name, kind = field.split(" ")
        out.append(columns.get(name, F.lit(None)).cast(TOOLS if kind == "TOOLS" else kind).alias(name))
    return rows.select(*out)


def _with_results(messages: DataFrame, results: DataFrame) -> DataFrame:
    """messages whose tools have the output and status of the last result with their id; results: source_path, line, id, output, status."""
    last = results.filter("id is not null").groupBy("source_path", "id").agg(F.max_by(F.struct("output", "status"), "line").alias("r"))
    calls = messages.select("source_path", "line", F.posexplode("tools").alias("place", "t"))
    met = calls.join(last, (calls.source_path == last.source_path) & (F.col("t.id") == last.id), "left").select(calls.source_path, "line", "place", "t", "r")
    t = F.struct(F.col("t.tool").alias("tool"), F.col("t.id").alias("id"), F.col("t.input").alias("input"), F.coalesce("t.output", "r.output").alias("output"), F.coalesce("t.status", "r.status").alias("status"))
    lists = met.groupBy("source_path", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", t.alias("t")))), lambda x: x["t"]).alias("met"))
    return messages.join(lists, ["source_path", "line"], "left").withColumn("tools", F.coalesce("met", "tools")).drop("met")


def _speaks() -> Column:
    return F.col("content").isNotNull() | F.col("thinking").isNotNull() | (F.size(F.coalesce("tools", F.array().cast(TOOLS))) > 0)


def claude(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claude-like logs: messages, and (source_path, session_id, cwd, branch) from the first line that has a folder."""
    schema = "type string, timestamp string, cwd string, gitBranch string, sessionId string, message struct<model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
    e = lines.select("source_path", "line", "raw_json", F.from_json("raw_json", schema).alias("e")).select("source_path", "line", "raw_json", "e.*").withColumn("blocks", _listed(F.col("message.content")))
    plain = F.when(F.col("blocks").isNull(), F.col("message.content"))
    said = F.coalesce(plain, F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))
    asked = F.when(_text(said).isNotNull(), said)
    hits = F.coalesce(F.size(F.filter("blocks", lambda b: F.contains(b["text"], F.lit(INTERRUPT)))), F.when(F.contains(plain, F.lit(INTERRUPT)), 1).otherwise(0))
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: _tool(b["name"], b["id"], b["input"]))
    user, agent = F.col("type") == "user", (F.col("type") == "assistant") & F.col("blocks").isNotNull()
    made = _shaped(
        e.filter(user | agent), role=F.col("type"), content=F.when(user, asked).otherwise(_joined(F.col("blocks"), "text", "text", "\n\n")), thinking=F.when(agent, _joined(F.col("blocks"), "thinking", "thinking", "\n\n")),
        at=normalised_at(F.col("timestamp")), tools=F.when(agent, tools), model=F.when(agent, F.col("message.model")), effort=F.when(agent, _effort(F.get_json_object("raw_json", "$.message"))),
        input_tokens=F.col("message.usage.input_tokens"), output_tokens=F.col("message.usage.output_tokens"), cache_read_tokens=F.col("message.usage.cache_read_input_tokens"), cache_creation_tokens=F.col("message.usage.cache_creation_input_tokens"),
        interrupts=F.when(user, hits),
    )
    results = e.filter(user).select("source_path", "line", F.explode("blocks").alias("b")).filter("b.type = 'tool_result'")
    parts = _listed(F.col("b.content"))
    output = _text(F.when(parts.isNotNull(), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n")).otherwise(F.col("b.content")))
    results = results.select("source_path", "line", F.col("b.tool_use_id").alias("id"), output.alias("output"), F.when(F.coalesce("b.is_error", F.lit(False)), "error").otherwise("success").alias("status"))
    first = e.filter("cwd is not null and cwd <> ''").groupBy("source_path").agg(F.min_by(F.struct("cwd", "gitBranch", "sessionId"), "line").alias("m"))
    heads = first.select("source_path", F.col("m.sessionId").alias("session_id"), F.col("m.cwd").alias("cwd"), F.col("m.gitBranch").alias("branch"))
    return _with_results(made, results).filter(_speaks() | (F.col("interrupts") > 0)), heads


def openclaw(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OpenClaw logs: only files whose first line is a session; compactions are messages of the system, the last change of model counts."""
    schema = "type string, id string, timestamp string, cwd string, summary string, provider string, modelId string, message struct<role:string,timestamp:string,toolCallId:string,isError:boolean,content:string,model:string,provider:string,command:string,output:string,exitCode:int,usage:struct<input:bigint,output:bigint,cacheRead:bigint>>"
    e = lines.select("source_path", "line", "raw_json", F.from_json("raw_json", schema).alias("e")).select("source_path", "line", "raw_json", "e.*")
    head = e.groupBy("source_path").agg(F.min_by(F.struct("type", "id", "timestamp", "cwd"), "line").alias("h"), F.min("line").alias("first")).filter("h.type = 'session'")
    e = e.join(head.select("source_path", "first"), "source_path").filter("line > first").withColumn("blocks", _listed(F.col("message.content")))
    role, at = F.col("message.role"), F.coalesce(normalised_at(F.col("message.timestamp")), F.col("timestamp"))
    named = lambda provider, model: F.when(F.coalesce(provider, F.lit("")) != "", F.concat(provider, F.lit("/"), model)).otherwise(model)
    said = _text(F.coalesce(F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), F.col("message.content")))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "toolCall"), lambda b: _tool(b["name"], b["id"], b["arguments"]))
    ran = F.array(_tool(F.lit("bash"), F.lit(None).cast("string"), F.to_json(F.struct(F.col("message.command").alias("command"))), _text(F.col("message.output")), F.when(F.coalesce("message.exitCode", F.lit(0)) != 0, "error").otherwise("success")))
    shell, message, pack = role == "bashExecution", F.col("type") == "message", F.col("type") == "compaction"
    made = _shaped(
        e.filter((message & (role.isin("user", "bashExecution") | ((role == "assistant") & F.col("blocks").isNotNull()))) | pack | (F.col("type") == "model_change")),
        role=F.when(pack, "system").when(message, F.when(role == "user", "user").otherwise("assistant")), content=F.when(pack, "[compaction]").when(role == "user", said).when(message & ~shell, _joined(F.col("blocks"), "text", "text", "\n\n")),
        thinking=F.when(role == "assistant", _joined(F.col("blocks"), "thinking", "thinking", "\n\n")), at=F.when(message, at).otherwise(F.col("timestamp")), tools=F.when(shell, ran).when(role == "assistant", calls), compaction=pack,
        model=F.when(F.col("type") == "model_change", named(F.col("provider"), F.col("modelId"))).when(role == "assistant", named(F.col("message.provider"), F.col("message.model"))),
        effort=F.when(F.col("type") == "model_change", _effort(F.col("raw_json"))).otherwise(_effort(F.get_json_object("raw_json", "$.message"))),
        input_tokens=F.coalesce("message.usage.input", F.lit(0)) + F.coalesce("message.usage.cacheRead", F.lit(0)), output_tokens=F.col("message.usage.output"),
    )
    results = e.filter(message & (role == "toolResult")).select("source_path", "line", F.col("message.toolCallId").alias("id"), said.alias("output"), F.when(F.coalesce("message.isError", F.lit(False)), "error").otherwise("success").alias("status"))
    changed = e.filter("type = 'model_change' and modelId is not null").groupBy("source_path").agg(F.max_by(named(F.col("provider"), F.col("modelId")), "line").alias("model"))
    heads = head.join(changed, "source_path", "left").select("source_path", F.col("h.id").alias("session_id"), F.col("h.cwd").alias("cwd"), F.col("h.timestamp").alias("started"), "model")
    return _with_results(made, results).filter(_speaks()), heads


def codex(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codex rollouts.  Thoughts and calls wait for the message that ends them: items up to an agent's message become part of it,
    those before a user's message or the end a message of their own.  A running count of such messages tells which wait for which.
    Tokens are the greatest of the cumulative counts, input less what was cached."""
    schema = "type string, timestamp string, payload struct<type:string,id:string,cwd:string,model:string,model_provider:string,effort:string,git:struct<branch:string>,message:string,text:string,name:string,arguments:string,input:string,call_id:string,output:string,summary:array<struct<text:string>>,info:struct<total_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>>>"
    e = lines.select("source_path", "line", "raw_json", F.from_json("raw_json", schema).alias("e")).select("source_path", "line", "raw_json", "e.*").withColumn("at", normalised_at(F.col("timestamp")))
    kind, p = F.col("payload.type"), "payload."
    event, item = F.col("type") == "event_msg", F.col("type") == "response_item"
    closes = event & kind.isin("user_message", "agent_message")
    before = Window.partitionBy("source_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    call = item & kind.isin("function_call", "custom_tool_call")
    thoughts = F.when(event & (kind == "agent_reasoning"), F.array(_text(F.col(p + "text")))).when(item & (kind == "reasoning"), F.transform(p + "summary", lambda s: _text(s["text"])))
    given = F.when(kind == "custom_tool_call", F.to_json(F.struct(F.col(p + "input").alias("patch")))).otherwise(F.col(p + "arguments"))
    items = e.withColumn("turn", F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(before), F.lit(0))).filter(closes | call | (event & (kind == "agent_reasoning")) | (item & (kind == "reasoning")))
    items = items.select("source_path", "line", "at", "turn", F.when(closes, kind).alias("end"), F.when(closes, _text(F.col(p + "message"))).alias("said"), thoughts.alias("thoughts"), F.when(call, _tool(F.col(p + "name"), F.col(p + "call_id"), given)).alias("call"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(c).alias("x")))), lambda s: s["x"])
    turns = items.groupBy("source_path", "turn").agg(F.max("end").alias("end"), F.max("said").alias("said"), F.max(F.when(F.col("end").isNotNull(), F.col("at"))).alias("at"), F.max("line").alias("line"), F.flatten(F.filter(ordered("thoughts"), lambda x: x.isNotNull())).alias("thoughts"), F.filter(ordered("call"), lambda x: x.isNotNull()).alias("calls"))
    thinking = F.array_distinct(F.filter("thoughts", lambda t: t.isNotNull()))
    turns = turns.withColumn("thinking", F.when(F.size(thinking) > 0, F.array_join(thinking, "\n\n"))).withColumn("calls", F.when(F.size("calls") > 0, F.col("calls")))
    user = F.col("end") == "user_message"
    # Without a message at the end, what waits gets the time of the last one.
    last = Window.partitionBy("source_path")
    turns = turns.withColumn("at", F.when(F.col("end").isNull(), F.max_by("at", F.when(F.col("said").isNotNull() | F.col("thinking").isNotNull() | F.col("calls").isNotNull(), F.when(F.col("end").isNotNull(), F.col("turn")))).over(last)).otherwise(F.col("at")))
    waits = _shaped(turns.withColumn("line", F.col("line") * 2), role=F.lit("assistant"), content=F.when(~F.coalesce(user, F.lit(False)), F.col("said")), thinking=F.col("thinking"), at=F.col("at"), tools=F.col("calls"))
    asks = _shaped(turns.filter(user & F.col("said").isNotNull()).withColumn("line", F.col("line") * 2 + 1), role=F.lit("user"), content=F.col("said"), at=F.col("at"))
    texts = F.from_json(F.col(p + "output"), "array<struct<type:string,text:string>>")
    plain = F.col(p + "output")
    after = _text(F.regexp_extract(plain, r"(?s)(?:^|\n)Output:\r?\n(.*)$", 1))
    output = F.when(F.startswith(plain, F.lit("[")) & texts.isNotNull(), F.array_join(F.transform(F.filter(texts, lambda t: t["type"] == "input_text"), lambda t: t["text"]), "\n")).when(kind == "custom_tool_call_output", F.coalesce(F.get_json_object(plain, "$.output"), plain)).otherwise(after)
    results = e.filter(item & kind.isin("function_call_output", "custom_tool_call_output")).select("source_path", "line", F.col(p + "call_id").alias("id"), output.alias("output"), F.lit("success").alias("status"))
    usage = "payload.info.total_token_usage."
    meta = F.col("type") == "session_meta"
    context = F.col("type").isin("session_meta", "turn_context") & (_text(F.col(p + "cwd")).isNotNull())
    first = lambda column, where: F.min_by(column, F.when(where & column.isNotNull(), F.col("line")))
    heads = e.groupBy("source_path").agg(
        first(F.col(p + "id"), meta).alias("session_id"), F.max_by(F.col(p + "cwd"), F.when(context, F.col("line"))).alias("cwd"), first(F.col("payload.git.branch"), meta).alias("branch"),
        F.coalesce(first(_text(F.col(p + "model")), F.col("type") == "turn_context"), F.concat(first(_text(F.col(p + "model_provider")), meta), F.lit("-codex")), F.lit("codex-unknown")).alias("model"),
        first(_effort(F.get_json_object("raw_json", "$.payload")), F.col("type") == "turn_context").alias("effort"),
        F.max(F.greatest(F.lit(0), F.coalesce(usage + "input_tokens", F.lit(0)) - F.coalesce(usage + "cached_input_tokens", F.lit(0)))).alias("input_tokens"), F.max(usage + "output_tokens").alias("output_tokens"), F.max(usage + "cached_input_tokens").alias("cache_read_tokens"),
    )
    return _with_results(waits.filter(_speaks()), results).union(asks), heads


def gemini(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gemini sessions: a row of files is a whole file's JSON; cached input counts as input."""
    call = "struct<name:string,id:string,args:string,status:string,result:array<struct<functionResponse:struct<response:struct<output:string>>,text:string>>>"
    schema = f"sessionId string, startTime string, lastUpdated string, messages array<struct<type:string,timestamp:string,content:string,model:string,tokens:struct<input:bigint,output:bigint,cached:bigint>,thoughts:array<struct<description:string>>,toolCalls:array<{call}>>>"
    e = files.select("source_path", F.from_json("raw_json", schema).alias("e")).filter("e is not null")
    m = e.select("source_path", F.posexplode("e.messages").alias("line", "m")).withColumn("line", F.col("line").cast("long")).withColumn("blocks", F.from_json(F.when(F.startswith(F.ltrim("m.content"), F.lit("[")), F.col("m.content")), "array<struct<text:string>>"))
    user = F.col("m.type") == "user"
    said = _text(F.coalesce(F.array_join(F.transform(F.filter("blocks", lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n"), F.col("m.content")))
    thoughts = F.filter(F.transform("m.thoughts", lambda t: _text(t["description"])), lambda t: t.isNotNull())
    output = lambda c: F.element_at(F.filter(F.transform(c["result"], lambda r: r["functionResponse"]["response"]["output"]), lambda o: o.isNotNull()), F.lit(-1))
    some = lambda c: F.when(F.size(F.filter(F.transform(c["result"], lambda r: r["functionResponse"]["response"]["output"]), lambda o: o.isNotNull())) > 0, output(c))
    tools = F.transform("m.toolCalls", lambda c: _tool(c["name"], c["id"], c["args"], some(c), F.coalesce(c["status"], F.lit("unknown"))))
    made = _shaped(
        m.filter(F.col("m.type").isin("user", "gemini")), role=F.when(user, "user").otherwise("assistant"), content=said, thinking=F.when(~user & (F.size(thoughts) > 0), F.array_join(thoughts, "\n\n")), at=F.col("m.timestamp"), tools=F.when(~user, tools),
        model=F.when(~user, F.col("m.model")), input_tokens=F.coalesce("m.tokens.input", F.lit(0)) + F.coalesce("m.tokens.cached", F.lit(0)), output_tokens=F.col("m.tokens.output"),
    )
    heads = e.select("source_path", F.col("e.sessionId").alias("session_id"), F.col("e.startTime").alias("started"), F.col("e.lastUpdated").alias("ended"))
    return made.filter(_speaks()), heads


def kimi(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kimi logs: no times; the greatest token count is the output; the session is the file's folder."""
    e = lines.select("source_path", "line", "raw_json", F.from_json("raw_json", "role string, content string, token_count bigint, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>").alias("e")).select("source_path", "line", "raw_json", "e.*").withColumn("blocks", _listed(F.col("content")))
    user = F.col("role") == "user"
    tools = F.transform("tool_calls", lambda c: _tool(c["function"]["name"], c["id"], c["function"]["arguments"]))
    made = _shaped(
        e.filter(F.col("role").isin("user", "assistant")), role=F.col("role"), content=F.when(user, F.when(F.col("blocks").isNull(), _text(F.col("content")))).otherwise(_joined(F.col("blocks"), "text", "text", "\n\n")),
        thinking=F.when(~user, _joined(F.col("blocks"), "think", "think", "\n\n")), tools=F.when(~user, tools),
    )
    first = F.min_by(_effort(F.col("raw_json")), F.when(_effort(F.col("raw_json")).isNotNull(), F.col("line")))
    heads = e.groupBy("source_path").agg(F.max(F.when(F.col("role") == "_usage", F.col("token_count"))).alias("output_tokens"), first.alias("effort"))
    return made.filter(_speaks()), heads.withColumn("session_id", _folder(F.col("source_path")))


def cursor(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cursor logs: like Claude's, with a message that may be the line itself; usage is counted wherever a line has it."""
    schema = "type string, timestamp string, modelId string, model string, content string, message struct<content:string,model:string>, usage struct<input_tokens:bigint,output_tokens:bigint>"
    e = lines.select("source_path", "line", F.from_json("raw_json", schema).alias("e")).select("source_path", "line", "e.*").withColumn("body", F.coalesce("message.content", F.when(F.col("message").isNull(), F.col("content")))).withColumn("blocks", _listed(F.col("body")))
    user, agent = F.col("type").isin("user", "human"), F.col("type").isin("assistant", "ai")
    asked = F.coalesce(F.when(F.col("blocks").isNull(), _text(F.col("body"))), _text(F.element_at(F.filter("blocks", lambda b: b["type"] == "text"), 1)["text"]))
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: _tool(b["name"], b["id"], b["input"]))
    first = F.when(F.size(F.filter("blocks", lambda b: b["type"] == "text")) > 0, asked).when(F.col("blocks").isNull(), _text(F.col("body")))
    made = _shaped(
        e.filter(user | agent | F.col("usage").isNotNull() | (F.col("type") == "model_change")), role=F.when(user, "user").when(agent, "assistant"), content=F.when(user, first).when(agent, F.coalesce(_joined(F.col("blocks"), "text", "text", "\n\n"), F.when(F.col("blocks").isNull(), _text(F.col("body"))))),
        thinking=F.when(agent, F.coalesce(_joined(F.col("blocks"), "thinking", "thinking", "\n\n"), _joined(F.col("blocks"), "thinking", "text", "\n\n"))), at=normalised_at(F.col("timestamp")), tools=F.when(agent, tools),
        model=F.coalesce(F.when(F.col("type") == "model_change", F.coalesce("modelId", "model")), F.when(agent, F.coalesce("message.model", "model"))), input_tokens=F.col("usage.input_tokens"), output_tokens=F.col("usage.output_tokens"),
    )
    ends = e.filter("timestamp is not null").groupBy("source_path").agg(F.max_by(normalised_at(F.col("timestamp")), "line").alias("ended"))
    return made, ends


def copilot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copilot events: a tool's result belongs to the message before it, if that is a tool call; the session is the file's folder."""
    schema = "type string, timestamp string, data struct<prompt:string,content:string,text:string,model:string,workingDirectory:string,toolName:string,name:string,input:string,parameters:string,output:string,result:string,isError:boolean,metrics:struct<input_tokens:bigint,output_tokens:bigint,inputTokens:bigint,outputTokens:bigint>,usage:struct<input_tokens:bigint,output_tokens:bigint,inputTokens:bigint,outputTokens:bigint>>"
    e = lines.select("source_path", "line", F.from_json("raw_json", schema).alias("e")).select("source_path", "line", "e.*").withColumn("at", normalised_at(F.col("timestamp")))
    asked, replied, called, gave = (F.col("type") == t for t in ("userPromptSubmitted", "assistantResponse", "preToolUse", "postToolUse"))
    said = F.when(asked, _text(F.col("data.prompt"))).when(replied, _text(F.coalesce("data.content", "data.text")))
    speaks = said.isNotNull() | called
    running = Window.partitionBy("source_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("said", said).withColumn("turn", F.sum(F.when(speaks, 1).otherwise(0)).over(running))
    output = F.substring(_text(F.coalesce("data.output", "data.result")), 1, 5000)
    results = e.filter(gave & output.isNotNull()).groupBy("source_path", "turn").agg(F.max_by(F.struct(output.alias("output"), F.when(F.coalesce("data.isError", F.lit(False)), "error").otherwise("success").alias("status")), "line").alias("r"))
    given = F.coalesce("data.input", "data.parameters", F.lit("{}"))
    given = F.when(F.startswith(F.ltrim(given), F.lit("{")), given).otherwise(F.to_json(F.struct(given.alias("command"))))
    rows = e.filter(speaks).join(results, ["source_path", "turn"], "left")
    made = _shaped(
        rows, role=F.when(asked, "user").otherwise("assistant"), content=F.col("said"), at=F.when(~called, F.col("at")),
        tools=F.when(called, F.array(_tool(F.coalesce("data.toolName", "data.name", F.lit("unknown")), F.lit(None).cast("string"), given, F.col("r.output"), F.col("r.status")))),
    )
    ended = F.col("type").isin("SessionEnd", "sessionEnd")
    used = lambda a, b: F.sum(F.when(ended, F.coalesce(f"data.metrics.{a}", f"data.metrics.{b}", f"data.usage.{a}", f"data.usage.{b}")))
    begun = F.col("type") == "sessionStart"
    heads = e.groupBy("source_path").agg(
        F.max_by("at", F.when(begun, F.col("line"))).alias("started"), F.max_by("at", F.when(F.col("at").isNotNull(), F.col("line"))).alias("ended"), F.max_by("data.workingDirectory", F.when(begun, F.col("line"))).alias("cwd"),
        F.coalesce(F.max_by("data.model", F.when(begun, F.col("line"))), F.min_by("data.model", F.when(replied & F.col("data.model").isNotNull(), F.col("line")))).alias("model"), used("input_tokens", "inputTokens").alias("input_tokens"), used("output_tokens", "outputTokens").alias("output_tokens"),
    )
    return made, heads.withColumn("session_id", _folder(F.col("source_path")))


def opencode(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OpenCode's three tables: parts in order of (time, id) make a message, cached tokens count as input."""
    part = "type string, text string, tool string, callID string, state struct<status:string,input:string,output:string>"
    p = parts.select(F.col("message_id"), "time_created", F.col("id").alias("part_id"), F.from_json("data", part).alias("p")).filter("p is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("time_created", "part_id", "p"))), lambda x: x["p"])
    lists = p.groupBy("message_id").agg(ordered.alias("parts"))
    body = "role string, model struct<providerID:string,modelID:string>, tokens struct<input:bigint,output:bigint,cache:struct<read:bigint,write:bigint>>"
    m = messages.select("session_id", F.col("id").alias("message_id"), "time_created", "data", F.from_json("data", body).alias("m")).join(lists, "message_id", "left")
    m = m.withColumn("source_path", F.col("session_id")).withColumn("line", F.row_number().over(Window.partitionBy("session_id").orderBy("time_created", "message_id")).cast("long"))
    texts = lambda kind: F.filter(F.transform(F.filter("parts", lambda x: x["type"] == kind), lambda x: _text(x["text"])), lambda t: t.isNotNull())
    some = lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n\n"))
    status = lambda x: F.when(x["state"]["status"] == "completed", "success").otherwise(x["state"]["status"])
    tools = F.transform(F.filter("parts", lambda x: x["type"] == "tool"), lambda x: _tool(x["tool"], x["callID"], x["state"]["input"], x["state"]["output"], status(x)))
    agent, cached = F.col("m.role") == "assistant", F.coalesce("m.tokens.cache.read", F.lit(0)) + F.coalesce("m.tokens.cache.write", F.lit(0))
    model = F.when(_text(F.col("m.model.providerID")).isNotNull() & _text(F.col("m.model.modelID")).isNotNull(), F.concat_ws("/", "m.model.providerID", "m.model.modelID")).otherwise(_text(F.col("m.model.modelID")))
    made = _shaped(
        m.filter(F.col("m.role").isin("user", "assistant")), role=F.col("m.role"), content=some(texts("text")), thinking=F.when(agent, some(texts("reasoning"))), at=normalised_at(F.col("time_created").cast("string")), tools=F.when(agent, tools),
        model=model, effort=_effort(F.col("data")), input_tokens=F.when(agent, F.coalesce("m.tokens.input", F.lit(0)) + cached), output_tokens=F.when(agent, F.col("m.tokens.output")),
    )
    time = lambda c: normalised_at(F.col(c).cast("string"))
    heads = sessions.select(F.col("id").alias("source_path"), F.col("id").alias("session_id"), F.col("directory").alias("cwd"), time("time_created").alias("started"))
    return made, heads


def read_sqlite(spark: SparkSession, path: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Tables (name: schema) of SQLite files as frames: a file is read by one task, its rows leave in batches."""
    import sqlite3

    files = spark.read.format("binaryFile").load(path).select("content")

    def reader(table: str, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for content in frame["content"]:
                    base = sqlite3.connect(":memory:")
                    base.deserialize(bytes(content))
                    rows = base.execute(f"SELECT {', '.join(names)} FROM {table}")
                    while some := rows.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names)
                    base.close()

        return work

    return {t: files.mapInPandas(reader(t, [f.split(" ")[0] for f in s.split(", ")]), s) for t, s in tables.items()}


OPENCODE_TABLES = {"session": "id string, directory string, time_created long, time_updated long", "message": "id string, session_id string, time_created long, data string", "part": "id string, message_id string, time_created long, data string"}


def aider(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat logs in Markdown (source_path, raw_json: the file): a heading starts a session, > and #### mark the user; tokens are guessed from characters."""
    chats = texts.select("source_path", F.posexplode(F.split("raw_json", r"(?m)^# aider chat started at (?=\S)")).alias("chat", "body")).filter("chat > 0")
    started = F.trim(F.regexp_extract("body", r"^([^\n]*)", 1))
    folder = F.regexp_replace("source_path", r"/[^/]*$", "")
    chats = chats.select(folder.alias("folder"), started.alias("started"), F.substring(F.sha2(F.concat(F.lit("aider:"), folder, F.lit(":"), started), 256), 1, 16).alias("source_path"), F.regexp_replace("body", r"^[^\n]*\n?", "").alias("body"))
    rows = chats.select("source_path", F.posexplode(F.split("body", "\n")).alias("at_line", "raw")).withColumn("bare", F.trim("raw"))
    quoted = F.regexp_like("bare", F.lit(r"^(?:> |#### )"))
    kind = F.when(quoted, "user").when((F.col("bare") == ">") | (F.col("bare") == ""), F.lit(None)).when(~F.startswith("bare", F.lit("#")), "assistant").otherwise("skip")
    w = Window.partitionBy("source_path").orderBy("at_line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).filter("kind is null or kind <> 'skip'").withColumn("role", F.last("kind", True).over(w))
    rows = rows.filter("role is not null and (bare <> '>' or role = 'user')")
    new = (F.col("role") != F.lag("role").over(Window.partitionBy("source_path").orderBy("at_line"))) | F.lag("role").over(Window.partitionBy("source_path").orderBy("at_line")).isNull()
    rows = rows.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w)).withColumn("said", F.when(F.col("bare") == ">", "").otherwise(F.trim(F.regexp_replace("bare", r"^(?:> |#### )", ""))))
    runs = rows.groupBy("source_path", "run", "role").agg(F.min("at_line").cast("long").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_line", "said"))), lambda x: x["said"]), "\n").alias("text"))
    made = _shaped(runs.filter(_text(F.col("text")).isNotNull()), role=F.col("role"), content=_text(F.col("text")))
    moment = F.try_to_timestamp("started", F.lit("yyyy-MM-dd HH:mm:ss"))
    tokens = made.groupBy("source_path").agg(F.floor(F.sum(F.length("content")) / 4).alias("n"))
    heads = chats.join(tokens, "source_path").select("source_path", F.col("source_path").alias("session_id"), F.col("folder").alias("cwd"), F.coalesce(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX"), "started").alias("started"), F.floor(F.col("n") / 3).alias("input_tokens"), F.floor(F.col("n") * 2 / 3).alias("output_tokens"))
    return made, heads.dropDuplicates(["source_path"])


#: A parser for each client; the last model of a head comes before those of messages for these.
PARSERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {"claude": claude, "openclaw": openclaw, "codex": codex, "gemini": gemini, "kimi": kimi, "cursor": cursor, "copilot": copilot, "aider": aider}
DEFAULT_MODEL = {"openclaw": "openclaw-unknown", "opencode": "opencode-unknown"}


def session_table(messages: DataFrame, heads: DataFrame, source: str) -> DataFrame:
    """A row for each session that has a message: ids, model, times, counts, and its messages in order.

    Times are those of the first and last message that has one, tokens are sums, unless the heads know better.
    """
    spoken = F.col("role").isNotNull() & _speaks()
    m = messages.withColumn("spoken", F.coalesce(spoken, F.lit(False)))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n_tools = F.when(F.col("spoken"), F.greatest(F.size(F.coalesce("tools", F.array().cast(TOOLS))), F.lit(0))).otherwise(0)
    timed = F.when(F.col("spoken") & F.col("at").isNotNull(), F.col("line"))
    body = F.struct("line", "role", "content", "thinking", "at", "tools", F.coalesce("compaction", F.lit(False)).alias("compaction"))
    folded = m.groupBy("source_path").agg(
        F.min_by("at", timed).alias("m_start"), F.max_by("at", timed).alias("m_end"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).alias("m_model"), F.min_by("effort", F.when(F.col("effort").isNotNull(), F.col("line"))).alias("m_effort"),
        count(F.col("spoken") & (F.col("role") == "user")).alias("user_messages"), count(F.col("spoken") & (F.col("role") == "assistant")).alias("assistant_messages"), F.sum(n_tools).alias("tool_uses"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"m_{c}") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")], F.coalesce(F.sum("interrupts"), F.lit(0)).alias("user_interrupts"),
        F.array_sort(F.collect_list(F.when(F.col("spoken"), body))).alias("messages"),
    )
    known = heads
    for name, kind in (("session_id", "string"), ("cwd", "string"), ("branch", "string"), ("started", "string"), ("ended", "string"), ("model", "string"), ("effort", "string"), ("input_tokens", "long"), ("output_tokens", "long"), ("cache_read_tokens", "long")):
        if name not in heads.columns:
            known = known.withColumn(name, F.lit(None).cast(kind))
    out = folded.filter(F.size("messages") > 0).join(known, "source_path", "left")
    named = F.when(_text(F.col("cwd")).isNotNull(), F.concat(F.lit(f"{source}:"), _last_name(F.col("cwd")))).otherwise(f"{source}:unknown")
    return out.select(
        "source_path", F.coalesce("session_id", _stem(F.col("source_path"))).alias("session_id"), F.lit(source).alias("source"), named.alias("project"), F.col("branch").alias("git_branch"),
        F.coalesce("model", "m_model", F.lit(DEFAULT_MODEL.get(source))).alias("model"), F.coalesce("effort", "m_effort").alias("model_effort"), F.coalesce("started", "m_start").alias("start_time"), F.coalesce("ended", "m_end").alias("end_time"),
        "user_messages", "assistant_messages", "tool_uses", F.coalesce("input_tokens", "m_input_tokens").alias("input_tokens"), F.coalesce("output_tokens", "m_output_tokens").alias("output_tokens"),
        F.coalesce("cache_read_tokens", "m_cache_read_tokens").alias("cache_read_tokens"), F.col("m_cache_creation_tokens").alias("cache_creation_tokens"), "user_interrupts", "messages",
    )


def parse(lines: DataFrame, client: str) -> DataFrame:
    """Sessions of a client's lines (files for gemini and aider)."""
    messages, heads = PARSERS[client](lines)
    return session_table(messages, heads, client)


def parse_all(inputs: dict[str, DataFrame]) -> DataFrame:
    """Sessions of several clients' lines, as one table."""
    tables = [parse(lines, client) for client, lines in inputs.items()]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def subagent_lines(lines: DataFrame) -> DataFrame:
    """Lines of sessions that have only subagents' files (<session>/subagents/agent-*.jsonl, no <session>.jsonl beside), as one file each.

    Their order is that of the times' text (none comes first), then of file and line.
    """
    split = F.regexp_extract("source_path", r"^(.*/[^/]+)/subagents/agent-[^/]*\.jsonl$", 1)
    roots = lines.select(F.regexp_replace("source_path", r"\.jsonl$", "").alias("folder")).distinct()
    own = lines.withColumn("folder", split).filter("folder <> ''").join(roots, "folder", "left_anti")
    order = Window.partitionBy("folder").orderBy(F.coalesce(F.get_json_object("raw_json", "$.timestamp"), F.lit("")), "source_path", "line")
    return own.withColumn("line", F.row_number().over(order).cast("long")).drop("source_path").withColumnRenamed("folder", "source_path").select("source_path", "line", "raw_json")


def with_local_agents(native: DataFrame, local: DataFrame, wrappers: DataFrame) -> DataFrame:
    """native sessions and, of ids that these lack, local agents' (wrappers: session_id, outer_session_id, model); native comes first."""
    marks = lambda f, rank, origin, channel: f.withColumn("rank", F.lit(rank)).withColumn("client_origin", F.lit(origin).cast("string")).withColumn("runtime_channel", F.lit(channel).cast("string"))
    w = wrappers.select("session_id", F.col("outer_session_id"), F.col("model").alias("w_model"))
    inner = marks(local, 1, "desktop", "local-agent").join(w, "session_id", "left").withColumn("model", F.coalesce("model", "w_model")).drop("w_model")
    both = marks(native, 0, None, None).withColumn("outer_session_id", F.lit(None).cast("string")).unionByName(inner)
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("rank", "source_path"))
    return both.withColumn("n", first).filter("n = 1").drop("n", "rank")


# Files


# Where each client keeps its sessions, as patterns of paths with the project's part in a group.
LAYOUTS = {
    "claude": r"/\.claude/projects/([^/]+)/[^/]+\.jsonl$", "codex": r"/\.codex/(?:archived_)?sessions/(.*)\.jsonl$", "openclaw": r"/\.openclaw/agents/([^/]+)/sessions/[^/]+\.jsonl$",
    "gemini": r"/\.gemini/tmp/([^/]+)/chats/[^/]+\.json$", "kimi": r"/\.kimi/sessions/([^/]+)/[^/]+/context\.jsonl$", "cursor": r"/\.cursor/projects/([^/]+)/[^/]+\.jsonl$",
    "copilot": r"/\.copilot/session-state/([^/]+)/events\.jsonl$", "aider": r"/([^/]+)/\.aider\.chat\.history\.md$", "custom": r"/custom/([^/]+)/[^/]+\.jsonl$",
}


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of the files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def logical_inputs(files: DataFrame) -> DataFrame:
    """path, size, source, project of the files that some client wrote."""
    hit = F.coalesce(*[F.when(F.regexp_like("path", F.lit(p)), F.struct(F.lit(s).alias("source"), F.regexp_extract("path", p, 1).alias("project"))) for s, p in LAYOUTS.items()])
    return files.withColumn("hit", hit).filter("hit is not null").select(*files.columns, "hit.source", "hit.project")


def project_name(source: Column, folder: Column) -> Column:
    """How a project shows: for folders that spell a path with hyphens, what comes after the home."""
    home = F.regexp_replace(folder, r"^-(?:Users|home)-[^-]+(?:-(?:Documents|Downloads|Desktop)(?=-))?-?", "")
    spelled = F.when(F.regexp_like(folder, F.lit(r"^-(?:Users|home)-[^-]+$")), F.lit("~home")).when(home != "", F.regexp_replace(home, "^-+", "")).otherwise(folder)
    named = F.when(source.isin("claude", "cursor"), spelled).when(source == "copilot", F.substring(folder, 1, 12)).otherwise(folder)
    return F.concat(source, F.lit(":"), named)


def discover_projects(files: DataFrame, source: str | None = None) -> DataFrame:
    """display_name, source, project, sessions, size of each project that has files, in this order."""
    inputs = logical_inputs(files)
    if source:
        inputs = inputs.filter(F.col("source") == source)
    by = inputs.groupBy("source", "project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("size").alias("size"))
    return by.select(project_name(F.col("source"), F.col("project")).alias("display_name"), "source", "project", "sessions", "size").orderBy("display_name", "source")


def families(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of every session of which one is among changed (path): a session's own file and its subagents' go together."""
    family = F.regexp_replace(F.regexp_replace("path", r"/subagents/[^/]*$", ""), r"\.jsonl$", "")
    inputs = logical_inputs(files.withColumn("family", family))
    touched = files.withColumn("family", family).join(changed.select("path"), "path", "left_semi").select("family").distinct()
    return files.withColumn("family", family).join(touched, "family", "left_semi").join(inputs.select("path", "source", "project"), "path", "left")


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or whose size or time differs from what is known of them."""
    k = known.select("path", F.col("size").alias("k_size"), F.col("modified").alias("k_modified"))
    return now.join(k, "path", "left").filter(~(F.col("size").eqNullSafe(F.col("k_size")) & F.col("modified").eqNullSafe(F.col("k_modified")))).drop("k_size", "k_modified")
