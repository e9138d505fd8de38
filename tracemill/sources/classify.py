"""Vendor lines to typed events and token usage, as column expressions over parsed JSON.

A line is parsed once into the few fields that matter; which events it stands for is an
array expression, exploded with its place.  No Python runs on the lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tool names by what they do, in lower case with _ for -.
READ_TOOLS = ("read", "read_file", "readmanyfiles", "view", "view_image")
WRITE_TOOLS = ("write", "write_file", "edit", "edit_file", "multiedit", "notebookedit")
PATCH_TOOLS = ("apply_patch", "patch")
SHELL_TOOLS = ("bash", "exec", "exec_command", "shell", "shell_command")
CLOSING = ("session_close", "session_end")
APPROVALS = ("approval_request", "approval_decision")

# Model families and tiers with US dollars a million tokens: input, output, cache read, cache write, reasoning.
PRICE_VERSION = "2026-04-21"
PRICES = {
    ("claude", "opus"): (15.0, 75.0, 1.5, 18.75, 75.0),
    ("claude", "sonnet"): (3.0, 15.0, 0.3, 3.75, 15.0),
    ("claude", "haiku"): (1.0, 5.0, 0.1, 1.25, 5.0),
    ("gpt", "5.4"): (2.5, 15.0, 0.25, 0.0, 15.0),
    ("gpt", "5.4-mini"): (0.75, 4.5, 0.075, 0.0, 4.5),
    ("gpt", "5.4-nano"): (0.2, 1.25, 0.02, 0.0, 1.25),
    ("gpt", "5.3-codex"): (1.75, 14.0, 0.175, 0.0, 14.0),
    ("gpt", "5.2"): (1.75, 14.0, 0.175, 0.0, 14.0),
    ("gpt", "5.2-codex"): (1.75, 14.0, 0.175, 0.0, 14.0),
    ("gpt", "5.1"): (1.25, 10.0, 0.125, 0.0, 10.0),
    ("gpt", "5.1-codex"): (1.25, 10.0, 0.125, 0.0, 10.0),
    ("gpt", "5.1-codex-max"): (1.25, 10.0, 0.125, 0.0, 10.0),
    ("gpt", "5"): (1.25, 10.0, 0.125, 0.0, 10.0),
    ("gpt", "5-codex"): (1.25, 10.0, 0.125, 0.0, 10.0),
    ("gpt", "5-mini"): (0.25, 2.0, 0.025, 0.0, 2.0),
    ("gpt", "5-nano"): (0.05, 0.4, 0.005, 0.0, 0.4),
    ("gpt", "5-pro"): (15.0, 120.0, 0.0, 0.0, 120.0),
    ("gpt", "4.1"): (2.0, 8.0, 0.5, 0.0, 8.0),
    ("gpt", "4.1-mini"): (0.4, 1.6, 0.1, 0.0, 1.6),
    ("gpt", "4o"): (2.5, 10.0, 1.25, 0.0, 10.0),
    ("gpt", "4o-mini"): (0.15, 0.6, 0.075, 0.0, 0.6),
    ("o", "1"): (15.0, 60.0, 0.0, 0.0, 60.0),
    ("o", "1-mini"): (3.0, 12.0, 0.0, 0.0, 12.0),
    ("o", "3"): (2.0, 8.0, 0.0, 0.0, 8.0),
    ("o", "3-mini"): (1.1, 4.4, 0.0, 0.0, 4.4),
    ("o", "4-mini"): (1.1, 4.4, 0.0, 0.0, 4.4),
    ("gemini", "pro"): (1.25, 10.0, 0.0, 0.0, 0.0),
    ("gemini", "flash"): (0.3, 2.5, 0.0, 0.0, 0.0),
    ("gemini", "ultra"): (7.0, 21.0, 0.0, 0.0, 0.0),
}
UNPRICED_GPT_TIERS = ("4-turbo", "4", "3.5")

LINE = "struct<type:string,timestamp:string,message:string,payload:string,model:string>"
MESSAGE = "struct<role:string,timestamp:string,content:string,model:string,usage:string,command:string,output:string,exitCode:string,toolCallId:string>"
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,toolUseId:string,tool_use_id:string,name:string>>"
PAYLOAD = "struct<type:string,name:string,call_id:string,model:string,info:string,exit_code:string,metadata:string>"
EVENT = "struct<type:string,event_key:string,confidence:string,lossiness:string>"
NO_EVENTS = f"array<{EVENT}>"


def _some(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def vendor_time(*candidates: Column) -> tuple[Column, Column]:
    """(time, naive): the first candidate that can be read; one without a zone stops the search and is naive."""
    time, naive, open_ = F.lit(None).cast("timestamp"), F.lit(False), F.lit(True)
    for c in candidates:
        number = F.regexp_like(c, F.lit(r"^\d+(\.\d+)?$"))
        zoned = F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$")), F.try_to_timestamp(c))
        own = F.when(number, F.timestamp_millis(c.try_cast("double").cast("long"))).otherwise(zoned)
        bare = F.regexp_like(c, F.lit(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?$"))
        time = F.when(open_ & time.isNull(), own).otherwise(time)
        naive = naive | (open_ & time.isNull() & F.coalesce(bare, F.lit(False)))
        open_ = open_ & time.isNull() & ~naive
    return time, naive


def tool_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "-", "_")


def _event(kind: Column | str, key: Column | None = None, confidence: Column | str = "high", lossiness: Column | str = "none") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("type"), (key if key is not None else F.lit(None).cast("string")).alias("event_key"), lit(confidence).alias("confidence"), lit(lossiness).alias("lossiness"))


def _if(hit: Column, *events: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), F.array(*events)).otherwise(F.array().cast(NO_EVENTS))


def _key(prefix: str, id: Column) -> Column:
    return F.when(_some(id), F.concat(F.lit(f"{prefix}:"), id))


def _tool_events(name: Column, id: Column, confidence: Column, lossiness: Column) -> Column:
    """A call, what it does to files, and the start of a command."""
    plain = F.coalesce(tool_name(name), F.lit(""))
    made = [_if(F.lit(True), _event("tool_call", _key("tool_call", id), confidence, lossiness))]
    for kind, tools in (("file_read", READ_TOOLS), ("file_write", WRITE_TOOLS), ("patch", PATCH_TOOLS), ("command_start", SHELL_TOOLS)):
        made.append(_if(plain.isin(*tools), _event(kind, _key(kind, id), confidence, lossiness)))
    return F.concat(*made)


def classified(lines: DataFrame) -> DataFrame:
    """lines (client, source_path, source_offset, raw_json) with seq, type, event_key, event_at, confidence and lossiness: a row for each event.

    What isn't JSON or isn't known is one schema_unknown of low confidence.
    """
    parsed = lines.withColumn("l", F.from_json("raw_json", LINE)).withColumn("m", F.from_json(F.col("l.message"), MESSAGE)).withColumn("p", F.from_json(F.col("l.payload"), PAYLOAD))
    parsed = parsed.withColumn("blocks", F.when(F.startswith(F.ltrim(F.col("m.content")), F.lit("[")), F.from_json(F.col("m.content"), BLOCKS)))
    l, m, p, blocks = F.col("l"), F.col("m"), F.col("p"), F.coalesce(F.col("blocks"), F.array().cast(BLOCKS))
    at, naive = vendor_time(m["timestamp"], l["timestamp"])
    sure, loss = F.when(naive, "low").otherwise("high"), F.when(naive, "unknown").otherwise("none")
    kind, role, codex = F.coalesce(l["type"], F.lit("")), F.coalesce(m["role"], F.lit("")), F.col("client") == "codex"
    plain = F.col("blocks").isNull() & _some(m["content"])
    said = plain | F.exists(blocks, lambda b: (b["type"] == "text") & _some(b["text"]))
    thought = F.exists(blocks, lambda b: b["type"].isin("text", "thinking") & (_some(b["text"]) | _some(b["thinking"])))
    results = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: _event("tool_result", _key("tool_result", F.coalesce(b["tool_use_id"], b["toolUseId"])), sure, loss))
    calls = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"].isin("tool_use", "toolCall")), lambda b: _tool_events(b["name"], F.coalesce(b["id"], b["toolUseId"]), sure, loss)))
    empty = F.array().cast(NO_EVENTS)
    bash = F.concat(_if(_some(m["command"]), _event("command_start")), _if(_some(m["output"]), _event("stdout_chunk", None, "low", "unknown")), _if(m["exitCode"].isNotNull(), _event("command_exit")))
    user = F.concat(_if(said, _event("user_message", None, sure, loss)), results)
    assistant = F.concat(_if(thought & F.col("blocks").isNotNull(), _event("assistant_message", None, sure, loss)), calls)
    chat = (
        F.when(kind == "compaction", F.array(_event("compaction", None, sure, "compacted")))
        .when(kind.isin(*CLOSING), F.array(_event("session_close", None, sure, loss)))
        .when(kind == "session", F.array(_event("session_open", None, sure, loss)))
        .when(kind.isin(*APPROVALS), F.array(_event(kind, None, sure, loss)))
        .when(role == "bashExecution", bash)
        .when(role == "toolResult", F.array(_event("tool_result", _key("tool_result", m["toolCallId"]), sure, loss)))
        .when((kind == "user") | ((kind == "message") & (role == "user")), user)
        .when((kind == "assistant") | ((kind == "message") & (role == "assistant")), assistant)
        .otherwise(empty)
    )
    inner = F.coalesce(p["type"], F.lit(""))
    finished = p["exit_code"].isNotNull() | F.get_json_object(p["metadata"], "$.exit_code").isNotNull()
    output = F.concat(F.array(_event("tool_result", _key("tool_result", p["call_id"]), sure, loss)), _if(finished, _event("command_exit", _key("command_exit", p["call_id"]), sure, loss)))
    rollout = (
        F.when(kind == "session_meta", F.array(_event("session_open", None, sure, loss)))
        .when(kind.isin(*CLOSING) | inner.isin(*CLOSING), F.array(_event("session_close", None, sure, loss)))
        .when(kind.isin(*APPROVALS), F.array(_event(kind, None, sure, loss)))
        .when(inner.isin(*APPROVALS), F.array(_event(inner, None, sure, loss)))
        .when(inner.isin("function_call", "custom_tool_call"), _tool_events(p["name"], p["call_id"], sure, loss))
        .when(inner.isin("function_call_output", "custom_tool_call_output"), output)
        .when(inner.isin("reasoning", "agent_reasoning"), F.array(_event("assistant_message", None, "medium", "partial")))
        .when((kind == "event_msg") & (inner == "user_message"), F.array(_event("user_message", None, sure, loss)))
        .when((kind == "event_msg") & (inner == "agent_message"), F.array(_event("assistant_message", None, sure, loss)))
        .otherwise(empty)
    )
    made = F.when(codex, rollout).otherwise(chat)
    broken = l.isNull() | F.expr("try_parse_json(raw_json)").isNull()
    unknown = F.array(_event("schema_unknown", None, "low", F.when(broken, "unknown").otherwise("none")))
    events = F.when(broken, unknown).when(F.size(made) > 0, made).otherwise(unknown)
    return parsed.select(*lines.columns, at.alias("event_at"), F.posexplode(events).alias("seq", "e")).select(*lines.columns, "seq", "e.type", "e.event_key", "event_at", "e.confidence", "e.lossiness")


def model_info(model: Column) -> tuple[Column, Column]:
    """(family, tier) of a vendor's model id; what isn't known keeps its id as tier."""
    name = F.lower(F.trim(model))
    name = F.regexp_replace(name, r"^.*/", "")
    starts = lambda prefix: F.regexp_like(name, F.lit(rf"^{prefix.replace('.', '[.]')}([-_]|$)"))
    choose = lambda hits, rest: reduce(lambda out, hit: F.when(hit[0], hit[1]).otherwise(out), reversed(hits), rest)
    gpt_tiers = sorted([t for f, t in PRICES if f == "gpt"] + list(UNPRICED_GPT_TIERS), key=lambda t: (-len(t), t))
    o_tiers = sorted((t for f, t in PRICES if f == "o"), key=lambda t: (-len(t), t))
    is_o = reduce(lambda a, b: a | b, [starts(f"o{t}") for t in [*o_tiers, "4"]])
    claude, gpt, gemini = (F.contains(name, F.lit(x)) for x in ("claude", "gpt", "gemini"))
    family = F.when(claude, "claude").when(is_o, "o").when(gpt, "gpt").when(gemini, "gemini").otherwise("unknown")
    tier = (
        F.when(claude, choose([(F.contains(name, F.lit(t)), t) for t in ("opus", "sonnet", "haiku")], name))
        .when(is_o, choose([(starts(f"o{t}"), t) for t in [*o_tiers, "4"]], name))
        .when(gpt, choose([(starts(f"gpt-{t}"), t) for t in gpt_tiers], name))
        .when(gemini, choose([(F.contains(name, F.lit(t)), t) for t in ("flash", "pro", "ultra")], name))
        .otherwise(F.coalesce(F.trim(model), F.lit("")))
    )
    return family, tier


def _whole(text: Column) -> Column:
    """An integer, or a number without a fraction; else null."""
    number = F.when(F.regexp_like(text, F.lit(r"^-?\d+(\.0+)?$")), text)
    return number.cast("double").cast("long")


def token_usage(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines with usage: model, family, tier, input, output, cache_read, cache_write, reasoning (null where not given), data_source and cost_estimate.

    order: columns by which the lines of a source_path follow each other; a model that a
    rollout names holds until the next.  A price that isn't known leaves the cost null.
    """
    from pyspark.sql.window import Window

    j = lambda path: F.get_json_object("raw_json", path)
    codex = F.col("client") == "codex"
    u, t = "$.message.usage.", "$.payload.info.last_token_usage."
    chat = {
        "input": j(u + "input_tokens"), "output": j(u + "output_tokens"), "cache_read": F.coalesce(j(u + "cache_read_input_tokens"), j(u + "cache_read_tokens")),
        "cache_write": F.coalesce(j(u + "cache_creation_input_tokens"), j(u + "cache_creation_tokens")), "reasoning": j(u + "reasoning_tokens"),
    }
    rollout = {"input": j(t + "input_tokens"), "output": j(t + "output_tokens"), "cache_read": j(t + "cached_input_tokens"), "cache_write": F.lit(None).cast("string"), "reasoning": j(t + "reasoning_output_tokens")}
    tokens = {k: _whole(F.when(codex, rollout[k]).otherwise(chat[k])) for k in chat}
    w = Window.partitionBy("source_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    threaded = F.last(F.when(codex & (j("$.type") == "turn_context"), j("$.payload.model")), ignorenulls=True).over(w)
    model = F.when(codex, threaded).otherwise(F.coalesce(j("$.message.model"), j("$.model")))
    gate = F.when(codex, (j("$.type") == "event_msg") & (j("$.payload.type") == "token_count")).otherwise(j("$.type") == "assistant")
    rows = lines.withColumn("model", model).withColumn("is_usage", F.coalesce(gate, F.lit(False)))
    rows = rows.withColumns(tokens).filter(F.col("is_usage") & reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in tokens])).drop("is_usage")
    family, tier = model_info(F.col("model"))
    rows = rows.withColumn("family", family).withColumn("tier", tier).withColumn("data_source", F.lit("api")).withColumn("pricing_table_version", F.lit(PRICE_VERSION))
    return rows.withColumn("cost_estimate", cost(F.col("family"), F.col("tier"), *[F.col(k) for k in ("input", "output", "cache_read", "cache_write", "reasoning")]))


def cost(family: Column, tier: Column, *tokens: Column) -> Column:
    """US dollars of input, output, cache_read, cache_write and reasoning tokens; null without a price."""
    table = F.create_map(*[x for (f, t), prices in PRICES.items() for x in (F.lit(f"{f}/{t}"), F.array(*map(F.lit, prices)))])
    price = F.try_element_at(table, F.concat_ws("/", family, tier))
    return sum((F.coalesce(n, F.lit(0)) * price[i] for i, n in enumerate(tokens[1:], 1)), F.coalesce(tokens[0], F.lit(0)) * price[0]) / 1_000_000
