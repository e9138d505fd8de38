"""The driver's tables as frames of the event domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recorder events: the user is the session."""
    e = table(spark, sf_dir, "events")
    client = F.when(F.col("user_id") % 3 == 0, "claude").when(F.col("user_id") % 3 == 1, "codex").otherwise("openclaw")
    confidence = F.when(F.col("event_id") % 4 == 0, "low").when(F.col("event_id") % 4 == 1, "medium").otherwise("high")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("type"), F.col("ts").alias("event_at"),
        client.alias("client"), confidence.alias("confidence"), F.lit("recorder").alias("source"), F.lit("none").alias("lossiness"),
        F.concat("event_type", F.lit(":"), (F.col("event_id") % 500).cast("string")).alias("event_key"),
        F.concat(client, F.lit(":ws"), (F.col("user_id") % 7).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("session_key"),
        F.lit("events").alias("source_path"), F.col("event_id").alias("source_offset"), F.lit(0).alias("seq"),
        "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("props").alias("raw_json"),
    )


#: The same frame in SQL.
EVENTS_SQL = """ev AS (
    SELECT event_id AS id, user_id AS session_id, event_type AS type, ts AS event_at,
        CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'openclaw' END AS client,
        CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
        event_type || ':' || (event_id % 500) AS event_key,
        CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'openclaw' END || ':ws' || (user_id % 7) || ':' || user_id AS session_key,
        value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
)"""


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as a token ledger: an order is a session, a line a turn."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = line.join(order, line.l_orderkey == order.o_orderkey)
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("event_at"),
        F.when(F.col("l_returnflag") == "N", "api").otherwise("estimated").alias("data_source"), F.col("l_linestatus").alias("model"), F.col("o_orderpriority").alias("service_tier"),
        F.lit("p").alias("provider"), F.lit("v1").alias("pricing_table_version"), F.concat(F.lit("claude:"), F.col("o_orderstatus"), F.lit(":"), F.col("o_orderkey").cast("string")).alias("session_key"),
        F.col("l_quantity").cast("long").alias("input"), F.lit(None).cast("long").alias("output"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost_cents"),
    )


USAGE_SQL = """us AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, o_orderkey AS session_id, o_orderdate AS event_at,
        CASE WHEN l_returnflag = 'N' THEN 'api' ELSE 'estimated' END AS data_source, l_linestatus AS model, o_orderpriority AS service_tier,
        CAST(l_quantity AS BIGINT) AS input_tokens, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; n_tools, how many tools a message used, is made from its length."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), "role", (F.length("text") % 6).cast("long").alias("n_tools"), "text")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the wide table of sessions; what orders lack is made from the key."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n).cast("int") + 1)
    unless = lambda n, value: F.when(k % n != 0, value)
    start = unless(97, F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=k * 7919 % 86400))
    lists = lambda n, *values: F.element_at(F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in values]), (k % n).cast("int") + 1)
    tools = F.map_from_arrays(F.array(*map(F.lit, ("Read", "Grep", "Edit", "Bash"))), F.array(k % 5, k % 2, k % 3, k % 7))
    out = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), k.cast("string")).alias("session_id"), F.concat(F.lit("proj-"), (F.col("o_custkey") % 25).cast("string")).alias("project"),
        pick(6, "claude", "codex", "openclaw", "cursor", "gemini", "aider").alias("source"), pick(7, "large-1", "large-1", "large-2", "small-1", "small-2", "<synthetic>", None).alias("model"), pick(4, "high", "", None, None).alias("model_effort"),
        start.alias("start_time"), unless(41, k * 37 % 5400).alias("duration_seconds"), (k % 13).alias("user_messages"), (k % 17).alias("assistant_messages"), (k % 61).alias("tool_uses"),
        unless(53, k * 131 % 90000).alias("input_tokens"), (k * 17 % 9000).alias("output_tokens"), F.when(k % 3 != 1, k * 11 % 70000).alias("cache_read_tokens"), (k * 5 % 4000).alias("cache_creation_tokens"),
        unless(31, (k * 29 % 700) / F.lit(100.0)).alias("estimated_cost_usd"), (k % 4).alias("user_interrupts"),
        pick(8, "tests_passed", "tests_failed", "build_failed", "errored", "completed", "partial", "analysis_only", None).alias("outcome_badge"), pick(9, "resolved", "partial", "failed", "odd", None, None, None, None, None).alias("ai_outcome_badge"),
        unless(6, k % 5 + 1).alias("ai_quality_score"), unless(29, pick(5, "documentation", "debugging", "testing", "feature", "unknown")).alias("task_type"), pick(11, "configuration", "debugging", *[None] * 9).alias("ai_task_type"),
        lists(3, ["tool_rich"], ["long_horizon", "debugging"], []).alias("value_badges"), F.when(k % 8 == 0, F.array(F.lit("novel_domain"))).alias("ai_value_badges"),
        lists(4, ["secrets_detected"], ["private_url", "manual_review"], [], []).alias("risk_badges"), F.when(k % 10 == 0, F.array().cast("array<string>")).alias("ai_risk_badges"),
        unless(19, tools).alias("tool_counts"), F.when(k % 23 == 0, "segmented").otherwise(pick(3, "approved", "new", "shortlisted")).alias("review_status"),
        F.when(k % 12 == 0, F.concat(F.lit("sh"), (k % 5).cast("string"))).alias("share_id"), pick(5, "pending_review", "embargoed", "released", None, None).alias("hold_state"),
        F.when(k % 10 == 1, F.lit("2024-01-01 00:00:00")).when(k % 15 == 1, F.lit("2030-01-01 00:00:00")).cast("timestamp_ntz").alias("embargo_until"),
        F.when(k % 15 == 0, "/clear").when(k % 15 == 5, "/fix the build").otherwise(F.concat(F.lit("Task "), k.cast("string"))).alias("display_title"),
        F.concat(F.lit("key:"), (k - k % 4).cast("string")).alias("session_key"), F.concat(F.lit("file"), (k % 300).cast("string")).alias("raw_source_path"),
    )
    return out.withColumn("end_time", F.col("start_time") + F.make_dt_interval(secs=F.col("duration_seconds")))


def _picked(n: int, *values: str | None) -> str:
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


#: The same table in SQL; tool counts are the columns Read, Grep, Edit, Bash.
WIDE_SQL = f"""ws AS (
    SELECT *, start_time + to_seconds(duration_seconds) AS end_time FROM (
    SELECT 's' || k AS session_id, 'proj-' || (o_custkey % 25) AS project, {_picked(6, "claude", "codex", "openclaw", "cursor", "gemini", "aider")} AS source,
        {_picked(7, "large-1", "large-1", "large-2", "small-1", "small-2", "<synthetic>")} AS model, {_picked(4, "high", "")} AS model_effort,
        CASE WHEN k % 97 <> 0 THEN o_orderdate + to_seconds(k * 7919 % 86400) END AS start_time, CASE WHEN k % 41 <> 0 THEN k * 37 % 5400 END AS duration_seconds,
        k % 13 AS user_messages, k % 17 AS assistant_messages, k % 61 AS tool_uses, CASE WHEN k % 53 <> 0 THEN k * 131 % 90000 END AS input_tokens, k * 17 % 9000 AS output_tokens,
        CASE WHEN k % 3 <> 1 THEN k * 11 % 70000 END AS cache_read_tokens, k * 5 % 4000 AS cache_creation_tokens, CASE WHEN k % 31 <> 0 THEN CAST(k * 29 % 700 AS DOUBLE) / 100 END AS estimated_cost_usd,
        k % 4 AS user_interrupts, {_picked(8, "tests_passed", "tests_failed", "build_failed", "errored", "completed", "partial", "analysis_only")} AS outcome_badge,
        {_picked(9, "resolved", "partial", "failed", "odd")} AS ai_outcome_badge, CASE WHEN k % 6 <> 0 THEN k % 5 + 1 END AS ai_quality_score,
        CASE WHEN k % 29 <> 0 THEN {_picked(5, "documentation", "debugging", "testing", "feature", "unknown")} END AS task_type, {_picked(11, "configuration", "debugging")} AS ai_task_type,
        CASE k % 3 WHEN 0 THEN ['tool_rich'] WHEN 1 THEN ['long_horizon', 'debugging'] ELSE [] END AS value_badges, CASE WHEN k % 8 = 0 THEN ['novel_domain'] END AS ai_value_badges,
        CASE k % 4 WHEN 0 THEN ['secrets_detected'] WHEN 1 THEN ['private_url', 'manual_review'] ELSE [] END AS risk_badges, CASE WHEN k % 10 = 0 THEN [] END AS ai_risk_badges,
        k % 19 <> 0 AS counted, k % 5 AS "Read", k % 2 AS "Grep", k % 3 AS "Edit", k % 7 AS "Bash",
        CASE WHEN k % 23 = 0 THEN 'segmented' ELSE {_picked(3, "approved", "new", "shortlisted")} END AS review_status, CASE WHEN k % 12 = 0 THEN 'sh' || (k % 5) END AS share_id,
        {_picked(5, "pending_review", "embargoed", "released")} AS hold_state, CASE WHEN k % 10 = 1 THEN TIMESTAMP '2024-01-01' WHEN k % 15 = 1 THEN TIMESTAMP '2030-01-01' END AS embargo_until,
        CASE WHEN k % 15 = 0 THEN '/clear' WHEN k % 15 = 5 THEN '/fix the build' ELSE 'Task ' || k END AS display_title,
        'key:' || (k - k % 4) AS session_key, 'file' || (k % 300) AS raw_source_path
    FROM (SELECT *, o_orderkey AS k FROM orders)))"""
