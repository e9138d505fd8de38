"""Lists, dashboards, insights, advice, gates and shares over the wide table of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import workbench as W
from ..operators.canonical import capability_matrix, coverage
from ..sources.fixtures import EVENTS_SQL, USAGE_SQL, WIDE_SQL, events, sessions, token_usage

NOW = "2024-06-01 00:00:00"
EXCLUDED = ("proj-3", "codex:proj-4")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _shares(spark: SparkSession) -> DataFrame:
    """Five shares, of which the even ones were sent out."""
    return spark.range(5).select(F.concat(F.lit("sh"), F.col("id").cast("string")).alias("share_id"), F.when(F.col("id") % 2 == 0, F.lit(NOW)).alias("shared_at"), (F.col("id") % 3).alias("created_at"))


def _links(s: DataFrame) -> DataFrame:
    return s.filter("user_messages = 5").select(F.concat(F.lit("sh"), (F.col("tool_uses") % 4).cast("string")).alias("share_id"), "session_id")


def _findings(s: DataFrame) -> DataFrame:
    return s.select("session_id", F.when(F.col("tool_uses") % 9 == 0, "open").otherwise("ignored").alias("status"), F.concat(F.lit("e"), (F.col("tool_uses") % 6).cast("string")).alias("entity_type"))


def _requested(spark: SparkSession) -> DataFrame:
    return spark.range(1, 400).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.concat(F.lit("key:"), F.col("id").cast("string")).alias("session_key"))


def _policies(spark: SparkSession) -> DataFrame:
    rows = [("block_domain", "b.example", 2), ("block_domain", "a.example", 1), ("block_domain", "b.example", 3), ("redact_string", "x", 1), ("other", "y", 1), ("exclude_project", "p", 4)]
    return spark.createDataFrame([(f"p{i}", *r) for i, r in enumerate(rows)], "policy_id string, policy_type string, value string, created_at long")


def _on(f, *args, **kwargs):
    return lambda spark, d: f(sessions(spark, d), *args, **kwargs)


def timeline_enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    usage = e.filter("type = 'purchase'").select(F.col("id").alias("event_id"), F.col("k").alias("input"), (F.col("k") / 4).alias("cost_estimate"))
    odd = e.filter("k > 90").select(F.col("id").alias("turn_event_id"), F.lit("input_spike").alias("kind")).union(e.filter("k > 95").select("id", F.lit("model_shift")))
    loops = e.filter("k = 7").select(F.col("id").alias("first_event_id"), F.lit("loop_exact_repeat").alias("kind"))
    t = W.timeline(e.select("id", "session_id", "type"), usage, odd, loops)
    return t.select("id", "input", "cost", F.array_join("anomalies", ",").alias("anomalies"), F.array_join("incidents", ",").alias("incidents"))


def timeline_counters(spark: SparkSession, d: str) -> DataFrame:
    return W.timeline_counters(events(spark, d).withColumn("origin", F.when(F.col("k") % 5 == 0, "hook").otherwise("base")).withColumn("lossiness", F.when(F.col("k") % 7 == 0, "partial").otherwise("none")))


def ledger_health(spark: SparkSession, d: str) -> DataFrame:
    return W.ledger_health(token_usage(spark, d), "data_source", "id")


def parent_backfill(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).select(F.col("session_id").alias("id"), F.concat(F.lit("k"), F.col("session_id").cast("string")).alias("session_key"), F.when(F.col("session_id") % 3 == 1, F.concat(F.lit("k"), (F.col("session_id") - 1).cast("string"))).alias("parent_session_key"), F.when(F.col("session_id") % 9 == 1, F.lit(-1).cast("long")).alias("parent_session_id")).distinct()
    return W.with_parents(s).select("id", "parent_session_id")


def bridge_keys(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("source_path", F.concat(F.lit("file"), (F.col("id") % 200).cast("string")))
    return W.bridged_keys(sessions(spark, d), e, F.concat(F.lit("path:"), F.col("raw_source_path")))


def import_remap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    asked = e.filter("k < 50").select("source_path", (F.col("source_offset") * 2).alias("source_offset"), "seq")
    found = W.remapped(asked, e, ("source_path", "source_offset", "seq"))
    return found.agg(F.count(F.lit(1)).alias("asked"), F.count("local_id").alias("found"), F.sum("local_id").alias("ids"))


def inspect_event(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("origin", F.when(F.col("k") % 2 == 0, "hook").otherwise("base"))
    key = e.filter("id = 77").select("session_id", "event_key").first()
    return W.inspected(e, session=key["session_id"], key=key["event_key"]).select("id", "origin")


def advisor_stats(spark: SparkSession, d: str) -> DataFrame:
    return W.advisor_totals(W.between(sessions(spark, d), "1995-01-01", "1996-12-31"))


def quiet_days(spark: SparkSession, d: str) -> DataFrame:
    """The four weekdays of fewest sessions, those of fewer than the mean."""
    s = sessions(spark, d).filter("start_time is not null")
    return W.low_days(s, days=4, fewer=F.lit(s.count() / 7))


def focus_projects(spark: SparkSession, d: str) -> DataFrame:
    f = W.focus(sessions(spark, d))
    tasks = F.array_join(F.transform(F.map_entries("tasks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return f.select("project", "sessions", "tokens", "cost", tasks.alias("tasks"))


def share_ready_counts(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    return W.share_ready_stats(W.share_ready(s, _shares(spark), _links(s), EXCLUDED))


def share_view(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    return W.share_sessions(_shares(spark), _links(s).filter("share_id <> 'sh1'"), s)


def share_create(spark: SparkSession, d: str) -> DataFrame:
    return W.share_links(_requested(spark).select(F.lit("new").alias("share_id"), "session_id"), sessions(spark, d))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    return W.release_blockers(_requested(spark), sessions(spark, d), _now())


def export_gates(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    return W.export_gate(_requested(spark), s, _findings(s), EXCLUDED, _now())


def review_updates(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    changes = s.filter("tool_uses = 7").select("session_id", F.when(F.col("user_interrupts") > 1, "blocked").alias("status"), F.when(F.col("user_interrupts") < 3, F.lit(4)).cast("long").alias("score"))
    return W.reviewed(s, changes)


def policy_merge(spark: SparkSession, d: str) -> DataFrame:
    return W.merged_policies(_policies(spark)).select("policy_type", F.array_join("values", ",").alias("values"))


def latest_sessions(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_by_key(sessions(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).withColumn("indexed_at", F.when(F.col("user_messages") == 1, F.col("end_time"))))


def redaction_summary(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(sessions(spark, d))
    return f.groupBy("entity_type", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def hold_history(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("session_id", F.col("id").alias("history_id"), F.col("event_at").alias("changed_at"), F.element_at(F.array(*map(F.lit, ("pending_review", "embargoed", "released"))), (F.col("k") % 3 + 1).cast("int")).alias("state"))
    return W.hold_history(e, 5).select("history_id", "state")


def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    types = spark.createDataFrame([("view",), ("click",), ("refund",), ("patch",)], "type string")
    matrix = capability_matrix(types, e.select("session_id").distinct(), e.filter("type <> 'click' or k % 50 = 0"), e.limit(0))
    return coverage(matrix, types.filter("type <> 'patch'")).select("session_id", "state", F.array_join("types", ",").alias("types"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    c = sessions(spark, d).select("session_id", "start_time", "end_time", F.coalesce("model", F.lit("claude-opus-4-20250514")).alias("model"))
    key = F.concat(F.when(F.length("session_id") % 2 == 0, "npm_").otherwise("k"), F.md5("session_id"))
    return c.select("session_id", T.masked(key).alias("masked"), T.short_model(F.col("model")).alias("model"), T.squashed(F.concat(F.lit("  a  b "), F.col("session_id"), F.lit(" and some more words")), 16).alias("short"), T.seconds_between(F.col("start_time"), F.col("end_time")).alias("seconds"), T.time_ago(F.col("end_time"), F.lit("1998-08-03 00:00:00").cast("timestamp_ntz")).alias("ago"))


QUERIES = {
    "session_page": lambda s, d: W.session_list(sessions(s, d), status="approved", sort="ai_quality_score", limit=40, offset=20).select("session_id", "ai_quality_score"),
    "session_page_fallback": lambda s, d: W.session_list(sessions(s, d), source="codex", task_type="debugging", sort="no such", descending=False, limit=25).select("session_id"),
    "sessions_between": lambda s, d: W.between(sessions(s, d), "1995-03-01", "1995-03-31").select("session_id"),
    "score_queue": lambda s, d: W.not_scored(sessions(s, d), 30).select("session_id"),
    "slash_commands": lambda s, d: W.without_commands(sessions(s, d)).select("session_id", "display_title"),
    "settled_sessions": lambda s, d: W.settled(sessions(s, d), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("session_id"),
    "outside_projects": lambda s, d: W.outside_projects(sessions(s, d), EXCLUDED).select("session_id"),
    "real_models": lambda s, d: W.real_models(sessions(s, d)).select("session_id", "model"),
    "export_fields": lambda s, d: W.exported(sessions(s, d)).drop("value_badges", "risk_badges", "start_time", "end_time"),
    "session_counts": _on(W.counts_by, "source", "project", "task", "review_status"),
    "workbench_summary": _on(W.summary),
    "mean_interrupts": _on(W.mean_interrupts),
    "value_badges": _on(W.badges, "ai_value_badges", "value_badges"),
    "risk_badges": _on(W.badges, "ai_risk_badges", "risk_badges"),
    "task_types": _on(W.by_task),
    "tokens_by_source": _on(W.tokens_by_source),
    "insights_heatmap": _on(W.heatmap),
    "focus_projects": focus_projects,
    "duration_vs_score": _on(W.duration_and_score),
    "insights_models": _on(W.model_effectiveness),
    "tool_usage": _on(W.tool_usage),
    "daily_trends": _on(W.trends),
    "cost_by_model": _on(W.cost_by_model),
    "project_sources": _on(W.project_sources),
    "advisor_stats": advisor_stats,
    "advisor_models": _on(W.advisor_models),
    "advisor_tasks": _on(W.advisor_tasks),
    "advisor_scores": _on(W.advisor_scores),
    "advisor_candidates": _on(W.downgrades),
    "advisor_interrupts": _on(W.interrupts_by_model),
    "advisor_recommendations": _on(W.recommendations),
    "quiet_days": quiet_days,
    "timeline_enrichment": timeline_enrichment,
    "timeline_counters": timeline_counters,
    "ledger_health": ledger_health,
    "parent_backfill": parent_backfill,
    "bridge_keys": bridge_keys,
    "import_remap": import_remap,
    "inspect_event": inspect_event,
    "share_ready_counts": share_ready_counts,
    "share_view": share_view,
    "share_create": share_create,
    "share_list": lambda s, d: W.share_list(_shares(s)),
    "release_gate": release_gate,
    "export_gates": export_gates,
    "review_updates": review_updates,
    "policy_merge": policy_merge,
    "latest_sessions": latest_sessions,
    "redaction_summary": redaction_summary,
    "hold_history": hold_history,
    "coverage_buckets": coverage_buckets,
    "text_functions": text_functions,
    "unscored_count": lambda s, d: sessions(s, d).filter("ai_quality_score is null").agg(F.count(F.lit(1)).alias("n")),
}

_W, _E, _U = f"WITH {WIDE_SQL}", f"WITH {EVENTS_SQL}", f"WITH {USAGE_SQL}"
_TASK = "coalesce(ai_task_type, task_type)"
_MODEL = "CASE WHEN model_effort <> '' THEN model || ' @ ' || model_effort ELSE model END"
_REAL = "model IS NOT NULL AND model <> '<synthetic>'"
_TOKENS = "CAST(sum(coalesce(input_tokens, 0) + output_tokens + coalesce(cache_read_tokens, 0) + cache_creation_tokens) AS BIGINT)"
_COST, _MEAN_COST = "round(sum(estimated_cost_usd), 4)", "round(sum(estimated_cost_usd), 4) / nullif(count(estimated_cost_usd), 0)"
_RESOLVED = "(ai_outcome_badge = 'resolved' OR (ai_outcome_badge IS NULL AND outcome_badge = 'tests_passed'))"
_OUTCOME = """CASE WHEN ai_outcome_badge IN ('resolved', 'partial', 'failed') THEN ai_outcome_badge WHEN ai_outcome_badge IS NOT NULL THEN 'unknown'
    WHEN outcome_badge = 'tests_passed' THEN 'resolved' WHEN outcome_badge IN ('tests_failed', 'build_failed', 'errored') THEN 'failed' WHEN outcome_badge = 'completed' THEN 'inconclusive'
    WHEN outcome_badge = 'partial' THEN 'interrupted' WHEN outcome_badge = 'analysis_only' THEN 'exploratory' ELSE 'unscored' END"""
_SHARE = f"CAST(count(*) FILTER ({_RESOLVED}) AS DOUBLE) / count(*)"
_STATE = f"CASE WHEN hold_state = 'embargoed' AND embargo_until <= TIMESTAMP '{NOW}' THEN 'released' ELSE coalesce(hold_state, 'auto_redacted') END"
_OUT = "(project = 'proj-3' OR source || ':' || project = 'codex:proj-4')"
_SHARES = "sh AS (SELECT 'sh' || i AS share_id, i % 2 = 0 AS sent FROM range(5) t(i)), lk AS (SELECT 'sh' || (tool_uses % 4) AS share_id, session_id FROM ws WHERE user_messages = 5)"
_DOWN = f"(SELECT session_id, {_MODEL} AS model, {_TASK} AS task, ai_quality_score AS score, estimated_cost_usd AS cost FROM ws WHERE estimated_cost_usd > 1 AND ai_quality_score <= 3 AND {_TASK} IN ('docs', 'documentation', 'testing', 'formatting', 'config', 'configuration') ORDER BY cost DESC, session_id LIMIT 5)"
_TOTALS = f"count(*) AS sessions, coalesce({_COST}, 0) AS cost, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(count(*) FILTER (duration_seconds > 1800 AND ai_quality_score <= 2) AS BIGINT) AS long_low, CAST(count(*) FILTER (duration_seconds < 600 AND ai_quality_score >= 4) AS BIGINT) AS short_high"
_MODELS = f"SELECT {_MODEL} AS model, count(*) AS sessions, coalesce({_COST}, 0) AS cost, avg(ai_quality_score) AS mean_score, {_SHARE} AS resolve_rate FROM ws WHERE {_REAL} GROUP BY 1"
_TASKS = f"SELECT {_TASK} AS task, count(*) AS sessions, coalesce({_COST}, 0) AS cost, avg(ai_quality_score) AS mean_score FROM ws WHERE {_TASK} IS NOT NULL GROUP BY 1"
_INTERRUPTS = f"SELECT {_MODEL} AS model, avg(user_interrupts) AS mean_interrupts, count(*) AS sessions, CAST(sum(tool_uses) AS BIGINT) AS tool_uses FROM ws WHERE {_REAL} AND user_interrupts > 0 GROUP BY 1"
_TOOLS = "(SELECT unnest(['Read', 'Grep', 'Edit', 'Bash']) AS tool, unnest([\"Read\", \"Grep\", \"Edit\", \"Bash\"]) AS calls FROM ws WHERE counted)"
_WANT = "rq AS (SELECT 's' || i AS session_id, 'key:' || i AS session_key FROM range(1, 400) t(i))"

SQL = {
    "session_page": f"{_W} SELECT session_id, ai_quality_score FROM ws WHERE review_status = 'approved' ORDER BY ai_quality_score DESC NULLS LAST, start_time DESC NULLS LAST, session_id LIMIT 40 OFFSET 20",
    "session_page_fallback": f"{_W} SELECT session_id FROM ws WHERE review_status <> 'segmented' AND source = 'codex' AND {_TASK} = 'debugging' ORDER BY start_time DESC NULLS LAST, session_id LIMIT 25",
    "sessions_between": f"{_W} SELECT session_id FROM ws WHERE CAST(start_time AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'",
    "score_queue": f"{_W} SELECT session_id FROM ws WHERE ai_quality_score IS NULL ORDER BY start_time DESC NULLS LAST, session_id LIMIT 30",
    "slash_commands": f"{_W} SELECT session_id, display_title FROM ws WHERE display_title <> '/clear'",
    "settled_sessions": f"{_W} SELECT session_id FROM ws WHERE end_time <= TIMESTAMP '1995-12-31 23:58:00'",
    "outside_projects": f"{_W} SELECT session_id FROM ws WHERE NOT {_OUT}",
    "real_models": f"{_W} SELECT session_id, model FROM ws WHERE {_REAL}",
    "export_fields": f"{_W} SELECT session_id, project, source, model, duration_seconds, user_messages, assistant_messages, tool_uses, input_tokens, output_tokens, display_title, outcome_badge, ai_quality_score, task_type FROM ws",
    "session_counts": f"{_W} SELECT 'source' AS field, source AS value, count(*) AS n FROM ws GROUP BY 2 UNION ALL SELECT 'project', project, count(*) FROM ws GROUP BY 2 UNION ALL SELECT 'task', {_TASK}, count(*) FROM ws WHERE {_TASK} IS NOT NULL GROUP BY 2 UNION ALL SELECT 'review_status', review_status, count(*) FROM ws GROUP BY 2",
    "workbench_summary": f"{_W} SELECT count(*) AS sessions, {_TOKENS} AS tokens, count(DISTINCT project) AS projects, count(DISTINCT source) AS sources, {_COST} AS cost FROM ws",
    "mean_interrupts": f"{_W} SELECT avg(user_interrupts) AS mean_interrupts FROM ws WHERE user_interrupts > 0",
    "value_badges": f"{_W} SELECT badge, count(*) AS n FROM (SELECT unnest(coalesce(ai_value_badges, value_badges)) AS badge FROM ws) GROUP BY 1",
    "risk_badges": f"{_W} SELECT badge, count(*) AS n FROM (SELECT unnest(coalesce(ai_risk_badges, risk_badges)) AS badge FROM ws) GROUP BY 1",
    "task_types": f"{_W} SELECT {_TASK} AS task, count(*) AS n FROM ws WHERE {_TASK} IS NOT NULL GROUP BY 1",
    "tokens_by_source": f"{_W} SELECT source, CAST(sum(input_tokens) + sum(coalesce(cache_read_tokens, 0)) + sum(cache_creation_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ws GROUP BY 1",
    "insights_heatmap": f"{_W} SELECT strftime(start_time, '%Y-%m-%d') AS day, hour(start_time) AS hour, count(*) AS sessions, {_TOKENS} AS tokens, coalesce({_COST}, 0) AS cost FROM ws WHERE start_time IS NOT NULL GROUP BY 1, 2",
    "focus_projects": f"{_W}, p AS (SELECT project, count(*) AS sessions, {_TOKENS} AS tokens, coalesce({_COST}, 0) AS cost FROM ws WHERE start_time IS NOT NULL GROUP BY 1 ORDER BY sessions DESC, project LIMIT 20), t AS (SELECT project, {_TASK} AS task, count(*) AS n FROM ws WHERE start_time IS NOT NULL AND {_TASK} IS NOT NULL GROUP BY 1, 2), a AS (SELECT project, string_agg(task || '=' || n, ',' ORDER BY task) AS tasks FROM t GROUP BY 1) SELECT p.*, tasks FROM p JOIN a USING (project)",
    "duration_vs_score": f"{_W} SELECT session_id, duration_seconds, ai_quality_score, {_OUTCOME} AS resolution, estimated_cost_usd AS cost FROM ws WHERE start_time IS NOT NULL AND duration_seconds IS NOT NULL AND ai_quality_score IS NOT NULL ORDER BY start_time DESC, session_id LIMIT 200",
    "insights_models": f"{_W} SELECT {_MODEL} AS model, count(*) AS sessions, avg(ai_quality_score) AS mean_score, {_SHARE} AS resolve_rate, {_MEAN_COST} AS mean_cost, {_COST} AS cost FROM ws WHERE {_REAL} AND start_time IS NOT NULL GROUP BY 1",
    "tool_usage": f"{_W} SELECT tool, CAST(sum(calls) AS BIGINT) AS calls FROM {_TOOLS} GROUP BY 1 ORDER BY calls DESC, tool LIMIT 20",
    "daily_trends": f"{_W} SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS sessions, {_MEAN_COST} AS mean_cost, avg(duration_seconds) AS mean_duration, {_SHARE} AS resolve_rate FROM ws WHERE start_time IS NOT NULL GROUP BY 1",
    "cost_by_model": f"{_W} SELECT {_MODEL} AS model, coalesce({_COST}, 0) AS cost FROM ws WHERE {_REAL} AND start_time IS NOT NULL GROUP BY 1",
    "project_sources": f"{_W} SELECT project, source, count(*) AS sessions, {_TOKENS} AS tokens FROM ws GROUP BY 1, 2",
    "advisor_stats": f"{_W} SELECT {_TOTALS} FROM ws WHERE CAST(start_time AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "advisor_models": f"{_W} {_MODELS}",
    "advisor_tasks": f"{_W} {_TASKS}",
    "advisor_scores": f"{_W} SELECT ai_quality_score AS score, count(*) AS sessions, {_MEAN_COST} AS mean_cost FROM ws WHERE ai_quality_score IS NOT NULL GROUP BY 1",
    "advisor_candidates": f"{_W} SELECT * FROM {_DOWN}",
    "advisor_interrupts": f"{_W} {_INTERRUPTS}",
    "advisor_recommendations": f"""{_W}, t AS (SELECT {_TOTALS} FROM ws), m AS ({_MODELS}), k AS ({_TASKS}), i AS ({_INTERRUPTS}), g AS (SELECT dayname(start_time) AS day, count(*) AS n FROM ws WHERE start_time IS NOT NULL GROUP BY 1 ORDER BY n, day LIMIT 2),
        e AS (SELECT count(*) AS n, max_by(model, (mean_score, model)) AS best, min_by(model, (cost / sessions, model)) AS cheapest, max(mean_score) AS s FROM m WHERE mean_score > 0)
        SELECT 'model_downgrade' AS kind, 'high' AS priority, CAST(count(*) AS VARCHAR) AS subject, round(.6 * sum(cost), 4) AS amount FROM {_DOWN} HAVING count(*) > 0
        UNION ALL SELECT 'session_efficiency', 'medium', CAST(short_high AS VARCHAR), long_low FROM t WHERE long_low >= 3
        UNION ALL SELECT 'unused_capacity', 'medium', string_agg(day, ' and ' ORDER BY day), count(*) FROM g WHERE n < 3 HAVING count(*) > 0
        UNION ALL SELECT * FROM (SELECT 'high_roi', 'low', task, round(mean_score, 4) FROM k WHERE mean_score > 0 AND (SELECT count(*) FROM k) >= 2 ORDER BY mean_score DESC, task LIMIT 1) WHERE 4 >= 0 AND (SELECT max(mean_score) FROM k) >= 3.5
        UNION ALL SELECT 'model_comparison', 'low', best || ' / ' || cheapest, round(s, 4) FROM e WHERE n >= 2 AND best <> cheapest
        UNION ALL SELECT 'agent_steering', 'medium', * FROM (SELECT model, round(mean_interrupts, 4) AS x FROM i ORDER BY mean_interrupts DESC, model LIMIT 1) WHERE x >= 2""",
    "quiet_days": f"{_W} SELECT * FROM (SELECT dayname(start_time) AS day, count(*) AS sessions FROM ws WHERE start_time IS NOT NULL GROUP BY 1 ORDER BY sessions, day LIMIT 4) WHERE sessions < (SELECT count(start_time) / 7 FROM ws)",
    "timeline_enrichment": f"{_E} SELECT id, CASE WHEN type = 'purchase' THEN k END AS input, CASE WHEN type = 'purchase' THEN k / 4 END AS cost, CASE WHEN k > 95 THEN 'input_spike,model_shift' WHEN k > 90 THEN 'input_spike' END AS anomalies, CASE WHEN k = 7 THEN 'loop_exact_repeat' END AS incidents FROM ev",
    "timeline_counters": f"{_E} SELECT session_id, count(*) AS events, CAST(count(*) FILTER (k % 5 <> 0) AS BIGINT) AS direct, CAST(count(*) FILTER (k % 7 = 0) AS BIGINT) AS lossy, CAST(count(*) FILTER (confidence = 'low') AS BIGINT) AS low FROM ev GROUP BY 1",
    "ledger_health": f"{_U} SELECT data_source AS kind, count(*) AS n, max(id) AS last FROM us GROUP BY 1",
    "parent_backfill": f"{_E}, s AS (SELECT DISTINCT session_id AS id FROM ev) SELECT s.id, CASE WHEN s.id % 9 = 1 THEN -1 WHEN s.id % 3 = 1 THEN p.id END AS parent_session_id FROM s LEFT JOIN s p ON p.id = s.id - 1",
    "bridge_keys": f"{_W}, {EVENTS_SQL}, f AS (SELECT 'file' || (id % 200) AS path, min_by(session_key, id) AS found FROM ev GROUP BY 1) SELECT session_id, coalesce(found, 'path:' || raw_source_path) AS session_key FROM ws LEFT JOIN f ON path = raw_source_path",
    "import_remap": f"{_E} SELECT count(*) AS asked, count(b.id) AS found, CAST(sum(b.id) AS BIGINT) AS ids FROM ev a LEFT JOIN ev b ON b.id = 2 * a.id WHERE a.k < 50",
    "inspect_event": f"{_E} SELECT id, CASE WHEN k % 2 = 0 THEN 'hook' ELSE 'base' END AS origin FROM ev WHERE (session_id, event_key) = (SELECT (session_id, event_key) FROM ev WHERE id = 77) ORDER BY k % 2 = 0, event_at, id LIMIT 1",
    "share_ready_counts": f"{_W}, {_SHARES}, r AS (SELECT * FROM ws WHERE review_status = 'approved' AND NOT {_OUT} AND session_id NOT IN (SELECT session_id FROM ws JOIN sh USING (share_id) WHERE sent UNION SELECT session_id FROM lk JOIN sh USING (share_id) WHERE sent)) SELECT count(*) AS sessions, count(DISTINCT project) AS projects, count(DISTINCT model) AS models FROM r",
    "share_view": f"{_W}, {_SHARES}, j AS (SELECT share_id, session_id, start_time FROM lk JOIN ws USING (session_id) WHERE lk.share_id <> 'sh1') SELECT lk.share_id, session_id, start_time FROM lk JOIN ws USING (session_id) WHERE lk.share_id <> 'sh1' UNION ALL SELECT share_id, session_id, start_time FROM ws JOIN sh USING (share_id) WHERE share_id NOT IN (SELECT share_id FROM lk WHERE share_id <> 'sh1')",
    "share_create": f"{_W}, {_WANT} SELECT 'new' AS share_id, session_id FROM rq JOIN ws USING (session_id)",
    "share_list": f"SELECT 'sh' || i AS share_id, CASE WHEN i % 2 = 0 THEN '{NOW}' END AS shared_at, i % 3 AS created_at FROM range(5) t(i)",
    "release_gate": f"{_W}, {_WANT}, s AS (SELECT session_id, {_STATE} AS state FROM ws) SELECT session_id, coalesce(state, 'missing') AS state FROM rq LEFT JOIN s USING (session_id) WHERE coalesce(state, 'missing') NOT IN ('auto_redacted', 'released')",
    "export_gates": f"{_W}, {_WANT}, s AS (SELECT session_key, count(*) AS n, bool_or({_STATE} NOT IN ('auto_redacted', 'released')) AS held, bool_or({_OUT}) AS out, count(*) FILTER (tool_uses % 9 = 0) AS open FROM ws GROUP BY 1) SELECT session_key, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN held THEN 'held' WHEN out THEN 'excluded_project' WHEN open > 0 THEN 'open_findings' END AS reason FROM rq LEFT JOIN s USING (session_key)",
    "review_updates": f"{_W} SELECT session_id, CASE WHEN tool_uses = 7 AND user_interrupts > 1 THEN 'blocked' ELSE review_status END AS review_status, CASE WHEN tool_uses = 7 AND user_interrupts < 3 THEN 4 ELSE ai_quality_score END AS ai_quality_score FROM ws",
    "policy_merge": "SELECT * FROM (VALUES ('block_domain', 'a.example,b.example'), ('redact_string', 'x'), ('exclude_project', 'p')) t(policy_type, \"values\")",
    "latest_sessions": f"{_W} SELECT session_key, arg_max(session_id, (coalesce(CASE WHEN user_messages = 1 THEN end_time END, start_time, TIMESTAMP '1900-01-01'), session_id)) AS session_id FROM ws GROUP BY 1",
    "hold_history": f"{_E} SELECT id AS history_id, ['pending_review', 'embargoed', 'released'][k % 3 + 1] AS state FROM ev WHERE session_id = 5",
    "coverage_buckets": f"{_E}, s AS (SELECT DISTINCT session_id FROM ev), m AS (SELECT s.session_id, t.type, EXISTS (FROM ev WHERE ev.session_id = s.session_id AND ev.type = t.type AND (ev.type <> 'click' OR k % 50 = 0)) AS seen FROM s CROSS JOIN (VALUES ('view'), ('click'), ('refund'), ('patch')) t(type)), c AS (SELECT session_id, type, CASE WHEN seen THEN 'present' WHEN type <> 'patch' THEN 'supported_but_absent' ELSE 'missing' END AS state FROM m) SELECT session_id, state, string_agg(type, ',' ORDER BY type) AS types FROM c GROUP BY 1, 2",
    "text_functions": f"{_W}, x AS (SELECT *, CASE WHEN length(session_id) % 2 = 0 THEN 'npm_' ELSE 'k' END || md5(session_id) AS key, 'a b ' || session_id || ' and some more words' AS t, date_diff('second', end_time, TIMESTAMP '1998-08-03') AS s FROM ws) SELECT session_id, left(key, CASE WHEN starts_with(key, 'npm_') THEN 8 ELSE 4 END) || '***' || right(key, 4) AS masked, coalesce(model, 'opus-4') AS model, left(t, 15) || '…' AS short, CASE WHEN start_time IS NOT NULL THEN duration_seconds END AS seconds, CASE WHEN s IS NULL OR s < 0 THEN 'recently' WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || ' days ago' END AS ago FROM x",
    "unscored_count": f"{_W} SELECT count(*) AS n FROM ws WHERE ai_quality_score IS NULL",
    "redaction_summary": f"{_W} SELECT 'e' || (tool_uses % 6) AS entity_type, CASE WHEN tool_uses % 9 = 0 THEN 'open' ELSE 'ignored' END AS status, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ws GROUP BY 1, 2",
}
