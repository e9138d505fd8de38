"""The aggregation front end and the dashboards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import agent_label, effort, model_at_effort, outcome_label, week_label, workspace
from ..plans.aggregate import DOMAINS, Spec, buckets, parse_metric, parse_predicate, parse_since, summary
from ..sources.fixtures import EVENTS_SQL, USAGE_SQL, events, table, token_usage

NOW = datetime(2024, 1, 31)


def agg_events_by_type_date(spark: SparkSession, d: str) -> DataFrame:
    return buckets(Spec(DOMAINS["events"], ("type", "date"), limit=1000), events(spark, d))


def agg_events_summary_other(spark: SparkSession, d: str) -> DataFrame:
    return summary(Spec(DOMAINS["events"], ("session",), limit=9), events(spark, d))


def agg_filter_in_since(spark: SparkSession, d: str) -> DataFrame:
    since = parse_since("10d", NOW)
    return buckets(Spec(DOMAINS["events"], ("client", "confidence"), predicates=(parse_predicate("type in: click|view | "), parse_predicate("confidence!=low")), since=since), events(spark, d))


def agg_cost_auto_partition(spark: SparkSession, d: str) -> DataFrame:
    return buckets(Spec(DOMAINS["cost"], ("service_tier", "model"), metric=parse_metric("sum:input_tokens"), limit=1000), token_usage(spark, d))


def agg_three_dims_nulls(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("lossiness", F.when(F.col("k") % 2 == 0, "none"))
    return buckets(Spec(DOMAINS["events"], ("lossiness", "type", "client"), limit=1000), e)


def workspace_segment(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(workspace(F.col("session_key")).alias("workspace")).groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))


def activity_daily(spark: SparkSession, d: str) -> DataFrame:
    by = events(spark, d).groupBy(F.date_format("event_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("day")).limit(30)


def activity_weekly(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("event_at").cast("date")
    by = events(spark, d).groupBy(week_label(day).alias("week")).agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("week_start"), F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("week")).limit(12)


def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy((F.weekday("event_at")).cast("long").alias("weekday"), F.hour("event_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    u = token_usage(spark, d)
    return u.agg(F.countDistinct("session_id").alias("sessions"), F.sum(F.coalesce("input", F.lit(0))).alias("tokens"), F.countDistinct("model").alias("models"), F.countDistinct("service_tier").alias("tiers"), F.sum("cost_cents").alias("cost_cents"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    badge = F.when(F.col("o_orderstatus") == "F", "tests_passed").when(F.col("o_orderkey") % 5 == 0, "errored").when(F.col("o_orderkey") % 5 == 1, "completed").when(F.col("o_orderkey") % 5 == 2, "partial")
    judged = F.when(F.col("o_orderkey") % 7 == 0, "resolved").when(F.col("o_orderkey") % 7 == 1, "odd")
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus", outcome_label(judged, badge).alias("outcome"))


SESSIONS_SQL = """se AS (
    SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'resolved' WHEN o_orderkey % 7 = 1 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'resolved'
        WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 THEN 'inconclusive' WHEN o_orderkey % 5 = 2 THEN 'interrupted' ELSE 'unscored' END AS outcome
    FROM orders
)"""


def outcome_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def resolve_rate_period_compare(spark: SparkSession, d: str) -> DataFrame:
    """Resolved among scored sessions of a period and of the one before it, in one pass."""
    period = F.when(F.year("o_orderdate") == 1996, "current").when(F.year("o_orderdate") == 1995, "previous")
    s = _sessions(spark, d).withColumn("period", period).filter("period is not null")
    return s.groupBy("period").agg(F.sum(F.when(F.col("outcome") == "resolved", 1).otherwise(0)).alias("resolved"), F.sum(F.when(F.col("outcome") != "unscored", 1).otherwise(0)).alias("scored")).withColumn("rate", F.when(F.col("scored") > 0, F.col("resolved") / F.col("scored")))


def agent_labels(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("origin", F.when(F.col("session_id") % 5 == 0, "desktop")).withColumn("channel", F.when(F.col("session_id") % 11 == 0, "local-agent"))
    return e.groupBy(agent_label(F.col("client"), F.col("origin"), F.col("channel")).alias("agent")).agg(F.count(F.lit(1)).alias("n"))


def model_effort_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    e = F.when(F.col("o_orderkey") % 3 == 0, "high").when(F.col("o_orderkey") % 3 == 1, "")
    return o.groupBy(model_at_effort(F.col("o_orderstatus"), e).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def tool_counts_explode(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.explode(F.map_from_arrays(F.array(F.lit("Read"), F.lit("Edit"), F.col("type")), F.array(F.col("k"), F.col("k") % 3, F.lit(1).cast("long")))).alias("tool", "n"))
    return e.groupBy("tool").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tool").limit(10)


def read_edit_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).agg(F.sum(F.when(F.col("type") == "view", F.col("k")).otherwise(0)).alias("reads"), F.sum(F.when(F.col("type") == "purchase", F.col("k")).otherwise(0)).alias("edits"))
    return e.select("reads", "edits", F.when((F.col("reads") > 0) | (F.col("edits") > 0), F.col("reads") / F.greatest("edits", F.lit(1))).alias("ratio"))


def badge_explode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    own, judged = F.array(F.lit("long"), F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.array(F.col("source")))
    return docs.select(F.explode(F.coalesce(judged, own)).alias("badge")).groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


def model_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = docs.join(labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean_quality"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("flagged"), F.sum("n_chars").alias("chars"))


def focus_with_breakdown(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("c_mktsegment"))
    return j.withColumn("project_n", total)


def effort_histogram(spark: SparkSession, d: str) -> DataFrame:
    u = token_usage(spark, d).groupBy("session_id").agg(F.sum("input").alias("tokens"), F.count(F.lit(1)).alias("tools"))
    e = effort(F.col("tools") * 8, F.col("tools") * 5, F.col("tokens") * 400, F.col("tools") * 2)
    bucket = F.when(e < 0.2, "0.0-0.2").when(e < 0.4, "0.2-0.4").when(e < 0.6, "0.4-0.6").when(e < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return u.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


def advisor_peak_hours(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.hour("event_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hour").limit(5)


def advisor_low_days(spark: SparkSession, d: str) -> DataFrame:
    by = events(spark, d).groupBy(F.weekday("event_at").cast("long").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy("n", "weekday").limit(2).filter("n < 3")


def advisor_downgrade(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter((F.col("o_totalprice") > 1) & F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def cost_by_project(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("cents"), "c_nationkey").limit(10)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals by status, by priority and over all in one pass."""
    g = table(spark, d, "orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.select("o_orderstatus", "o_orderpriority", "n")


def doctor_verdict(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("client").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("type").alias("types"), F.sum(F.when(F.col("type") == "error", 1).otherwise(0)).alias("unknown"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("verdict", F.when(F.col("unknown") == 0, "ok").when(F.col("unknown") * 2 < F.col("rows"), "degraded").otherwise("unsupported"))


QUERIES = {f.__name__: f for f in (agg_events_by_type_date, agg_events_summary_other, agg_filter_in_since, agg_cost_auto_partition, agg_three_dims_nulls, workspace_segment, activity_daily, activity_weekly, activity_heatmap, dashboard_summary, outcome_distribution, resolve_rate_period_compare, agent_labels, model_effort_labels, tool_counts_explode, read_edit_ratio, badge_explode, model_effectiveness, focus_with_breakdown, effort_histogram, score_histogram, advisor_peak_hours, advisor_low_days, advisor_downgrade, cost_by_project, status_counts, doctor_verdict)}

_E, _U, _S = f"WITH {EVENTS_SQL}", f"WITH {USAGE_SQL}", f"WITH {SESSIONS_SQL}"
_LABELS = "lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"
SQL = {
    "agg_events_by_type_date": f"{_E} SELECT type, strftime(event_at, '%Y-%m-%d') AS date, count(*) AS count FROM ev GROUP BY 1, 2 ORDER BY count DESC, type, date LIMIT 1000",
    "agg_events_summary_other": f"{_E}, g AS (SELECT session_key, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, session_key LIMIT 9) SELECT (SELECT count(*) FROM ev) AS total, (SELECT count(*) FROM ev) AS rows_scanned, CAST((SELECT count(*) FROM ev) - (SELECT sum(n) FROM g) AS BIGINT) AS other_count",
    "agg_filter_in_since": f"{_E} SELECT client, confidence, count(*) AS count FROM ev WHERE type IN ('click', 'view') AND confidence <> 'low' AND event_at >= TIMESTAMP '2024-01-21' GROUP BY 1, 2 ORDER BY count DESC, client, confidence LIMIT 10",
    "agg_cost_auto_partition": f"{_U} SELECT data_source, service_tier, model, CAST(sum(input_tokens) AS BIGINT) AS sum_input_tokens FROM us GROUP BY ALL",
    "agg_three_dims_nulls": f"{_E} SELECT CASE WHEN k % 2 = 0 THEN 'none' END AS lossiness, type, client, count(*) AS count FROM ev GROUP BY ALL",
    "workspace_segment": f"{_E} SELECT split_part(session_key, ':', 2) AS workspace, count(*) AS n FROM ev GROUP BY 1",
    "activity_daily": f"{_E} SELECT strftime(event_at, '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1 ORDER BY day DESC LIMIT 30",
    "activity_weekly": f"{_E} SELECT strftime(event_at, '%Y-W%W') AS week, strftime(min(CAST(event_at AS DATE)), '%Y-%m-%d') AS week_start, count(*) AS n FROM ev GROUP BY 1 ORDER BY week DESC LIMIT 12",
    "activity_heatmap": f"{_E} SELECT (dayofweek(event_at) + 6) % 7 AS weekday, hour(event_at) AS hour, count(*) AS n FROM ev GROUP BY ALL",
    "dashboard_summary": f"{_U} SELECT count(DISTINCT session_id) AS sessions, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(DISTINCT model) AS models, count(DISTINCT service_tier) AS tiers, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM us",
    "outcome_distribution": f"{_S} SELECT outcome, count(*) AS n FROM se GROUP BY 1",
    "resolve_rate_period_compare": f"{_S}, c AS (SELECT CASE year(o_orderdate) WHEN 1996 THEN 'current' WHEN 1995 THEN 'previous' END AS period, CAST(count(*) FILTER (outcome = 'resolved') AS BIGINT) AS resolved, CAST(count(*) FILTER (outcome <> 'unscored') AS BIGINT) AS scored FROM se WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1) SELECT *, CASE WHEN scored > 0 THEN resolved / scored END AS rate FROM c",
    "agent_labels": f"{_E} SELECT CASE WHEN client = 'claude' AND (session_id % 5 = 0 OR session_id % 11 = 0) THEN 'Claude Desktop' WHEN client = 'claude' THEN 'Claude Code' WHEN client = 'codex' AND session_id % 5 = 0 THEN 'Codex Desktop' WHEN client = 'codex' THEN 'Codex' ELSE 'OpenClaw' END AS agent, count(*) AS n FROM ev GROUP BY 1",
    "model_effort_labels": "SELECT o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ' @ high' ELSE '' END AS model, count(*) AS n FROM orders GROUP BY 1",
    "tool_counts_explode": f"{_E}, t AS (SELECT 'Read' AS tool, k AS n FROM ev UNION ALL SELECT 'Edit', k % 3 FROM ev UNION ALL SELECT type, 1 FROM ev) SELECT tool, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1 ORDER BY n DESC, tool LIMIT 10",
    "read_edit_ratio": f"{_E}, s AS (SELECT CAST(sum(CASE WHEN type = 'view' THEN k ELSE 0 END) AS BIGINT) AS reads, CAST(sum(CASE WHEN type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS edits FROM ev) SELECT reads, edits, CASE WHEN reads > 0 OR edits > 0 THEN reads / greatest(edits, 1) END AS ratio FROM s",
    "badge_explode": "SELECT badge, count(*) AS n FROM (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN [source] ELSE ['long', lang] END) AS badge FROM documents) GROUP BY 1",
    "model_effectiveness": f"WITH {_LABELS} SELECT source, count(*) AS n, avg(quality) AS mean_quality, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS flagged, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN lb USING (doc_id) GROUP BY 1",
    "focus_with_breakdown": "WITH g AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS project_n FROM g",
    "effort_histogram": f"{_U}, s AS (SELECT session_id, sum(input_tokens) AS tokens, count(*) AS tools FROM us GROUP BY 1), e AS (SELECT .3 * least(tools * 8 / 60.0::DOUBLE, 1) + .3 * least(tools * 5 / 50.0::DOUBLE, 1) + .2 * least(tokens * 400 / 100000.0::DOUBLE, 1) + .2 * least(tools * 2 / 20.0::DOUBLE, 1) AS e FROM s) SELECT CASE WHEN e < .2 THEN '0.0-0.2' WHEN e < .4 THEN '0.2-0.4' WHEN e < .6 THEN '0.4-0.6' WHEN e < .8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM e GROUP BY 1",
    "score_histogram": f"WITH {_LABELS} SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n FROM documents LEFT JOIN lb USING (doc_id) GROUP BY 1",
    "advisor_peak_hours": f"{_E} SELECT hour(event_at) AS hour, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, hour LIMIT 5",
    "advisor_low_days": f"{_E} SELECT * FROM (SELECT (dayofweek(event_at) + 6) % 7 AS weekday, count(*) AS n FROM ev GROUP BY 1 ORDER BY n, weekday LIMIT 2) WHERE n < 3",
    "advisor_downgrade": "SELECT o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_totalprice > 1 AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "cost_by_project": "SELECT c_nationkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY cents DESC, c_nationkey LIMIT 10",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "doctor_verdict": f"{_E}, g AS (SELECT client, count(DISTINCT session_id) AS sessions, count(DISTINCT type) AS types, CAST(count(*) FILTER (type = 'error') AS BIGINT) AS unknown, count(*) AS rows FROM ev GROUP BY 1) SELECT *, CASE WHEN unknown = 0 THEN 'ok' WHEN unknown * 2 < rows THEN 'degraded' ELSE 'unsupported' END AS verdict FROM g",
}
