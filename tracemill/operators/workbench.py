"""Session lists, dashboards, insights, advice and shares, over a table of sessions.

Every function takes a frame with a row for each session and returns a frame; costs are
rounded to four digits, so that the order of a sum doesn't show.  Where the origin leaves
ties open the key decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import effective_hold, model_at_effort, outcome_label

SYNTHETIC = "<synthetic>"
# Columns that a list may be sorted by, states that may be shared, tasks that need no large model, columns that are exported.
SORTABLE = ("start_time", "end_time", "project", "source", "model", "duration_seconds", "input_tokens", "output_tokens", "review_status", "display_title", "ai_quality_score")
SHAREABLE = ("auto_redacted", "released")
SIMPLE_TASKS = ("docs", "documentation", "testing", "formatting", "config", "configuration")
EXPORTED = ("session_id", "project", "source", "model", "start_time", "end_time", "duration_seconds", "git_branch", "user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens", "display_title", "messages", "outcome_badge", "value_badges", "risk_badges", "ai_quality_score", "task_type")
POLICIES = ("redact_string", "redact_username", "exclude_project", "block_domain")


def task() -> Column:
    """The judged task type, or else the guessed one."""
    return F.coalesce("ai_task_type", "task_type")


def outcome() -> Column:
    return outcome_label(F.col("ai_outcome_badge"), F.col("outcome_badge"))


def labelled_model() -> Column:
    return model_at_effort(F.col("model"), F.col("model_effort"))


def all_tokens() -> Column:
    """Fresh, cached and cache-writing input, and output."""
    return sum((F.coalesce(c, F.lit(0)) for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")), F.coalesce("input_tokens", F.lit(0)))


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _cost() -> Column:
    return F.round(F.sum("estimated_cost_usd"), 4)


def _mean_cost() -> Column:
    """The sum is rounded, not the mean, which would meet ties."""
    return _cost() / F.count("estimated_cost_usd")


def _share(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)) / F.count(F.lit(1))


def real_models(sessions: DataFrame) -> DataFrame:
    """Sessions whose model is known and no stand-in of a parser."""
    return sessions.filter(F.col("model").isNotNull() & (F.col("model") != SYNTHETIC))


def between(sessions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions that began on the days from start to end, either of which may be open."""
    day = F.col("start_time").cast("date")
    if start:
        sessions = sessions.filter(day >= F.lit(start).cast("date"))
    if end:
        sessions = sessions.filter(day <= F.lit(end).cast("date"))
    return sessions


def session_list(sessions: DataFrame, *, status: str | None = None, source: str | None = None, project: str | None = None, task_type: str | None = None, sort: str = "start_time", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions; a parent that was cut into segments isn't listed, an unknown sort falls back to the newest first."""
    out = sessions.filter(F.coalesce(F.col("review_status") != "segmented", F.lit(True)))
    for column, value in (("review_status", status), ("source", source), ("project", project)):
        if value:
            out = out.filter(F.col(column) == value)
    if task_type:
        out = out.filter(task() == task_type)
    if sort not in SORTABLE:
        sort, descending = "start_time", True
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    newest = [] if sort == "start_time" else [F.col("start_time").desc_nulls_last()]
    return out.orderBy(key, *newest, "session_id").offset(offset).limit(limit)


def not_scored(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """The newest sessions without a judged score."""
    return sessions.filter("ai_quality_score is null").orderBy(F.col("start_time").desc_nulls_last(), "session_id").limit(limit)


def without_commands(sessions: DataFrame) -> DataFrame:
    """Sessions whose title is more than a slash command."""
    title = F.coalesce("display_title", F.lit(""))
    return sessions.filter(~(F.startswith(title, F.lit("/")) & ~F.contains(title, F.lit(" "))))


def settled(sessions: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """Sessions that ended at least so many seconds ago."""
    return sessions.filter(F.col("end_time") <= now - F.make_dt_interval(secs=F.lit(seconds)))


def outside_projects(sessions: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Sessions of no excluded project; those are given as project or source:project."""
    named = F.col("project").isin(*excluded) | F.concat_ws(":", "source", "project").isin(*excluded)
    return sessions.filter(~F.coalesce(named, F.lit(False))) if excluded else sessions


def exported(sessions: DataFrame) -> DataFrame:
    """The columns that may leave, of those that there are; paths and commands don't."""
    return sessions.select(*[c for c in EXPORTED if c in sessions.columns])


def inspected(events: DataFrame, *, id: int | None = None, session: object = None, key: str | None = None) -> DataFrame:
    """An event by its id, or the first base event of a session and key (events: canonical, with `origin`)."""
    if id is not None:
        return events.filter(F.col("id") == id)
    hit = events.filter((F.col("session_id") == session) & (F.col("event_key") == key))
    return hit.orderBy((F.col("origin") == "base").desc(), F.col("event_at").asc_nulls_last(), "id").limit(1)


# Counts


def counts_by(sessions: DataFrame, *columns: str) -> DataFrame:
    """field, value, n for each of columns, in one pass; `task` is the task type."""
    named = sessions.select(*[(task() if c == "task" else F.col(c)).cast("string").alias(c) for c in columns])
    which = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("f")
    return named.select(which).groupBy("f.field", "f.value").agg(_n()).select("field", "value", "n").filter("value is not null")


def mean_interrupts(sessions: DataFrame) -> DataFrame:
    return sessions.filter("user_interrupts > 0").agg(F.avg("user_interrupts").alias("mean_interrupts"))


def badges(sessions: DataFrame, judged: str, guessed: str) -> DataFrame:
    """badge, n: judged badges, where there are any, rather than guessed ones; no list, no rows."""
    return sessions.select(F.explode(F.coalesce(judged, guessed)).alias("badge")).groupBy("badge").agg(_n())


def by_task(sessions: DataFrame) -> DataFrame:
    return sessions.select(task().alias("task")).filter("task is not null").groupBy("task").agg(_n())


def tokens_by_source(sessions: DataFrame) -> DataFrame:
    """Input with what caches gave and took, and output, by source; without a single count null."""
    into = F.sum("input_tokens") + F.sum(F.coalesce("cache_read_tokens", F.lit(0))) + F.sum(F.coalesce("cache_creation_tokens", F.lit(0)))
    return sessions.groupBy("source").agg(into.alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def summary(sessions: DataFrame) -> DataFrame:
    """Totals of a dashboard in one row: two levels, so that distinct counts don't multiply rows."""
    g = sessions.groupBy("project", "source").agg(_n(), F.sum(all_tokens()).alias("t"), F.sum("estimated_cost_usd").alias("c"))
    p = g.groupBy("project").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("c").alias("c"), F.collect_set("source").alias("s"))
    return p.agg(F.sum("n").alias("sessions"), F.sum("t").alias("tokens"), F.count("project").alias("projects"), F.size(F.array_distinct(F.flatten(F.collect_set("s")))).cast("long").alias("sources"), F.round(F.sum("c"), 4).alias("cost"))


# Insights


def heatmap(sessions: DataFrame) -> DataFrame:
    dated = sessions.filter("start_time is not null")
    return dated.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("day"), F.hour("start_time").cast("long").alias("hour")).agg(_n("sessions"), F.sum(all_tokens()).alias("tokens"), F.coalesce(_cost(), F.lit(0.0)).alias("cost"))


def focus(sessions: DataFrame, n: int = 20) -> DataFrame:
    """The n projects of most sessions, with a map from task types to sessions, from one aggregation."""
    dated = sessions.filter("start_time is not null")
    parts = dated.groupBy("project", task().alias("task")).agg(_n(), F.sum(all_tokens()).alias("t"), F.sum("estimated_cost_usd").alias("c"))
    tasks = F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("task", "n")), lambda e: e["task"].isNotNull())))
    out = parts.groupBy("project").agg(F.sum("n").alias("sessions"), F.sum("t").alias("tokens"), F.round(F.coalesce(F.sum("c"), F.lit(0.0)), 4).alias("cost"), tasks.alias("tasks"))
    return out.orderBy(F.desc("sessions"), F.col("project").asc_nulls_last()).limit(n)


def duration_and_score(sessions: DataFrame, n: int = 200) -> DataFrame:
    known = sessions.filter("start_time is not null and duration_seconds is not null and ai_quality_score is not null")
    return known.orderBy(F.desc("start_time"), "session_id").limit(n).select("session_id", "duration_seconds", "ai_quality_score", outcome().alias("resolution"), F.col("estimated_cost_usd").alias("cost"))


def model_effectiveness(sessions: DataFrame) -> DataFrame:
    known = real_models(sessions.filter("start_time is not null"))
    return known.groupBy(labelled_model().alias("model")).agg(_n("sessions"), F.avg("ai_quality_score").alias("mean_score"), _share(outcome() == "resolved").alias("resolve_rate"), _mean_cost().alias("mean_cost"), _cost().alias("cost"))


def tool_usage(sessions: DataFrame, n: int = 20) -> DataFrame:
    used = sessions.select(F.explode("tool_counts").alias("tool", "calls")).groupBy("tool").agg(F.sum("calls").alias("calls"))
    return used.orderBy(F.desc("calls"), "tool").limit(n)


def trends(sessions: DataFrame) -> DataFrame:
    dated = sessions.filter("start_time is not null")
    return dated.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("day")).agg(_n("sessions"), _mean_cost().alias("mean_cost"), F.avg("duration_seconds").alias("mean_duration"), _share(outcome() == "resolved").alias("resolve_rate"))


def cost_by_model(sessions: DataFrame) -> DataFrame:
    return real_models(sessions.filter("start_time is not null")).groupBy(labelled_model().alias("model")).agg(F.coalesce(_cost(), F.lit(0.0)).alias("cost"))


def project_sources(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project", "source").agg(_n("sessions"), F.sum(all_tokens()).alias("tokens"))


# Advice


def advisor_totals(sessions: DataFrame) -> DataFrame:
    """One row: totals, and how many long sessions have low scores and short ones high scores."""
    low = F.sum(F.when((F.col("duration_seconds") > 1800) & (F.col("ai_quality_score") <= 2), 1).otherwise(0))
    high = F.sum(F.when((F.col("duration_seconds") < 600) & (F.col("ai_quality_score") >= 4), 1).otherwise(0))
    return sessions.agg(_n("sessions"), F.coalesce(_cost(), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(low, F.lit(0)).alias("long_low"), F.coalesce(high, F.lit(0)).alias("short_high"))


def advisor_models(sessions: DataFrame) -> DataFrame:
    resolved = (F.col("ai_outcome_badge") == "resolved") | (F.col("ai_outcome_badge").isNull() & (F.col("outcome_badge") == "tests_passed"))
    return real_models(sessions).groupBy(labelled_model().alias("model")).agg(_n("sessions"), F.coalesce(_cost(), F.lit(0.0)).alias("cost"), F.avg("ai_quality_score").alias("mean_score"), _share(resolved).alias("resolve_rate"))


def advisor_tasks(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("task", task()).filter("task is not null").groupBy("task").agg(_n("sessions"), F.coalesce(_cost(), F.lit(0.0)).alias("cost"), F.avg("ai_quality_score").alias("mean_score"))


def advisor_scores(sessions: DataFrame) -> DataFrame:
    return sessions.filter("ai_quality_score is not null").groupBy(F.col("ai_quality_score").alias("score")).agg(_n("sessions"), _mean_cost().alias("mean_cost"))


def low_days(sessions: DataFrame, days: int = 2, fewer: int | Column = 3) -> DataFrame:
    """The weekdays of fewest sessions, those of fewer than 3; a day without any isn't known."""
    by = sessions.filter("start_time is not null").groupBy(F.date_format("start_time", "EEEE").alias("day")).agg(_n("sessions"))
    return by.orderBy("sessions", "day").limit(days).filter(F.col("sessions") < fewer)


def downgrades(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The dearest sessions over a dollar with simple tasks and middling scores."""
    hit = (F.col("estimated_cost_usd") > 1) & (F.col("ai_quality_score") <= 3) & task().isin(*SIMPLE_TASKS)
    return sessions.filter(hit).orderBy(F.desc("estimated_cost_usd"), "session_id").limit(n).select("session_id", labelled_model().alias("model"), task().alias("task"), F.col("ai_quality_score").alias("score"), F.col("estimated_cost_usd").alias("cost"))


def interrupts_by_model(sessions: DataFrame) -> DataFrame:
    return real_models(sessions).filter("user_interrupts > 0").groupBy(labelled_model().alias("model")).agg(F.avg("user_interrupts").alias("mean_interrupts"), _n("sessions"), F.coalesce(F.sum("tool_uses"), F.lit(0)).alias("tool_uses"))


def recommendations(sessions: DataFrame) -> DataFrame:
    """kind, priority, subject, amount of what the statistics suggest; each part is an aggregate of a few rows.

    Downgrades save three fifths of their cost; three long sessions with low scores are a habit;
    a task type is worth naming from a mean score of 3.5, a model's interrupts from a mean of 2.
    """
    none = F.lit(None).cast("string")
    totals, models, tasks = advisor_totals(sessions), advisor_models(sessions), advisor_tasks(sessions)
    row = lambda kind, priority, subject, amount: [F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), subject.cast("string").alias("subject"), F.round(amount.cast("double"), 4).alias("amount")]
    d = downgrades(sessions).agg(_n(), F.sum("cost").alias("c")).filter("n > 0").select(*row("model_downgrade", "high", F.col("n"), 0.6 * F.col("c")))
    e = totals.filter("long_low >= 3").select(*row("session_efficiency", "medium", F.col("short_high"), F.col("long_low")))
    days = low_days(sessions).agg(F.array_join(F.array_sort(F.collect_list("day")), " and ").alias("days"), _n()).filter("n > 0")
    u = days.select(*row("unused_capacity", "medium", F.col("days"), F.col("n")))
    several = tasks.agg(_n()).filter("n >= 2").select(F.lit(True).alias("several"))
    best = tasks.filter("mean_score > 0").orderBy(F.desc("mean_score"), "task").limit(1).filter("mean_score >= 3.5")
    r = best.join(F.broadcast(several)).select(*row("high_roi", "low", F.col("task"), F.col("mean_score")))
    scored = models.filter("mean_score > 0")
    ends = scored.agg(_n(), F.max_by("model", F.struct("mean_score", "model")).alias("best"), F.min_by("model", F.struct(F.col("cost") / F.col("sessions"), "model")).alias("cheapest"), F.max("mean_score").alias("s"))
    m = ends.filter("n >= 2 and best != cheapest").select(*row("model_comparison", "low", F.concat_ws(" / ", "best", "cheapest"), F.col("s")))
    worst = interrupts_by_model(sessions).orderBy(F.desc("mean_interrupts"), "model").limit(1).filter("mean_interrupts >= 2")
    i = worst.select(*row("agent_steering", "medium", F.col("model"), F.col("mean_interrupts")))
    out = d
    for more in (e, u, r, m, i):
        out = out.union(more)
    return out.withColumn("subject", F.coalesce("subject", none))


# Holds, gates, policies, shares


def release_blockers(requested: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """session_id, state of the requested ids that may not go out: their effective state, or `missing`."""
    known = sessions.select("session_id", effective_hold(F.col("hold_state"), F.col("embargo_until"), now).alias("state"))
    state = F.coalesce("state", F.lit("missing"))
    return requested.select("session_id").distinct().join(known, "session_id", "left").select("session_id", state.alias("state")).filter(~F.col("state").isin(*SHAREABLE))


def hold_history(log: DataFrame, session: object) -> DataFrame:
    return log.filter(F.col("session_id") == session).orderBy("changed_at", "history_id")


def export_gate(requested: DataFrame, sessions: DataFrame, findings: DataFrame, excluded: Sequence[str], now: Column) -> DataFrame:
    """session_key, reason (null: may go): no or several sessions of a key, a hold, an excluded project, open findings, in this order."""
    open_ = findings.filter("status = 'open'").groupBy("session_id").agg(_n("open"))
    rows = sessions.join(open_, "session_id", "left")
    held = ~effective_hold(F.col("hold_state"), F.col("embargo_until"), now).isin(*SHAREABLE)
    out = F.col("project").isin(*excluded) | F.concat_ws(":", "source", "project").isin(*excluded) if excluded else F.lit(False)
    each = rows.groupBy("session_key").agg(_n(), F.max(held).alias("held"), F.max(F.coalesce(out, F.lit(False))).alias("out"), F.sum(F.coalesce("open", F.lit(0))).alias("open"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("held"), "held").when(F.col("out"), "excluded_project").when(F.col("open") > 0, "open_findings")
    return requested.select("session_key").distinct().join(each, "session_key", "left").select("session_key", reason.alias("reason"))


def merged_policies(policies: DataFrame) -> DataFrame:
    """policy_type, values: the values of each known type, each once, in the order in which they came."""
    known = policies.filter(F.col("policy_type").isin(*POLICIES))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "policy_id", "value"))), lambda p: p["value"])
    return known.groupBy("policy_type").agg(F.array_distinct(ordered).alias("values"))


def share_links(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows for a share's junction table: the wanted (share_id, session_id) that are sessions, each once."""
    return wanted.distinct().join(sessions.select("session_id"), "session_id", "left_semi").select("share_id", "session_id")


def share_list(shares: DataFrame) -> DataFrame:
    return shares.orderBy(F.desc("created_at"), "share_id")


def share_sessions(share: DataFrame, links: DataFrame, sessions: DataFrame) -> DataFrame:
    """share_id, session_id, start_time: by junction rows, and by the sessions' own column for shares without any."""
    s = sessions.select("session_id", "start_time", F.col("share_id").alias("own_share"))
    linked = share.select("share_id").join(links, "share_id").join(s, "session_id").select("share_id", "session_id", "start_time")
    bare = share.select("share_id").join(linked.select("share_id").distinct(), "share_id", "left_anti")
    own = bare.join(s, bare.share_id == s.own_share).select("share_id", "session_id", "start_time")
    return linked.union(own)


def share_ready(sessions: DataFrame, shares: DataFrame, links: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Approved sessions that no share has sent out, of projects that may be shared."""
    sent = shares.filter("shared_at is not null").select("share_id")
    by_column = sessions.join(sent, "share_id", "left_semi").select("session_id")
    by_link = links.join(sent, "share_id", "left_semi").select("session_id")
    fresh = sessions.filter("review_status = 'approved'").join(by_column.union(by_link).distinct(), "session_id", "left_anti")
    return outside_projects(fresh, excluded)


def share_ready_stats(ready: DataFrame) -> DataFrame:
    """One row: how many sessions, of how many projects and models."""
    g = ready.groupBy("project", "model").agg(_n())
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.countDistinct("project").alias("projects"), F.countDistinct("model").alias("models"))


def reviewed(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """session_id, review_status, ai_quality_score after changes (session_id, status, score); a score outside 1 to 5 raises."""
    score = F.when(F.col("score").isNull() | F.col("score").between(1, 5), F.col("score")).otherwise(F.raise_error(F.lit("a score is from 1 to 5")).cast("long"))
    c = changes.select("session_id", "status", score.alias("checked"))
    return sessions.join(c, "session_id", "left").select("session_id", F.coalesce("status", "review_status").alias("review_status"), F.coalesce("checked", "ai_quality_score").alias("ai_quality_score"))


# Keys and references


def with_parents(sessions: DataFrame, key: str = "session_key", parent_key: str = "parent_session_key", id: str = "id", parent: str = "parent_session_id") -> DataFrame:
    """sessions whose missing parent id is filled from the session that has the parent's key."""
    p = sessions.select(F.col(key).alias("p_key"), F.col(id).alias("p_id"))
    return sessions.join(p, F.col(parent_key) == F.col("p_key"), "left").withColumn(parent, F.coalesce(parent, "p_id")).drop("p_key", "p_id")


def bridged_keys(sessions: DataFrame, events: DataFrame, derived: Column) -> DataFrame:
    """session_id, session_key: the key of the first event of a session's file, or else one derived from its path."""
    first = events.groupBy("source_path").agg(F.min_by("session_key", "id").alias("found"))
    return sessions.join(first, sessions.raw_source_path == first.source_path, "left").select("session_id", F.coalesce("found", derived).alias("session_key"))


def remapped(references: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """references with local_id, the id of the event with the same raw reference; null where there is none."""
    local = events.select(*keys, F.col("id").alias("local_id")).dropDuplicates(list(keys))
    return references.join(local, list(keys), "left")


def latest_by_key(sessions: DataFrame) -> DataFrame:
    """One session of each key: the one that was updated, indexed or begun last."""
    last = F.coalesce("updated_at", "indexed_at", "start_time")
    return sessions.groupBy("session_key").agg(F.max_by("session_id", F.struct(last, "session_id")).alias("session_id"))


def timeline(events: DataFrame, usage: DataFrame, anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """events with their usage, and the kinds of anomalies and incidents that start at them; each side meets them once."""
    u = usage.groupBy(F.col("event_id").alias("id")).agg(F.sum("input").alias("input"), F.sum("cost_estimate").alias("cost"))
    a = anomalies.groupBy(F.col("turn_event_id").alias("id")).agg(F.array_sort(F.collect_list("kind")).alias("anomalies"))
    i = incidents.groupBy(F.col("first_event_id").alias("id")).agg(F.array_sort(F.collect_list("kind")).alias("incidents"))
    return events.join(u, "id", "left").join(a, "id", "left").join(i, "id", "left")


def timeline_counters(events: DataFrame) -> DataFrame:
    """session_id with counts of its events: direct, lossy, of low confidence."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return events.groupBy("session_id").agg(_n("events"), count(F.col("origin") == "base").alias("direct"), count(F.col("lossiness") != "none").alias("lossy"), count(F.col("confidence") == "low").alias("low"))


def ledger_health(rows: DataFrame, kind: str, cursor: str) -> DataFrame:
    """kind, n and last of a derived table: rows of each kind and the furthest cursor."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(_n(), F.max(cursor).alias("last"))
