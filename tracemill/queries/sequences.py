"""Ordered sessions: turns, runs, anomalies, pauses, segments, and the canonical view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import effective_hold
from ..operators import canonical as C
from ..operators import segments as G
from ..operators import sequences as S
from ..sources.fixtures import EVENTS_SQL, events, messages, table

TYPES = ("signup", "purchase", "error", "view", "click", "refund")


def turn_numbering(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("idx")
    return S.numbered_turns(messages(spark, d), F.col("role") == "user", w).select("session", "idx", "turn")


def repeat_runs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("fingerprint", F.when(F.col("k") % 10 != 0, (F.col("k") % 2).cast("string")))
    return S.repeat_runs(e, "type", "fingerprint", S.ordered(), {"view": 3, "click": 4}, breakers=("error",))


def input_spike(spark: SparkSession, d: str) -> DataFrame:
    return S.input_spikes(events(spark, d), "value", S.ordered()).select("session_id", "id", "value", "baseline")


def value_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("size", F.lit(100) + F.col("k") % 20)
    found = S.cache_collapses(e, "value", "size", S.ordered(), source=F.col("confidence") != "low")
    return found.select("session_id", "id", "previous", "value", "drop_ratio")


def label_shift(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("model", F.when(F.col("k") % 3 != 0, F.col("type")))
    return S.shifts(e, "model", S.ordered()).select("session_id", "id", "previous", "model")


def tier_shift(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("tier", F.when(F.col("k") % 3 != 0, (F.col("k") % 4).cast("string"))).withColumn("model", F.when(F.col("k") % 5 != 0, F.col("type")))
    return S.shifts(e, "tier", S.ordered(), same="model").select("session_id", "id", "previous", "tier", "model")


def model_threading(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return S.carried(e, F.when(F.col("type") == "signup", (F.col("k") % 5).cast("string")), S.ordered(), "model").select("id", "model")


def idle_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    parts = S.gap_sessions(events(spark, d), "session_id", "event_at", "id", minutes=360)
    return parts.groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def session_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = S.session_bounds(events(spark, d), closing=F.col("type") == "purchase")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return b.select("session_id", day("started_at"), day("ended_at"), "n_events", F.when(F.col("closed") == 1, "ended").otherwise("open").alias("status"))


def call_result_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    calls = e.filter("type = 'view'").select("session_id", "k", F.col("id").alias("call_id"))
    results = e.filter("type = 'click'").select("session_id", "k", F.col("id").alias("result_id"), "event_at")
    return S.paired_results(calls, results, ["session_id", "k"], "event_at", "result_id").select("call_id", "result_id")


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("id % 3 = 0")
    up = F.when(F.col("id") % 2 == 0, "high").otherwise("medium")
    moved = F.when(F.col("id") % 9 == 0, F.concat("event_key", F.lit("x"))).otherwise(F.col("event_key"))
    return e.select("session_id", moved.alias("event_key"), F.lit("override").alias("type"), "event_at", up.alias("confidence"), F.lit("hook").alias("source"), F.col("id").alias("write_seq"))


_OV = """ov AS (
    SELECT session_id, CASE WHEN id % 9 = 0 THEN event_key || 'x' ELSE event_key END AS event_key, 'override' AS type,
        CASE WHEN id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, id AS write_seq
    FROM ev WHERE id % 3 = 0
), fo AS (
    SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY session_id, event_key ORDER BY CASE confidence WHEN 'high' THEN 3 ELSE 2 END DESC, write_seq) = 1
)"""


def override_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_overrides(_overrides(spark, d)).select("session_id", "event_key", "confidence", "write_seq")


def canonical_override_view(spark: SparkSession, d: str) -> DataFrame:
    view = C.canonical(events(spark, d), C.fold_overrides(_overrides(spark, d)))
    return view.select("session_id", "event_key", "id", "type", "confidence", "origin")


def capability_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    types = spark.createDataFrame([(t,) for t in TYPES], "type string")
    return C.capability_matrix(types, e.select("session_id").distinct(), e, e.filter("confidence = 'low'"))


def latest_hold_state(spark: SparkSession, d: str) -> DataFrame:
    """Audit log to current state: the latest change of each session, embargoes judged at a fixed time."""
    e = events(spark, d).withColumn("state", F.when(F.col("k") % 4 == 0, "embargoed").when(F.col("k") % 4 == 1, "released").when(F.col("k") % 4 == 2, "pending_review"))
    last = e.groupBy("session_id").agg(F.max_by(F.struct("state", "id", "event_at"), F.struct("event_at", "id")).alias("l")).select("session_id", "l.*")
    now = F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")
    return last.select("session_id", "id", effective_hold(F.col("state"), F.col("event_at") + F.expr("INTERVAL 7 DAY"), now).alias("state"))


def exchange_tool_mode(spark: SparkSession, d: str) -> DataFrame:
    return G.exchanges(messages(spark, d), "session", "idx", "role", F.col("n_tools")).select("session", "exchange", "first_index", "n_tools", "mode")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    x = G.exchanges(m, "session", "idx", "role", F.col("n_tools"))
    shift = G.mode_shifts(x, "session").withColumn("signal", F.lit("tool_mode"))
    gap = m.filter("idx > 0 and n_tools = 1").select("session", "idx", F.lit("time_gap").alias("signal"))
    packed = m.filter("idx > 0 and n_tools = 4").select("session", "idx", F.lit("compaction").alias("signal"))
    return shift.union(gap).union(packed)


_MSG = "ms AS (SELECT conv_id AS session, turn AS idx, role, length(text) % 6 AS n_tools, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn) = 1)"
_EXCH = f"""{_MSG}, tx AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY idx) AS exchange FROM ms),
ex AS (SELECT session, CAST(exchange AS BIGINT) AS exchange, min(idx) AS first_index, CAST(sum(n_tools) AS BIGINT) AS n_tools, CASE WHEN sum(n_tools) = 0 THEN 'qa' WHEN sum(n_tools) <= 3 THEN 'light' ELSE 'heavy' END AS mode FROM tx WHERE exchange > 0 GROUP BY 1, 2)"""
_SIG = f"""{_EXCH}, sg AS (
    SELECT session, first_index AS idx, 'tool_mode' AS signal FROM (SELECT *, lag(mode) OVER (PARTITION BY session ORDER BY exchange) AS b FROM ex) WHERE (b = 'qa' AND mode = 'heavy') OR (b = 'heavy' AND mode = 'qa')
    UNION ALL SELECT session, idx, 'time_gap' FROM ms WHERE idx > 0 AND n_tools = 1 UNION ALL SELECT session, idx, 'compaction' FROM ms WHERE idx > 0 AND n_tools = 4
), pl AS (SELECT DISTINCT session, idx FROM sg),
mt AS (SELECT pl.session, pl.idx, list_sort(list(DISTINCT signal)) AS names, max(CASE signal WHEN 'time_gap' THEN .9 WHEN 'compaction' THEN .8 ELSE .5 END) AS w FROM pl JOIN sg ON pl.session = sg.session AND abs(pl.idx - sg.idx) <= 2 GROUP BY 1, 2),
sc AS (SELECT session, idx, CAST(CASE WHEN len(names) >= 3 THEN .95 WHEN len(names) = 2 THEN w + .1 ELSE w END AS DOUBLE) AS confidence, array_to_string(names, ' + ') AS reason FROM mt),
sn AS (SELECT s.session, max(m.idx) AS idx FROM sc s JOIN ms m ON m.session = s.session AND m.idx <= s.idx AND m.role = 'user' WHERE s.confidence >= .6 GROUP BY s.session, s.idx),
bd AS (SELECT DISTINCT session, idx FROM sn WHERE idx > 0),
sp AS (SELECT *, lead(idx) OVER (PARTITION BY session ORDER BY idx) AS until FROM bd),
kb AS (SELECT sp.session, sp.idx FROM sp JOIN ms m ON m.session = sp.session AND m.idx >= sp.idx AND (until IS NULL OR m.idx < until) GROUP BY sp.session, sp.idx, until HAVING until IS NULL OR count(*) FILTER (m.role = 'user') >= 2 OR count(*) >= 3)"""


def boundary_scoring(spark: SparkSession, d: str) -> DataFrame:
    return G.scored(_signals(spark, d), "session")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    good = G.scored(_signals(spark, d), "session").filter(F.col("confidence") >= G.MIN_SCORE).select("session", "idx")
    return G.kept_boundaries(G.snapped(good, m, "session", "idx", "role").distinct(), m, "session", "idx", "role")


def segment_split(spark: SparkSession, d: str) -> DataFrame:
    return G.split(messages(spark, d), _kept(spark, d), "session", "idx").select("session", "idx", "segment", "segment_id")


def training_turns(spark: SparkSession, d: str) -> DataFrame:
    return G.training_turns(messages(spark, d), "session", "idx", "role", "text")


QUERIES = {f.__name__: f for f in (turn_numbering, repeat_runs, input_spike, value_collapse, label_shift, tier_shift, model_threading, idle_gap_sessions, session_bounds, call_result_pairs, override_upsert_fold, canonical_override_view, capability_join, latest_hold_state, exchange_tool_mode, boundary_scoring, segment_split, training_turns)}

_E = f"WITH {EVENTS_SQL}"
_W = "(PARTITION BY session_id ORDER BY event_at NULLS LAST, id)"
_RUN = lambda t, n: f"""r{t} AS (SELECT session_id, id, fp, type = '{t}' AND fp IS NOT NULL AS mine, lag(CASE WHEN type = '{t}' THEN fp END) OVER {_W} AS b FROM fe WHERE type IN ('{t}', 'error')),
i{t} AS (SELECT *, sum(CASE WHEN mine AND b IS NOT DISTINCT FROM fp THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY n) AS island FROM (SELECT r.*, row_number() OVER (PARTITION BY r.session_id ORDER BY e.event_at NULLS LAST, r.id) AS n FROM r{t} r JOIN fe e ON e.id = r.id)),
o{t} AS (SELECT session_id, '{t}' AS kind, fp AS fingerprint, min(id) AS first_id, max(id) AS last_id, count(*) AS count FROM i{t} WHERE mine GROUP BY session_id, island, fp HAVING count(*) >= {n})"""  # noqa: E731
SQL = {
    "turn_numbering": f"WITH {_MSG} SELECT session, idx, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY idx) AS BIGINT) AS turn FROM ms",
    "repeat_runs": f"{_E}, fe AS (SELECT *, CASE WHEN k % 10 <> 0 THEN CAST(k % 2 AS VARCHAR) END AS fp FROM ev), {_RUN('view', 3)}, {_RUN('click', 4)} SELECT * FROM oview UNION ALL SELECT * FROM oclick",
    "input_spike": f"{_E}, t AS (SELECT session_id, id, value, avg(value) OVER (PARTITION BY session_id ORDER BY event_at NULLS LAST, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline, count(value) OVER (PARTITION BY session_id ORDER BY event_at NULLS LAST, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM ev) SELECT session_id, id, value, baseline FROM t WHERE n = 5 AND baseline > 0 AND value > 3 * baseline",
    "value_collapse": f"{_E}, t AS (SELECT *, 100 + k % 20 AS size, lag(value) OVER {_W} AS pv, 100 + lag(k) OVER {_W} % 20 AS ps, lag(confidence) OVER {_W} AS pc FROM ev) SELECT session_id, id, pv AS previous, value, (pv - value) / pv AS drop_ratio FROM t WHERE confidence <> 'low' AND pc <> 'low' AND ps > 0 AND abs(size - ps) <= .25 * ps AND pv > 0 AND (pv - value) / pv >= .5",
    "label_shift": f"{_E}, t AS (SELECT session_id, id, type AS model, lag(type) OVER {_W} AS previous FROM ev WHERE k % 3 <> 0) SELECT session_id, id, previous, model FROM t WHERE previous <> model",
    "tier_shift": f"{_E}, t AS (SELECT session_id, id, CAST(k % 4 AS VARCHAR) AS tier, CASE WHEN k % 5 <> 0 THEN type END AS model, lag(CAST(k % 4 AS VARCHAR)) OVER {_W} AS previous, lag(CASE WHEN k % 5 <> 0 THEN type END) OVER {_W} AS pm FROM ev WHERE k % 3 <> 0) SELECT session_id, id, previous, tier, model FROM t WHERE previous <> tier AND pm = model",
    "model_threading": f"{_E} SELECT id, last_value(CASE WHEN type = 'signup' THEN CAST(k % 5 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_at NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM ev",
    "idle_gap_sessions": f"{_E}, t AS (SELECT *, CASE WHEN epoch_us(event_at) - lag(epoch_us(event_at)) OVER {_W} >= 21600000000 THEN 1 ELSE 0 END AS p FROM ev), s AS (SELECT session_id, id, CAST(sum(p) OVER {_W} AS BIGINT) AS part FROM t) SELECT session_id, part, count(*) AS n, min(id) AS first_id FROM s GROUP BY 1, 2",
    "session_bounds": f"{_E} SELECT session_id, strftime(min(event_at), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(event_at), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS n_events, CASE WHEN bool_or(type = 'purchase') THEN 'ended' ELSE 'open' END AS status FROM ev GROUP BY 1",
    "call_result_pairs": f"{_E}, r AS (SELECT session_id, k, id AS result_id FROM ev WHERE type = 'click' QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY event_at NULLS LAST, id) = 1) SELECT c.id AS call_id, result_id FROM ev c LEFT JOIN r ON r.session_id = c.session_id AND r.k = c.k WHERE c.type = 'view'",
    "override_upsert_fold": f"{_E}, {_OV} SELECT session_id, event_key, confidence, write_seq FROM fo",
    "canonical_override_view": f"{_E}, {_OV}, b AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY session_id, event_key ORDER BY event_at NULLS LAST, id) = 1), r AS (SELECT 'high' AS c, 3 AS n UNION ALL SELECT 'medium', 2 UNION ALL SELECT 'low', 1), j AS (SELECT coalesce(b.session_id, o.session_id) AS session_id, coalesce(b.event_key, o.event_key) AS event_key, b.id, b.type AS bt, b.confidence AS bc, o.type AS ot, o.confidence AS oc, b.event_key IS NULL AS hook, o.event_key IS NOT NULL AND (b.event_key IS NULL OR ro.n >= rb.n) AS wins FROM b FULL JOIN fo o ON b.session_id = o.session_id AND b.event_key = o.event_key LEFT JOIN r rb ON rb.c = b.confidence LEFT JOIN r ro ON ro.c = o.confidence) SELECT session_id, event_key, id, CASE WHEN wins THEN ot ELSE bt END AS type, CASE WHEN wins THEN oc ELSE bc END AS confidence, CASE WHEN hook THEN 'hook' WHEN wins THEN 'override' ELSE 'base' END AS origin FROM j",
    "capability_join": f"{_E}, t AS (SELECT unnest({list(TYPES)}) AS type), s AS (SELECT DISTINCT session_id FROM ev) SELECT s.session_id, t.type, (SELECT count(*) FROM ev e WHERE e.session_id = s.session_id AND e.type = t.type) AS n_events, (SELECT count(*) FROM ev e WHERE e.session_id = s.session_id AND e.type = t.type AND e.confidence = 'low') AS n_overrides FROM s CROSS JOIN t",
    "latest_hold_state": f"{_E}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_at DESC, id DESC) = 1) SELECT session_id, id, CASE k % 4 WHEN 0 THEN CASE WHEN event_at + INTERVAL 7 DAY <= TIMESTAMP '2024-02-05' THEN 'released' ELSE 'embargoed' END WHEN 1 THEN 'released' WHEN 2 THEN 'pending_review' ELSE 'auto_redacted' END AS state FROM l",
    "exchange_tool_mode": f"WITH {_EXCH} SELECT * FROM ex",
    "boundary_scoring": f"WITH {_SIG} SELECT * FROM sc",
    "segment_split": f"WITH {_SIG}, z AS (SELECT ms.session, ms.idx, count(kb.idx) OVER (PARTITION BY ms.session ORDER BY ms.idx) AS segment FROM ms LEFT JOIN kb ON kb.session = ms.session AND kb.idx = ms.idx) SELECT *, session || '_seg-' || lpad(CAST(segment AS VARCHAR), 2, '0') AS segment_id FROM z",
    "training_turns": f"WITH {_MSG}, t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY idx) AS turn FROM ms) SELECT session, CAST(turn AS BIGINT) AS turn, arg_min(text, idx) FILTER (role = 'user') AS prompt, arg_max(text, idx) FILTER (role = 'assistant') AS reply, count(*) FILTER (role = 'assistant') AS n_steps FROM t WHERE turn > 0 GROUP BY 1, 2 HAVING count(*) FILTER (role = 'assistant') > 0",
}
