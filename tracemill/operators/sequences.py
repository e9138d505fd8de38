"""Operators over a session's ordered rows.

All share one window, partitioned by session and ordered by time (nulls last) and
id, so detectors over one frame share an exchange and a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..session import written

# Thresholds of the detectors.
SPIKE_WINDOW, SPIKE_MULTIPLIER = 5, 3.0
COLLAPSE_DROP, COLLAPSE_TOLERANCE = 0.5, 0.25
REPEATS = {"command_start": 3, "tool_call": 5}
BREAKERS = ("user_message", "compaction")


def ordered(session: str = "session_id", time: str = "event_at", id: str = "id") -> WindowSpec:
    return Window.partitionBy(session).orderBy(F.asc_nulls_last(time), F.col(id))


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def numbered_turns(rows: DataFrame, is_turn: Column, w: WindowSpec) -> DataFrame:
    """turn: how many turns began so far; rows before the first are turn 0."""
    return rows.withColumn("turn", F.sum(F.when(is_turn, 1).otherwise(0)).over(running(w)).cast("long"))


def input_spikes(rows: DataFrame, value: str, w: WindowSpec, size: int = SPIKE_WINDOW, multiplier: float = SPIKE_MULTIPLIER) -> DataFrame:
    """Rows over multiplier times the mean of the size rows before them; a full window and a positive mean are needed."""
    before = w.rowsBetween(-size, -1)
    held = rows.filter(F.col(value).isNotNull())
    tagged = held.withColumn("baseline", F.avg(value).over(before)).withColumn("held", F.count(value).over(before))
    return tagged.filter((F.col("held") == size) & (F.col("baseline") > 0) & (F.col(value) > multiplier * F.col("baseline"))).drop("held")


def cache_collapses(rows: DataFrame, cache: str, size: str, w: WindowSpec, source: Column | None = None) -> DataFrame:
    """Rows whose cached part fell by half or more against the row before, of about the same size; an estimated row between breaks the chain."""
    api = source if source is not None else F.lit(True)
    tagged = rows.withColumn("is_api", api).withColumn("prior", F.lag(F.struct(F.col(cache).alias("cache"), F.col(size).alias("size"), F.col("is_api").alias("is_api"))).over(w))
    p = F.col("prior")
    alike = F.abs(F.col(size) - p["size"]) <= COLLAPSE_TOLERANCE * p["size"]
    drop = (p["cache"] - F.col(cache)) / p["cache"]
    hit = F.col("is_api") & p["is_api"] & (p["size"] > 0) & alike & (p["cache"] > 0) & (drop >= COLLAPSE_DROP)
    return tagged.filter(hit).withColumn("drop_ratio", drop).withColumn("previous", p["cache"]).drop("is_api", "prior")


def shifts(rows: DataFrame, value: str, w: WindowSpec, same: str | None = None) -> DataFrame:
    """Rows whose value differs from the one before that isn't null; same: a column that has to be equal and not null in both."""
    held = rows.filter(F.col(value).isNotNull())
    tagged = held.withColumn("previous", F.lag(value).over(w))
    hit = F.col("previous").isNotNull() & (F.col("previous") != F.col(value))
    if same:
        tagged = tagged.withColumn("previous_same", F.lag(same).over(w))
        hit = hit & (F.col("previous_same") == F.col(same))
        return tagged.filter(hit).drop("previous_same")
    return tagged.filter(hit)


def carried(rows: DataFrame, value: Column, w: WindowSpec, name: str) -> DataFrame:
    """name: the latest value so far that isn't null."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(running(w)))


def repeat_runs(rows: DataFrame, kind: str, fingerprint: str, w: WindowSpec, thresholds: dict[str, int] | None = None, breakers: tuple[str, ...] = BREAKERS) -> DataFrame:
    """Runs of equal fingerprints of a watched kind: session_id, kind, fingerprint, first_id, last_id, count.

    A breaker of any kind, another fingerprint of the kind, and a null one end a run; rows of other kinds don't.
    """
    thresholds = thresholds or REPEATS
    session = "session_id"
    out = None
    for watched, least in thresholds.items():
        part = rows.filter((F.col(kind) == watched) | F.col(kind).isin(*breakers))
        mine = (F.col(kind) == watched) & F.col(fingerprint).isNotNull()
        part = part.withColumn("mine", mine).withColumn("before", F.lag(F.when(mine, F.col(fingerprint))).over(w))
        fresh = ~F.col("mine") | ~F.col("before").eqNullSafe(F.col(fingerprint))
        part = part.withColumn("island", F.sum(F.when(fresh, 1).otherwise(0)).over(running(w))).filter("mine")
        runs = part.groupBy(session, "island", F.col(fingerprint).alias("fingerprint")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("count"))
        runs = runs.filter(F.col("count") >= least).select(session, F.lit(watched).alias("kind"), "fingerprint", "first_id", "last_id", "count")
        out = runs if out is None else out.union(runs)
    return out


def paired_results(calls: DataFrame, results: DataFrame, key: list[str], time: str, id: str, last: bool = False) -> DataFrame:
    """calls with the first (or last) result of their key; calls without one stay."""
    order = [F.desc_nulls_last(time), F.desc(id)] if last else [F.asc_nulls_last(time), F.col(id)]
    picked = results.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n = 1").drop("n")
    return calls.join(picked, key, "left")


def gap_sessions(rows: DataFrame, key: str, time: str, id: str, minutes: int = 30) -> DataFrame:
    """rows with part: how many pauses of minutes or more came before, in a key's order of time."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(time), F.col(id))
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)
    tagged = rows.withColumn("pause", pause)
    return tagged.withColumn("part", F.sum(F.when(F.col("pause") >= minutes * 60_000_000, 1).otherwise(0)).over(running(w)).cast("long")).drop("pause")


def session_bounds(rows: DataFrame, key: str = "session_id", time: str = "event_at", closing: Column | None = None) -> DataFrame:
    """First and last time of each session, its number of rows, and whether any of them closed it."""
    closed = F.max(F.when(closing, 1).otherwise(0)) if closing is not None else F.lit(0)
    return rows.groupBy(key).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("n_events"), closed.alias("closed"))


def numbered_after(rows: DataFrame, order: list[str], base: int, name: str = "write_seq") -> DataFrame:
    """rows numbered from base + 1 in the order of columns (nulls last), without bringing them to one task.

    Rows are dealt to ranges, counted there, and numbered within their range after those before it.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    ranged = written(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    counts = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], base
    for r in sorted(counts):
        starts.append((r, total))
        total += counts[r]
    first = rows.sparkSession.createDataFrame(starts, "range int, start long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    return ranged.join(F.broadcast(first), "range").withColumn(name, F.col("start") + place).drop("range", "start")


def chronological() -> list[Column]:
    """The order of a session's events, hook-only ones (no id) among them: time (nulls last), base rows first, then where they come from."""
    return [F.asc_nulls_last("event_at"), F.col("id").isNull(), F.asc_nulls_last("id"), F.coalesce("source_path", F.lit("")), F.coalesce("source_offset", F.lit(-1)), F.coalesce("seq", F.lit(-1)), F.coalesce("event_key", F.lit("")), F.col("type")]


def with_hooks_in_place(stream: DataFrame, kinds: tuple[str, ...] = ("command_start", "tool_call", *BREAKERS)) -> DataFrame:
    """place: the order of a stream in which base rows keep theirs (position), and each timed hook-only row of a kind that runs are made of stands before the first later base row; other hook-only rows come last."""
    hook = F.col("id").isNull() & F.col("type").isin(*kinds) & F.col("event_at").isNotNull()
    s = stream.withColumn("hook", hook)
    base = s.filter("not hook").withColumn("rank", F.col("position").cast("double"))
    later = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("event_at"), F.col("hook")).rowsBetween(0, Window.unboundedFollowing)
    marked = s.withColumn("next", F.min(F.when(~F.col("hook") & F.col("event_at").isNotNull(), F.struct("event_at", "position"))).over(later))
    mine = marked.filter("hook").withColumn("rank", F.coalesce(F.col("next.position") - 0.5, F.lit(float(1 << 52)))).drop("next")
    both = base.unionByName(mine)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("rank", F.asc_nulls_last("event_at"), F.coalesce("event_key", F.lit(""))))).drop("hook", "rank")


def greatest_counts(rows: DataFrame, session: str, total: str, cached: str, output: str) -> DataFrame:
    """Tokens of sessions that report totals so far: the greatest of each, input less what was cached."""
    c = lambda name: F.coalesce(name, F.lit(0))
    return rows.groupBy(session).agg(F.max(F.greatest(F.lit(0), c(total) - c(cached))).alias("input_tokens"), F.max(c(output)).alias("output_tokens"), F.max(c(cached)).alias("cache_read_tokens"))


def fingerprints(events: DataFrame, shell: tuple[str, ...]) -> DataFrame:
    """events (type, tool, input, outcome: null if there was none) with fingerprint: what was run with which arguments to which outcome.

    Arguments are a JSON object whose keys are put in order; a shell's count only with command, folder
    and its other names.  A shell's tool call has none: its command does.  Slots are hashed, so that a
    fingerprint tells nothing of its texts; no outcome differs from an empty one.
    """
    given = F.from_json("input", "map<string,string>")
    kept = F.when(F.col("type") == "command_start", F.map_filter(given, lambda k, v: k.isin("command", "cmd", "workdir", "cwd"))).otherwise(given)
    args = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))
    name = F.when(F.col("type") == "command_start", F.coalesce(F.get_json_object("input", "$.command"), F.get_json_object("input", "$.cmd"))).when((F.col("type") == "tool_call") & ~F.translate(F.lower(F.trim("tool")), "-", "_").isin(*shell), F.col("tool"))
    slot = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    state = F.when(F.col("outcome").isNull(), "missing").otherwise("present")
    whole = F.concat_ws("|", "type", slot(name), slot(F.coalesce(args, F.lit(""))), state, F.coalesce(slot(F.col("outcome")), F.lit("")))
    return events.withColumn("fingerprint", F.when(F.coalesce(name, F.lit("")) != "", whole))
