"""Cutting long sessions into parts at pauses, compactions and changes of how tools are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Signals and their weights; where they meet, and what segments may be small.
WEIGHTS = {"compaction": 0.8, "time_gap": 0.9, "tool_mode": 0.5, "workspace": 0.6}
REACH, MIN_USER_MESSAGES, MIN_MESSAGES, MIN_SCORE = 2, 2, 3, 0.6


def _w(session: str, index: str):
    return Window.partitionBy(session).orderBy(index)


def exchanges(messages: DataFrame, session: str, index: str, role: str, tools: Column) -> DataFrame:
    """session, exchange, first_index, n_tools, mode: a user message and what follows it; mode is qa, light (to 3 tools) or heavy."""
    w = _w(session, index).rowsBetween(Window.unboundedPreceding, 0)
    tagged = messages.withColumn("exchange", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w).cast("long")).filter("exchange > 0")
    out = tagged.groupBy(session, "exchange").agg(F.min(index).alias("first_index"), F.sum(tools).cast("long").alias("n_tools"))
    return out.withColumn("mode", F.when(F.col("n_tools") == 0, "qa").when(F.col("n_tools") <= 3, "light").otherwise("heavy"))


def mode_shifts(exchange: DataFrame, session: str) -> DataFrame:
    """session, idx: first messages of exchanges that go from qa to heavy or back."""
    before = F.lag("mode").over(Window.partitionBy(session).orderBy("exchange"))
    tagged = exchange.withColumn("before", before)
    hit = ((F.col("before") == "qa") & (F.col("mode") == "heavy")) | ((F.col("before") == "heavy") & (F.col("mode") == "qa"))
    return tagged.filter(hit).select(session, F.col("first_index").alias("idx"))


def snapped(boundaries: DataFrame, messages: DataFrame, session: str, index: str, role: str) -> DataFrame:
    """boundaries moved back to the nearest user message; those that land on the first message go."""
    w = _w(session, index).rowsBetween(Window.unboundedPreceding, 0)
    users = messages.select(session, F.col(index).alias("at"), F.max(F.when(F.col(role) == "user", F.col(index))).over(w).alias("user_at"))
    moved = boundaries.join(users, (boundaries[session] == users[session]) & (F.col("idx") == F.col("at"))).select(boundaries[session], F.col("user_at").alias("idx"), *[c for c in boundaries.columns if c not in (session, "idx")])
    return moved.filter("idx is not null and idx > 0")


def scored(signals: DataFrame, session: str) -> DataFrame:
    """session, idx, confidence, reason of each place where a signal (session, idx, signal) fires; signals within REACH places agree.

    One signal counts its weight, two the greater one and .1, three and more .95.
    """
    places = signals.select(session, "idx").distinct()
    near = F.explode(F.sequence(F.col("idx") - REACH, F.col("idx") + REACH))
    spread = signals.select(session, near.alias("idx"), "signal").distinct()
    met = places.join(spread, [session, "idx"]).groupBy(session, "idx").agg(F.sort_array(F.collect_set("signal")).alias("names"))
    weight = F.array_max(F.transform("names", lambda n: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(0.5))))
    confidence = F.when(F.size("names") >= 3, 0.95).when(F.size("names") == 2, weight + 0.1).otherwise(weight)
    return met.select(session, "idx", confidence.alias("confidence"), F.array_join("names", " + ").alias("reason"))


def kept_boundaries(boundaries: DataFrame, messages: DataFrame, session: str, index: str, role: str) -> DataFrame:
    """boundaries less those whose segment has too few messages; the last segment may be small, neighbours are the original ones."""
    w = Window.partitionBy(session).orderBy("idx")
    spans = boundaries.withColumn("until", F.lead("idx").over(w))
    m = messages.select(F.col(session).alias("m_session"), F.col(index).alias("m_index"), F.col(role).alias("m_role"))
    inside = (F.col("m_session") == F.col(session)) & (F.col("m_index") >= F.col("idx")) & (F.col("until").isNull() | (F.col("m_index") < F.col("until")))
    counted = spans.join(m, inside, "left").groupBy(*boundaries.columns, "until").agg(F.count("m_index").alias("n"), F.sum(F.when(F.col("m_role") == "user", 1).otherwise(0)).alias("users"))
    return counted.filter(F.col("until").isNull() | (F.col("users") >= MIN_USER_MESSAGES) | (F.col("n") >= MIN_MESSAGES)).select(*boundaries.columns)


def split(messages: DataFrame, boundaries: DataFrame, session: str, index: str) -> DataFrame:
    """messages with segment (from 0) and segment_id (the session's id with _seg-NN)."""
    cut = boundaries.select(F.col(session).alias("cut_session"), F.col("idx").alias("cut"))
    tagged = messages.join(cut, (F.col(session) == F.col("cut_session")) & (F.col(index) == F.col("cut")), "left")
    w = _w(session, index).rowsBetween(Window.unboundedPreceding, 0)
    segment = F.count("cut").over(w)
    return tagged.withColumn("segment", segment).drop("cut_session", "cut").withColumn("segment_id", F.concat(F.col(session).cast("string"), F.lit("_seg-"), F.lpad(F.col("segment").cast("string"), 2, "0")))


def training_turns(messages: DataFrame, session: str, index: str, role: str, text: str) -> DataFrame:
    """session, turn, prompt, reply, n_steps: a user message, the last message of the assistant before the next one, and how many came between (`transcripts.training_rows` has replies by their mark)."""
    w = _w(session, index).rowsBetween(Window.unboundedPreceding, 0)
    tagged = messages.withColumn("turn", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w).cast("long")).filter("turn > 0")
    made = F.col(role) == "assistant"
    out = tagged.groupBy(session, "turn").agg(F.min_by(text, F.when(F.col(role) == "user", F.col(index))).alias("prompt"), F.max_by(text, F.when(made, F.col(index))).alias("reply"), F.sum(F.when(made, 1).otherwise(0)).cast("long").alias("n_steps"))
    return out.filter("n_steps > 0")
