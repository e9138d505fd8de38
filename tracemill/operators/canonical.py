"""The canonical view of events: one row for each event key, with higher ranked overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CONFIDENCE_RANK


def rank_of(confidence: Column) -> Column:
    out = None
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank) if out is None else out.when(confidence == name, rank)
    return out.otherwise(-1)


def first_by_key(base: DataFrame, session: str = "session_id", key: str = "event_key") -> DataFrame:
    """The earliest row of each key (time with nulls last, path, offset, seq); rows without a key stay."""
    order = [F.asc_nulls_last("event_at"), F.col("source_path"), F.col("source_offset"), F.col("seq")]
    w = Window.partitionBy(session, key).orderBy(*order)
    keyed = base.filter(F.col(key).isNotNull()).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return keyed.unionByName(base.filter(F.col(key).isNull()))


def canonical(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """base with overrides of at least the same rank in place of their rows, and overrides without a row added.

    On reading an override of equal rank wins; on writing (`fold_overrides`) the first does.
    """
    keyed = first_by_key(base).select("session_id", "event_key", "id", "type", "event_at", "confidence", "source")
    b = keyed.filter("event_key is not null").alias("b")
    o = overrides.select("session_id", "event_key", "type", "event_at", "confidence", "source").alias("o")
    same = (F.col("b.session_id") == F.col("o.session_id")) & (F.col("b.event_key") == F.col("o.event_key"))
    wins = F.col("o.event_key").isNotNull() & (F.col("b.event_key").isNull() | (rank_of(F.col("o.confidence")) >= rank_of(F.col("b.confidence"))))
    pick = lambda c: F.when(wins, F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}"))).otherwise(F.col(f"b.{c}")).alias(c)
    origin = F.when(F.col("b.event_key").isNull(), "hook").when(wins, "override").otherwise("base").alias("origin")
    merged = b.join(o, same, "full").select(F.coalesce("b.session_id", "o.session_id").alias("session_id"), F.coalesce("b.event_key", "o.event_key").alias("event_key"), F.col("b.id").alias("id"), pick("type"), pick("event_at"), pick("confidence"), pick("source"), origin)
    return merged.unionByName(keyed.filter("event_key is null").withColumn("origin", F.lit("base")))


def fold_overrides(writes: DataFrame, order: str = "write_seq") -> DataFrame:
    """What stays of successive writes to each key: a write replaces another only at a higher rank, so the earliest of the highest."""
    w = Window.partitionBy("session_id", "event_key").orderBy(rank_of(F.col("confidence")).desc(), F.col(order))
    return writes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def capability_matrix(types: DataFrame, sessions: DataFrame, base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every type of every session with its events and overrides counted.

    types is the fixed list of event types, so the product with sessions is a projection of sessions.
    """
    grid = sessions.select("session_id").crossJoin(F.broadcast(types.select("type")))
    n_base = base.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n_events"))
    n_over = overrides.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n_overrides"))
    out = grid.join(n_base, ["session_id", "type"], "left").join(n_over, ["session_id", "type"], "left")
    return out.select("session_id", "type", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"))


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of incoming whose raw identity existing lacks, once each: an idempotent append."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def merged_sessions(old: DataFrame, new: DataFrame, key: str, frozen: list[str], kept: list[str], fresh: list[str], ended: str = "ended") -> DataFrame:
    """An index upsert: fresh columns come from new, kept (review) columns from old, frozen ones from old once its status is ended."""
    o, n = old.alias("o"), new.alias("n")
    done = F.col("o.status") == ended
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fresh]
    cols += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept]
    cols += [F.when(done & F.col(f"o.{c}").isNotNull(), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in frozen]
    status = F.when(done | (F.col("n.status") == ended), ended).otherwise(F.coalesce("n.status", "o.status")).alias("status")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols, status)


def coverage(matrix: DataFrame, supported: DataFrame) -> DataFrame:
    """session_id, state, types: of a capability matrix, what a session's client can't tell (missing), could have (absent), and did (present); supported: type."""
    can = supported.select("type", F.lit(True).alias("can"))
    state = F.when(F.col("n_events") + F.col("n_overrides") > 0, "present").when(F.col("can"), "supported_but_absent").otherwise("missing")
    return matrix.join(F.broadcast(can), "type", "left").groupBy("session_id", state.alias("state")).agg(F.array_sort(F.collect_list("type")).alias("types"))
