"""What leaves the engine: line files, shares with a manifest, bundles, training rows; and bundles that come back.

Every sink is an ordinary Spark write, so files are written by the executors and committed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redaction import scrubbed_sessions
from ..operators.transcripts import training_rows
from ..operators.workbench import exported, real_models

BUNDLE_VERSION = 1


def write_sessions(sessions: DataFrame, path: str, user: str) -> None:
    """JSON lines of the sessions with a real model, scrubbed, in a folder for each project."""
    scrubbed_sessions(real_models(sessions), user).withColumn("project_folder", F.coalesce("project", F.lit("unknown"))).write.partitionBy("project_folder").mode("errorifexists").json(path)


def write_share(sessions: DataFrame, path: str, share_id: str) -> DataFrame:
    """A share: sessions/ with the columns that may leave, and manifest/ with one row that counts and sums them; returns the manifest.

    The manifest is written last, so that a folder with one is whole.
    """
    out = exported(sessions)
    spark = sessions.sparkSession
    out.write.mode("errorifexists").json(f"{path}/sessions")
    lines = spark.read.text(f"{path}/sessions")
    # The digest doesn't depend on how rows were dealt to files.
    digest = lines.select(F.sha2("value", 256).alias("h")).agg(F.count(F.lit(1)).alias("sessions"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("digest"))
    manifest = digest.select(F.lit(share_id).alias("share_id"), F.lit(BUNDLE_VERSION).alias("version"), "sessions", "digest")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def bundles(events: DataFrame, usage: DataFrame, anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """session_key, version, body, digest: a replay bundle for each session, as one JSON text and its hash.

    Sections are sorted, null fields are left out, so the same session gives the same digest anywhere.
    Each section is a frame with session_key and ref, an order within the session.
    """
    out = None
    for name, frame in (("events", events), ("token_usage", usage), ("cost_anomalies", anomalies), ("incidents", incidents)):
        rest = sorted(c for c in frame.columns if c not in ("session_key", "ref"))
        part = frame.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("ref", F.to_json(F.struct(*rest)).alias("j")))).alias("rows"))
        part = part.select("session_key", F.concat(F.lit(f'"{name}":['), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]")).alias(name))
        out = part if out is None else out.join(part, "session_key", "left")
    empty = lambda name: F.coalesce(name, F.lit(f'"{name}":[]'))
    body = F.concat(F.lit("{"), F.concat_ws(",", empty("cost_anomalies"), empty("events"), empty("incidents"), empty("token_usage")), F.lit("}"))
    return out.select("session_key", F.lit(BUNDLE_VERSION).alias("version"), body.alias("body")).withColumn("digest", F.sha2("body", 256))


def write_bundles(made: DataFrame, path: str) -> None:
    made.write.mode("errorifexists").json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """session_key, body of bundles of this version whose digest is that of their body; with `problem` where it isn't so."""
    rows = spark.read.schema("session_key string, version int, body string, digest string").json(path)
    problem = F.when(F.coalesce("version", F.lit(-1)) != BUNDLE_VERSION, "version").when(~F.col("digest").eqNullSafe(F.sha2("body", 256)), "digest")
    return rows.select("session_key", "body", problem.alias("problem"))


def bundle_section(read: DataFrame, name: str, schema: str) -> DataFrame:
    """session_key and the rows of one section of sound bundles."""
    rows = F.from_json("body", f"struct<{name}:array<struct<{schema}>>>")[name]
    return read.filter("problem is null").select("session_key", F.explode(rows).alias("r")).select("session_key", "r.*")


def write_training(messages: DataFrame, path: str) -> None:
    """JSON lines, one for each turn."""
    training_rows(messages).write.mode("errorifexists").json(path)


def write_messages(sessions: DataFrame, path: str, buckets: int = 64) -> None:
    """Sessions' messages as a table by a hash of the session, so that one session is read from one folder."""
    sessions.select("session_id", "messages", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("part")).write.partitionBy("part").mode("overwrite").parquet(path)


def read_messages(spark: SparkSession, path: str, session_id: str, buckets: int = 64) -> DataFrame:
    """session_id, messages of one session; only its folder is read."""
    part = F.pmod(F.xxhash64(F.lit(session_id)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).filter((F.col("part") == part) & (F.col("session_id") == session_id)).select("session_id", "messages")


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("errorifexists").json(path)


def line_snippets(lines: DataFrame, refs: DataFrame, most: int = 16 << 20) -> DataFrame:
    """refs (source_path, source_offset) with raw_json of their line; null for lines of more than so many bytes."""
    kept = F.when(F.octet_length("raw_json") <= most, F.col("raw_json"))
    return refs.join(lines.select("source_path", "source_offset", kept.alias("raw_json")), ["source_path", "source_offset"], "left")


def upserted(old: DataFrame, new: DataFrame, kept: tuple[str, ...], frozen: tuple[str, ...] = ("estimated_cost_usd",)) -> DataFrame:
    """The table of sessions after new rows came: a session's new values, but for kept columns (a review, a judge's labels), which stay once set, and frozen ones, which stay once the session had ended.

    A full outer join by session_id; columns that either side lacks are null.
    """
    names = ["session_id", *dict.fromkeys([c for c in (*old.columns, *new.columns) if c != "session_id"])]
    side = lambda f, p: f.select("session_id", F.lit(True).alias(f"{p}here"), *[F.col(c).alias(p + c) for c in f.columns if c != "session_id"])
    both = side(old, "o_").join(side(new, "n_"), "session_id", "full")

    def value(c: str):
        o = F.col("o_" + c) if c in old.columns else F.lit(None)
        n = F.col("n_" + c) if c in new.columns else F.lit(None)
        if c in kept:
            return F.coalesce(o, n)
        if c in frozen and "end_time" in old.columns:
            return F.when(F.col("o_end_time").isNotNull(), F.coalesce(o, n)).otherwise(F.coalesce(n, o))
        return F.when(F.col("n_here"), n).otherwise(o)

    return both.select("session_id", *[value(c).alias(c) for c in names[1:]])
