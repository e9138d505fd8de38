"""Event batches into an append-only table, and derived tables for the sessions that they touch.

A batch is written once whatever is replayed: rows whose identity the table has are left
out.  No row is too late: a late row's session is computed anew as a whole, so a stream
ends with what a batch over the same rows gives.  Tables lie in folders by a hash of the
session, and a batch reads and writes those of its own sessions only, so what it costs
follows the sessions that it touches and not the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.canonical import append_new
from ..session import exists

BUCKETS = 64
IDLE_SECONDS = 3600


def _part(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def parts_of(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The folders of the sessions in rows; there are as many as buckets at most."""
    return sorted(r[0] for r in rows.select(_part(key, buckets)).distinct().collect())


class EventTable:
    """Parquet files of events under a path, in folders by session; `append` is idempotent by the identity columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, identity: list[str], key: str = "session_id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.identity, self.key, self.buckets = spark, path, schema, identity, key, buckets

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All events, or those in some folders."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, part int").parquet(self.path)
        return (rows if parts is None else rows.filter(F.col("part").isin(*parts))).drop("part")

    def append(self, rows: DataFrame) -> None:
        """Rows whose identity the folders of their sessions lack; identity has to tell the session."""
        known = self.read(parts_of(rows, self.key, self.buckets))
        append_new(known, rows.select(*known.columns), self.identity).withColumn("part", _part(self.key, self.buckets)).write.mode("append").partitionBy("part").parquet(self.path)


class SessionTable:
    """A derived table by session: each version holds the folders that it replaced, and a folder's last version counts.

    A version counts once its writing ended (it has a _SUCCESS file); what later ones replace is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "session_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _folders(self) -> tuple[int, dict[int, list[str]]]:
        """The last version, and the paths of each folder, oldest first."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[int, list[str]] = {}
        last = 0
        if not fs.exists(root):
            return last, found
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v"))
        for v in versions:
            last = max(last, v)
            if not fs.exists(jvm.Path(f"{self.path}/v{v}/_SUCCESS")):
                continue
            for s in fs.listStatus(jvm.Path(f"{self.path}/v{v}")):
                name = s.getPath().getName()
                if name.startswith("part="):
                    found.setdefault(int(name[5:]), []).append(f"{self.path}/v{v}/{name}")
        return last, found

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """All rows, or those in some folders; None before the first."""
        _, found = self._folders()
        paths = [p[-1] for part, p in sorted(found.items()) if parts is None or part in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def replace(self, touched: DataFrame, rows: DataFrame) -> None:
        """rows in place of all rows of touched sessions; each touched session has to have one at least."""
        parts = parts_of(touched, self.key, self.buckets)
        last, _ = self._folders()
        old = self.read(parts)
        new = rows if old is None else old.join(touched, self.key, "left_anti").unionByName(rows)
        new.withColumn("part", _part(self.key, self.buckets)).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{last + 1}")
        self._clean()

    def _clean(self) -> None:
        """Delete folders that two later versions have replaced: a reader of the one before still has its files."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for paths in self._folders()[1].values():
            for path in paths[:-2]:
                where = jvm.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def ingest(stream: DataFrame, events: EventTable, derived: SessionTable, derive: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "session_id") -> StreamingQuery:
    """A query that takes all of what is there: events are appended, touched sessions derived anew."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        if not rows.isEmpty():
            events.append(rows)
            touched = rows.select(key).distinct()
            derived.replace(touched, derive(events.read(parts_of(touched, key, events.buckets)).join(touched, key, "left_semi")))
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_with_overrides(events_in: DataFrame, overrides_in: DataFrame, events: EventTable, overrides: EventTable, derived: SessionTable, derive: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, key: str = "session_id") -> None:
    """Two streams, each with its own frontier, into one derived table: a session is derived anew when either brings a row of it.

    One runs to its end before the other, so a session that both touch is derived twice, and ends as one batch of both would leave it.
    """

    def rebuild(rows: DataFrame, table: EventTable) -> None:
        rows = rows.persist()
        if not rows.isEmpty():
            table.append(rows)
            touched = rows.select(key).distinct()
            parts = parts_of(touched, key, events.buckets)
            own = lambda t: t.read(parts).join(touched, key, "left_semi")
            made = derive(own(events), own(overrides))
            derived.replace(touched.join(made.select(key).distinct(), key, "left_semi"), made)
        rows.unpersist()

    for stream, table, name in ((events_in, events, "events"), (overrides_in, overrides, "overrides")):
        stream.writeStream.foreachBatch(lambda rows, _, t=table: rebuild(rows, t)).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()


def touched_sessions(events: DataFrame, overrides: DataFrame, last_event: int, last_write: int, key: str = "session_id") -> DataFrame:
    """Sessions with an event after last_event or an override written after last_write."""
    return events.filter(F.col("id") > last_event).select(key).union(overrides.filter(F.col("write_seq") > last_write).select(key)).distinct()


def closed_when_idle(sessions: DataFrame, now: Column, seconds: int = IDLE_SECONDS) -> DataFrame:
    """sessions (status, closed, last_seen) with status ended where they were closed or nothing came for so long; ended never goes back."""
    idle = F.col("last_seen") <= now - F.make_dt_interval(secs=F.lit(seconds))
    return sessions.withColumn("status", F.when((F.col("status") == "ended") | F.col("closed") | F.coalesce(idle, F.lit(False)), "ended").otherwise("active"))


def drained(flagged: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str = "session_id") -> DataFrame:
    """work's result for the flagged rows that path lacks, added to it; what a run that broke off has written isn't done again."""
    spark = flagged.sparkSession
    done = spark.read.parquet(path).select(key).distinct() if exists(spark, path) else None
    left = flagged if done is None else flagged.join(done, key, "left_anti")
    work(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
