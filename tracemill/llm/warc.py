"""WARC captures: reading, writing, and resolving not-modified revisits.

A revisit of the profile server-not-modified has no body; it stands for the latest
earlier full response of its canonical URL.  That is an as-of join: all records are
range-partitioned by (URL, time, id) and scanned once in that order, carrying the
last full response.  Ranges cut through a URL with many captures, so no URL lands
in one task whole; each range reports its last response, and from these reports,
one for each range, the next range's first URL gets what it lacks.  Only keys,
times and validators move; headers and bodies are joined for the revisits' sources.

A source is accepted if its validators agree with the revisit's: entity tags by weak
comparison where both have one, else modification dates where both have one.  Headers
merge as for a stored response: the revisit's replace the source's, but for those
that describe the body or the connection.

`read_warc` gives a file's records and `captures` makes of them what `resolve_revisits`
takes.

Defined results: a record without a URL or time is never a source nor resolved;
equal times are ordered by id; repeated rows are records each; null headers count as
none; an empty table gives an empty result; the result has its own columns only.
"""

from __future__ import annotations

import gzip
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, stored

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

# Headers of a 304 that don't replace the stored response's.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")

#: What every record starts with, and what then follows.
MARK, _VERSION = b"WARC/1.", re.compile(rb"[0-9]\r?\n")
RECORD = "record_id string, type string, url string, at timestamp, profile string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """The URL by which captures meet: no scheme, user, www., default port, fragment or closing slash; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""))


def _fields(raw: bytes) -> dict[str, str]:
    """Header lines by name in lower case; the values of a repeated name are joined by a comma."""
    out: dict[str, str] = {}
    for row in raw.split(b"\n"):
        name, colon, value = row.decode("utf-8", "replace").partition(":")
        if colon and name.strip():
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _record(head: dict[str, str], block: bytes) -> dict | None:
    """A RECORD row of a response or revisit; None for other kinds."""
    if head.get("warc-type") not in ("response", "revisit"):
        return None
    first, _, rest = block.partition(b"\r\n")
    raw, _, body = rest.partition(b"\r\n\r\n") if not rest.startswith(b"\r\n") else (b"", b"", rest[2:])
    status = first.split(b" ")[1] if first.startswith(b"HTTP/") and first.count(b" ") else b""
    return {
        "record_id": head.get("warc-record-id"),
        "type": head["warc-type"],
        "url": head.get("warc-target-uri"),
        "at": pd.to_datetime(head.get("warc-date"), utc=True, errors="coerce"),
        "profile": head.get("warc-profile"),
        "status": int(status) if status.isdigit() else None,
        "headers": _fields(raw),
        "body": body if head["warc-type"] == "response" else None,
    }


def records_of(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The response and revisit records of what stands between MARKs, in the order of a file.

    A block that has MARK in itself comes as several pieces; they are joined until there are as
    many bytes as its header tells.  What doesn't start as a record (the rest of a file that is cut
    short, or what comes before the first one) is left out.
    """
    held: list[bytes] = []
    size, need = 0, 0
    for piece in pieces:
        if held:
            held.append(MARK)
            size += len(MARK)
        elif not _VERSION.match(piece):
            continue
        held.append(piece)
        size += len(piece)
        if size < need:
            continue
        whole = b"".join(held)
        end = whole.find(b"\r\n\r\n")
        if end < 0:
            held, need = [whole], size + 1
            continue
        head = _fields(whole[:end])
        length = head.get("content-length", "0")
        need = end + 4 + (int(length) if length.isdigit() else 0)
        if size < need:
            held = [whole]
            continue
        record = _record(head, whole[end + 4 : need])
        if record is not None:
            yield record
        held, size, need = [], 0, 0


def format_warc(record: dict) -> bytes:
    """One record as a gzip member."""
    lines = [f"HTTP/1.1 {record['status'] or 200} -", *(f"{k}: {v}" for k, v in sorted((record["headers"] or {}).items())), "", ""]
    block = "\r\n".join(lines).encode() + (record["body"] or b"")
    head = {"WARC-Type": record["type"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["url"], "WARC-Date": record["at"].strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Length": len(block)}
    if record.get("profile"):
        head["WARC-Profile"] = record["profile"]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of WARC files, plain or gzipped (by record or as one).

    Files are read as text between MARKs, so a task holds a record at a time and never a file;
    plain files are split.  A record of a plain file whose block has MARK in itself has to lie within
    one split; records of more than 2 GiB aren't supported.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "type", "url", "at", "profile", "status", "headers", "body"]
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("at", pa.timestamp("us", tz="UTC")), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

        def out(rows: list[dict]) -> pa.RecordBatch:
            columns = {c: [r[c] for r in rows] for c in names}
            columns["at"] = [None if pd.isna(x) else x.to_pydatetime() for x in columns["at"]]
            columns["headers"] = [list(x.items()) for x in columns["headers"]]
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        def pieces() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                part = batch.column(0).to_pylist()
                for i, where in enumerate(part):
                    yield where, batch.column(1)[i].as_py()

        rows, held = [], 0
        for _, group in itertools.groupby(pieces(), key=lambda p: p[0]):
            for record in records_of(piece for _, piece in group):
                rows.append(record)
                held += len(record["body"] or b"") + 1000
                if held > 8 << 20:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    part = F.concat_ws("@", "_metadata.file_path", "_metadata.file_block_start")
    pieces = spark.read.option("lineSep", MARK.decode()).text(path).select(part.alias("part"), F.col("value").cast("binary").alias("piece"))
    return in_arrow(pieces, work, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """RECORD rows as resolve_revisits takes them: id, url, at (microseconds), full, headers, body, and record_id.

    A response is full unless its status is 304; of revisits those stay that say not modified.
    """
    revisit = (F.col("type") == "revisit") & F.regexp_like("profile", F.lit(r"/revisit/server-not-modified$"))
    response = (F.col("type") == "response") & (F.col("status").isNull() | (F.col("status") != 304))
    kept = records.filter(F.coalesce(revisit | response, F.lit(False)))
    return kept.select(F.xxhash64("record_id", "url", "at").alias("id"), "url", F.unix_micros("at").alias("at"), (F.col("type") == "response").alias("full"), "headers", "body", "record_id")


def latest_before(records: DataFrame) -> DataFrame:
    """id and source (null if none) of each record of (url_key, at long, id long, full boolean) that isn't full: the latest earlier full one of its URL."""
    ordered = records.filter("url_key is not null and at is not null")
    ranged = ordered.repartitionByRange("url_key", "at", "id").sortWithinPartitions("url_key", "at", "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        first_key = key = source = None
        for frame in frames:
            if not len(frame):
                continue
            keys, ids, full = frame["url_key"].to_numpy(), frame["id"].to_numpy(), frame["full"].to_numpy()
            new = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
            if first_key is None:
                first_key = keys[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            last = np.maximum.accumulate(np.where(full, np.arange(len(keys)), -1))
            own = last >= np.maximum(start, 0)  # a full response of the same URL in this frame
            carried = ~own & (start < 0) & (source is not None)
            lacks = ~own & ~carried
            found = np.where(own, ids[np.maximum(last, 0)], source if source is not None else 0)
            pending = (keys == first_key) & lacks
            out = pd.DataFrame({"part": part, "id": ids, "source": pd.arrays.IntegerArray(found.astype(np.int64), lacks), "pending": pending, "first_key": None, "last_key": None})
            yield out[~full]
            key, source = keys[-1], None if lacks[-1] else int(found[-1])
        if first_key is not None:
            yield pd.DataFrame({"part": [part], "id": pd.array([None], dtype="Int64"), "source": pd.array([source], dtype="Int64"), "pending": [False], "first_key": [first_key], "last_key": [key]})

    scanned = stored(ranged.select("url_key", "id", "full").mapInPandas(work, "part int, id long, source long, pending boolean, first_key string, last_key string"), "scanned")
    # One report for each range: what the next range's first URL starts with.
    carried, key, source = [], None, None
    for r in scanned.filter("last_key is not null").orderBy("part").collect():
        if r["first_key"] == key and source is not None:
            carried.append((r["part"], source))
        source = r["source"] if r["source"] is not None or r["last_key"] != r["first_key"] or r["last_key"] != key else source
        key = r["last_key"]
    carry = records.sparkSession.createDataFrame(carried, "part int, carried long")
    rows = scanned.filter("last_key is null").join(F.broadcast(carry), "part", "left")
    return rows.select("id", F.coalesce("source", F.when(F.col("pending"), F.col("carried"))).alias("source"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(source: Column, revisit: Column) -> Column:
    """The source's headers, replaced by the revisit's where those are permitted."""
    none = F.create_map().cast("map<string,string>")
    permitted = F.map_filter(F.coalesce(revisit, none), lambda k, v: ~k.isin(*KEPT_HEADERS))
    stays = F.map_filter(F.coalesce(source, none), lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(stays, permitted)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of records (id long, url, at long, full boolean, headers, body) with what it stands for.

    id, url_key, source_id, outcome (resolved, validators_differ or no_source), and headers
    (merged) and body of those resolved.  Header names have to be in lower case.
    """
    keyed = records.withColumn("url_key", canonical_url(F.col("url")))
    found = stored(latest_before(keyed.select("url_key", "at", "id", "full")), "sources")
    revisits = keyed.filter("not full").select("id", "url_key", F.col("headers").alias("own")).join(found, "id", "left")
    needed = found.filter("source is not null").select("source").distinct()
    sources = keyed.filter("full").select(F.col("id").alias("source"), F.col("headers").alias("stored"), "body").join(needed, "source", "left_semi")
    both = revisits.join(sources, "source", "left")
    own_tag, tag = _weak(F.col("own")["etag"]), _weak(F.col("stored")["etag"])
    own_date, date = F.col("own")["last-modified"], F.col("stored")["last-modified"]
    agree = F.when(own_tag.isNotNull() & tag.isNotNull(), own_tag == tag).when(own_date.isNotNull() & date.isNotNull(), own_date == date).otherwise(True)
    outcome = F.when(F.col("source").isNull(), "no_source").when(agree, "resolved").otherwise("validators_differ")
    done = both.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select("id", "url_key", F.col("source").alias("source_id"), "outcome", F.when(resolved, merged_headers(F.col("stored"), F.col("own"))).alias("headers"), F.when(resolved, F.col("body")).alias("body"))
