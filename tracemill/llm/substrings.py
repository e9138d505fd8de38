"""Repeated passages across documents, by seed and extend on winnowed anchors.

Seeds.  Every window of `window` words selects the least fingerprint of its
`SEED`-word runs: its anchor.  The choice depends on the window's words alone, so
equal windows of any documents meet at the same anchor.  Consecutive windows with
one anchor form a run, which is one row.

Extension.  Runs are joined on their anchor.  A run extends both ways to the whole
span of its windows; where an earlier document has the same span, the whole run
repeats.  Where spans at one anchor differ, the match ends somewhere inside: each
distinct span, once, is extended window by window, and equal windows meet by their
128-bit fingerprints.  A group of n equal anchors so costs n rows and never n * n
pairs.  Repeats that touch are joined: what is removed are maximal repeats of at
least `window` words.

Of a passage that documents share, the document with the smallest id keeps it;
windows are judged on the input.

Defined results: null and empty texts have no words; texts of fewer words than a
window keep all; documents with a null id keep all and take nothing from others;
rows that repeat an id have to repeat its text, and keep or lose the same words; an
empty table gives an empty result; other columns stay, whatever their names, but for one
named like the count, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Powers, chunks, field, in_arrow, mix, stored, whole_row, words_of

#: Words in the part of a window that can be its anchor.
SEED = 15
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

_SEED_POWERS = Powers(0xD1342543DE82EF95)
_A_POWERS = Powers(0xAF251AF3B0F025B5)
_B_POWERS = Powers(0xD6E8FEB86659FD93)


class Rolling:
    """Fingerprints of any runs of words of one array."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(hashes) + 1)
        self.prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each values[i:i + width]."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


def grams_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of size words."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return Rolling(hashes, _SEED_POWERS).of(at, at + size)


def runs_of(hashes: np.ndarray, first: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, start (word in its text), windows, anchor, span_a, span_b."""
    counts = np.diff(first)
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < window or not (counts >= window).any():
        return {"text": none, "start": none, "windows": none, "anchor": none, "span_a": none, "span_b": none}
    of = np.repeat(np.arange(len(counts)), counts)
    seed = min(SEED, window)
    keys = grams_of(hashes, seed)
    anchor = _least(keys, window - seed + 1)
    whole = of[: len(anchor)] == of[window - 1 :]
    start = np.flatnonzero(whole)
    picked, text = anchor[start], of[start]
    new = np.r_[True, (np.diff(picked) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1)]
    begin = np.flatnonzero(new)
    windows = np.diff(np.r_[begin, len(start)])
    at = start[begin]
    # Spans are fingerprinted by their runs of `seed` words: polynomials of the words themselves
    # would collide for long words of a Thue-Morse kind, whatever the base.
    end = at + windows + window - seed
    return {
        "text": text[begin],
        "start": at - first[:-1][text[begin]],
        "windows": windows,
        "anchor": keys[picked[begin]].astype(np.int64),
        "span_a": Rolling(keys, _A_POWERS).of(at, end).astype(np.int64),
        "span_b": Rolling(keys, _B_POWERS).of(at, end).astype(np.int64),
    }


def anchored_runs(docs: DataFrame, window: int) -> DataFrame:
    """id, start, windows, anchor, span_a, span_b of every run of docs (id, text)."""
    names = ["start", "windows", "anchor", "span_a", "span_b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = words_of(data, offsets)
                found = runs_of(words.hashes(), words.first, window)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(found["text"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found["start"], pa.int32()), pa.array(found["windows"], pa.int32()), *(pa.array(found[c]) for c in names[2:])], names=["id", *names])

    return in_arrow(docs, work, "id long, start int, windows int, anchor long, span_a long, span_b long")


def _only(docs: DataFrame, ids: DataFrame, few: bool, how: str) -> DataFrame:
    return docs.join(F.broadcast(ids) if few else ids, "id", how)


def _windows(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """id, start and the fingerprint of every window of the spans (id, start, windows)."""
    lists = stored(spans.groupBy("id").agg(F.collect_set(F.struct("start", "windows")).alias("runs")), "spans")
    few = lists.count() <= BROADCAST_IDS
    held = _only(docs, lists.select("id"), few, "left_semi").join(lists, "id").select("id", "text", F.col("runs.start").alias("starts"), F.col("runs.windows").alias("sizes"))

    seed = min(SEED, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = batch.column(2), batch.column(3)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = words_of(data, offsets)
                keys = grams_of(words.hashes(), seed)
                one, two = Rolling(keys, _A_POWERS), Rolling(keys, _B_POWERS)
                of, at = [], []
                for k in range(hi - lo):
                    s, n = (x[lo + k].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, sizes))
                    places = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    of.append(np.full(len(places), k))
                    at.append(places)
                of, at = np.concatenate(of), np.concatenate(at)
                begin = at + words.first[:-1][of]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), *(pa.array(x.of(begin, begin + window - seed + 1).astype(np.int64)) for x in (one, two))], names=["id", "start", "a", "b"])

    return in_arrow(held, work, "id long, start int, a long, b long")


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """id, starts and windows (arrays): the runs of windows of docs (id, text) that an earlier document has too."""
    runs = stored(anchored_runs(docs.filter("id is not null"), window), "runs")
    shared = runs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("high")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits the skewed.
    runs = stored(runs.join(stored(shared, "anchors"), "anchor"), "shared")
    spans = stored(runs.groupBy("anchor", "span_a", "span_b", "low").agg(F.min("id").alias("first_id")), "spans")
    runs = stored(runs.drop("low").join(spans.drop("low"), ["anchor", "span_a", "span_b"]).select("id", "start", "windows", "anchor", (F.col("id") > F.col("first_id")).alias("whole")), "extended")
    whole = runs.filter("whole").select("id", "start", "windows")
    # Anchors at which a span is not the earliest: there windows decide, of each span's first document.
    mixed = spans.filter("first_id > low").select("anchor").distinct()
    odd = runs.filter("not whole").join(mixed, "anchor", "left_semi").select("id", "start", "windows")
    windows = stored(_windows(docs, odd, window), "windows")
    lows = windows.groupBy("a", "b").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    single = windows.join(stored(lows, "lows"), ["a", "b"]).filter("id > first_id").select("id", "start", F.lit(1).alias("windows"))
    return whole.union(single).groupBy("id").agg(F.collect_set(F.struct("start", "windows")).alias("runs")).select("id", F.col("runs.start").alias("starts"), F.col("runs.windows").alias("windows"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, counted: str | None = "n_removed") -> DataFrame:
    """docs with text less its repeated passages, and counted, the number of words that went (None: no such column).

    A removed word goes with the white space after it; texts without repeats stay as they are.
    """
    own = [c for c in docs.columns if counted is None or c.lower() != counted.lower()]
    slim = docs.select(field(id_col).cast("long").alias("id"), field(text).alias("text"))
    found = stored(repeats(slim, window), "repeats")
    few = found.count() <= BROADCAST_IDS
    keyed = docs.select(field(id_col).cast("long").alias("id"), whole_row(docs, (text,)).alias("row"), field(text).alias("text"))
    touched = _only(keyed, found.select("id"), few, "left_semi").join(found, "id").select("row", "text", "starts", "windows")
    schema = T.StructType([touched.schema["row"], T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = words_of(data, offsets)
                held = data.tobytes()
                for k in range(hi - lo):
                    first, last = words.first[k], words.first[k + 1]
                    s, n = (batch.column(c)[lo + k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                    edge = np.zeros(last - first + 1, dtype=np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    begin, after = words.begin[first:last], np.r_[words.begin[first + 1 : last], offsets[k + 1]]
                    parts = [held[offsets[k] : begin[0]], *compress((held[x:y] for x, y in zip(begin.tolist(), after.tolist(), strict=True)), keep.tolist())]
                    texts.append(b"".join(parts).decode())
                    gone.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["row", "text", "gone"])

    order = [F.col("text").alias(text) if c == text else field(c, "row").alias(c) for c in own]
    added = [F.col("gone").alias(counted)] if counted else []
    cut = in_arrow(touched, work, schema).select(*order, *added)
    same = _only(keyed, found.select("id"), few, "left_anti").withColumn("gone", F.lit(0).cast("long")).select(*order, *added)
    return same.union(cut)
