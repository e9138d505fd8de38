"""What the corpus operators share: scratch tables, text chunks and word arrays.

Texts reach Python as Arrow string buffers.  Words are found and fingerprinted
with numpy straight on those bytes, many documents at a time, so a pass over a
corpus costs a few nanoseconds a byte and its memory is bounded by the chunk
size, not by the batch, partition or document count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as scratch_dir

#: Bytes of text that are worked on at once (a longer text is a chunk alone).
CHUNK_BYTES = 512 << 10
#: Rows of a batch that goes to Python at most: a bound on memory where texts are long.
BATCH_ROWS = 1000
#: Bytes up to which a word's fingerprint is a polynomial.
LONG_WORD = 200
#: ASCII white space: the separators of words.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a new scratch table, in the innermost scratch scope."""
    return f"{_SCOPES[-1] if _SCOPES else scratch_dir(spark) + '/tracemill'}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark wrote, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Scratch tables made inside go when it ends: write or collect what is to outlive it before."""
    _SCOPES.append(f"{scratch_dir(spark)}/tracemill/scope-{uuid.uuid4().hex}")
    try:
        yield _SCOPES[-1]
    finally:
        drop_path(spark, _SCOPES.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read again.

    Cuts the lineage: what is read later survives the loss of any executor, and
    nothing before it is computed twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def field(name: str, of: str | None = None) -> Column:
    """The column of that very name, dots and all; of: the struct that holds it."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of df but some as one struct, out of the way of names that are added beside it."""
    names = [c for c in df.columns if c not in but]
    return F.struct(*[field(c).alias(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))


def in_arrow(df: DataFrame, work: Callable, schema: object) -> DataFrame:
    """df.mapInArrow(work, schema), in batches of at most BATCH_ROWS rows (for the session from now on)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    names = df.columns
    if any("." in c or "`" in c for c in names):  # mapInArrow would look for fields of structs
        return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lambda batches: work(b.rename_columns(names) for b in batches), schema)
    return df.mapInArrow(work, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(_ODD)


@dataclass
class Words:
    """The words of a run of texts.

    data: the texts' bytes, joined; begin, end: each word's bytes in it; first:
    index of each text's first word, and the number of words at its end.
    """

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word (equal words, equal fingerprints)."""
        up, down = BYTE_POWERS.upto(len(self.data) + 1)
        prefix = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=prefix[1:])
        out = mix((prefix[self.end] - prefix[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))
        # Modulo 2**64 there are pairs of runs of 1024 bytes and more that collide for every base.
        for i in np.flatnonzero(self.end - self.begin > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.begin[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; a word never crosses from one text to the next."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    begin = np.flatnonzero(first)
    return Words(data, begin, np.flatnonzero(last) + 1, np.searchsorted(begin, offsets), offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, held = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def sums_by_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (one a word) over each text."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
