"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

`tokenize_pieces` turns documents into pieces of at most `capacity` tokens.
`pack_pieces` packs pieces of any table into bins: every partition is packed by
best-fit decreasing, and a dual-feasible-function lower bound certifies its bin
count.  Partitions whose count is above their bound, and the open bins that
partitions leave, give their pieces up to an exchange: those pieces are dealt
anew into fewer and, for a few rounds, larger partitions and packed again, until the
global bound is met or an exchange saves no bin.

Defined results: null or empty text is a piece of the end token alone; repeated
rows are packed once each; a null doc_id is kept; an empty table gives an empty
result; extra columns named like the added ones are replaced by them.
"""

from __future__ import annotations

import array
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, free_name, in_arrow, lowered, stored

#: Pieces that one packing task holds (a few tens of bytes each).
GROUP_PIECES = 32_768
#: Exchange rounds in each of which tasks may hold twice as many pieces as in the one before.
GROWTH = 3
#: Words that a task keeps encoded; a bound on its memory, not on its results.
CACHE_WORDS = 300_000

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK &= ~_ALNUM
_MARK[65:91] = False
_MARK[39] = False


class WordEncoder(dict):
    """Word (bytes, A-Z lowered) to its ids as packed little-endian uint32.

    The tokenizer drops white space and never merges across it, nor across a
    border of an ASCII letter or digit and an ASCII mark other than the
    apostrophe, so that ids of a text are the ids of such words in turn.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = [x.id for x in self.model.tokenize(word.decode())]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        packed = array.array("I", ids).tobytes()
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text of a column."""
        ids_of = self.__getitem__
        for lo, hi, data, offsets in chunks(column):
            data = lowered(data)
            alnum, mark = _ALNUM[data], _MARK[data]
            cuts = np.flatnonzero((alnum[:-1] & mark[1:]) | (mark[:-1] & alnum[1:])) + 1
            # A special token's own string stays whole: it is found before marks are.
            held = data.tobytes()
            if b"<|" in held and b"|>" in held:
                cuts = cuts[:0]
                held = None
                yield from self._special(column, lo, hi)
                continue
            spaced = np.insert(data, cuts, 32).tobytes()
            at = offsets + np.searchsorted(cuts, offsets, side="left")
            for i in range(hi - lo):
                yield b"".join(map(ids_of, spaced[at[i] : at[i + 1]].split()))

    def _special(self, column: pa.Array, lo: int, hi: int) -> Iterator[bytes]:
        for text in column.slice(lo, hi - lo).to_pylist():
            ids = self.tokenizer.encode(text or "", add_special_tokens=False).ids
            yield array.array("I", ids).tobytes()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, text: str = "text") -> DataFrame:
    """docs with a row for each piece, and piece, start, length and ids (binary, little-endian uint32) added.

    A document is its tokens and end_id.  Only documents of more than capacity
    ids are cut, into pieces of capacity ids and a last one of the rest.
    """
    keep = [f for f in docs.schema.fields if f.name.lower() not in {"piece", "start", "length", "ids", text.lower()}]
    added = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(keep + added)
    names = [f.name for f in keep]
    end = array.array("I", [end_id]).tobytes()
    size = 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            row, piece, start, length, ids, held = [], [], [], [], [], 0
            own = batch.select(names)

            def out(row, piece, start, length, ids, own=own):
                arrays = own.take(pa.array(row, pa.int64())).columns if names else []
                return pa.RecordBatch.from_arrays([*arrays, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[*names, "piece", "start", "length", "ids"])

            for i, packed in enumerate(encoder.texts(batch.column(text))):
                packed += end
                for k, at in enumerate(range(0, len(packed), size)):
                    part = packed[at : at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
                    held += len(part)
                if held > 8 << 20:
                    yield out(row, piece, start, length, ids)
                    row, piece, start, length, ids, held = [], [], [], [], [], 0
            if row:
                yield out(row, piece, start, length, ids)

    return in_arrow(docs.select(*map(field, names), field(text).alias(text)), work, schema)


def bound_parts(capacity: int, cut_points: tuple[int, ...] = (2, 3, 4, 6, 10, 20)) -> list[tuple[str, int, int]]:
    """The dual feasible functions in use: (kind, parameter, value of a whole bin).

    "sum" is the identity.  "keep" counts pieces over capacity - e as whole bins and
    drops those of at most e.  "step" counts, for k, floor((k + 1) * x / capacity)
    where that isn't a whole number and k * x / capacity where it is.
    """
    keeps = [("keep", capacity // k, capacity) for k in cut_points]
    steps = [("step", k, k * capacity) for k in range(1, 7)]
    return [("sum", 0, capacity), *keeps, *steps]


def bound_values(lengths: np.ndarray, capacity: int) -> list[int]:
    """Sums of every dual feasible function over lengths, in the order of bound_parts."""
    x = lengths.astype(np.int64)
    out = []
    for kind, p, _ in bound_parts(capacity):
        if kind == "sum":
            y = x
        elif kind == "keep":
            y = np.where(x > capacity - p, capacity, np.where(x <= p, 0, x))
        else:
            whole = (p + 1) * x % capacity == 0
            y = np.where(whole, p * x, (p + 1) * x // capacity * capacity)
        out.append(int(y.sum()))
    return out


def lower_bound(sums: list[int], capacity: int) -> int:
    """The least number of bins that the sums of the dual feasible functions allow."""
    return max(-(-s // whole) for s, (_, _, whole) in zip(sums, bound_parts(capacity), strict=True))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece, and the free room of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []  # rooms: a bit for each free room that a bin has
    for i in order.tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(0)
        left = room - need
        free[b] = left
        if left:
            open_by_room[left].append(b)
            rooms |= 1 << left
        bins[i] = b
    return bins, np.array(free, dtype=np.int64)


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((-lengths, bins))
    ends = np.cumsum(lengths[order])
    before = ends - lengths[order]
    first = np.r_[True, np.diff(bins[order]) != 0] if len(bins) else np.zeros(0, dtype=bool)
    base = np.maximum.accumulate(np.where(first, before, 0))
    out = np.empty(len(bins), dtype=np.int64)
    out[order] = before - base
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 4096, length: str = "length", group_pieces: int = GROUP_PIECES, max_rounds: int = 8) -> DataFrame:
    """pieces with sequence_id and offset: bins of at most capacity, filled without gaps from 0.

    Every length has to be in 1..capacity.  Partitions hold about group_pieces pieces whatever
    the size of the input, and are dealt by a hash of all of a row, the row's place mixed in, so that no key or run of
    equal rows makes one of them large.  Exchange rounds move only pieces of open bins.
    """
    pieces = pieces.drop("sequence_id", "offset")
    own = pieces.columns
    if any("." in c or "`" in c for c in own):  # applyInPandas would look for fields of structs
        plain = pieces.toDF(*[f"c{i}" for i in range(len(own))])
        done = pack_pieces(plain, capacity, f"c{own.index(length)}", group_pieces, max_rounds)
        return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "sequence_id", "offset")
    columns = own
    part, open_bin = free_name(pieces, "part"), free_name(pieces, "open_bin")
    packed_schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(open_bin, T.BooleanType())])

    def packing(round_no: int):
        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            sizes = rows[length].to_numpy(dtype=np.int64)
            bins, free = best_fit_decreasing(sizes, capacity)
            bound = lower_bound(bound_values(sizes, capacity), capacity)
            released = np.zeros(len(free), dtype=bool)
            if len(free) > bound:
                released = free > 0  # not certified: all its unfilled bins go to the exchange
            elif len(free):
                released[np.argmax(free)] = free.max() > 0  # certified: its emptiest bin may still merge with another partition's
            rows = rows[columns].copy()
            rows["sequence_id"] = (round_no << 56) + (int(key[0]) << 24) + bins
            rows["offset"] = _offsets(bins, sizes)
            rows[open_bin] = released[bins]
            return rows

        return work

    def dealt(df: DataFrame, parts: int) -> Column:
        salt = F.monotonically_increasing_id()
        return F.pmod(F.xxhash64(*[field(c) for c in columns if not isinstance(df.schema[c].dataType, T.MapType)], salt), F.lit(parts)).cast("int")

    def packed(df: DataFrame, round_no: int, parts: int) -> DataFrame:
        out = df.select(*map(field, columns), dealt(df, parts).alias(part)).groupBy(part).applyInPandas(packing(round_no), packed_schema)
        return stored(out, f"packed{round_no}")

    def all_sums(df: DataFrame) -> list[int]:
        x, c = field(length).cast("long"), capacity
        aggs = []
        for i, (kind, p, _) in enumerate(bound_parts(capacity)):
            if kind == "sum":
                y = x
            elif kind == "keep":
                y = F.when(x > c - p, c).when(x <= p, 0).otherwise(x)
            else:
                y = F.when(F.lit(p + 1) * x % c == 0, F.lit(p) * x).otherwise(F.floor(F.lit(p + 1) * x / c) * c)
            aggs.append(F.sum(y).alias(f"f{i}"))
        row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        return [row["n"], *[row[f"f{i}"] or 0 for i in range(len(aggs))]]

    source = stored(pieces, "pieces")
    n, *sums = all_sums(source)
    if not n:
        return source.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    bound = lower_bound(sums, capacity)
    done: list[DataFrame] = []
    closed = 0
    current, count, before = source, n, math.inf
    for round_no in range(max_rounds):
        current = packed(current, round_no, max(1, math.ceil(count / (group_pieces << min(round_no, GROWTH)))))
        tally = {r[open_bin]: r for r in current.groupBy(open_bin).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence_id").alias("bins")).collect()}
        opened = tally.get(True)
        bins = closed + sum(r["bins"] for r in tally.values())
        if opened is None or bins <= bound or (bins >= before and round_no > GROWTH) or round_no == max_rounds - 1:
            done.append(current)
            break
        done.append(current.filter(~F.col(open_bin)))
        closed += tally[False]["bins"] if False in tally else 0
        current, count, before = current.filter(F.col(open_bin)), opened["n"], bins
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop(open_bin)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, text: str = "text") -> DataFrame:
    """Pieces of docs with their ids, each with the sequence and the offset at which it stands."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, end_id, capacity, text), capacity)
