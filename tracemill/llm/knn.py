"""Exact top-k by inner product: a Voronoi join with bounds from cell summaries.

Data vectors fall into the cells of pivots; a cell of many vectors is cut into rings by
the distance from its pivot.  A ring's summary holds its size and the ranges of its
members' distances from the pivot, norms, and lengths along and across the pivot's
direction.  For a query each of these bounds the score of every member from above:

- by the triangle inequality on distances, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2;
- by q.p + |q| r, with r the ring's outer radius;
- by the ranges along the pivot's direction, and |q| times the greatest length across it;
- by |q| times the greatest norm.

A score that k members certainly reach comes from the pivots themselves, which are data
vectors, and from the rings' lower bounds; the query's most promising ring sharpens it.
Then a query is copied only to rings whose least upper bound reaches that score.  On
clustered vectors few rings do; independent random directions of many dimensions are
nearly all equally far apart, and no bound of this kind rules much out.

No task's group grows with the input: of equal vectors only those rows go on that some
query's answer can hold; a ring is dealt to splits of about BLOCK vectors, and the
queries of a ring to groups of about QUERIES.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; a shorter vector counts as padded with zeros; equal scores go to the
smaller id; with fewer than k candidates all are returned; rows that repeat an id are
candidates each, and none of them for a query with that id; queries that repeat an id
are one, with the least of their vectors; extra columns aren't looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, stored

#: Pivots at least and at most (between, half the root of the number of vectors), and rings of a cell at most:
#: the pivots and a summary for each ring are all that reaches every task.
LEAST_PIVOTS, MOST_PIVOTS, RINGS = 8, 4096, 64
#: Vectors in a split of a ring, queries in a group, both as an expectation; queries that are multiplied at once.
BLOCK, QUERIES, QUERIES_AT_ONCE = 4096, 8192, 512
#: Upper bounds that are held at once (8 bytes each).
BOUNDS_AT_ONCE = 1 << 20
#: From here on products of doubles would lose digits.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as bigint, null where the vector takes no part."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), dtype=np.int64)
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, dtype=np.int32)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < EXACT else a @ b.T


def best_of(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of x for each of q; ids have to be in ascending order."""
    out_q, out_id, out_score = [], [], []
    for lo in range(0, len(asked), QUERIES_AT_ONCE):
        names = asked[lo : lo + QUERIES_AT_ONCE]
        scores = _products(q[lo : lo + QUERIES_AT_ONCE], x)
        own = ids[None, :] == names[:, None]
        m = len(ids)
        if m and np.abs(scores).max(initial=0) < (1 << 61) // m:
            # Score and place in one number: no ties are left, and any partition is the exact one.
            keys = scores * m - np.arange(m)
            keys[own] = np.iinfo(np.int64).min
            at = np.argpartition(keys, m - k, axis=1)[:, m - k :] if m > k else np.broadcast_to(np.arange(m), keys.shape)
            row = np.repeat(np.arange(len(names)), at.shape[1])
            at = at.ravel()
        else:
            order = [np.lexsort((ids, -s))[: k + int(o.sum())] for s, o in zip(scores, own, strict=True)]
            row = np.repeat(np.arange(len(names)), [len(o) for o in order])
            at = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        ok = ~own[row, at]
        row, at = row[ok], at[ok]
        out_q.append(names[row])
        out_id.append(ids[at])
        out_score.append(scores[row, at])
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(o) if o else none for o in (out_q, out_id, out_score))


def collapsed(data: DataFrame, k: int) -> DataFrame:
    """data (id, v) less the rows of equal vectors that no answer can hold.

    Equal vectors score alike, so the smaller ids win; leaving one id out, of at most k rows
    each, 2k rows hold k others.  Vectors that many rows share are found by a count of hashes.
    """
    hot = stored(data.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * k).select("h"), "hot")
    if hot.isEmpty():
        return data
    keyed = data.withColumn("h", F.xxhash64("v"))
    each = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    whole = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = keyed.join(hot, "h", "left_semi").withColumn("n", each).filter(F.col("n") <= k).withColumn("n", whole).filter(F.col("n") <= 2 * k)
    return keyed.join(hot, "h", "left_anti").select("id", "v").union(few.select("id", "v"))


class VoronoiJoin:
    """The join's cells over data (id, v), and what of it queries (id, v) need.

    v: array<bigint> without nulls.  What reaches the driver is bounded by MOST_PIVOTS * RINGS summaries.
    """

    def __init__(self, data: DataFrame, queries: DataFrame, k: int, pivots: int | None = None):
        self.spark, self.k, self.queries = data.sparkSession, k, queries
        data = collapsed(data, k)
        shape = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
        self.n, self.width = shape["n"], max(1, shape["w"] or 0, queries.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0)
        wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(math.sqrt(self.n) / 2)))
        chosen = data.select("v", F.xxhash64("id", "v").alias("o")).orderBy("o", "v").limit(wanted).select("v").distinct().collect()
        self.points = np.zeros((len(chosen), self.width))
        for i, row in enumerate(sorted(r["v"] for r in chosen)):
            self.points[i, : len(row)] = row
        if self.n:
            self._cut(stored(self._assigned(data), "cells"))

    def _assigned(self, data: DataFrame) -> DataFrame:
        """data with cell, the nearest pivot; far, the distance to it; norm; along and across, the lengths by the pivot's direction."""
        points, width = self.points, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares = (points**2).sum(axis=1)
            unit = points / np.maximum(np.sqrt(squares), 1e-300)[:, None]
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    x = _matrix(part.column(1), width).astype(float)
                    cell = (squares - 2 * x @ points.T).argmin(axis=1)
                    far = np.sqrt(((x - points[cell]) ** 2).sum(axis=1))
                    along = (x * unit[cell]).sum(axis=1)
                    across = np.sqrt(((x - along[:, None] * unit[cell]) ** 2).sum(axis=1))
                    norm = np.sqrt((x**2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), *map(pa.array, (far, norm, along, across))], names=["id", "v", "cell", "far", "norm", "along", "across"])

        return in_arrow(data.select("id", "v"), work, "id long, v array<bigint>, cell int, far double, norm double, along double, across double")

    def _cut(self, celled: DataFrame) -> None:
        """Cells into rings, rings into splits; keeps a summary of each ring."""
        cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000).alias("q")).collect()
        edges = []
        for r in cells:
            rings = min(RINGS, -(-r["n"] // BLOCK))
            edges.append((r["cell"], sorted({r["q"][round(i * RINGS / rings) - 1] for i in range(1, rings)})))
        edge = self.spark.createDataFrame(edges, "cell int, edges array<double>")
        ring = F.size(F.filter("edges", lambda e: e < F.col("far")))
        ringed = celled.join(F.broadcast(edge), "cell").withColumn("ring", ring).drop("edges")
        ranges = [f(c).alias(f"{name}_{c}") for c in ("far", "norm", "along", "across") for name, f in (("min", F.min), ("max", F.max))]
        found = sorted(ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), *ranges).collect(), key=lambda r: (r["cell"], r["ring"]))
        self.cell = np.array([r["cell"] for r in found], dtype=np.int64)
        self.sizes = np.array([r["n"] for r in found], dtype=np.int64)
        self.summary = {c: np.array([r[c] for r in found]) for c in found[0].asDict() if "_" in c}
        self.splits = -(-self.sizes // BLOCK)
        rings = self.spark.createDataFrame([(r["cell"], r["ring"], i, int(self.splits[i])) for i, r in enumerate(found)], "cell int, ring int, block int, splits int")
        named = ringed.join(F.broadcast(rings), ["cell", "ring"])
        self.blocks = named.select("id", "v", "block", F.pmod(F.xxhash64("id", "v"), F.col("splits")).cast("int").alias("split"))

    def wanted(self, queries: DataFrame, first: bool) -> DataFrame:
        """query_id, block: the ring of the highest bound alone (first), or every other one that can hold an answer at floor."""
        points, cell, sizes, summary, width, k = self.points, self.cell, self.sizes, self.summary, self.width, self.k

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares = (points**2).sum(axis=1)
            length = np.sqrt(squares)
            step = max(1, BOUNDS_AT_ONCE // max(len(cell), len(points)))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    q = _matrix(part.column(1), width).astype(float)
                    floor = part.column(2).to_numpy(zero_copy_only=False)
                    qq = (q**2).sum(axis=1)[:, None]
                    norm, scores = np.sqrt(qq), q @ points.T
                    apart = np.sqrt(np.maximum(qq + squares - 2 * scores, 0))[:, cell]
                    mid = scores[:, cell]
                    least = np.maximum(0, np.maximum(apart - summary["max_far"], summary["min_far"] - apart))
                    high = (qq + summary["max_norm"] ** 2 - least**2) / 2
                    high = np.minimum(high, mid + norm * summary["max_far"])
                    high = np.minimum(high, norm * summary["max_norm"])
                    shadow = scores / np.maximum(length, 1e-300)
                    aside = np.sqrt(np.maximum(qq - shadow**2, 0))[:, cell]
                    shadow = shadow[:, cell]
                    high = np.minimum(high, np.maximum(shadow * summary["min_along"], shadow * summary["max_along"]) + aside * summary["max_across"])
                    slack = 1e-6 * (qq + summary["max_norm"] ** 2 + 1)
                    high += slack
                    best = high.argmax(axis=1)
                    # The query itself may be a pivot, or among a ring's members: k + 1 of them hold k others,
                    # as long as a single row has its id.
                    low = mid - norm * summary["max_far"] - slack
                    order = np.argsort(-low, axis=1)
                    enough = np.cumsum(sizes[order], axis=1) >= k + 1
                    sure = np.where(enough.any(axis=1), low[np.arange(len(q)), order[np.arange(len(q)), enough.argmax(axis=1)]], -np.inf)
                    if len(points) > k:
                        sure = np.maximum(sure, np.partition(scores, len(points) - k - 1, axis=1)[:, len(points) - k - 1] - slack.max(axis=1))
                    single = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                    sure = np.where(single, np.maximum(sure, floor), floor)
                    need = (np.arange(len(cell)) == best[:, None]) if first else (high >= sure[:, None]) & (np.arange(len(cell)) != best[:, None])
                    row, block = np.nonzero(need)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(block, pa.int32())], names=["query_id", "block"])

        return in_arrow(queries.select("id", "v", "floor", "single"), work, "query_id long, block int")

    def solved(self, wanted: DataFrame) -> DataFrame:
        """query_id, id, score: the best k for each query within every split that it is copied to."""
        width, k = self.width, self.k
        asked = {r["block"]: r["n"] for r in wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(b, int(self.splits[b]), -(-n // QUERIES)) for b, n in asked.items()]
        plan = F.broadcast(self.spark.createDataFrame(plan, "block int, splits int, groups int"))
        vectors = self.queries.select(F.col("id").alias("query_id"), "v")
        copies = wanted.join(plan, "block").select("query_id", "block", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("part"))
        copies = copies.join(vectors, "query_id")
        members = self.blocks.join(plan, "block").select("id", "v", "block", "split", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [np.zeros(0, dtype=np.int64)] * 3
            if left.num_rows and right.num_rows:
                right = right.sort_by("id")
                found = best_of(left["query_id"].to_numpy(), _matrix(left["v"], width), right["id"].to_numpy(), _matrix(right["v"], width), k)
            return pa.table(dict(zip(("query_id", "id", "score"), found, strict=True)))

        keys = ["block", "split", "part"]
        return copies.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(work, "query_id long, id long, score long")

    def rounds(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """What queries want at first, what they find there, what they want beyond that, and find."""
        again = self.blocks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(False).alias("single"))
        asked = self.queries.select("id", "v").join(again, "id", "left")
        asked = stored(asked.select("id", "v", F.lit(float("-inf")).alias("floor"), F.coalesce("single", F.lit(True)).alias("single")), "queries")
        wanted = stored(self.wanted(asked, True), "wanted")
        near = stored(self.solved(wanted), "near")
        floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("score")).alias("s"))
        floors = floors.filter(F.col("n") >= self.k).select(F.col("query_id").alias("id"), F.element_at("s", -self.k).cast("double").alias("known"))
        sharper = asked.join(floors, "id", "left").select("id", "v", F.coalesce("known", "floor").alias("floor"), "single")
        beyond = stored(self.wanted(sharper, False), "wanted")
        return wanted, near, beyond, self.solved(beyond)

    def looked_at(self, *wanted: DataFrame) -> int:
        """How many pairs of a query and a vector the copies lead to."""
        size = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "block int, size long")
        return sum(w.join(F.broadcast(size), "block").agg(F.sum("size").alias("n")).first()["n"] or 0 for w in wanted)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the k best of data (id, v) for every one of queries (id, v), other than itself.

    v: array<bigint>, null where a row takes no part.
    """
    data = data.select("id", "v").filter("v is not null and id is not null")
    queries = queries.select("id", "v").filter("v is not null and id is not null").groupBy("id").agg(F.min("v").alias("v"))
    join = VoronoiJoin(data, queries, k, pivots)
    if not join.n:
        return join.spark.createDataFrame([], "query_id long, rank int, id long, score long")
    _, near, _, far = join.rounds()
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.union(far).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
