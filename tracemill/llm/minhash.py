"""Near duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

A document's set is its distinct word shingles.  Equal sets are one class and only
the class's smallest id goes on.  Signatures follow SuperMinHash: each element
gives every component a value rank + uniform, where an element's ranks over the
components are a permutation, so components are correlated in a way that lowers
the estimate's variance; ranks are drawn in ascending order and drawing stops for
a document once no open component can change.  Rows that share a band are
candidates, candidates are confirmed on full sets, and confirmed links are grouped
by union-find: every partition reduces its links to a spanning forest, and star
rounds join the forests.

Within a bucket candidates are not all pairs.  Each member is first held against
the bucket's smallest member, its centre.  What that joins needs no more pairs
inside.  In further rounds the members of other groups are held against one member
of the bucket: first the one whose sketch is the most usual, then drawn ones, while
that finds links.  Only what is then still apart is held against each other,
unless sizes, finer sketches (2048 bits; a pair at similarity 0.8 is ruled out with
chance 3e-7) or the distances of both to the centre (Jaccard distance is a metric)
rule a link out.  No bucket is capped and every candidate pair is either
judged or inside one group.

With 32 bands of 4 a pair at similarity 0.8 is missed with chance 5e-8; a lower
threshold has bands of fewer rows and wider sketch limits.

Defined results: null and empty texts have the empty set and are linked with
nothing; repeated rows of one id count as one document; a null id is a document of
its own without links; an empty table gives an empty result; where duplicates are
dropped, other columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, in_arrow, lowered, mix, stored, whole_row, words_of

COMPONENTS, BAND_ROWS = 128, 4
#: Components, and so bits, of the sketches that rule out the last cross pairs.
FINE_COMPONENTS = 2048
#: Chances, at most, that banding and that a sketch (by independent bits) miss a pair at the threshold.
BANDS_MISS, SKETCH_MISS = 1e-7, 7e-7
#: Rounds, at most, in which each bucket's groups are held against one member, and the share of links among its pairs with which a round leads to another.
PIVOT_ROUNDS, ROUND_PAYS = 4, 0.1
#: Nodes that a task's union-find holds at most; beyond, what it knows goes out as links.
FOREST_NODES = 600_000
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def band_rows(percent: int, m: int = COMPONENTS, most: int = BAND_ROWS) -> int:
    """Rows of a band, up to most, with which m components miss a pair of that similarity with chance BANDS_MISS at most."""
    for rows in range(most, 0, -1):
        if m % rows == 0 and (1 - (percent / 100) ** rows) ** (m // rows) <= BANDS_MISS:
            return rows
    raise ValueError(f"{m} components can't find pairs at {percent} percent")


def most_unlike(percent: int, bits: int) -> int:
    """Most bits of two sketches that may differ: a pair of that similarity passes it with chance SKETCH_MISS at most; 80 counts for all above."""
    p, chance = (1 - min(percent, 80) / 100) / 2, 0.0
    for k in range(bits, -1, -1):
        chance += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
        if chance > SKETCH_MISS:
            return k
    return 0


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the shingles of each text, and each text's first one; a text of fewer words is one shingle."""
    words = words_of(lowered(data), offsets)
    hashes, counts = words.hashes(), words.counts()
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(made)])
    of = np.repeat(np.arange(len(counts)), made)
    at = words.first[:-1][of] + np.arange(first[-1]) - first[:-1][of]
    size = np.minimum(counts, width)[of]
    out = mix(size.astype(np.uint64) + np.uint64(0x1234567))
    for k in range(width):
        use = size > k
        out[use] = mix(out[use] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[use] + k])
    return out, first


def super_minhash(elements: np.ndarray, first: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (texts by m, uint64): rank << 32 | 32 uniform bits, the least over each text's elements."""
    n = len(first) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(n * m, top, dtype=np.uint64)
    text = np.repeat(np.arange(n), np.diff(first))
    places = None
    for rank in range(m):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - rank) >> np.uint64(32)).astype(np.int64)
        # Step `rank` of a Fisher-Yates shuffle of each element: component = place[pick], and place[pick] = place[rank].
        if places is None:
            component = pick
            if rank == 0:
                first_pick = pick
        else:
            rows = np.arange(len(elements))
            component = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[:, rank]
        slot = text * m + component
        free = signature[slot] >= np.uint64(rank) << np.uint64(32)  # set at a lower rank: settled
        value = np.uint64(rank) << np.uint64(32) | draw >> np.uint64(32)
        np.minimum.at(signature, slot[free], value[free])
        # Early stop: texts whose components all have a rank up to this one draw no more.
        going = (signature.reshape(n, m) == top).any(axis=1)[text]
        if not going.all():
            elements, text = elements[going], text[going]
            places = places[going] if places is not None else None
            if rank == 0:
                first_pick = first_pick[going]
        if rank == 0 and len(elements):
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            places[np.arange(len(elements)), first_pick] = 0
    return signature.reshape(n, m)


def fine_sketches(docs: DataFrame, width: int, m: int = FINE_COMPONENTS) -> DataFrame:
    """id and f_0, f_1, ... (64 bits each) of docs (id, held): a bit for each of m components."""
    names = [f"f_{i}" for i in range(m // 64)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                elements, first = shingle_hashes(data, offsets, width)
                for a, b in _pieces(elements, first, 10_000):
                    sign = super_minhash(elements[first[a] : first[b]], first[a : b + 1] - first[a], m)
                    bits = np.packbits((mix(sign) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], names=["id", *names])

    return in_arrow(docs, work, "id long, " + ", ".join(f"{x} long" for x in names))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text: str) -> DataFrame:
    """id and held (the text) of the documents in ids, written.  ids are broadcast when a count shows that they are few."""
    texts = docs.select(field(id_col).cast("long").alias("id"), field(text).alias("held"))
    few = ids.count() <= BROADCAST_IDS
    return stored(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "texts")


def _spread(df: DataFrame, rows: int = 256) -> DataFrame:
    """df, dealt to tasks of about rows rows, for work that costs much a row; as many tasks at least as there are cores."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)), F.xxhash64("id"))


def _pieces(elements: np.ndarray, first: np.ndarray, limit: int = 100_000) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, m: int = COMPONENTS, rows: int = BAND_ROWS) -> DataFrame:
    """id, n_shingles, set_a and set_b (128 bits of the set), bands (array of m / rows), sketch_0 and sketch_1 (a bit a component)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch_0", T.LongType()), T.StructField("sketch_1", T.LongType())])
    bands = m // rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                elements, first = shingle_hashes(data, offsets, width)
                for a, b in _pieces(elements, first):
                    part = elements[first[a] : first[b]]
                    at = first[a : b + 1] - first[a]
                    distinct = [np.unique(part[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    sizes = np.array([len(x) for x in distinct], dtype=np.int64)
                    part = np.concatenate(distinct)
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    total = np.zeros((2, len(part) + 1), dtype=np.uint64)
                    np.cumsum(mix(part ^ np.uint64(0xA0761D6478BD642F)), out=total[0, 1:])
                    np.cumsum(mix(part ^ np.uint64(0xE7037ED1A0B428DB)), out=total[1, 1:])
                    sums = total[:, at[1:]] - total[:, at[:-1]]
                    sign = super_minhash(part, at, m)
                    banded = mix(sign[:, 0::rows])
                    for k in range(1, rows):
                        banded = mix(banded * np.uint64(0x9E3779B97F4A7C15) + sign[:, k::rows])
                    banded = mix(banded + np.arange(bands, dtype=np.uint64))
                    sketch = np.packbits((mix(sign)[:, :128] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(banded.astype(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo + a, b - a), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], schema=out)

    out = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch_0", pa.int64()), ("sketch_1", pa.int64())])
    return in_arrow(docs.select(field(id_col).cast("long").alias("id"), field(text).alias("held")), work, schema)


def _verify(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """pairs (a, b) with the similarity of their full sets, written to the scratch folder.

    Only texts of documents in pairs move.
    """
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired")
    texts = _texts(docs, ids, id_col, text)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("held").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("held").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, left = batch.column(0).to_pylist(), batch.column(2)
            similarity = np.zeros(len(a))
            now, one = None, None
            for lo, hi, data, offsets in chunks(batch.column(3)):
                elements, first = shingle_hashes(data, offsets, width)
                for k in range(hi - lo):
                    i = lo + k
                    if one is None or a[i] != now:  # rows come sorted by a
                        raw = (left[i].as_py() or "").encode()
                        now, one = a[i], np.unique(shingle_hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), width)[0])
                    two = np.unique(elements[first[k] : first[k + 1]])
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    similarity[i] = common / max(1, len(one) + len(two) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], names=["a", "b", "similarity"])

    found = in_arrow(both, work, "a long, b long, similarity double")
    return stored(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "judged")


def _forest(links: DataFrame) -> DataFrame:
    """Links (a, b) reduced within each partition to (root, member) of a spanning forest."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def flush() -> pd.DataFrame:
            rows = [(root(x), x) for x in list(parent)]
            parent.clear()
            return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")

        for frame in frames:
            for x, y in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > FOREST_NODES:  # a bound on memory: what is known goes out, and more follows
                yield flush()
        yield flush()

    return links.select("a", "b").mapInPandas(work, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60, one_task: int = FOREST_NODES // 2) -> DataFrame:
    """(id, root): the smallest id that links reach, for every id in a link.

    Every partition's links become a spanning forest.  Forests that a count shows to
    have at most one_task links are joined by union-find in one task; larger ones by
    alternating star rounds, where a hot node's links are reduced with partial minima
    and joined back by joins that Spark may split.
    """
    edges = stored(_forest(links), "forest")
    if edges.count() <= one_task:
        edges = stored(_forest(edges.coalesce(1)), "forest")
        max_rounds = 0
    for _ in range(max_rounds):
        # Large star: neighbours greater than a node are linked to its least neighbour.
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = near.filter("v > u").join(least, "u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        # Small star: a node and its smaller neighbours are linked to the least of them.
        small_least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(small_least, "b").select(F.col("low"), F.col("b"), F.col("a"))
        new = small.select(F.col("low").alias("a"), F.col("b")).union(small.filter("a != low").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()
        new = stored(new, "stars")
        # Done when no member is a root too and each member has one root.
        open_ends = new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("id"), F.col("n"), F.lit(0).alias("r")).union(new.select(F.col("a").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("r"))).groupBy("id").agg(F.max("n").alias("n"), F.max("r").alias("r"))
        edges = new
        if open_ends.filter("n > 1 or (n > 0 and r > 0)").isEmpty():
            break
    else:
        if max_rounds:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def _unlike(a: str, b: str) -> Column:
    """How many bits of two sketches differ."""
    return F.bit_count(F.col(f"{a}_0").bitwiseXOR(F.col(f"{b}_0"))) + F.bit_count(F.col(f"{a}_1").bitwiseXOR(F.col(f"{b}_1")))


def _possible(n_a: str, n_b: str, sketch_a: str, sketch_b: str, percent: int) -> Column:
    """The size filter, and the sketch filter of 128 bits: at similarity 0.8 over 32 of them differ with chance 1e-7."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (_unlike(sketch_a, sketch_b) <= most_unlike(percent, 128))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, root) with more links."""
    return stored(components(groups.filter("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")).union(links)), "groups")


def _tagged(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members of those buckets that hold several groups, with their root and their centre's."""
    tagged = members.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    mixed = stored(mixed, "mixed")
    centers = groups.select(F.col("id").alias("center"), F.col("root").alias("center_root"))
    return tagged.join(mixed, "key", "left_semi").join(centers, "center", "left").withColumn("center_root", F.coalesce("center_root", "center"))


def _first(tagged: DataFrame, order: Column) -> DataFrame:
    """The first member of each bucket, its columns named p_."""
    columns = ("id", "n_shingles", "sketch_0", "sketch_1", "root")
    best = tagged.groupBy("key").agg(F.min(F.struct(order.alias("o"), *columns)).alias("p"))
    return best.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in columns])


def _central(tagged: DataFrame) -> DataFrame:
    """The member of each bucket whose sketch is nearest to the bits that most members have: a text that the others were made from, if it is there."""
    bits = [F.sum(F.getbit("sketch_0", F.lit(i))).alias(f"b{i}") for i in range(64)]
    counted = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *bits)
    usual = sum((F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(1, 64)), F.when(2 * F.col("b0") > F.col("n"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    # A row a bucket: broadcast where they are few, so that a bucket's members are reduced where they lie.
    usual = stored(counted.select("key", usual.alias("usual")), "usual")
    held = tagged.join(F.broadcast(usual) if usual.count() <= BROADCAST_IDS else usual, "key")
    return _first(held, F.bit_count(F.col("sketch_0").bitwiseXOR(F.col("usual"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, m: int = COMPONENTS, rows: int | None = None) -> DataFrame:
    """id, n_shingles, component_id and kept for every document of docs.

    component_id is the smallest id that links of 100 * intersection >= percent *
    union reach; kept says that it is the document's own.  Bands (of as many rows as percent
    allows, if rows is None) and sketch limits follow percent; one too low for m raises ValueError.
    """
    rows = band_rows(percent, m) if rows is None else rows
    signed = stored(signatures(docs, id_col, text, width, m, rows), "signatures")
    filled = signed.filter("n_shingles > 0 and id is not null")
    classes = stored(filled.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("class_id")), "classes")
    reps = filled.join(classes.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi")
    buckets = reps.select(F.explode("bands").alias("key"), "id", "n_shingles", "sketch_0", "sketch_1")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n_shingles", "sketch_0", "sketch_1")).alias("c")).filter("size > 1")
    shared = shared.select("key", F.col("c.id").alias("center"), F.col("c.n_shingles").alias("center_n"), F.col("c.sketch_0").alias("center_0"), F.col("c.sketch_1").alias("center_1"))
    # Written, so that both sides of the join are plain exchanges, of which Spark splits the skewed.
    members = stored(buckets.join(stored(shared, "shared"), "key"), "members")
    first = members.filter((F.col("id") != F.col("center")) & _possible("n_shingles", "center_n", "sketch", "center", percent)).select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    judged = _verify(stored(first, "pairs"), docs, id_col, text, width)
    alike = F.col("similarity") >= percent / 100
    links = judged.filter(alike).select("a", "b")
    groups = stored(components(links), "groups")

    # Rounds with another pivot for each bucket: members of other groups than the pivot's are held
    # against it, so a round costs a pair for each member at most, and groups that many links join
    # grow together without the other pairs.  Rounds go on while they pay.
    seen = judged.select("a", "b")
    for r in range(PIVOT_ROUNDS):
        tagged = stored(_tagged(members, groups), "tagged")
        if tagged.isEmpty():
            break
        pivots = stored(_central(tagged) if r == 0 else _first(tagged, F.xxhash64(F.lit(r), "id")), "pivots")
        pairs = tagged.join(pivots, "key").filter((F.col("root") != F.col("p_root")) & _possible("n_shingles", "p_n_shingles", "sketch", "p_sketch", percent))
        pairs = stored(pairs.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        held = pairs.count()
        if not held:
            continue
        found = _verify(pairs, docs, id_col, text, width)
        seen = seen.union(found.select("a", "b"))
        more = stored(found.filter(alike).select("a", "b"), "links")
        groups = _joined(groups, more)
        if more.count() < ROUND_PAYS * held:
            break

    # What is still in different groups of a bucket: every such pair that no filter rules out.
    tagged = _tagged(members, groups).join(judged.select(F.col("a").alias("center"), F.col("b").alias("id"), "similarity"), ["center", "id"], "left")
    tagged = tagged.withColumn("near", F.when(F.col("id") == F.col("center"), 1.0).otherwise(F.col("similarity"))).withColumn("main", F.col("root") == F.col("center_root"))
    tagged = stored(tagged.select("key", "id", "n_shingles", "root", "near", "main"), "tagged")
    if not tagged.isEmpty():
        fine = stored(fine_sketches(_spread(_texts(docs, stored(tagged.select("id").distinct(), "odd"), id_col, text)), width).dropDuplicates(["id"]), "fine")
        bits = [c for c in fine.columns if c != "id"]
        known = filled.select("id", "bands").join(fine, "id").dropDuplicates(["id"])
        tagged = stored(tagged.join(stored(known, "known"), "id"), "fine_tagged")
        odd = tagged.filter("not main").select("key", *[F.col(c).alias(f"u_{c}") for c in ("id", "n_shingles", "root", "near", "bands", *bits)])
        # Jaccard distance is a metric: a pair whose distances to one centre differ by more than the threshold's can't be linked.
        apart = F.coalesce(F.abs(F.col("near") - F.col("u_near")) > 1 - percent / 100 + 1e-9, F.lit(False))
        once = F.col("main") | (F.col("u_id") < F.col("id"))
        sizes = 100 * F.least("n_shingles", "u_n_shingles") >= percent * F.greatest("n_shingles", "u_n_shingles")
        unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"u_{c}"))) for c in bits[1:]), F.bit_count(F.col(bits[0]).bitwiseXOR(F.col(f"u_{bits[0]}"))))
        # A pair counts in the first of the buckets that it shares.
        shared_bands = F.filter(F.zip_with("bands", "u_bands", lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
        rest = tagged.join(odd, "key").filter((F.col("root") != F.col("u_root")) & once & sizes & ~apart & (unlike <= most_unlike(percent, FINE_COMPONENTS)) & (shared_bands[0] == F.col("key")))
        rest = stored(rest.select(F.least("id", "u_id").alias("a"), F.greatest("id", "u_id").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            groups = _joined(groups, _verify(rest, docs, id_col, text, width).filter(alike).select("a", "b"))
    member = signed.select("id", "n_shingles", "set_a", "set_b").join(classes, ["n_shingles", "set_a", "set_b"], "left")
    member = member.join(groups.select(F.col("id").alias("class_id"), "root"), "class_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "class_id", "id")).otherwise(F.col("id"))
    return member.select("id", "n_shingles", component.alias("component_id")).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id.

    Texts move only where an id stands in docs more than once, or where the ids to drop are too many to broadcast.
    """
    judged = stored(near_duplicates(docs, id_col, text, width, percent).select(field(id_col).alias("id"), "kept"), "near_duplicates")
    gone = judged.filter("not kept").select("id").distinct()
    few = gone.count() <= BROADCAST_IDS
    keyed = docs.select(field(id_col).cast("long").alias("id"), field(text).alias("held"), whole_row(docs).alias("row"))
    left = keyed.join(F.broadcast(gone) if few else gone, "id", "left_anti")
    again = stored(judged.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if again.isEmpty():
        return left.select("row.*")
    # Of rows that repeat an id, the one whose text has the least hash stays.
    one = left.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("held")).alias("row"))
    return left.join(again, "id", "left_anti").select("row").union(one.select("row")).select("row.*")
