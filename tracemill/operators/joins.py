"""Joins beyond plain equality: ranges, prefixes, specificity, hierarchies, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def enclosing_parent(sessions: DataFrame, group: str, id: str, start: str, end: str, can_parent: Column) -> DataFrame:
    """id, parent_id: the parent whose span holds a session's start, in the same group; the earliest, then the smallest id.

    No pairs are made.  In the order of their starts, only a parent that ends later than all before
    it can be the earliest open one at some time; these rise in start and end, so the answer is the
    first of them that ends at or after the time, if it has begun.  A session that meets itself has,
    of parents as early, only those that begin when it does.
    """
    s = sessions.select(F.col(group).alias("g"), F.col(id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.coalesce(can_parent, F.lit(False)).alias("p"))
    order = Window.partitionBy("g").orderBy("s", "id")
    parents = s.filter("p and s is not null").withColumn("until", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("twin", F.lead(F.struct("s", "id")).over(order))
    leads = parents.filter("until is null or e > until").select("g", F.col("e").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(s.schema["id"].dataType).alias("id"), F.struct("s", "id", "twin").alias("lead"))
    asks = s.filter("s is not null").select("g", F.col("s").alias("t"), F.lit(0).alias("kind"), "id", F.lit(None).cast(leads.schema["lead"].dataType).alias("lead"))
    ahead = Window.partitionBy("g").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    met = asks.union(leads).withColumn("lead", F.first("lead", True).over(ahead)).filter("kind = 0 and lead.s <= t")
    own = F.when(F.col("lead.twin.s") == F.col("t"), F.col("lead.twin.id"))
    return met.select("id", F.when(F.col("lead.id") == F.col("id"), own).otherwise(F.col("lead.id")).alias("parent_id")).filter("parent_id is not null")


def hierarchy_roots(nodes: DataFrame, id: str, parent: str) -> DataFrame:
    """id, root, depth of every node; a node whose parent is missing is a root, and nodes that lead to a cycle have none.

    Paths double in every step, so depth d takes log2(d) joins.  A step settles the depths from 2^k to 2^(k+1) - 1;
    where it settles none there is no deeper node, and what is left leads to a cycle.
    """
    known = nodes.select(F.col(id).alias("k"))
    up = nodes.select(F.col(id).alias("id"), F.col(parent).alias("p")).join(known, F.col("p") == F.col("k"), "left")
    state = written(up.select("id", F.coalesce("k", "id").alias("top"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("k").isNull().alias("done")), "roots")
    left = state.filter("not done").count()
    for _ in range(state.count().bit_length()):
        if not left:
            break
        nxt = state.select(F.col("id").alias("top"), F.col("top").alias("t2"), F.col("depth").alias("d2"), F.col("done").alias("n2"))
        # Written in every step: each uses the one before twice, so the plan would double too.
        state = written(state.join(nxt, "top", "left").select("id", F.coalesce("t2", "top").alias("top"), (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.coalesce("d2", F.lit(0)))).alias("depth"), (F.col("done") | F.coalesce("n2", F.lit(True))).alias("done")), "roots")
        before, left = left, state.filter("not done").count()
        if left == before:
            break
    return state.select("id", F.when(F.col("done"), F.col("top")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """rows with the columns of the longest prefix of value; rows without one stay.

    Each distinct value meets prefixes by equality with its own beginnings of a length that
    occurs, so no row is held against every prefix, and rows meet the result by their value.
    """
    lengths = prefixes.select(F.length(prefix).alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    values = rows.select(F.col(value).alias("v")).filter("v is not null").distinct().crossJoin(F.broadcast(lengths))
    parts = values.select("v", F.explode(F.filter("ns", lambda n: n <= F.length("v"))).alias("n")).select("v", F.expr("substring(v, 1, n)").alias(prefix))
    found = parts.join(prefixes, prefix).groupBy("v").agg(F.max_by(F.struct(*prefixes.columns), F.length(prefix)).alias("hit"))
    return rows.join(found, F.col(value) == F.col("v"), "left").select(*rows.columns, "hit.*")


def most_specific(rows: DataFrame, allowed: DataFrame, hash: str, kind: str) -> DataFrame:
    """rows with the allowed entry of their hash: of their kind rather than of any (null), the oldest of several."""
    a = allowed.select(F.col(hash).alias("a_hash"), F.col(kind).alias("a_kind"), "added_at", "entry_id")
    hit = (F.col(hash) == F.col("a_hash")) & (F.col("a_kind").isNull() | (F.col("a_kind") == F.col(kind)))
    w = Window.partitionBy("row_id").orderBy(F.col("a_kind").isNull(), "added_at", "entry_id")
    return rows.join(a, hit, "inner").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "a_hash")


def diversified(rows: DataFrame, source: str, order: list[Column], n: int, id: str) -> DataFrame:
    """n rows: the best of each source first, then the best of the rest.

    Ranks stop at the first of each source; of the rest the 2 n best are enough, as n of them at most are firsts.
    """
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(*order))).filter("place = 1")
    rest = rows.orderBy(*order).limit(2 * n).join(best.select(id), id, "left_anti").withColumn("place", F.lit(2))
    return best.unionByName(rest).orderBy("place", *order).limit(n)


def not_yet(rows: DataFrame, key: str, *taken: DataFrame) -> DataFrame:
    """rows whose key is in none of taken."""
    ids = taken[0].select(key)
    for more in taken[1:]:
        ids = ids.union(more.select(key))
    return rows.join(ids.distinct(), key, "left_anti")


def tiered(rows: DataFrame, tiers: list[tuple[Column, list[Column]]], n: int, id: str) -> DataFrame:
    """n rows by tier: a row counts in the first tier that it meets, tiers come in turn, each in its own order.

    Each tier gives its n best, so no tier is ranked as a whole.
    """
    tier = F.lit(None).cast("int")
    for i, (meets, _) in reversed(list(enumerate(tiers))):
        tier = F.when(meets, i).otherwise(tier)
    held, out = rows.withColumn("tier", tier), None
    for i, (_, order) in enumerate(tiers):
        best = held.filter(F.col("tier") == i).orderBy(*order, id).limit(n)
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy(*order, id)))
        out = best if out is None else out.unionByName(best)
    return out.orderBy("tier", "place").limit(n)
