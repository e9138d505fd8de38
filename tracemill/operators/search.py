"""Full-text search over postings: phrase, NEAR, AND, OR, NOT, prefix; BM25 ranking.

The index is a table of (term, doc_id, tf, positions), made once from the text and kept in
folders by a hash of the term (`write_index`).  A query reads only the folders of its terms,
so its cost follows the length of their postings; a prefix has to look into all folders.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_QUERY_BYTES, MAX_LIMIT = 4096, 1000


class QueryError(ValueError):
    """A search query that can't be read."""


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks with marks, and the same without, by Unicode's decompositions."""
    pairs = {}
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(base) > 1 and base[0].isascii():
            pairs[letter] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _plain_letters()


def folded(text: Column) -> Column:
    """text in lower case, Latin letters without their marks."""
    low = F.lower(text)
    return F.when(F.regexp_like(low, F.lit(f"[{_MARKED[0]}-ɏ]")), F.translate(low, _MARKED, _PLAIN)).otherwise(low)


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(_MARKED, _PLAIN))


def terms_of(text: Column, extra: str = "-_") -> Column:
    """Runs of letters, digits and the extra characters, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}" + re.escape(extra) + "]+"), F.lit(0))


def postings(docs: DataFrame, id: str, text: str, extra: str = "-_") -> DataFrame:
    """term, doc_id, tf, positions (from 0)."""
    exploded = docs.select(F.col(id).alias("doc_id"), F.posexplode(terms_of(F.coalesce(F.col(text), F.lit("")), extra)).alias("pos", "term"))
    return exploded.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(index: DataFrame) -> DataFrame:
    """doc_id, n_terms of every document that has a term."""
    return index.groupBy("doc_id").agg(F.sum("tf").alias("n_terms"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """A written index: postings in folders by the hash of the term, lengths of documents, and their number."""

    spark: SparkSession
    path: str
    buckets: int

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")

    @property
    def n_docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/count")

    def terms(self, *words: str) -> DataFrame:
        """Postings of words; Spark reads their folders only."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        places = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"), self.buckets)).distinct().collect()]
        return rows.filter(F.col("part").isin(*places) & F.col("term").isin(*words))

    def prefix(self, word: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.startswith("term", F.lit(word)))


def write_index(docs: DataFrame, id: str, text: str, path: str, extra: str = "-_", buckets: int = 64) -> Index:
    """The index of docs under path."""
    spark = docs.sparkSession
    made = postings(docs, id, text, extra).withColumn("part", _bucket(F.col("term"), buckets))
    made.repartition("part").sortWithinPartitions("part", "term", "doc_id").write.partitionBy("part").parquet(f"{path}/postings")
    lengths(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/sizes")
    docs.agg(F.count(F.lit(1)).alias("n_docs")).write.parquet(f"{path}/count")
    return Index(spark, path, buckets)


def updated_postings(index: DataFrame, gone: DataFrame, docs: DataFrame, id: str, text: str, extra: str = "-_") -> DataFrame:
    """Postings after documents went (gone: doc_id) or changed (docs, whose old postings go too)."""
    stale = gone.select("doc_id").union(docs.select(F.col(id).alias("doc_id"))).distinct()
    return index.select("term", "doc_id", "tf", "positions").join(stale, "doc_id", "left_anti").select("term", "doc_id", "tf", "positions").union(postings(docs, id, text, extra))


@dataclass(frozen=True)
class Node:
    """A parsed query: term, prefix, phrase and near have words; and, or, not have parts; within: how many words may stand between those of a near."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple["Node", ...] = ()
    within: int = 10

    def leaves(self) -> list["Node"]:
        return [self] if not self.parts else [x for p in self.parts for x in p.leaves()]


def parse(query: str) -> Node:
    """Phrases in double quotes, prefixes with *, NEAR(a b, n), AND, OR, NOT, parentheses; terms beside each other are joined by AND."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise QueryError("the query is too long")
    tokens = re.findall(r'"[^"]*"|NEAR\([^()]*\)|[()]|[^\s()"]+', query)
    if query.count('"') % 2 or not tokens:
        raise QueryError("an empty query or an open quote")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either() -> Node:
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both() -> Node:
        left = leaf()
        while peek() not in (None, ")", "OR"):
            kind = take() if peek() in ("AND", "NOT") else "AND"
            left = Node("not" if kind == "NOT" else "and", parts=(left, leaf()))
        return left

    def leaf() -> Node:
        token = peek()
        if token is None or token in (")", "AND", "OR", "NOT"):
            raise QueryError(f"a term is missing before {token or 'the end'}")
        take()
        if token == "(":
            inner = either()
            if peek() != ")":
                raise QueryError("an open parenthesis")
            take()
            return inner
        if token.startswith("NEAR("):
            inner, _, within = token[5:-1].partition(",")
            words = tuple(re.findall(r"[\w-]+", fold(inner)))
            if len(words) < 2 or (within and not within.strip().isdigit()):
                raise QueryError(f"not a NEAR of words: {token!r}")
            return Node("near", words, within=int(within) if within else 10)
        if token.startswith('"'):
            words = tuple(re.findall(r"[\w-]+", fold(token)))
            if not words:
                raise QueryError("an empty phrase")
            return Node("phrase", words) if len(words) > 1 else Node("term", words)
        prefix = token.endswith("*")
        word = token[:-1] if prefix else token
        if not re.fullmatch(r"\w+", word):
            raise QueryError(f"not a bare term: {token!r}; put it in quotes")
        return Node("prefix" if prefix else "term", (fold(word),))

    out = either()
    if peek() is not None:
        raise QueryError(f"unexpected {peek()!r}")
    return out


def _less(n: int):
    return lambda p: p - n


def _unit(index: Index, node: Node) -> DataFrame:
    """doc_id, tf of a leaf as one unit: how often its term, prefix, phrase or near group stands in a document."""
    if node.kind == "term":
        return index.terms(*node.words).select("doc_id", "tf")
    if node.kind == "prefix":
        return index.prefix(node.words[0]).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    rows, out = index.terms(*node.words), None
    for i, word in enumerate(node.words):
        shift = i if node.kind == "phrase" else 0
        places = rows.filter(F.col("term") == word).select("doc_id", F.transform("positions", _less(shift)).alias(f"p{i}"))
        out = places if out is None else out.join(places, "doc_id")
    if node.kind == "phrase":
        starts = F.col("p0")
        for i in range(1, len(node.words)):
            starts = F.array_intersect(starts, F.col(f"p{i}"))
    else:
        # A group is found from its first word on: all others stand within so many places after it.
        reach = node.within + len(node.words) - 1
        met = lambda p: _all(F.exists(f"p{i}", _between(p, reach)) for i in range(len(node.words)))
        starts = F.filter(F.array_distinct(F.concat(*[F.col(f"p{i}") for i in range(len(node.words))])), met)
    return out.withColumn("tf", F.size(starts).cast("long")).filter("tf > 0").select("doc_id", "tf")


def _between(p: Column, reach: int):
    return lambda q: (q >= p) & (q <= p + reach)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def matching(index: Index, node: Node) -> DataFrame:
    """doc_id of the documents that a query holds for: set algebra over postings."""
    if not node.parts:
        return _unit(index, node).select("doc_id")
    first, *rest = [matching(index, p) for p in node.parts]
    for other in rest:
        if node.kind == "and":
            first = first.join(other, "doc_id", "left_semi")
        elif node.kind == "not":
            first = first.join(other, "doc_id", "left_anti")
        else:
            first = first.union(other).distinct()
    return first


def bm25(index: Index, leaves: list[Node]) -> DataFrame:
    """doc_id, score of the documents with any of a query's leaves, each of which counts as one unit; the better, the smaller (negated)."""
    hits = None
    for i, leaf in enumerate(leaves):
        unit = _unit(index, leaf).select(F.lit(i).alias("leaf"), "doc_id", "tf")
        hits = unit if hits is None else hits.union(unit)
    stats = index.sizes.agg(F.sum("n_terms").alias("total")).crossJoin(F.broadcast(index.n_docs)).select("n_docs", (F.col("total") / F.col("n_docs")).alias("mean"))
    frequency = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(F.broadcast(frequency), "leaf").join(index.sizes, "doc_id").crossJoin(F.broadcast(stats))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean")))
    return joined.groupBy("doc_id").agg((-F.sum(idf * weight)).alias("score"))


def scored(index: Index, query: str) -> DataFrame:
    """doc_id, score of every document that a query holds for."""
    node = parse(query)
    # What is ruled out adds nothing to a score.
    wanted = list(dict.fromkeys(_positive(node)))
    return matching(index, node).join(bm25(index, wanted), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _positive(node: Node) -> list[Node]:
    if not node.parts:
        return [node]
    parts = node.parts[:1] if node.kind == "not" else node.parts
    return [x for p in parts for x in _positive(p)]


def search(index: Index, query: str, limit: int = 50, events: DataFrame | None = None, where: Column | None = None, since: Column | None = None, id: str = "id", time: str = "event_at") -> DataFrame:
    """doc_id, score by relevance, then id: the best limit documents that the query holds for.

    events: rows by id to which where and since apply before the limit.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise QueryError(f"a limit is from 1 to {MAX_LIMIT}")
    hits = scored(index, query)
    if events is not None:
        kept = events if where is None else events.filter(where)
        kept = kept if since is None else kept.filter(F.col(time) >= since)
        hits = hits.join(kept.select(F.col(id).alias("doc_id")), "doc_id", "left_semi")
    return hits.orderBy("score", "doc_id").limit(limit)


def total_matches(index: Index, query: str) -> DataFrame:
    """One row: how many documents a query holds for."""
    return matching(index, parse(query)).agg(F.count(F.lit(1)).alias("total"))


def search_sessions(index: Index, sessions: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """sessions (session_id) whose transcript has all words of a query, by relevance; a query without a word finds none."""
    words = re.findall(r"\w+", query)
    if not words:
        return sessions.limit(0).withColumn("score", F.lit(0.0))
    hits = scored(index, " AND ".join(f'"{w}"' for w in words))
    return sessions.join(hits.withColumnRenamed("doc_id", "session_id"), "session_id").orderBy("score", "session_id").offset(offset).limit(limit)


def snippet(text: Column, term: str, size: int = 16) -> Column:
    """Up to size words of text around the first one that starts with term, ... where it was cut."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    at = F.coalesce(F.array_position(F.transform(words, lambda w: F.startswith(F.lower(w), F.lit(term))), True), F.lit(0)).cast("int")
    begin = F.greatest(at - size // 2, F.lit(1))
    piece = F.array_join(F.slice(words, begin, size), " ")
    return F.concat(F.when(begin > 1, "...").otherwise(""), piece, F.when(begin + size - 1 < F.size(words), "...").otherwise(""))
