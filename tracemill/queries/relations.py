"""Joins, hierarchies, search and curation."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import effort, task_type, visible
from ..operators import curation as K
from ..operators import joins as J
from ..operators import search as X
from ..operators.sequences import session_bounds
from ..session import exists, shared_folder
from ..sources.fixtures import EVENTS_SQL, events, messages, table
from ..streaming.ingest import EventTable, SessionTable, ingest

PREFIXES = (("STANDARD", 1.0), ("STANDARD BRUSHED", 2.0), ("SMALL", 3.0), ("PROMO", 4.0), ("PROMO BURNISHED", 5.0), ("E", 6.0), ("ECONOMY", 7.0))
NOW = "2024-01-31 00:00:00"


def subagent_time_window(spark: SparkSession, d: str) -> DataFrame:
    s = session_bounds(events(spark, d)).withColumn("project", F.col("session_id") % 10)
    return J.enclosing_parent(s, "project", "session_id", "started_at", "ended_at", F.col("session_id") % 3 == 0)


def hierarchy_roots(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey").cast("long") - 1).alias("parent"))
    return J.hierarchy_roots(n, "id", "parent")


def longest_prefix_price(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(list(PREFIXES), "prefix string, price double")
    return J.longest_prefix(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", prices, "prefix").select("p_partkey", "prefix", "price")


def allowlist_specificity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("hash"), F.col("lang").alias("kind"))
    b = table(spark, d, "benchmark")
    allowed = b.select(F.concat(F.lit("src"), (F.col("item_id") % 15).cast("string")).alias("hash"), F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "de").alias("kind"), (F.col("item_id") % 7).alias("added_at"), F.col("item_id").alias("entry_id"))
    return J.most_specific(docs, allowed, "hash", "kind").select("row_id", "entry_id", F.col("a_kind").alias("allowed_kind"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, d, "documents").join(labels, "doc_id").select("doc_id", "source", "quality", "n_chars")


_LAB = "lb AS (SELECT doc_id, source, n_chars, quality FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"


def highlights_diversified(spark: SparkSession, d: str) -> DataFrame:
    return J.diversified(_scored(spark, d), "source", [F.desc("quality"), F.desc("n_chars"), F.col("doc_id")], 25, "doc_id").select("doc_id", "source", "quality", "n_chars")


def share_ready_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    shared = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    also = o.filter("o_orderkey % 11 = 0")
    return J.not_yet(o, "o_orderkey", shared, also).orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderkey").limit(200)


def recommender_tiers(spark: SparkSession, d: str) -> DataFrame:
    best, long = F.col("quality") == 1, F.col("n_chars") > 5000
    return J.tiered(_scored(spark, d), [(best & long, [F.desc("n_chars")]), (best, [F.desc("n_chars")]), (long, [F.col("n_chars")])], 50, "doc_id").select("doc_id", "tier")


def recent_effort(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("tokens"), F.countDistinct("type").alias("files"))
    return e.select("session_id", effort(F.col("n"), F.col("n"), F.col("tokens"), F.col("files")).alias("effort"))


def _index(spark: SparkSession, d: str) -> X.Index:
    """The index of the documents under d; made by a context's first query of them, read by later ones."""
    path = f"{shared_folder(spark)}/tracemill/index-{hashlib.md5(d.encode()).hexdigest()}-{spark.sparkContext.applicationId}"
    if exists(spark, f"{path}/count/_SUCCESS"):  # written last
        return X.Index(spark, path, 64)
    return X.write_index(table(spark, d, "documents"), "doc_id", "text", path)


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_index(spark, d), "license OR password", 50).select("doc_id", F.round("score", 9).alias("score"))


def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    return X.matching(_index(spark, d), X.parse("(license OR token) NOT apache"))


def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return X.matching(_index(spark, d), X.parse('"licensed under the"'))


def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return X.matching(_index(spark, d), X.parse("licen*"))


def search_prefix_ranked(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_index(spark, d), "licen*", 50).select("doc_id", F.round("score", 9).alias("score"))


def search_near(spark: SparkSession, d: str) -> DataFrame:
    return X.matching(_index(spark, d), X.parse("NEAR(licensed license, 4)"))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("event_at"))
    return X.search(_index(spark, d), "license", 100, docs, F.col("source") != "src0", F.lit(300)).select("doc_id", F.round("score", 9).alias("score"))


def search_total(spark: SparkSession, d: str) -> DataFrame:
    return X.total_matches(_index(spark, d), "license AND the")


def hold_filter_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    state = F.when(F.col("doc_id") % 4 == 0, "embargoed").when(F.col("doc_id") % 4 == 1, "pending_review").when(F.col("doc_id") % 4 == 2, "released")
    until = F.when(F.col("doc_id") % 8 == 0, F.lit("2024-01-01 00:00:00")).when(F.col("doc_id") % 16 == 4, F.lit("2025-01-01 00:00:00")).cast("timestamp_ntz")
    held = docs.select("doc_id", state.alias("state"), until.alias("until"))
    return X.matching(_index(spark, d), X.parse("license")).join(held, "doc_id").filter(visible(F.col("state"), F.col("until"), F.lit(NOW).cast("timestamp_ntz"))).select("doc_id")


def pii_email_scan(spark: SparkSession, d: str) -> DataFrame:
    return K.emails_of(table(spark, d, "documents"), "doc_id", "text")


def pii_spans_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return K.pii_spans(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    text = K.redacted(F.coalesce("text", F.lit("")), {"[EMAIL]": K.EMAIL_SCAN, "[KEY]": "AKIA[A-Z0-9]{16}"}, ("example.com",), {"[EMAIL]": "@", "[KEY]": "AKIA"})
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("md5"))


def finding_groups(spark: SparkSession, d: str) -> DataFrame:
    f = K.emails_of(table(spark, d, "documents"), "doc_id", "text").withColumn("confidence", F.lit(0.9)).withColumn("hash", K.entity_hash(F.lit("email"), F.col("entity")))
    return K.grouped_findings(f, ["hash"], "confidence", "entity")


def finding_decisions(spark: SparkSession, d: str) -> DataFrame:
    f = K.emails_of(table(spark, d, "documents"), "doc_id", "text").withColumn("hash", K.entity_hash(F.lit("email"), F.col("entity")))
    made = f.filter("doc_id % 2 = 0").select("hash").distinct().withColumn("status", F.lit("ignored"))
    return K.decided(f, made, ["hash"]).select("doc_id", "entity", "status")


def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    f = K.emails_of(table(spark, d, "documents"), "doc_id", "text")
    return f.select("doc_id", "entity", K.finding_id(F.col("doc_id"), F.lit("email"), F.col("entity")).alias("finding_id"))


def entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents, each with a token made of its id's digest and a path that isn't one, as theirs have none."""
    made = F.base64(F.unhex(F.md5(F.col("doc_id").cast("string"))))
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), made, F.concat(F.lit("/srv/Build12/"), F.md5(F.col("doc_id").cast("string")))).alias("text"))
    return K.entropy_candidates(docs, "doc_id", "text").select("doc_id", "token", F.round("entropy", 9).alias("entropy"), "place")


def task_type_argmax(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter("role = 'user'")
    first = F.min_by("text", "idx")
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    g = m.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("idx"))).filter("n <= 5").groupBy("session").agg(first.alias("first"), rest.alias("all"))
    return g.select("session", task_type(F.concat("first", F.lit(" fix bug "), (F.col("session") % 3).cast("string")), F.col("all")).alias("task"))


def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Sessions derived by a stream over the events' file; equal to session_bounds over the table."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    rows = stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("event_at"), F.col("event_type").alias("type"))
    store = EventTable(spark, f"{root}/events", "id long, session_id long, event_at timestamp_ntz, type string", ["id"])
    derived = SessionTable(spark, f"{root}/sessions")
    ingest(rows, store, derived, session_bounds, f"{root}/checkpoint").awaitTermination()
    return derived.read().select("session_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"), "n_events")


QUERIES = {f.__name__: f for f in (subagent_time_window, hierarchy_roots, longest_prefix_price, allowlist_specificity, highlights_diversified, share_ready_anti, recommender_tiers, recent_effort, search_bm25, search_boolean, search_phrase, search_prefix, search_prefix_ranked, search_near, search_filtered, search_total, hold_filter_search, pii_email_scan, pii_spans_dedupe, redact_documents, finding_groups, finding_decisions, finding_ids, entropy_tokens, task_type_argmax, stream_equals_batch)}

_E = f"WITH {EVENTS_SQL}"
_TOK = r"tk AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_-]+') AS t FROM documents))"
_MAIL = rf"em AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{K.EMAIL}')) AS entity FROM documents)"
SQL = {
    "subagent_time_window": f"{_E}, s AS (SELECT session_id, min(event_at) AS a, max(event_at) AS z FROM ev GROUP BY 1), j AS (SELECT c.session_id AS id, p.session_id AS parent_id, row_number() OVER (PARTITION BY c.session_id ORDER BY p.a, p.session_id) AS n FROM s c JOIN s p ON c.session_id % 10 = p.session_id % 10 AND p.session_id <> c.session_id AND p.session_id % 3 = 0 AND c.a >= p.a AND c.a <= p.z) SELECT id, parent_id FROM j WHERE n = 1",
    "hierarchy_roots": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey - n_nationkey % 5 AS BIGINT) AS root, CAST(n_nationkey % 5 AS BIGINT) AS depth FROM nation",
    "longest_prefix_price": f"WITH p AS (SELECT * FROM (VALUES {', '.join(f'({a!r}, {b}::DOUBLE)' for a, b in PREFIXES)}) t(prefix, price)) SELECT p_partkey, prefix, price FROM part LEFT JOIN p ON starts_with(p_type, prefix) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) = 1",
    "allowlist_specificity": "WITH a AS (SELECT 'src' || (item_id % 15) AS hash, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS kind, item_id % 7 AS added_at, item_id AS entry_id FROM benchmark) SELECT doc_id AS row_id, entry_id, kind AS allowed_kind FROM documents JOIN a ON hash = source AND (kind IS NULL OR kind = lang) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind IS NULL, added_at, entry_id) = 1",
    "highlights_diversified": f"WITH {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS p FROM lb) SELECT doc_id, source, quality, n_chars FROM r ORDER BY p > 1, quality DESC, n_chars DESC, doc_id LIMIT 25",
    "share_ready_anti": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0) ORDER BY o_orderstatus = 'F' DESC, o_orderkey LIMIT 200",
    "recommender_tiers": f"WITH {_LAB}, t AS (SELECT *, CASE WHEN quality = 1 AND n_chars > 5000 THEN 0 WHEN quality = 1 THEN 1 WHEN n_chars > 5000 THEN 2 END AS tier FROM lb) SELECT doc_id, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 2 THEN n_chars ELSE -n_chars END, doc_id LIMIT 50",
    "recent_effort": f"{_E}, s AS (SELECT session_id, count(*) AS n, sum(k) AS t, count(DISTINCT type) AS f FROM ev GROUP BY 1) SELECT session_id, .3::DOUBLE * least(n / 60.0::DOUBLE, 1) + .3::DOUBLE * least(n / 50.0::DOUBLE, 1) + .2::DOUBLE * least(t / 100000.0::DOUBLE, 1) + .2::DOUBLE * least(f / 20.0::DOUBLE, 1) AS effort FROM s",
    "search_bm25": f"WITH {_TOK}, ln AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS mean), tf AS (SELECT doc_id, term, count(*) AS tf FROM tk WHERE term IN ('license', 'password') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT doc_id, -sum(CASE WHEN ln((nd - df + .5) / (df + .5)) <= 0 THEN 1e-6 ELSE ln((nd - df + .5) / (df + .5)) END * tf * 2.2 / (tf + 1.2 * (.25 + .75 * n / mean))) AS score FROM tf JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY 1) SELECT doc_id, round(CAST(score AS DOUBLE), 9) AS score FROM s ORDER BY s.score, doc_id LIMIT 50",
    "search_boolean": f"WITH {_TOK} SELECT DISTINCT doc_id FROM tk WHERE term IN ('license', 'token') AND doc_id NOT IN (SELECT doc_id FROM tk WHERE term = 'apache')",
    "search_phrase": f"WITH {_TOK} SELECT DISTINCT a.doc_id FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.term = 'under' JOIN tk c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 AND c.term = 'the' WHERE a.term = 'licensed'",
    "search_prefix": f"WITH {_TOK} SELECT DISTINCT doc_id FROM tk WHERE starts_with(term, 'licen')",
    "search_prefix_ranked": f"WITH {_TOK}, ln AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS mean), h AS (SELECT doc_id, count(*) AS tf FROM tk WHERE starts_with(term, 'licen') GROUP BY 1), w AS (SELECT ln((nd - (SELECT count(*) FROM h) + .5) / ((SELECT count(*) FROM h) + .5)) AS raw, mean FROM st) SELECT doc_id, round(-(CASE WHEN raw <= 0 THEN 1e-6::DOUBLE ELSE raw END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (.25::DOUBLE + .75::DOUBLE * n / mean)), 9) AS score FROM h JOIN ln USING (doc_id) CROSS JOIN w ORDER BY score, doc_id LIMIT 50",
    "search_near": f"WITH {_TOK} SELECT DISTINCT a.doc_id FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 5 WHERE a.term = 'licensed' AND b.term = 'license'",
    "search_filtered": f"WITH {_TOK}, ln AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS mean), h AS (SELECT doc_id, count(*) AS tf FROM tk WHERE term = 'license' GROUP BY 1), w AS (SELECT ln((nd - (SELECT count(*) FROM h) + .5) / ((SELECT count(*) FROM h) + .5)) AS raw, mean FROM st) SELECT doc_id, round(-(CASE WHEN raw <= 0 THEN 1e-6::DOUBLE ELSE raw END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (.25::DOUBLE + .75::DOUBLE * n / mean)), 9) AS score FROM h JOIN ln USING (doc_id) JOIN documents USING (doc_id) CROSS JOIN w WHERE source <> 'src0' AND n_chars >= 300 ORDER BY score, doc_id LIMIT 100",
    "search_total": f"WITH {_TOK} SELECT count(*) AS total FROM (SELECT doc_id FROM tk WHERE term = 'license' INTERSECT SELECT doc_id FROM tk WHERE term = 'the')",
    "entropy_tokens": r"""WITH t AS (SELECT doc_id, base64(unhex(md5(CAST(doc_id AS VARCHAR)))) AS token FROM documents), k AS (
            SELECT * FROM t WHERE regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]') AND NOT regexp_matches(token, '/.*/')
                AND NOT regexp_matches(token, '^(eyJ|ghp_|gho_|ghs_|ghr_|sk-|hf_|AKIA|pypi-|npm_|xox)') AND NOT regexp_matches(lower(token), 'webpack|babel|eslint|vendor/|dist/|build/')
        ), c AS (
            SELECT doc_id, token, count(*) / length(token) AS p FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM k) GROUP BY doc_id, token, ch
        ), e AS (
            SELECT doc_id, token, -sum(p * log2(p)) AS h FROM c GROUP BY 1, 2
        )
        SELECT doc_id, token, round(h, 9) AS entropy, 1 AS place FROM e WHERE h >= 4""",
    "hold_filter_search": f"WITH {_TOK} SELECT DISTINCT doc_id FROM tk WHERE term = 'license' AND (doc_id % 4 >= 2 OR doc_id % 8 = 0)",
    "pii_email_scan": f"WITH {_MAIL} SELECT * FROM em",
    "redact_documents": rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?:[A-Za-z0-9-]+\.)*example\.com', '[REDACTED_DOMAIN]', 'g'), '{K.EMAIL}', '[EMAIL]', 'g'), 'AKIA[A-Z0-9]{{16}}', '[KEY]', 'g')) AS md5 FROM documents",
    "finding_groups": f"WITH {_MAIL} SELECT sha256('|email|' || lower(entity)) AS hash, count(*) AS n, .9::DOUBLE AS confidence, max(entity) AS representative FROM em GROUP BY 1",
    "finding_decisions": f"WITH {_MAIL} SELECT doc_id, entity, CASE WHEN lower(entity) IN (SELECT lower(entity) FROM em WHERE doc_id % 2 = 0) THEN 'ignored' ELSE 'open' END AS status FROM em",
    "finding_ids": f"WITH {_MAIL} SELECT doc_id, entity, substr(sha256(doc_id || '|email|' || entity), 1, 32) AS finding_id FROM em",
    "stream_equals_batch": f"{_E} SELECT session_id, strftime(min(event_at), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(event_at), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS n_events FROM ev GROUP BY 1",
}
