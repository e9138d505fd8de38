"""The corpus operators' queries, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .knn import quantised, top_k
from .langid import fit_languages, predict_language
from .licenses import find_licenses
from .minhash import near_duplicates
from .packing import pack_pieces, tokenize_pieces
from .quality import fit_quality, judged, quality_features
from .sampling import decode_pieces, sample_pieces
from .secret_scan import BASE_KINDS, RULES, find_secrets, joined_spans, of_kind
from .substrings import remove_repeats
from .warc import resolve_revisits


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digests)

#: A run of characters that are no ASCII white space, and of those that are.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    text = F.coalesce("text", F.lit(""))
    kept = F.sha2(F.trim(F.regexp_replace(text, GAP, " ")), 256)
    return cut.select("doc_id", (F.regexp_count(text, F.lit(WORD)) + F.col("n_removed")).cast("long").alias("n_words"), "n_removed", kept.alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit_languages(docs.filter("not held_out"))
    return predict_language(docs.select("doc_id", "text", "held_out"), model)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(quality_features(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality")
    return judged(counted, fit_quality(counted)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kind((kind,))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(of_kind(BASE_KINDS)), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0)).withColumnRenamed("id", "vec_id")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, more = F.transform("places", lambda x: x["label"]), F.transform("blocks", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("places", lambda x: x["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    encoded = sample_pieces(docs, model).withColumn("n_pieces", (F.length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
    decoded = F.sha2(F.col("text"), 256)
    return decode_pieces(encoded, model).select("doc_id", "n_pieces", "ids_crc32", decoded.alias("decoded_sha256"), (decoded == F.col("sha")).alias("lossless"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of their folder's URL, and a not-modified revisit for each, up to 66 pages earlier than itself.

    Ids are even for responses and odd for revisits.  Revisits of even pages name an entity tag, others a date.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"/[0-9]+.*$", "/").alias("url"), "html")
    tag, day = F.md5(F.coalesce("html", F.lit(""))), (F.col("page_id") % 3).cast("string")
    full = F.create_map(F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("age"), F.lit("0"))
    common = F.create_map(F.lit("age"), F.lit("1"), F.lit("content-length"), F.lit("0"))
    named = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))).otherwise(F.create_map(F.lit("last-modified"), day))
    responses = pages.select((F.col("page_id") * 2).alias("id"), "url", (F.col("page_id") * 2).alias("at"), F.lit(True).alias("full"), full.alias("headers"), F.col("html").alias("body"))
    earlier = F.col("page_id") - F.col("page_id") % 7 * 11
    revisits = pages.select((F.col("page_id") * 2 + 1).alias("id"), "url", (earlier * 2 + 1).alias("at"), F.lit(False).alias("full"), F.map_concat(named, common).alias("headers"), F.lit(None).cast("string").alias("body"))
    found = resolve_revisits(responses.union(revisits))
    header = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select(F.expr("id div 2").alias("page_id"), "url_key", F.expr("source_id div 2").alias("source_page_id"), "outcome", header.alias("headers"), F.md5("body").alias("body_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_license_scans": op8_license_scans,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_sentencepiece": op10_sentencepiece,
}

def _secret_sql() -> str:
    """Each rule's gaps and matches in turn, their running lengths, and the digest columns."""
    texts = "t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
    each = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{pattern}', {rule.group}))"
        each.append(f"""SELECT r, '{rule.kind}' AS kind, {place} AS place, b, b + length(m[i]) AS e FROM (
            SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM (
                SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
                    SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t) WHERE len(m) > 0)) WHERE {size} >= {rule.least}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    span = "kind || ':' || b || ':' || e"
    return f"""WITH {texts}, f AS ({' UNION ALL '.join(each)})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY b, place) FILTER (kind IN ({base})), '')) AS base_sha256,
            coalesce(string_agg({span}, ',' ORDER BY b, place), '') AS spans
        FROM t LEFT JOIN f USING (r) GROUP BY r, doc_id"""


SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), h AS (
            SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50)
        ), low AS (
            SELECT h, min(doc_id) AS m FROM h GROUP BY 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM h JOIN low USING (h) WHERE m < doc_id
        ), x AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
        ), k AS (
            SELECT x.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL) AS kept
            FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY 1
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a
        ), m AS (
            SELECT id, min(x) AS component_id FROM r GROUP BY 1
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op6_secret_scans": _secret_sql(),
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_warc_revisits": """
        WITH p AS (
            SELECT page_id, html, regexp_replace(trim(regexp_replace(url, '/[0-9]+.*$', '/')), '#.*$', '') AS bare FROM pages
        ), q AS (
            SELECT page_id, html, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
                regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p
        ), h AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), '^www\\.', '') AS host,
                regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS query FROM q
        ), k AS (
            SELECT page_id, html, regexp_replace(host, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '') || path
                || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM h
        ), v AS (
            SELECT page_id, url_key, html, page_id - page_id % 7 * 11 AS at FROM k
        ), s AS (
            SELECT v.page_id, v.url_key, v.html, f.page_id AS source, f.html AS stored FROM v ASOF LEFT JOIN k f ON v.url_key = f.url_key AND v.at >= f.page_id
        ), o AS (
            SELECT *, CASE WHEN source IS NULL THEN 'no_source'
                WHEN CASE WHEN page_id % 2 = 0 THEN md5(coalesce(html, '')) = md5(coalesce(stored, '')) ELSE page_id % 3 = source % 3 END THEN 'resolved'
                ELSE 'validators_differ' END AS outcome FROM s
        )
        SELECT page_id, url_key, source AS source_page_id, outcome,
            CASE WHEN outcome = 'resolved' THEN 'age=1;content-length=' || length(stored) || ';content-type=text/html;etag=' || CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END || md5(stored) || ';last-modified=' || (source % 3) END AS headers,
            CASE WHEN outcome = 'resolved' THEN md5(stored) END AS body_md5
        FROM o
    """,
}
