"""Exact top-k, web captures, and the pipeline."""

import random

import pandas as pd
import pytest

import brute
from tracemill.llm import knn, warc


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(150)]
    rows += [(900, None), (950, [float("nan")] * 8), (951, [None] * 8), (952, [float("inf")] * 8), (1000, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id as id", "embedding")
    data = frame.select("id", knn.quantised(frame.embedding).alias("v"))
    for pivots in (1, 7, 64):
        found = knn.top_k(data, data.filter("id % 50 = 0"), k=5, pivots=pivots).collect()
        want = brute.top(rows, [i for i, _ in rows if i % 50 == 0], 5)
        assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found) == sorted(want)


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1]), (1, [2, 3]), (2, None)], "id long, v array<bigint>")
    found = knn.top_k(frame, frame.filter("id = 0"), k=5).collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in found] == [(0, 1, 1, 2)]
    assert knn.top_k(frame.limit(0), frame, k=5).count() == 0


def test_large_numbers_stay_exact(spark):
    big = 2**30 + 1
    frame = spark.createDataFrame([(0, [big, 1]), (1, [big, 2]), (2, [big, 3])], "id long, v array<bigint>")
    assert [r["score"] for r in knn.top_k(frame, frame.filter("id = 0"), k=2).orderBy("rank").collect()] == [big * big + 3, big * big + 2]


def test_canonical_urls(spark):
    urls = {"http://WWW.Example.com:80/a/?b=2&a=1#x": "example.com/a?a=1&b=2", "https://u:p@example.com:443": "example.com", "https://example.com:80/": "example.com:80", "example.com/A": "example.com/A", None: None}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in frame.select("u", warc.canonical_url(frame.u)).collect()} == urls


RECORD = "id long, url string, at long, full boolean, headers map<string,string>, body string"


def test_revisits(spark):
    rows = [
        (1, "http://a/x", 10, True, {"etag": '"1"', "content-type": "t", "age": "0"}, "one"),
        (2, "https://a/x#y", 20, False, {"etag": 'W/"1"', "content-type": "no", "age": "9"}, None),
        (3, "http://a/x", 30, True, {"etag": '"2"'}, "two"),
        (4, "http://a/x", 30, False, {"etag": '"1"'}, None),
        (5, "http://a/y", 5, False, {}, None),
        (6, "http://a/x", 5, False, None, None),
        (7, None, 5, False, None, None),
        (8, "http://a/x", None, False, None, None),
        (9, "http://a/z", 1, True, {"last-modified": "d"}, "z"),
        (10, "http://a/z", 2, False, {"last-modified": "d"}, None),
    ]
    found = {r["id"]: (r["source_id"], r["outcome"], r["headers"], r["body"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    none = (None, "no_source", None, None)
    assert found == {2: (1, "resolved", {"etag": 'W/"1"', "content-type": "t", "age": "9"}, "one"), 4: (3, "validators_differ", None, None), 5: none, 6: none, 7: none, 8: none, 10: (9, "resolved", {"last-modified": "d"}, "z")}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_one_url_over_many_ranges(spark):
    """A URL whose captures fill several ranges, between others: every range but the first starts with a carried source."""
    rng = random.Random(4)
    rows = [(i, "u", i, rng.random() < 0.01) for i in range(3000)] + [(5000 + i, f"v{i % 7}", i, rng.random() < 0.2) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, url_key string, at long, full boolean").repartition(16)
    want, last = {}, {}
    for i, u, _, full in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if full:
            last[u] = i
        else:
            want[i] = last.get(u)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["id"]: r["source"] for r in warc.latest_before(frame).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_warc_round_trip(spark, tmp_path):
    at = pd.Timestamp("2026-01-01 10:00:00")
    records = [
        {"record_id": "<a>", "type": "response", "url": "http://a/", "at": at, "profile": None, "status": 200, "headers": {"etag": "1", "x": "y"}, "body": b"<p>\r\n\r\n</p>"},
        {"record_id": "<b>", "type": "revisit", "url": "http://a/", "at": at, "profile": warc.NOT_MODIFIED, "status": 304, "headers": {"etag": "1"}, "body": None},
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(warc.format_warc, records)))
    found = [r.asDict() for r in warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()]
    assert [{**r, "body": bytes(r["body"]) if r["body"] is not None else None, "at": pd.Timestamp(r["at"])} for r in found] == records


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"{t}", "en", "s", len(t)) for i, t in brute.odd_documents() if t is not None]
    good = "The quick brown fox and the lazy dog were in the house. " + " ".join(f"word{i} the of." for i in range(40))
    rows += [(1000, good, "en", "s", len(good)), (1001, good, "en", "s", len(good)), (1002, good + " password=abcdef123", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, {r["doc_id"] for r in docs.collect()}))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or i < 2
    assert 1000 in seen[0][1] and 3 not in seen[0][1] and 15 not in seen[0][1]
    assert 1000 in seen[1][1] and not {1001, 1002} & seen[1][1]
    assert seen[1][1] == seen[4][1]
