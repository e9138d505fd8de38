"""Clashing names, empty tables, repeated rows, scratch folders, pruning, and texts made to collide."""

import gzip
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from tracemill.llm import common, knn, langid, licenses, minhash, packing, quality, sampling, secret_scan, substrings, warc

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside or add, a dotted one, and one in capitals.
CLASHES = ["secret_key", "secret_blob", "secret_findings", "gone_id", "again_id", "id", "row", "whole", "held", "key", "gone", "n_removed", "blob", "findings", "a.b", "bands", "kept", "quality", "N_WORDS",
           "part", "open_bin", "piece", "sequence_id", "offset", "sample_seed", "ids", "lang_pred", "score", "places", "blocks", "component_id", "n_shingles", "quality_text", "starts", "windows", "label"]
GOOD = "The quick brown fox and the lazy dog were in the house. " + " ".join(f"word{i} the of." for i in range(40))
TEXTS = [None, "", GOOD, GOOD, GOOD + " password=abcdef123", "gnu general public license " * 3, " ".join(f"other{i} and the." for i in range(60)), "x"]


def clashing(spark, empty=False):
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}-{i}" for c in CLASHES]) for i, t in enumerate(TEXTS)]
    rows += [rows[2], rows[6], (None, GOOD, None, None, None, *[None] * len(CLASHES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([] if empty else rows, schema)


def own_columns(frame, names):
    """The clashing columns of a result by document, those that it has."""
    return sorted([tuple(r[c] for c in names) for r in frame.select("doc_id", *[common.field(c) for c in names if c != "doc_id"]).collect()], key=str)


def test_every_stage_keeps_other_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = clashing(spark)
    before = {r["doc_id"]: r for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        alone = stage(spark, clashing(spark), str(tmp_path))
        assert alone.columns == docs.columns, name
        for r in alone.collect():
            for c in CLASHES + ["lang", "source"]:
                assert r[c] == before[r["doc_id"]][c], (name, c)
        assert stage(spark, clashing(spark, empty=True), str(tmp_path)).count() == 0, name
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == docs.count()
    assert pipeline.STAGES[-1][1](spark, clashing(spark, empty=True), str(tmp_path)).count() == 0
    cut = {(r["doc_id"], r["text"]) for r in pipeline.secret_scan(spark, docs, "").collect()}
    assert (4, GOOD + " [ASSIGN]") in cut and (0, None) in cut
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs.filter("doc_id is not null"), "").collect()) == [0, 1, 2, 5, 6, 7]


def test_every_operator_takes_clashing_names(spark):
    docs, empty = clashing(spark), clashing(spark, empty=True)
    model = quality.fit_quality(quality.quality_features(docs))
    languages = langid.fit_languages(docs)
    made = {
        "packing": lambda d: packing.pack_documents(d, WORDS),
        "substrings": lambda d: substrings.remove_repeats(d),
        "langid": lambda d: langid.predict_language(d, languages),
        "quality": lambda d: quality.judged(quality.quality_features(d), model),
        "minhash": lambda d: minhash.near_duplicates(d),
        "secrets": lambda d: secret_scan.find_secrets(d),
        "licenses": lambda d: licenses.find_licenses(d),
        "sampling": lambda d: sampling.decode_pieces(sampling.sample_pieces(d, PIECES), PIECES),
    }
    for name, apply in made.items():
        found = apply(docs)
        rows = found.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect()), name
        if name != "minhash":
            kept = [c for c in CLASHES if c in found.columns and isinstance(rows[0][c], str) and c not in ("lang_pred", "blob")]
            assert len(kept) >= 15, name
            for r in rows:
                assert all(r[c] == (None if r["doc_id"] is None else f"{c}-{r['doc_id']}") for c in kept), name
        assert apply(empty).count() == 0, name
    assert langid.predict_language(docs, langid.fit_languages(empty)).filter("lang_pred != 'und'").count() == 0
    vectors = spark.createDataFrame([(i, [i, 1], "x") for i in range(4)], "id long, v array<bigint>, `a.b` string")
    assert knn.top_k(vectors, vectors, k=2).count() == 8
    captures = spark.createDataFrame([(1, "http://a/", 1, True, {"etag": "x"}, "b", "s"), (2, "http://a/", 2, False, None, None, "s")], "id long, url string, at long, full boolean, headers map<string,string>, body string, source string")
    assert warc.resolve_revisits(captures.union(captures)).count() >= 2


def test_scratch_folder_without_setting():
    """A local session without spark.checkpoint.dir works; on a cluster that is an error."""
    code = "from pyspark.sql import SparkSession; from tracemill.llm import common; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print(common.stored(s.range(3), 'x').count())"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=180)
    assert found.stdout.strip().endswith("3"), found.stderr

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(session)


def test_scratch_scope_goes(spark):
    with common.scratch_scope(spark) as scope:
        assert common.stored(spark.range(5), "inside").count() == 5
        path = spark._jvm.org.apache.hadoop.fs.Path(scope)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path)


def test_top_k_prunes_clusters(spark):
    """On clustered vectors the copies lead to less than a fifth of all pairs, with exact results."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    centers *= 1000 / np.linalg.norm(centers, axis=1, keepdims=True)
    rows = [(i, [int(x) for x in centers[i % 40] + rng.normal(size=24) * 8]) for i in range(4000)]
    data = spark.createDataFrame(rows, "id long, v array<bigint>")
    queries = data.filter("id % 50 = 0")
    join = knn.VoronoiJoin(data, queries, 5, pivots=160)
    wanted, _, beyond, _ = join.rounds()
    assert join.looked_at(wanted, beyond) < 0.2 * queries.count() * 4000
    found = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in knn.top_k(data, queries, 5, pivots=160).collect())
    x = np.array([v for _, v in rows])
    want = []
    for q in range(0, 4000, 50):
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(4000), -s)).tolist() if j != q][:5]
        want += [(q, n, j, int(s[j])) for n, j in enumerate(order, 1)]
    assert found == want


def test_top_k_of_repeats(spark, monkeypatch):
    """Many equal vectors, ids that repeat, rings and splits and groups of few rows: the same as a plain search."""
    for name, value in (("BLOCK", 16), ("QUERIES", 8)):
        monkeypatch.setattr(knn, name, value)
    rng = random.Random(2)
    rows = [(i, [3, 3, 3]) for i in range(120)] + [(200 + i, [rng.randint(-4, 4) for _ in range(3)]) for i in range(150)] + [(7, [4, 4, 4]), (7, [4, 4, 4]), (201, [9, 9, 9])]
    data = spark.createDataFrame(rows, "id long, v array<bigint>")
    queries = data.filter("id % 3 = 0 or id = 7")
    asked = {}
    for i, v in rows:
        if i % 3 == 0 or i == 7:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    for pivots in (1, 9):
        found = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in knn.top_k(data, queries, 4, pivots).collect()]
        assert sorted(found) == sorted(want)


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_thue_morse_runs_are_told_apart(spark):
    """Runs that collide for polynomials modulo 2**64 with any odd base, as words and as texts of words."""
    bits = thue_morse(2048)
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    text = lambda first, second: " ".join((first, second)[b] for b in bits)
    data = np.frombuffer(f"{one} {two}".encode(), dtype=np.uint8)
    assert len(set(common.words_of(data, np.array([0, len(data)])).hashes().tolist())) == 2
    docs = [(1, text("yes", "no")), (2, text("no", "yes")), (3, text("yes", "no"))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(frame).collect()}
    assert found == {i: n for i, (_, n) in brute.kept_words(docs, 50).items()}


def test_long_templates_raise(spark):
    with pytest.raises(ValueError, match="block_words"):
        licenses.find_licenses(spark.createDataFrame([("x",)], "text string"), templates={"long": " ".join(f"w{i}" for i in range(40))})


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abc{i:05d} ok" for i in range(1500))
    found = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["findings"]
    assert [(r["kind"], r["begin"], r["end"]) for r in found] == brute.secret_spans(text)


def test_ledger_reads_only_what_is_asked(spark, tmp_path):
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    schema = "doc_id long, text string"
    secret_scan.find_secrets(spark.createDataFrame([(1, "token=abcdef1"), (2, "b")], schema), ledger=ledger).collect()
    again = secret_scan.find_secrets(spark.createDataFrame([(3, "b"), (4, "token=abcdef1"), (5, "token=abcdef1"), (6, "c")], schema), ledger=ledger)
    assert sorted((r["doc_id"], len(r["findings"])) for r in again.collect()) == [(3, 0), (4, 1), (5, 1), (6, 0)]
    assert ledger.read().count() == 3


def test_long_words_are_sampled_in_parts(spark):
    text = "é" * 9000 + " " + "ab" * 30000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    encoded = sampling.sample_pieces(frame, PIECES)
    assert sampling.decode_pieces(encoded, PIECES).first()["text"] == text


def test_central_pivots(spark):
    """Copies of a text with a late id: the text itself is the pivot, and all of them one group after a round."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.05 else f"z{rng.randint(0, 10**6)}" for w in base)) for i in range(60)] + [(60, " ".join(base))]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    _, want = brute.near_groups(rows, 2, 80)
    assert found == want


def test_warc_files_to_resolved_revisits(spark, tmp_path):
    """Files with the mark in a body, repeated headers, other records and a cut end; then captures, then resolution."""
    at = pd.Timestamp("2026-01-01 10:00:00")

    def record(i, kind, second, headers, body=None, status=200, profile=None, url="http://a/x"):
        return {"record_id": f"<{i}>", "type": kind, "url": url, "at": at + pd.Timedelta(seconds=second), "profile": profile, "status": status, "headers": headers, "body": body}

    tricky = b"one WARC/1.0\r\nWARC-Type: response\r\n\r\n two WARC/1.1\r\n" + bytes(range(256))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nWARC/\r\n\r\n"
    rows = [
        record(1, "response", 0, {"etag": '"1"', "content-type": "t"}, tricky),
        record(2, "revisit", 5, {"etag": 'W/"1"', "x": "new"}, None, 304, warc.NOT_MODIFIED),
        record(3, "response", 7, {}, b"", 304),
        record(4, "revisit", 8, {"etag": '"2"'}, None, 304, warc.NOT_MODIFIED),
        record(5, "revisit", 9, {}, None, 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        record(6, "revisit", 1, {}, None, 304, warc.NOT_MODIFIED, url="http://b/"),
    ]
    members = [warc.format_warc(r) for r in rows]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + b"".join(members[:3]) + members[3][:40])
    plain = b"".join(gzip.decompress(m) for m in members[3:])
    (tmp_path / "b.warc").write_bytes(plain.replace(b"x: new", b"x: new") + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nHTTP/1.1 200\r\n\r\ncut")
    try:
        found = warc.read_warc(spark, str(tmp_path / "b.warc")).collect()
    except Exception as error:  # pragma: no cover
        raise AssertionError(error) from error
    assert [r["record_id"] for r in found] == ["<4>", "<5>", "<6>"]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + b"".join(members[:3]))
    everything = warc.read_warc(spark, str(tmp_path))
    body = {r["record_id"]: r["body"] for r in everything.collect()}
    assert bytes(body["<1>"]) == tricky
    taken = warc.captures(everything)
    names = {r["id"]: r["record_id"] for r in taken.collect()}
    done = {names[r["id"]]: (names.get(r["source_id"]), r["outcome"], r["body"] and bytes(r["body"])) for r in warc.resolve_revisits(taken).collect()}
    assert done == {"<2>": ("<1>", "resolved", tricky), "<4>": ("<1>", "validators_differ", None), "<6>": (None, "no_source", None)}


def test_repeated_headers():
    rows = list(warc.records_of([b"1\r\nWARC-Type: response\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nVary: a\r\nVary: b\r\n\r\nbodyx"]))
    assert rows[0]["headers"] == {"vary": "a, b"}


def test_language_decoder_against_a_plain_one():
    """Loss-weighted decoding: the same language and score as sums written out."""
    rng = np.random.default_rng(5)
    n = 4
    code = langid.codebook(n)
    bits = code.shape[1]
    model = langid.LanguageModel([f"l{i}" for i in range(n)], code, rng.normal(size=(langid.BUCKETS, bits)), np.abs(rng.normal(size=bits)) + 0.5, np.abs(rng.normal(size=bits)) + 0.1)
    counts = rng.integers(0, 3, size=(20, langid.BUCKETS))
    best, score, close = model.decode(counts)
    for i, row in enumerate(counts):
        total = sum(row.tolist())
        losses = []
        for word in code:
            loss = 0.0
            for b in range(bits):
                margin = sum(c * w for c, w in zip(row.tolist(), model.weights[:, b].tolist())) / total
                z = 4 * margin / model.scale[b] * total / (total + langid.SHRINK)
                loss += model.trust[b] * math.log1p(math.exp(-z * word[b]))
            losses.append(loss)
        likely = [math.exp(-x) for x in losses]
        likely = [x / sum(likely) for x in likely]
        assert best[i] == losses.index(min(losses)) and score[i] == pytest.approx(max(likely))
        assert close[i] == (sorted(likely)[-1] - sorted(likely)[-2] < 0.2)


DATA = "/root/testdata/sf0.001"


def test_query_functions(spark):
    """The queries without SQL, on the smallest tables: columns, types and digests against plain versions."""
    from tracemill.llm import queries

    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    types = lambda f: {n: t for n, t in f.dtypes}

    quality_rows = queries.op4_quality_rules(spark, DATA)
    assert {k: v for k, v in types(quality_rows).items() if k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == dict.fromkeys(("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint")
    for r in quality_rows.collect():
        base = brute.quality_base(docs[r["doc_id"]][0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["kept"] and r["base_failed"])

    import zlib

    language_rows = queries.op3_language_id(spark, DATA).collect()
    right = [r["lang_pred"] == docs[r["doc_id"]][1] for r in language_rows if r["held_out"] and docs[r["doc_id"]][1]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in language_rows)
    assert sum(right) >= 0.95 * len(right) > 0

    license_rows = queries.op8_license_scans(spark, DATA)
    for r in license_rows.collect():
        n, places = brute.phrase_places(docs[r["doc_id"]][0], licenses.PHRASES)
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want, total = {}, 0
    for i, (text, _) in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[i, p // 4096] = (p, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    packed = queries.op1_best_fit_packing(spark, DATA)
    assert {k: types(packed)[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = packed.collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096 and len(filled) <= 1.02 * math.ceil(total / 4096) + 1

    pieces = queries.op10_sentencepiece(spark, DATA).collect()
    assert len(pieces) == len(docs) and all(r["lossless"] for r in pieces)
    assert re.fullmatch("[0-9a-f]{64}", pieces[0]["decoded_sha256"])
