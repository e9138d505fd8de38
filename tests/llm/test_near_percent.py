"""Bands and sketch limits follow the threshold."""

import pytest

from tracemill.llm import minhash


def test_limits_at_the_usual_threshold_stay():
    assert (minhash.band_rows(80), minhash.most_unlike(80, 128), minhash.most_unlike(80, 2048)) == (4, 32, 273)
    assert (minhash.band_rows(90), minhash.most_unlike(90, 128)) == (4, 32)
    assert (minhash.band_rows(50), minhash.band_rows(30)) == (2, 1)
    assert minhash.most_unlike(50, 128) > 50 and minhash.most_unlike(50, 2048) > 600
    with pytest.raises(ValueError):
        minhash.band_rows(5)


def test_pairs_at_half_are_linked(spark):
    rows = []
    for g in range(12):
        word = lambda kind, n, g=g: " ".join(f"{kind}{g}x{i}" for i in range(n))
        rows += [(2 * g, f"{word('c', 40)} {word('a', 20)}"), (2 * g + 1, f"{word('c', 40)} {word('b', 20)}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, width=1, percent=50).collect()} == {i: i // 2 * 2 for i in range(24)}
    assert all(r["kept"] for r in minhash.near_duplicates(frame, width=1, percent=51).collect())
