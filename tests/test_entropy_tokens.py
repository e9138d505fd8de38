"""The filters of high-entropy tokens come before the cut at the top."""

from tracemill.operators import curation as K

TOKEN = "aB3dE6gH9jK2mN5pQ8sT"
BENIGN = (
    "ghp_aB3dE6gH9jK2mN5pQ8sT", "0123456789abcdefABCDEF01", "01234567-89ab-cdEF-0123-456789abcdef", "aB3dE6gH9jK2mN5pQ8sT.tsx", "aB3dE6/gH9jK2/mN5pQ8sTuV",
    "aB3d.E6gH.9jK2.mN5pQ8sT", "sha256-aB3dE6gH9jK2mN5pQ8sT", "webpackaB3dE6gH9jK2mN5pQ8sT", "ab3de6gh9jk2mn5pq8st", "AB3DE6GH9JK2MN5PQ8ST", "aBcdEfgHijKlmNopQrsT", "dist/aB3dE6gH9jK2mN5pQ8sT", "akB1/AKIAaB3dE6gH9jK2mN/x",
)


def tokens(spark, *texts):
    found = K.entropy_candidates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    return sorted((r["id"], r["place"], r["token"]) for r in found)


def test_benign_strings_take_no_place(spark):
    paths = " ".join(f"src/module{i}/XyZ0123456789abcdefghijkLMNOP{i}" for i in range(20))
    assert tokens(spark, f"{paths} {TOKEN}", " ".join(BENIGN), None) == [(0, 1, TOKEN)]


def test_a_token_may_hold_dots(spark):
    dotted = "aB3dE6gH9j.K2mN5pQ8sT.uV"
    assert tokens(spark, f"key={dotted} end", f"a {dotted} b") == [(0, 1, f"key={dotted}"), (1, 1, dotted)]


def test_the_top_is_cut_among_candidates(spark):
    real = [f"aB3dE6gH9jK2mN5pQ8sT{i:02d}" for i in range(17)]
    assert len(tokens(spark, " ".join(real))) == 15
