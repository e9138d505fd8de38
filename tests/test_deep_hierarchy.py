"""Roots of chains of any depth, and of none that lead to a cycle."""

from tracemill.operators import joins as J


def test_deep_chains_have_roots_and_cycles_have_none(spark):
    chain = [(i, i - 1 if i else None) for i in range(301)]
    cycle = [(1000 + i, 1000 + (i + 1) % 70) for i in range(70)] + [(2000, 1003)]
    found = {r["id"]: (r["root"], r["depth"]) for r in J.hierarchy_roots(spark.createDataFrame(chain + cycle, "id long, parent long"), "id", "parent").collect()}
    assert found == {i: (0, i) for i, _ in chain} | {i: (None, None) for i, _ in cycle}
    assert J.hierarchy_roots(spark.createDataFrame([], "id long, parent long"), "id", "parent").collect() == []
