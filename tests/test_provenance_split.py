"""Edges that no pass can change take part in no join of the provenance pass."""

from pyspark.sql import functions as F

from strandline.operators import provenance as pv

EDGE = "source string, target string, type string, provenance string, observed_count bigint, confirmed_at timestamp, detail string"


def test_only_calls_are_joined(spark):
    edges = spark.createDataFrame(
        [("a", "b", "CALLS", "static", None, None, ""), ("a", "b", "IMPORTS", "static", None, None, ""), ("b", "c", "CALLS", "static", None, None, ""),
         ("a", "c", None, "static", None, None, ""), ("c", "a", "CALLS", None, None, None, "")], EDGE,
    )
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "stable_id string")
    dynamic = spark.createDataFrame([("a", "c", 2), ("b", "c", 3)], "source string, target string, count bigint")
    linked = pv.upsert_dynamic_edges(edges, dynamic, nodes)
    got = {(r.source, r.target, r.type): (r.provenance, r.observed_count) for r in linked.collect()}
    assert got == {
        ("a", "b", "CALLS"): ("static", None), ("a", "b", "IMPORTS"): ("static", None), ("b", "c", "CALLS"): ("static", 3),
        ("a", "c", None): ("static", None), ("c", "a", "CALLS"): (None, None), ("a", "c", "CALLS"): ("dynamic", 2),
    }
    observed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "trace_id bigint, stable_id string")
    out = pv.confirm_static_edges(edges, observed, F.lit("2000-01-01").cast("timestamp"))
    got = {(r.source, r.target, r.type): (r.provenance, r.observed_count) for r in out.collect()}
    assert got == {
        ("a", "b", "CALLS"): ("confirmed", 1), ("a", "b", "IMPORTS"): ("static", None), ("b", "c", "CALLS"): ("static", None),
        ("a", "c", None): ("static", None), ("c", "a", "CALLS"): (None, None),
    }
    # The other edges come by a union, beside the join.
    for df in (linked, out):
        top = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        assert top[0].startswith("Union")
