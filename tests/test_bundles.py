"""Steps in bundles: edges are read once, and what scores alike moves as one row."""

from strandline.operators import expand

EDGES = [(f"h{k % 2}", f"n{i}", "CALLS", "static" if i % 3 else None) for i in range(30) for k in range(2)] + [("n1", "n2", "IMPORTS", "dynamic")] * 2


def test_edges_are_read_once_for_both_ways(spark):
    edges = spark.createDataFrame(EDGES, "source string, target string, type string, provenance string")
    steps = expand.moves(edges)
    assert steps._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    want = [("out", s, t, k, p) for s, t, k, p in EDGES] + [("in", t, s, k, p) for s, t, k, p in EDGES if k == "CALLS"]
    assert sorted(map(tuple, steps.collect()), key=repr) == sorted(want, key=repr)


def test_bundles_hold_every_step_once(spark, monkeypatch):
    edges = spark.createDataFrame(EDGES, "source string, target string, type string, provenance string")
    want = sorted((tuple(r) for r in expand.moves(edges).collect()), key=repr)
    for hub, most in ((10_000, 20), (4, 12)):
        monkeypatch.setattr(expand, "HUB", hub)
        steps = expand.moves(edges)
        rows = expand.bundles(steps, expand.hubs_of(steps)).collect()
        assert sorted(((r.way, r.parent_id, e, r.edge_type, r.provenance) for r in rows for e in r.ends), key=repr) == want
        assert max(len(r.ends) for r in rows) <= most
        kinds = {(r.way, r.parent_id, r.edge_type, r.provenance) for r in rows}
        # Nodes of few steps have a row for each kind of them, those of very many several.
        assert len(rows) == len(kinds) if hub > 100 else len(rows) > len(kinds)
