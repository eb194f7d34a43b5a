"""Pairs met in a trace, against sets, with ids in every trace and chunks of few traces."""

import random

import pytest

from strandline.operators import provenance


@pytest.mark.parametrize("size", [4096, 8])
def test_met_pairs_equal_set_intersections(spark, monkeypatch, size):
    monkeypatch.setattr(provenance, "CHUNK_TRACES", size)
    draw = random.Random(3)
    seen = {f"t{k}": {"hot", *(f"f{draw.randrange(40)}" for _ in range(draw.choice([0, 1, 3])))} for k in range(300)}
    # Two sets of traces that never meet, one much larger than the other.
    for k in range(300):
        seen[f"t{k}"].add("even" if k % 2 == 0 else "odd")
    seen["t1"].add("once")
    names = sorted({x for s in seen.values() for x in s}) + ["never"]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(150)] + [("hot", "hot"), ("even", "odd"), ("once", "even"), ("once", "odd"), ("hot", "once"), (None, "hot"), ("hot", None)]
    observed = spark.createDataFrame([(t, x) for t, s in seen.items() for x in s for _ in range(2)] + [(None, "hot"), ("t0", None)], "trace_id string, stable_id string")
    found = provenance.met_pairs(spark.createDataFrame(pairs, "source string, target string"), observed).collect()
    want = {(a, b) for a, b in pairs if a and b and any(a in s and b in s for s in seen.values())}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_lists_stay_short_for_an_id_in_every_trace(spark, monkeypatch):
    monkeypatch.setattr(provenance, "CHUNK_TRACES", 50)
    observed = spark.createDataFrame([(k, "hot") for k in range(5000)], "trace_id bigint, stable_id string")
    lists = provenance.trace_lists(observed, spark.createDataFrame([("hot",)], "stable_id string")).collect()
    assert len(lists) == 100 and max(len(r.traces) for r in lists) < 100 and sum(len(r.traces) for r in lists) == 5000
