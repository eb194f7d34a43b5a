"""Reachability: chains in few rounds, cycles, and greatest values without pairs."""

import random

import pytest

from strandline.operators import closure


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for t in edges.get(todo.pop(), ()):
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def as_map(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def graph(kind):
    draw = random.Random(kind)
    if kind == "random":
        return [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(75)]
    if kind == "chains":  # long runs between crossings, two runs between the same crossings, a ring with a way in
        pairs = [(f"a{k}", f"a{k + 1}") for k in range(40)] + [("a40", "b0"), ("a40", "c0")]
        pairs += [(f"{x}{k}", f"{x}{k + 1}") for x in "bc" for k in range(9)] + [("b9", "end"), ("c9", "end"), ("a40", "end")]
        pairs += [("end", "r0")] + [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)]
        return pairs + [(f"lone{k}", f"lone{(k + 1) % 5}") for k in range(5)]
    return [(f"x{k}", f"x{(k + 1) % 30}") for k in range(30)] + [("s", "s"), ("s", "t"), ("t", "s"), ("x3", "x3")]


@pytest.mark.parametrize("kind", ["random", "chains", "cycles"])
def test_closure_equals_a_walk(spark, kind):
    pairs = graph(kind)
    edges = as_map(pairs)
    entries = sorted({a for a, _ in pairs})[::3] + ["nowhere"]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, "x"), ("x", None)], "source string, target string")
    out = closure.transitive_closure(spark.createDataFrame([(e,) for e in entries], "entry string"), df).collect()
    got = sorted((r.entry, r.node) for r in out)
    assert got == sorted((e, t) for e in entries for t in reach(edges, e))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Two thousand nodes in a row: rounds grow with the digits of the length, and so do tables written."""
    labels = []
    whole = closure.written
    monkeypatch.setattr(closure, "written", lambda df, label: labels.append(label) or whole(df, label))
    df = spark.createDataFrame([(k, k + 1) for k in range(2000)], "source bigint, target bigint")
    found = closure.transitive_closure(spark.createDataFrame([(0,)], "entry bigint"), df)
    assert sorted(r.node for r in found.collect()) == list(range(1, 2001))
    assert labels.count("jumps") <= 13 and labels.count("round") <= closure.SHALLOW + 3


@pytest.mark.parametrize("kind", ["random", "chains", "cycles"])
def test_greatest_reachable_equals_a_walk(spark, kind):
    draw = random.Random(1)
    pairs = graph(kind)
    edges, names = as_map(pairs), sorted({x for p in pairs for x in p})
    values = {n: draw.randrange(1000) for n in names if draw.random() < 0.4}
    rows = spark.createDataFrame([*values.items(), ("unknown", 9999), (names[0], None)], "node string, value bigint")
    out = closure.greatest_reachable(spark.createDataFrame(pairs, "source string, target string"), rows)
    want = {n: max((values[t] for t in reach(edges, n) if t in values), default=None) for n in names}
    assert {r.node: r.value for r in out.collect()} == {n: v for n, v in want.items() if v is not None}
