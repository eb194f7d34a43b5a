"""Small examples of the operators' documented behaviour."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import labels, sqltext, text
from strandline.operators import closure, diff, embed, expand, provenance, resolve, search, specs
from strandline.plans.intents import distinct_questions, intents


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_rank_fusion(spark):
    vector = spark.createDataFrame([("q", n, i + 1) for i, n in enumerate("abc")], "query_id string, id string, rank int")
    graph = spark.createDataFrame([("q", n, i + 1) for i, n in enumerate("bda")], "query_id string, id string, rank int")
    rows = search.fuse(search.ranked_lists((vector, "vector"), (graph, "graph"))).orderBy("rank").collect()
    assert [r.id for r in rows][:2] == ["b", "a"]
    assert {r.id: r.retrieval_method for r in rows} == {"a": "both", "b": "both", "c": "vector", "d": "graph"}
    many = spark.createDataFrame([("q", f"n{i}", i + 1) for i in range(20)], "query_id string, id string, rank int")
    assert search.fuse(search.ranked_lists((many, "vector")), 5).count() == 5


def test_vector_topk_matches_brute_force_with_a_hot_repo_and_copies(spark):
    rng = random.Random(1)
    vectors = [(i, "hot" if i % 3 else f"r{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(1000 + i, "hot", vectors[1][2]) for i in range(150)]  # a third of all rows are one vector
    queries = [(i, "hot", [rng.gauss(0, 1) for _ in range(8)]) for i in range(20)] + [(99, "hot", vectors[1][2]), (98, "none", [1.0] * 8)]

    def cosine(a, b):
        dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(dot / na / nb, 9)

    want = []
    for q, repo, e in queries:
        near = sorted(((-cosine(e, v), i) for i, r, v in vectors if r == repo))[:6]
        want += [(q, i) for _, i in near]
    qs = spark.createDataFrame(queries, "query_id bigint, repo string, embedding array<double>")
    vs = spark.createDataFrame(vectors, "id bigint, repo string, embedding array<double>").repartition(5)
    assert values(search.vector_topk(qs, vs, 6), "query_id", "id") == sorted(want)
    assert values(search.vector_topk(qs, vs, 6, query_rows=5, block_rows=70), "query_id", "id") == sorted(want)


def graph(spark, edges):
    df = spark.createDataFrame(edges, "source string, target string, type string, provenance string")
    names = sorted({x for e in edges for x in e[:2]})
    return spark.createDataFrame([(n, True) for n in names], "stable_id string, active boolean"), df


def simulate(edges, seed, hops, decay=0.7):
    seen = {seed: (1.0, 0)}
    for hop in range(hops):
        found = {}
        for s, t, kind, prov in edges:
            if s in seen and seen[s][1] == hop:
                score = seen[s][0] * decay * labels.EDGE_WEIGHTS.get(kind, 0) * labels.PROVENANCE_WEIGHTS.get(prov, 0.8)
                if score > 0:
                    found[t] = max(found.get(t, 0), score)
        for t, score in found.items():
            if t not in seen or score > seen[t][0]:
                seen[t] = (score, hop + 1)
    return {k: (round(s, 9), h) for k, (s, h) in seen.items()}


def test_expansion_equals_a_simulation(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", rng.choice(["CALLS", "IMPORTS", "INHERITS"]), rng.choice(["static", "confirmed", "dynamic"])) for _ in range(200)]
    nodes, df = graph(spark, edges)
    queries = spark.createDataFrame([("q", "flow")], "query_id string, query_type string")
    seeds = spark.createDataFrame([("q", "n0")], "query_id string, stable_id string")
    out = expand.expand(queries, seeds, nodes, df, hops=3)
    assert {r.stable_id: (round(r.score, 9), r.hop) for r in out.collect()} == simulate(edges, "n0", 3)


def test_expansion_rules(spark):
    nodes, edges = graph(spark, [("a", "b", "CALLS", "static"), ("b", "c", "CALLS", "confirmed"), ("a", "d", "DEFINES", "static")])
    seeds = spark.createDataFrame([("f", "a"), ("i", "c"), ("l", "a")], "query_id string, stable_id string")
    queries = spark.createDataFrame([("f", "flow"), ("i", "impact"), ("l", "lookup")], "query_id string, query_type string")
    got = values(expand.expand(queries, seeds, nodes, edges), "query_id", "stable_id", "hop")
    assert got == [("f", "a", 0), ("f", "b", 1), ("f", "c", 2), ("i", "a", 2), ("i", "b", 1), ("i", "c", 0), ("l", "a", 0)]
    with pytest.raises(Exception, match="unknown query_type"):
        expand.expand(spark.createDataFrame([("f", "why")], "query_id string, query_type string"), seeds, nodes, edges).collect()


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")], "source string, target string")
    entries = spark.createDataFrame([("a",), ("e",), ("d",)], "entry string")
    assert values(closure.transitive_closure(entries, edges), "entry", "node") == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("e", "d")]


def test_reconcile(spark):
    static = spark.createDataFrame([("e", "login", "validate"), ("e", "login", "send")], "entry string, source string, target string")
    seen = spark.createDataFrame([("e", "login"), ("e", "validate"), ("e", "audit")], "entry string, fn string")
    got = closure.reconcile(seen, static)
    assert values(got["dynamic_only"], "target") == [("audit",)]
    assert values(got["never_observed"], "target") == [("send",)]
    assert values(got["confirmed"], "target") == [("validate",)]


def test_side_effect_classes(spark):
    names = ["execute", "fetchall", "redis_set", "hset", "_send_request", "httpx_request", "write_file", "open", "cache.get", "authenticate", "execute_workflow", "preselect"]
    got = dict(map(tuple, spark.createDataFrame([(n,) for n in names], "fn string").select("fn", labels.side_effect(F.col("fn"))).collect()))
    assert [got[n] for n in names] == ["db_write", "db_read", "cache_set", "cache_set", "http_out", "http_out", "fs_write", "fs_write", "cache_read", None, "db_write", None]


def test_import_statements(spark):
    cases = {
        "from auth.service import AuthService": ("from", "auth.service", 0, ["AuthService"]),
        "from x import A as B, C": ("from", "x", 0, ["A", "C"]),
        "from . import y": ("from", "", 1, ["y"]),
        "from ..pkg.mod import (\n  a,\n  b as c,\n)": ("from", "pkg.mod", 2, ["a", "b"]),
        "import os, sys": ("plain", "", 0, ["os", "sys"]),
        "import numpy as np": ("plain", "", 0, ["numpy"]),
        "from m import *": ("from", "m", 0, ["*"]),
        "x = 1": ("plain", "", 0, []),
    }
    df = spark.createDataFrame([(b,) for b in cases], "body string").select("body", resolve.parse_import(F.col("body")).alias("i"))
    assert {r.body: (r.i.kind, r.i.module, r.i.dots, r.i.names) for r in df.collect()} == cases
    hints = spark.createDataFrame([("auth.service", "a/b.py", 0), ("", "auth/service.py", 1), ("", "a/b/c.py", 2), ("", "c.py", 1)], "m string, p string, d int")
    assert [r[0] for r in hints.select(resolve.path_hint(F.col("m"), F.col("p"), F.col("d"))).collect()] == ["auth/service", "auth/", "a/", ""]


def test_path_lookup_matches_any_substring(spark):
    rng = random.Random(3)
    nodes = [(f"n{i:03d}", "r", "main", "q", "/".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(4)), True) for i in range(120)]
    hints = ["/".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    refs = spark.createDataFrame([(f"s{i}", "r", "main", h) for i, h in enumerate(hints)], "source string, repo string, target_name string, path_hint string")
    df = spark.createDataFrame(nodes, "stable_id string, repo string, name string, qualified_name string, file_path string, active boolean")
    want = sorted((f"s{i}", min((n[0] for n in nodes if h in n[4]), default=None)) for i, h in enumerate(hints))
    assert values(resolve.by_name_and_path(refs, df), "source", "target") == want


def test_pending_drops_by_count_and_age(spark):
    rows = [("a", "T", "", "r", "2024-01-02", 5), ("b", "T", "", "r", "2024-01-02", 6), ("c", "T", "", "r", "2023-12-30", 0), ("d", "T", "", "idle", "2023-12-30", 0)]
    pending = spark.createDataFrame(rows, "source_stable_id string, target_name string, path_hint string, repo string, attempted_at string, attempt_count int")
    pending = pending.withColumns({"edge_type": F.lit("IMPORTS"), "attempted_at": F.col("attempted_at").cast("timestamp")})
    nodes = spark.createDataFrame([], "stable_id string, repo string, name string, qualified_name string, file_path string, active boolean")
    _, left = resolve.retry_pending(pending, nodes, spark.createDataFrame([("r",)], "repo string"), F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert values(left, "source_stable_id", "attempt_count") == [("a", 6), ("d", 0)]


def test_table_and_service_names(spark):
    tables = {"SELECT * FROM users WHERE id": "users", "INSERT INTO audit_log (a)": "audit_log", "UPDATE accounts SET x": "accounts", "delete from  (t1);": "t1", "fn:execute": "fn:execute", "select": "select"}
    df = spark.createDataFrame([(d,) for d in tables], "d string").select("d", sqltext.table_name(F.col("d")).alias("t"))
    assert dict(map(tuple, df.collect())) == tables
    services = {"POST https://api.example.com/v1": "api.example.com", "call billing": "billing"}
    df = spark.createDataFrame([(d,) for d in services], "d string").select("d", sqltext.service_name(F.col("d")).alias("t"))
    assert dict(map(tuple, df.collect())) == services


def test_spec_text(spark):
    paths = spark.createDataFrame([("t", "login", 0.3)], "trace string, name string, coverage_pct double")
    calls = spark.createDataFrame([("t", 0, "a", "auth", 1.0, 28.0, None), ("t", 1, "b", "audit", 0.5, 2.25, "x=1")], "trace string, seq bigint, stable_id string, shown string, frequency_ratio double, avg_ms double, args string")
    effects = spark.createDataFrame([("t", 0, "db_read", "SELECT a FROM users", 0), ("t", 1, "db_write", "INSERT INTO users", 2), ("t", 2, "http_out", "POST https://h.io/x", 2)], "trace string, seq bigint, type string, detail string, hop_depth int")
    dynamic = spark.createDataFrame([("t", "b")], "trace string, target string")
    never = spark.createDataFrame([("t", 0, "send")], "trace string, seq bigint, target string")
    got = specs.spec_texts(specs.spec_lines(paths, calls, effects, dynamic, never, ["trace"]), ["trace"]).first().spec_text
    assert got.split("\n") == [
        "PATH login  (LOW confidence · 30% branch coverage)", "⚠ LOW COVERAGE — spec reflects partial observation only",
        "  1.  auth    1.00    ~28.0ms    [confirmed]", "  2.  audit    0.50    ~2.3ms    [dynamic-only]    args: x=1",
        "  ⚠ send   static-only — present in AST but never observed", "", "SIDE_EFFECTS:", "  DB READ   SELECT a FROM users",
        "  DB WRITE   INSERT INTO users   (conditional)", "  HTTP OUT   POST https://h.io/x   (conditional)", "", "CHANGE_IMPACT:",
        "  tables affected    users (r/w)", "  external services  h.io (conditional)",
    ]


def test_name_status_and_languages(spark):
    lines = ["A\tsrc/a.py", "R100\told.py\tnew/b.go", "D\tc.tsx", "T\td.ts", "M\treadme.md", "", "M\tMakefile"]
    got = diff.name_status(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert values(got, "path", "diff_type", "language") == [("c.tsx", "deleted", "typescript"), ("d.ts", "modified", "typescript"), ("new/b.go", "modified", "go"), ("src/a.py", "added", "python")]


def test_confirmation_needs_one_trace(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "stable_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "source string, target string").select(
        "*", F.lit("CALLS").alias("type"), F.lit("static").alias("provenance"), F.lit(None).cast("bigint").alias("observed_count"), F.lit(None).cast("timestamp").alias("confirmed_at"))
    seen = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("3", "a"), ("3", "b")], "trace_id string, stable_id string")
    got = provenance.confirm_static_edges(edges, seen, F.current_timestamp())
    assert values(got, "source", "target", "provenance", "observed_count") == [("a", "b", "confirmed", 1), ("a", "c", "static", None), ("c", "d", "static", None)]
    assert nodes.count() == 4


def test_embedding_dimension_is_checked(spark):
    df = spark.createDataFrame([("abc",)], "embed_text string")
    assert len(embed.embed(df, lambda texts: [[1.0, 2.0]] * len(texts), dim=2).first().vector) == 2
    with pytest.raises(Exception, match="Expected vector dimension 3"):
        embed.embed(df, lambda texts: [[1.0, 2.0]] * len(texts), dim=3).collect()


def test_intents(spark):
    df = spark.createDataFrame([("How does the login flow work", "r", None), (" how does THE login flow work ", "r", "{}")], "question string, repo string, answer string")
    rows = intents(df, "question", "answer").collect()
    assert [r.keywords for r in rows] == [["login", "flow"]] * 2 and not any(r.valid for r in rows)
    assert distinct_questions(df).count() == 1


def test_globs():
    import re

    assert re.match(text.glob_regex("*_handler"), "a/b_handler") and not re.match(text.glob_regex("*_handler", True), "a/b_handler")
    assert re.match(text.glob_regex("db_?[!x]"), "db_1y") and not re.match(text.glob_regex("db_?[!x]"), "db_1x")
