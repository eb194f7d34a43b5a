"""Vectors in blocks: where many copies would move, blocks of questions take turns."""

import random
from pathlib import Path

from strandline.operators import search
from strandline.session import shared_folder


def test_turns_find_the_same_as_one_pass(spark, monkeypatch):
    draw = random.Random(6)
    # One repository of many blocks, one of a single one, and one that no question is of.
    repo = lambda i: "large" if i % 10 else ("small" if i % 20 else "alone")
    rows = [(i, repo(i), [draw.uniform(-1, 1) for _ in range(4)] if i % 17 else None) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id int, repo string, embedding array<float>")
    queries = vectors.where("repo <> 'alone'").withColumnRenamed("id", "query_id")
    # Some questions ask two repositories.
    queries = queries.unionByName(queries.where("repo = 'large' and query_id < 60").selectExpr("query_id", "'small' repo", "embedding"))
    ask = lambda: sorted(map(tuple, search.vector_topk(queries, vectors, 3, query_rows=20, block_rows=30).collect()))
    turned = lambda: len(list(Path(shared_folder(spark)).glob("nearest-*")))
    before = turned()
    want = ask()
    assert {q for q, *_ in want} == {i for i, r, e in rows if r != "alone" and e}
    assert turned() == before
    # About 5,000 copies in turns of 700 at most.
    monkeypatch.setattr(search, "MOVED", 700)
    assert ask() == want and turned() == before + 1
