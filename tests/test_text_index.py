"""The stored full-text index against brute-force BM25, before and after changes."""

import math
import random
import re

from pyspark.sql import functions as F

from strandline.operators.metrics import top_rows
from strandline.operators.search import postings
from strandline.operators.text_index import FIRST_PAGES, TextIndex, apply_change

DOCS = "doc_id bigint, repo string, text string, active boolean"
TERMS = "query_id bigint, repo string, term string, qtf bigint"


def documents():
    draw = random.Random(11)
    rare = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(900):
        words = ["common"] * draw.choice([1, 1, 2, 9]) + draw.choices(rare, k=draw.choice([2, 8, 60]))
        rows.append((k, "hot" if k % 3 else f"r{k % 4}", " ".join(words).upper() if k % 2 else ", ".join(words), k % 10 != 0))
    return rows + [(2000, "hot", None, True), (2001, "hot", "", True), (2002, None, "common w1", True), (2003, "hot", "w1 w1 w1", None), (None, "hot", "w1", True)]


def questions():
    draw = random.Random(12)
    rows = [(q, draw.choice(["hot", "r0", "r2", "none"]), t, n) for q in range(25) for t, n in {draw.choice(["common", f"w{draw.randrange(60)}"]): draw.choice([1, 2]) for _ in range(4)}.items()]
    return rows + [(99, "hot", "unknown", 1), (98, None, "w1", 1), (97, "hot", "common", 1)]


def brute(docs, terms, k):
    live = [(d, r, re.findall("[a-z0-9]+", (t or "").lower())) for d, r, t, a in docs if a and d is not None]
    avgdl = sum(len(w) for *_, w in live) / len(live)
    df, counts = {}, []
    for d, r, words in live:
        n = {t: words.count(t) for t in set(words)}
        counts.append((d, r, len(words), n))
        for t in n:
            df[t] = df.get(t, 0) + 1
    out = []
    for q in sorted({q for q, *_ in terms}):
        asked = [(r, t, m) for q2, r, t, m in terms if q2 == q]
        scores = {}
        for d, r, dl, n in counts:
            for repo, t, m in asked:
                if r is not None and r == repo and t in n:
                    idf = math.log(1 + (len(live) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[d] = scores.get(d, 0) + m * idf * n[t] / (n[t] + 1.2 * (0.25 + 0.75 * dl / avgdl))
        best = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
        out += [(q, place + 1, -s) for place, (s, _) in enumerate(best)]
    return out


def found(index, spark, k):
    rows = index.topk(spark.createDataFrame(questions(), TERMS), k).collect()
    return sorted((r.query_id, r["rank"], round(r.score, 6)) for r in rows)


def test_build_and_changes(spark, tmp_path):
    docs = documents()
    index = TextIndex(spark, str(tmp_path / "index"))
    assert index.topk(spark.createDataFrame(questions(), TERMS), 3).collect() == []
    table = spark.createDataFrame(docs, DOCS)
    index.write_segment(0, table)
    assert found(index, spark, 7) == brute(docs, questions(), 7)
    # Replaced, deleted, revived and new documents; a retry of the batch changes nothing.
    upserts = [(k, "hot", f"common w{k % 9} w59 w59", True) for k in range(0, 300, 4)] + [(5000 + k, "r0", "w1 w2 w3 common", True) for k in range(40)]
    gone = [*range(1, 200, 5), 5003, 777777]
    for _ in range(2):
        apply_change(index, 1, table, spark.createDataFrame(upserts, DOCS), spark.createDataFrame([(g,) for g in gone], "doc_id bigint"))
    current = {d: (d, r, t, a) for d, r, t, a in docs} | {u[0]: u for u in upserts}
    current = [row for d, row in current.items() if d not in gone]
    assert found(index, spark, 7) == brute(current, questions(), 7)
    # A second change deletes what the first one brought.
    apply_change(index, 2, spark.createDataFrame(current, DOCS), spark.createDataFrame([], DOCS), spark.createDataFrame([(5000,), (4,)], "doc_id bigint"))
    current = [row for row in current if row[0] not in (5000, 4)]
    assert found(index, spark, 7) == brute(current, questions(), 7)
    want = {}
    for _, _, t, a in (row for row in current if row[3] and row[0] is not None):
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())):
            want[w] = want.get(w, 0) + 1
    assert {r.term: r.df for r in index.document_frequencies().collect()} == want


def test_only_asked_buckets_and_needed_pages_are_read(spark, tmp_path):
    """Short documents outscore long ones: pages of long documents stay closed; other buckets are not listed."""
    docs = [(k, "r", "needle " + "hay " * (k // 50), True) for k in range(6000)]
    index = TextIndex(spark, str(tmp_path / "index"))
    index.write_segment(0, spark.createDataFrame(docs, DOCS).repartition(4))
    terms = spark.createDataFrame([(1, "r", "needle", 1)], TERMS)
    asked, buckets, avgdl = index.asked(terms)
    assert len(buckets) == 1
    plan = index.postings(buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    bounds = index.page_bounds(asked, buckets, avgdl)
    first = top_rows(bounds, ["query_id"], [F.desc("bound"), F.col("segment"), F.col("page")], FIRST_PAGES).drop("rank")
    got = index.topk(terms, 10).collect()
    least = min(r.score for r in got)
    assert index.unopened(bounds, first).where(F.col("bound") >= least).count() < bounds.count() / 4
    assert sorted(r.id for r in got) == list(range(10))
    # The term of all documents is many blocks, none of them a whole list.
    assert index.postings(buckets).where("term = 'needle'").agg(F.max("n")).first()[0] < 400


def test_terms_are_counted_within_a_document(spark):
    rows = [(1, "r", "b a B", True), (1, "r", "a c c", True), (1, "r", "a", True), (2, None, "x", True), (3, "r", "", True), (4, "r", None, True),
            (5, "r", "a", None), (None, "r", "a", True)]
    found = postings(spark.createDataFrame(rows, DOCS))
    expected = [(1, "r", 1, "a", 1), (1, "r", 3, "a", 2), (1, "r", 3, "b", 2), (1, "r", 3, "c", 2), (2, None, 1, "x", 1), (None, "r", 1, "a", 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert found.columns == ["doc_id", "repo", "dl", "term", "tf"]
    # No table of (document, term) pairs in a task.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "term" in line]
    terms = spark.createDataFrame([("b",), ("b",)], "term string")
    assert [tuple(r) for r in postings(spark.createDataFrame(rows, DOCS), terms).collect()] == [(1, "r", 3, "b", 2)]


def test_lists_of_postings_are_gathered_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from strandline.operators import text_index

    docs = spark.createDataFrame([(i, "r", f"word{i % 7} other{i % 3} all", True) for i in range(60)], "doc_id long, repo string, text string, active boolean")
    read = lambda index: sorted(tuple(r) for r in index.postings().select("term", "repo", "page", "n", "docs", "tfs", "dls").collect())
    dealt, found = [], []
    repartition = type(docs).repartition
    for postings in (1_000_000, 6):
        monkeypatch.setattr(text_index, "TASK_POSTINGS", postings)
        monkeypatch.setattr(type(docs), "repartition", lambda df, n, *by: (dealt.append(n), repartition(df, n, *by))[1])
        index = text_index.TextIndex(spark, str(tmp_path / str(postings)))
        index.write_segment(0, docs)
        found.append(read(index))
        monkeypatch.undo()
    assert found[0] == found[1] and 30 in dealt
