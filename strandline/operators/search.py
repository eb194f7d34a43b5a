"""Hybrid retrieval for a batch of questions: vector and full-text top-k, rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scan
from strandline.functions.text import term_counts, token_count, tokens
from strandline.operators.metrics import top_rows
from strandline.operators.text_index import TextIndex
from strandline.session import cut_lineage, run_folder, written

# Fusion constant, BM25 parameters, defaults of a request.
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
MAX_SEEDS = 8
GATEWAY_SEEDS, MAX_TOKENS, HOP_DEPTH, DECAY = 20, 2000, 2, 0.7
OVERFETCH = 2

# Questions and vectors of a block; a pair of blocks is one unit of work.
QUERY_ROWS = 1024
BLOCK_ROWS = 8192
# Copies of questions and vectors that move at a time, to the pairs of blocks they take part in.
MOVED = 4_000_000
# Vectors multiplied at once.
STRIP = 2048


def block_topk(k: int, schema_columns: list[str]):
    """Task-side helper: the best ``k`` vectors of a block for each question of a block."""

    def best(rows, places, scores):
        """Of candidates the first k per row by score, then place."""
        order = np.lexsort((places, -scores, rows))
        rows, places, scores = rows[order], places[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        return rows[nth < k], places[nth < k], scores[nth < k]

    def unit(column):
        m = np.stack([np.asarray(r, dtype="float64") for r in column])
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1.0, norms)

    def pair(questions, vectors):
        if not len(questions) or not len(vectors):
            return pd.DataFrame({c: [] for c in schema_columns})
        vectors = vectors.sort_values("id", kind="stable")
        asked, held = unit(questions["embedding"]), unit(vectors["embedding"])
        found = []
        for start in range(0, len(held), STRIP):
            scores = np.round(asked @ held[start : start + STRIP].T, 9)
            width = scores.shape[1]
            floor = np.partition(scores, width - k, axis=1)[:, width - k, None] if width > k else -np.inf
            rows, columns = np.nonzero(scores >= floor)
            found.append(best(rows, columns + start, scores[rows, columns]))
        rows, places, scores = best(*(np.concatenate(x) for x in zip(*found, strict=True)))
        values = questions["query_id"].to_numpy()[rows], vectors["id"].to_numpy()[places], scores
        return pd.DataFrame(dict(zip(schema_columns, values, strict=True)))

    return pair


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top-k of each question among the vectors of its repository.

    ``queries``: (query_id, repo, embedding); ``vectors``: (id, repo, embedding). Both are cut into
    blocks by hash within their repository, and blocks of questions and of vectors meet
    pairwise. Only the k best of a pair ever leave a task; ties go to the smaller id.

    Pairs grow with the square of a repository. Where that makes many copies, blocks of questions take turns, and each turn's
    result is written, so that the copies of one turn are on disk at a time.
    """
    queries = queries.select("query_id", "repo", "embedding").where(F.col("embedding").isNotNull())
    vectors = vectors.select("id", "repo", "embedding").where(F.col("embedding").isNotNull())
    ids = dict((f.name, f.dataType.simpleString()) for f in [*queries.schema.fields, *vectors.schema.fields])
    rows_of = lambda df, n: df.groupBy("repo").agg(F.count(F.lit(1)).alias(n))
    sizes = rows_of(queries, "__nq").join(rows_of(vectors, "__nv"), "repo")
    sizes = sizes.withColumns({"__qs": F.ceil(F.col("__nq") / query_rows).cast("int"), "__vs": F.ceil(F.col("__nv") / block_rows).cast("int")})
    sizes = written(sizes, "blocks")
    copies = sizes.agg(F.sum(F.col("__nq") * F.col("__vs") + F.col("__nv") * F.col("__qs"))).first()[0] or 0
    turns = max(1, -(-copies // MOVED))
    # A question's turn is its own, whatever repositories it asks.
    sizes = sizes.select("repo", F.ceil(F.col("__qs") / turns).cast("int").alias("__qs"), "__vs")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit_of_work = ["repo", "__q", "__v"]
    pair = block_topk(k, ["query_id", "id", "score"])
    schema = f"query_id {ids['query_id']}, id {ids['id']}, score double"

    def turn(number: int) -> DataFrame:
        asked = queries if turns == 1 else queries.where(F.pmod(F.xxhash64(F.lit("turn"), "query_id"), F.lit(turns)) == number)
        left = asked.join(sizes, "repo").withColumn("__q", block("query_id", "__qs")).withColumn("__v", all_of("__vs")).drop("__qs", "__vs")
        right = vectors.join(sizes, "repo").withColumn("__v", block("id", "__vs")).withColumn("__q", all_of("__qs")).drop("__qs", "__vs")
        # Both sides may come from one frame: new aliases keep their columns apart.
        left = left.select(*[F.col(c).alias(c) for c in left.columns])
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        partial = left.groupBy(*unit_of_work).cogroup(right.groupBy(*unit_of_work)).applyInPandas(pair, schema)
        # All blocks of vectors that a question meets are met in its turn.
        return top_rows(partial, ["query_id"], [F.desc("score"), F.col("id")], k)

    if turns == 1:
        return turn(0)
    folder = run_folder(queries.sparkSession, "nearest")
    for number in range(turns):
        found = written(turn(number), "nearest", into=folder)
    return found


def postings(docs: DataFrame, only_terms: DataFrame | None = None) -> DataFrame:
    """Index rows (doc_id, repo, name, type, dl, term, tf) of active documents' whole texts.

    With ``only_terms`` (a ``term`` column) other terms are dropped before the shuffle.
    """
    each = term_counts(docs.filter(F.col("active")))
    return each if only_terms is None else each.join(only_terms.select("term").distinct(), "term", "left_semi").select(*each.columns)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of active documents and their mean length."""
    return docs.filter(F.col("active")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(token_count(F.col("text"))).alias("avgdl")
    )


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, repo, term, qtf) of the symbols and keywords; a repeated word counts again."""
    words = queries.select("query_id", "repo", F.explode(F.concat("symbols", "keywords")).alias("w"))
    each = words.select("query_id", "repo", F.explode(tokens(F.col("w"))).alias("term"))
    return each.groupBy("query_id", "repo", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_topk(index: DataFrame, n_docs: int, avgdl: float, terms: DataFrame, k: int) -> DataFrame:
    """Best documents per question among those of its repository, any term matching.

    Which side of the join moves is left to the sizes that the engine measures.
    """
    rated = document_frequencies(index).withColumn(
        "idf", F.ln(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    )
    asked = terms.join(rated, "term")
    rows = index.join(asked, ["term", "repo"])
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.lit(float(avgdl)))
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + norm)
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    scored = scored.select("query_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    return top_rows(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def fulltext_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 straight from document texts (no stored index).

    The index rows of the asked terms are written once, laid out by document.
    """
    terms = query_terms(queries)
    stats = corpus_stats(docs).first()
    index = cut_lineage(postings(docs, terms).repartition("doc_id"))
    return bm25_topk(index, stats["n_docs"], stats["avgdl"] or 1.0, terms, k)


def symbol_matches(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Active nodes of the question's repository named exactly like one of its symbols."""
    asked = queries.select("query_id", "repo", F.explode("symbols").alias("symbol")).distinct()
    active = nodes.filter(F.col("active"))
    by_name = active.select("repo", F.col("name").alias("symbol"), "id")
    by_qualified = active.select("repo", F.col("qualified_name").alias("symbol"), "id")
    hits = asked.join(by_name, ["repo", "symbol"]).union(asked.join(by_qualified, ["repo", "symbol"]))
    return hits.select("query_id", "id").distinct()


def graph_list(direct: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Direct matches first, then full-text hits by score; the first mention of a node counts."""
    tiers = direct.select("query_id", "id", F.lit(0).alias("tier"), F.lit(0.0).alias("score")).unionByName(
        fulltext.select("query_id", "id", F.lit(1).alias("tier"), "score")
    )
    first = tiers.groupBy("query_id", "id").agg(F.min(F.struct("tier", (-F.col("score")).alias("neg"))).alias("t"))
    flat = first.select("query_id", "id", "t.tier", "t.neg")
    # A name shared by a third of all nodes makes one list that long: number it in chunks.
    order = ["tier", "neg", "id"]
    placed = scan.range_chunks(flat, ["query_id"], order)
    return scan.numbered(placed, ["query_id"], order, "rank").select("query_id", "id", "tier", F.col("rank").cast("int").alias("rank"))


def ranked_lists(*lists: tuple[DataFrame, str]) -> DataFrame:
    """Union of (query_id, id, rank) lists tagged with their source; a missing list adds nothing."""
    whole = None
    for rows, source in lists:
        tagged = rows.select("query_id", "id", "rank", F.lit(source).alias("source"))
        whole = tagged if whole is None else whole.unionByName(tagged)
    return whole


def fuse(lists: DataFrame, max_seeds: int | None = MAX_SEEDS, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of 1-based ranks, cut to the best seeds of each question."""
    seen = lambda s: F.max(F.col("source") == s)
    fused = lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), seen("vector").alias("__v"), seen("graph").alias("__g")
    )
    method = F.when(F.col("__v") & F.col("__g"), "both").when(F.col("__v"), "vector").otherwise("graph")
    fused = fused.select("query_id", "id", F.round("score", 12).alias("score"), method.alias("retrieval_method"))
    if max_seeds is None:
        return fused
    return top_rows(fused, ["query_id"], [F.desc("score"), F.col("id")], max_seeds)


def hybrid_seeds(queries: DataFrame, vectors: DataFrame, docs: DataFrame, max_seeds: int = MAX_SEEDS, index: TextIndex | None = None) -> DataFrame:
    """Seeds of every question: vector list and graph list, each twice as long as asked, fused.

    ``queries``: (query_id, repo, symbols, keywords, embedding); a question without words or
    without a vector uses the other list alone. With a stored ``index`` of ``docs`` texts are not read.
    """
    limit = max_seeds * OVERFETCH
    near = vector_topk(queries.filter(F.col("embedding").isNotNull()), vectors, limit)
    nodes = docs.select(F.col("doc_id").alias("id"), "repo", "name", "qualified_name", "active")
    fulltext = fulltext_topk(docs, queries, limit) if index is None else index.topk(query_terms(queries), limit)
    graph = graph_list(symbol_matches(nodes, queries), fulltext)
    return fuse(ranked_lists((near, "vector"), (graph, "graph")), max_seeds)
