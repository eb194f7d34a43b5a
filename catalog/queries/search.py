"""Questions, vector and full-text retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import VIEWS
from strandline.functions import text
from strandline.operators import search as sr
from strandline.operators.text_index import TextIndex, apply_change
from strandline.operators.vector_index import VectorIndex
from strandline.session import run_folder

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
# Benchmark items ask; the vector and the symbol of the same number belong to the question.
VIEWS["q_base"] = """
select item_id query_id, case item_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end repo, text question from {benchmark}
"""
VIEWS["docs"] = """
select doc_id, lang repo, 'd'||cast(doc_id as string) name, 'q'||cast(cast(floor(doc_id / 3) as int) as string) qualified_name,
  n_chars > 40 active, text from {documents}
"""
VIEWS["doc_vec"] = "select vec_id id, d.repo, embedding from {embeddings} e join {docs} d on d.doc_id = e.vec_id where d.active"

KEYWORDS = f"list_slice(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '' and w not in ({STOP}) and length(w) > 1), 1, 8)"


def questions(t):
    """(query_id, repo, symbols, keywords, embedding): symbols name a document and a qualified group."""
    base = t.q_base.withColumn("keywords", text.keywords(F.col("question")))
    base = base.withColumn("symbols", F.array(F.concat(F.lit("d"), "query_id"), F.concat(F.lit("q"), "query_id")))
    vec = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return base.join(vec, "query_id", "left")


@query(
    "prj22_keywords",
    f"""select 'b'||item_id id, array_to_string({KEYWORDS.replace('question', 'text')}, ' ') keywords from benchmark
    union all select 'c'||conv_id||'.'||turn, array_to_string({KEYWORDS.replace('question', 'text')}, ' ') from conversations where role = 'user'""",
)
def _(t):
    asked = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("id"), "text").union(
        t.conversations.filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn"), "text")
    )
    return asked.select("id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "prj24_intent_key",
    "select 'query_intent:'||sha256(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')||'|'||role) intent_key, count(*) n from conversations group by all",
)
def _(t):
    return t.conversations.groupBy(text.intent_key(F.col("text"), F.col("role")).alias("intent_key")).agg(F.count("*").alias("n"))


TERMS = f"""qterms as (select query_id, repo, term, count(*) qtf from (
  select query_id, repo, unnest(regexp_extract_all(lower(w), '[a-z0-9]+', 0)) term from (
    select query_id, repo, unnest(list_concat(['d'||query_id, 'q'||query_id], {KEYWORDS})) w from {{q_base}})) group by all)"""
INDEX = """toks as (select doc_id, repo, regexp_extract_all(lower(text), '[a-z0-9]+', 0) ts from {docs} where active),
post as (select doc_id, repo, len(ts) dl, term, count(*) tf from (select doc_id, repo, ts, unnest(ts) term from toks) group by all),
corpus as (select count(*) n_docs, avg(len(ts)) avgdl from toks)"""
BM25 = f"""{TERMS}, {INDEX},
dfs as (select term, count(*) df from post group by term),
bm as (select q.query_id, p.doc_id id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / cast(df + 0.5 as double)) * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 9) score
  from qterms q join post p on p.term = q.term and p.repo = q.repo join dfs on dfs.term = q.term, corpus group by all),
ft as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from bm) where rank <= 16)"""


# By application and data folder: the index of the whole documents table, built when it is first asked.
_INDEXES: dict[tuple[str, str], str] = {}


def vector_index(t) -> VectorIndex:
    """The stored index of all vectors, kept like that of texts."""
    key = (t.spark.sparkContext.applicationId, t.folder + " vectors")
    if key not in _INDEXES:
        folder = run_folder(t.spark, "vector-index")
        VectorIndex(t.spark, folder).build(t.vec.withColumnRenamed("vec_id", "id"))
        _INDEXES[key] = folder
    return VectorIndex(t.spark, _INDEXES[key])


def text_index(t) -> TextIndex:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        folder = run_folder(t.spark, "text-index")
        TextIndex(t.spark, folder).write_segment(0, t.docs)
        _INDEXES[key] = folder
    return TextIndex(t.spark, _INDEXES[key])


def fulltext(t, k: int):
    return text_index(t).topk(sr.query_terms(questions(t)), k)


@query("ag21_corpus_stats", f"with {INDEX} select n_docs, round(avgdl, 6) avgdl from corpus")
def _(t):
    return sr.corpus_stats(t.docs).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("ag21_document_frequencies", f"with {INDEX} select term, count(*) df from post group by term")
def _(t):
    return sr.document_frequencies(sr.postings(t.docs))


@query("tk2_fulltext_topk", f"with {BM25} select query_id, id, round(score, 6) score, cast(rank as integer) rank from ft")
def _(t):
    return fulltext(t, 16).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("tk2_fulltext_unstored", f"with {BM25} select query_id, id, round(score, 6) score, cast(rank as integer) rank from ft")
def _(t):
    out = sr.fulltext_topk(t.docs, questions(t), 16)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# A batch of changes: some documents gain words and may turn active, some are deleted, some are new.
VIEWS["doc_upserts"] = """
select doc_id, repo, text||' d'||cast(doc_id + 1 as string)||' '||repo||' changed' text, not active or doc_id % 2 = 0 active from {docs} where doc_id % 5 = 0
union all select doc_id + 100000000, repo, 'new d'||cast(doc_id as string)||' '||text, true from {docs} where doc_id % 6 = 1
"""
VIEWS["docs_changed"] = """
select doc_id, repo, text, active from {docs} where doc_id % 5 <> 0 and doc_id % 7 <> 3
union all select doc_id, repo, text, active from {doc_upserts} where doc_id % 7 <> 3 or doc_id >= 100000000
"""


def changed_index(t) -> TextIndex:
    """A build, then one batch of upserts and deletions, the latter written twice as after a retry."""
    index = TextIndex(t.spark, run_folder(t.spark, "text-index"))
    index.write_segment(0, t.docs)
    for _ in range(2):
        apply_change(index, 1, t.docs, t.doc_upserts, t.docs.where("doc_id % 7 = 3"))
    return index


CHANGED = BM25.replace("{docs}", "{docs_changed}")


@query("tk2_fulltext_after_changes", f"with {CHANGED} select query_id, id, round(score, 6) score, cast(rank as integer) rank from ft")
def _(t):
    out = changed_index(t).topk(sr.query_terms(questions(t)), 16)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "ag21_statistics_after_changes",
    f"with {INDEX.replace('{docs}', '{docs_changed}')} select term, count(*) df, any_value(n_docs) n_docs, any_value(round(avgdl, 6)) avgdl from post, corpus group by term",
)
def _(t):
    index = changed_index(t)
    known = index.statistics()
    return index.document_frequencies().select("term", "df", F.lit(known.n_docs).cast("bigint").alias("n_docs"), F.round(F.lit(known.avgdl), 6).alias("avgdl"))


DIRECT = """direct as (select distinct q.query_id, d.doc_id id from {q_base} q join {docs} d on d.repo = q.repo and d.active
  and (d.name in ('d'||query_id, 'q'||query_id) or d.qualified_name in ('d'||query_id, 'q'||query_id)))"""
GRAPH = f"""{BM25}, {DIRECT}, tiers as (select query_id, id, 0 tier, 0.0 neg from direct union all select query_id, id, 1, -score from ft),
firsts as (select query_id, id, min((tier, neg)) tn from tiers group by all),
glist as (select query_id, id, tn[1] tier, row_number() over (partition by query_id order by tn[1], tn[2], id) rank from firsts)"""


@query("wn9_graph_list_rank", f"with {GRAPH} select query_id, id, tier, cast(rank as integer) rank from glist")
def _(t):
    nodes = t.docs.withColumnRenamed("doc_id", "id")
    return sr.graph_list(sr.symbol_matches(nodes, questions(t)), fulltext(t, 16))


NEAREST = """with v as (select vec_id, repo, cast(embedding as double[]) e from {vec}), s as (select q.vec_id query_id, v.vec_id id, round(list_cosine_similarity(q.e, v.e), 9) score from v q join v on v.repo = q.repo)
    select query_id, id, round(score, 6) score, cast(rank as integer) rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 16"""


@query("tk1_vector_topk", NEAREST)
def _(t):
    out = sr.vector_topk(t.vec.withColumnRenamed("vec_id", "query_id"), t.vec.withColumnRenamed("vec_id", "id"), 16)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("tk1_vector_topk_cells", NEAREST)
def _(t):
    out = vector_index(t).topk(t.vec.withColumnRenamed("vec_id", "query_id"), 16)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "tk1_vector_topk_after_changes",
    """with v as (select vec_id, repo, cast(embedding as double[]) e from {vec}),
    c as (select vec_id id, repo, e from v where vec_id % 5 > 1 union all select vec_id, repo, list_reverse(e) from v where vec_id % 5 = 0 union all select vec_id + 100000000, repo, e from v where vec_id % 3 = 0),
    s as (select q.vec_id query_id, c.id, round(list_cosine_similarity(q.e, c.e), 9) score from v q join c on c.repo = q.repo)
    select query_id, id, round(score, 6) score, cast(rank as integer) rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 16""",
)
def _(t):
    # One fifth is replaced, one fifth is deleted, copies of a third are new; written twice as after a retry.
    index = VectorIndex(t.spark, run_folder(t.spark, "vector-index"))
    rows = t.vec.withColumnRenamed("vec_id", "id")
    index.build(rows)
    copies = rows.where("id % 3 = 0").withColumn("id", F.col("id") + 100_000_000)
    after = rows.where("id % 5 = 0").withColumn("embedding", F.reverse("embedding")).unionByName(copies)
    for _ in range(2):
        index.write_segment(1, after, rows.where("id % 5 = 1"))
    out = index.topk(t.vec.withColumnRenamed("vec_id", "query_id"), 16)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "tk1_vector_topk_blocked",
    """with v as (select vec_id, repo, cast(embedding as double[]) e from {vec}), s as (select q.vec_id query_id, v.vec_id id, round(list_cosine_similarity(q.e, v.e), 9) score from v q join v on v.repo = q.repo)
    select query_id, id, round(score, 6) score, cast(rank as integer) rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 5""",
)
def _(t):
    out = sr.vector_topk(t.vec.withColumnRenamed("vec_id", "query_id"), t.vec.withColumnRenamed("vec_id", "id"), 5, query_rows=300, block_rows=200)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


FUSED = f"""{GRAPH}, qv as (select q.query_id, q.repo, cast(e.embedding as double[]) e from {{q_base}} q join embeddings e on e.vec_id = q.query_id),
dv as (select id, repo, cast(embedding as double[]) e from {{doc_vec}}),
vs as (select q.query_id, d.id, round(list_cosine_similarity(q.e, d.e), 9) score from qv q join dv d on d.repo = q.repo),
vl as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from vs) where rank <= 16),
lists as (select query_id, id, rank, 'vector' source from vl union all select query_id, id, rank, 'graph' from glist),
fused as (select query_id, id, round(sum(1.0 / cast(60 + rank as double)), 12) score,
  case when count(*) = 2 then 'both' else min(source) end retrieval_method from lists group by query_id, id),
seeds as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from fused) where rank <= 8)"""


def _lists(t):
    q = questions(t)
    near = sr.vector_topk(q.filter("embedding is not null"), t.doc_vec, 16)
    nodes = t.docs.withColumnRenamed("doc_id", "id")
    return sr.ranked_lists((near, "vector"), (sr.graph_list(sr.symbol_matches(nodes, q), fulltext(t, 16)), "graph"))


@query("set4_ranked_lists", f"with {FUSED} select query_id, source, count(*) n, cast(max(rank) as integer) last from lists group by all")
def _(t):
    return _lists(t).groupBy("query_id", "source").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


@query("ag1_rank_fusion", f"with {FUSED} select query_id, id, round(score, 9) score, retrieval_method from fused")
def _(t):
    return sr.fuse(_lists(t), None).select("query_id", "id", F.round("score", 9).alias("score"), "retrieval_method")


@query("hybrid_seeds", f"with {FUSED} select query_id, id, round(score, 9) score, retrieval_method, cast(rank as integer) rank from seeds")
def _(t):
    out = sr.hybrid_seeds(questions(t), t.doc_vec, t.docs, index=text_index(t))
    return out.select("query_id", "id", F.round("score", 9).alias("score"), "retrieval_method", "rank")


@query("tk3_seed_cap", f"with {FUSED} select query_id, id, cast(rank as integer) rank from seeds where rank <= 5")
def _(t):
    return sr.fuse(_lists(t), 5).select("query_id", "id", "rank")
