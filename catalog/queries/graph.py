"""Expansion, pruning and edge collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from strandline.functions import labels
from strandline.operators import document as doc
from strandline.operators import expand as ex
from strandline.plans.answer import subgraph

WEIGHT = "case edge_type when 'CALLS' then 1.0e0 when 'IMPORTS' then 0.8e0 when 'INHERITS' then 0.7e0 else 0.0e0 end * case provenance when 'confirmed' then 1.0e0 when 'dynamic' then 0.9e0 when 'conflict' then 0.6e0 else 0.8e0 end"
SCORE = WEIGHT.replace("case edge_type", "f.score * 0.7e0 * case m.edge_type").replace("case provenance", "case m.provenance")


def _hop(n: int) -> str:
    return f"""f{n} as (select * from v{n - 1} where hop = {n - 1}),
  c{n} as (select f.query_id, f.query_type, m.stable_id, {SCORE} score, {n} hop, m.parent_id, m.edge_type, m.provenance
    from f{n} f join moves m on m.parent_id = f.stable_id and m.way = case f.query_type when 'impact' then 'in' else 'out' end
    where (f.query_type = 'flow' and m.edge_type in ('CALLS','IMPORTS','INHERITS')) or (f.query_type = 'lookup' and m.edge_type in ('IMPORTS','INHERITS')) or (f.query_type = 'impact' and m.edge_type = 'CALLS')),
  v{n} as (select query_id, query_type, stable_id, score, hop, parent_id, edge_type, provenance from (
    select *, row_number() over (partition by query_id, stable_id order by score desc, hop, parent_id nulls first, edge_type, provenance) rn from (
      select * from v{n - 1} union all select * from c{n} where score > 0 and stable_id in (select stable_id from {{g_nodes}} where active))) where rn = 1)"""


EXPANDED = f"""moves as (select 'out' way, source parent_id, target stable_id, type edge_type, provenance from {{g_edges}}
  union all select 'in', target, source, type, provenance from {{g_edges}} where type = 'CALLS'),
v0 as (select q.query_id, q.query_type, s.stable_id, 1.0e0 score, 0 hop, cast(null as varchar) parent_id, cast(null as varchar) edge_type, cast(null as varchar) provenance
  from (select distinct * from {{g_seeds}}) s join {{g_queries}} q on q.query_id = s.query_id),
{_hop(1)}, {_hop(2)}"""

LATEST = "latest as (select repo, node_stable_id stable_id, arg_max(spec_text, generated_at) spec_text from {g_specs} group by all)"
PRUNED = f"""{EXPANDED}, {LATEST},
costed as (select v.*, l.spec_text, q.max_tokens, case when hop > 0 then 20 when l.spec_text is not null then 60 else 120 end cost
  from (select v2.*, case when hop = 0 then stable_id end seed_id from v2) v left join latest l on l.stable_id = v.seed_id join {{g_queries}} q on q.query_id = v.query_id),
cum as (select *, sum(cost) over (partition by query_id order by score desc, hop, stable_id rows unbounded preceding) used from costed),
kept as (select *, row_number() over (partition by query_id order by score desc, hop, stable_id) pos from cum where hop = 0 or used <= max_tokens)"""


def parts(t):
    return subgraph(t.g_queries, t.g_seeds, t.g_nodes, ex.edge_table(t.g_edges), ex.latest_specs(t.g_specs))


@query(
    "gr1_best_score_expansion",
    f"with {EXPANDED} select query_id, stable_id, round(score, 9) score, hop, coalesce(parent_id, '') parent_id, coalesce(edge_type, '') edge_type, coalesce(provenance, '') provenance from v2",
)
def _(t):
    v = ex.expand(t.g_queries, t.g_seeds, t.g_nodes, t.g_edges)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return v.select("query_id", "stable_id", F.round("score", 9).alias("score"), "hop", blank("parent_id"), blank("edge_type"), blank("provenance"))


@query(
    "jn11_frontier_neighbors",
    """with m as (select 'out' way, source parent_id, target stable_id, type edge_type from {g_edges} union all select 'in', target, source, type from {g_edges} where type = 'CALLS')
    select q.query_id, q.query_type, m.stable_id, m.edge_type from {g_queries} q join m on m.parent_id = q.query_id and m.way = case q.query_type when 'impact' then 'in' else 'out' end
    where (q.query_type = 'flow' and edge_type in ('CALLS','IMPORTS','INHERITS')) or (q.query_type = 'lookup' and edge_type in ('DEFINES','IMPORTS','INHERITS')) or (q.query_type = 'impact' and edge_type in ('CALLS','TESTED_BY'))""",
)
def _(t):
    frontier = t.g_queries.withColumn("stable_id", F.col("query_id")).withColumn("score", F.lit(1.0))
    return ex.neighbors(frontier, ex.moves(t.g_edges)).select("query_id", "query_type", "stable_id", "edge_type")


@query(
    "prj18_weights",
    f"select type edge_type, provenance, count(*) n, round(sum({WEIGHT.replace('edge_type', 'type')}), 6) total from {{g_edges}} group by all",
)
def _(t):
    w = labels.edge_weight(F.col("type")) * labels.provenance_weight(F.col("provenance"))
    return t.g_edges.groupBy(F.col("type").alias("edge_type"), "provenance").agg(F.count("*").alias("n"), F.round(F.sum(w), 6).alias("total"))


@query(
    "prj19_hop_score",
    f"select source, target, type, round(l * 0.7e0 * {WEIGHT.replace('edge_type', 'type')}, 9) score from (select *, length(source) / 10.0e0 l from {{g_edges}}) where {WEIGHT.replace('edge_type', 'type')} > 0",
)
def _(t):
    score = labels.hop_score(F.length("source") / 10.0, 0.7, F.col("type"), F.col("provenance"))
    return t.g_edges.select("source", "target", "type", F.round(score, 9).alias("score")).filter("score > 0")


@query("prj20_token_cost", f"with {PRUNED} select hop, spec_text is not null has_spec, cost, count(*) n from costed group by all")
def _(t):
    v = ex.expand(t.g_queries, t.g_seeds, t.g_nodes, t.g_edges)
    # Only seeds have specs, so other rows are counted before specs are looked up.
    v = v.groupBy("hop", F.when(F.col("hop") == 0, F.col("stable_id")).alias("stable_id")).agg(F.count("*").alias("n"))
    v = ex.attach_specs(v, ex.latest_specs(t.g_specs))
    has = F.col("spec_text").isNotNull()
    return v.groupBy("hop", has.alias("has_spec"), labels.token_cost(F.col("hop"), has).alias("cost")).agg(F.sum("n").alias("n"))


@query("wn14_latest_spec", "select repo, node_stable_id stable_id, arg_max(spec_text, generated_at) spec_text from {g_specs} group by all")
def _(t):
    return ex.latest_specs(t.g_specs).select("repo", "stable_id", "spec_text")


@query(
    "jn10_seed_hydration",
    "select distinct s.query_id, s.stable_id, coalesce(n.name, '?') \"name\" from {g_seeds} s left join {g_nodes} n on n.stable_id = s.stable_id and n.active",
)
def _(t):
    rows = ex.hydrate(t.g_seeds.distinct(), t.g_nodes, ["name"])
    return rows.select("query_id", "stable_id", F.coalesce("name", F.lit("?")).alias("name"))


@query(
    "jn12_spec_attach",
    f"with {LATEST} select s.query_id, s.stable_id, coalesce(l.spec_text, '') spec_text from (select distinct * from {{g_seeds}}) s left join latest l on l.stable_id = s.stable_id",
)
def _(t):
    seeds = t.g_seeds.distinct().withColumn("hop", F.lit(0))
    return ex.attach_specs(seeds, ex.latest_specs(t.g_specs)).select("query_id", "stable_id", F.coalesce("spec_text", F.lit("")).alias("spec_text"))


@query("wn7_budget_prune", f"with {PRUNED} select query_id, stable_id, hop, cost, cast(pos as integer) pos, round(score, 9) score from kept")
def _(t):
    return parts(t)["nodes"].select("query_id", "stable_id", "hop", "cost", "pos", F.round("score", 9).alias("score"))


EDGES = f"""{PRUNED}, std as (select a.query_id, e.* from {{g_edges}} e join kept a on a.stable_id = e.source join kept b on b.query_id = a.query_id and b.stable_id = e.target),
conf as (select a.query_id, e.* from {{g_edges}} e join kept a on a.stable_id = e.source where e.provenance in ('conflict','dead')),
alle as (select *, 0 extra from std union all select *, 1 extra from conf)"""


@query("jn13_induced_edges", f"with {EDGES} select query_id, source, target, type, provenance from std")
def _(t):
    p = parts(t)
    return p["edges"].filter("extra = 0").drop("extra")


@query("jn14_conflict_edges", f"with {EDGES} select query_id, 'CONFLICT' type, source, target, '' detail from conf")
def _(t):
    return parts(t)["warnings"]


@query("set7_edge_union", f"with {EDGES} select query_id, type, extra, count(*) n from alle group by all")
def _(t):
    return parts(t)["edges"].groupBy("query_id", "type", "extra").agg(F.count("*").alias("n"))


@query(
    "ag16_budget_totals",
    f"""with {EDGES}, u as (select query_id, 1 c, 0 u from v2 union all select query_id, 0, cost from kept union all select query_id, 0, 15 from conf)
    select query_id, cast(sum(u) as bigint) budget_used, cast(sum(c) as bigint) total_candidates from u group by query_id""",
)
def _(t):
    return parts(t)["totals"]


IDS = f"""{EDGES}, typed as (select k.*, n.name, n.type, n.runs, n.coverage, case n.type when 'function' then 'fn' when 'method' then 'fn' when 'class' then 'cls' when 'file' then 'file' else '' end prefix,
  case n.type when 'function' then 0 when 'method' then 1 else 2 end tr from kept k left join {{g_nodes}} n on n.stable_id = k.stable_id and n.active),
named as (select *, case when prefix <> '' then prefix||':'||row_number() over (partition by query_id, prefix order by tr, hop, score desc, stable_id) else '' end display_id from typed)"""


@query("wn8_display_ids", f"with {IDS} select query_id, stable_id, display_id from named")
def _(t):
    return parts(t)["nodes"].select("query_id", "stable_id", "display_id")
