"""Closure, reconciliation, discovery, provenance and specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import VIEWS
from strandline.functions import labels, sqltext
from strandline.operators import closure as cl
from strandline.operators import discovery as ds
from strandline.operators import provenance as pv
from strandline.operators import specs as sp
from strandline.functions import text
from strandline.operators.document import display_ids  # noqa: F401
from strandline.session import written

# ---- closure and reconciliation: every customer is an entry ------------------------------
CLOSURE = """with recursive reach(entry, node) as (
  select 'c:'||c_custkey, g.target from customer join {g_calls} g on g.source = 'c:'||c_custkey
  union select r.entry, g.target from reach r join {g_calls} g on g.source = r.node)"""
VIEWS["observed"] = """
select distinct 'c:'||cast(o_custkey as string) entry, 'p:'||cast(l_partkey as string) fn from {orders} join {lineitem} on l_orderkey = o_orderkey where l_returnflag <> 'N'
union select 'c:'||cast(o_custkey as string), 'p:'||cast(l_suppkey as string) from {orders} join {lineitem} on l_orderkey = o_orderkey where l_returnflag = 'A'
union select 'c:'||cast(c_custkey as string), 'c:'||cast(c_custkey as string) from {customer}
"""


def _closure(t):
    entries = t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("entry"))
    return cl.transitive_closure(entries, t.g_calls)


def _reconciled(t):
    static = _closure(t).select("entry", F.col("entry").alias("source"), F.col("node").alias("target"))
    return cl.reconcile(t.observed, static)


@query("gr2_transitive_closure", f"{CLOSURE} select entry, node from reach")
def _(t):
    return _closure(t)


@query("jn15_dynamic_only", f"{CLOSURE} select entry, fn target from {{observed}} where (entry, fn) not in (select entry, node from reach) and fn <> entry")
def _(t):
    return _reconciled(t)["dynamic_only"]


@query("jn16_never_observed", f"{CLOSURE} select entry, entry source, node target from reach where (entry, node) not in (select entry, fn from {{observed}})")
def _(t):
    return _reconciled(t)["never_observed"]


@query("gr7_confirmed_edges", f"{CLOSURE} select entry, entry source, node target from reach where (entry, node) in (select entry, fn from {{observed}})")
def _(t):
    return _reconciled(t)["confirmed"]


# ---- discovery: customers are candidate entrypoints, orders their dependencies -----------
VIEWS["d_nodes"] = """
select 'c:'||cast(c_custkey as string) stable_id, case c_nationkey % 6 when 0 then 'test_'||c_name when 1 then 'Test'||c_name when 2 then 'ServeHTTP' when 3 then 'main' else c_name end name,
  case when c_acctbal > 3000 then 'function' else 'method' end type, 'repo'||cast(c_nationkey % 3 as string) repo, c_acctbal > -500 active,
  'src/'||c_mktsegment||case when c_nationkey % 2 = 0 then '.go' else '.py' end file_path,
  case c_mktsegment when 'BUILDING' then '@app.route(1)' when 'MACHINERY' then '@router.get' when 'AUTOMOBILE' then '@click.command()' end decorators from {customer}
"""
VIEWS["d_specs"] = """
select 'repo'||cast(c_nationkey % 3 as string) repo, 'c:'||cast(o_custkey as string) node_stable_id, o_orderdate generated_at, o_orderkey from {orders} join {customer} on c_custkey = o_custkey
where o_orderstatus = 'F' and c_nationkey % 4 <> 3
"""
ENTRY_WHERE = """active and (starts_with(name, 'test_') or coalesce(contains(decorators, 'app.route') or contains(decorators, 'router.') or contains(decorators, 'click.command'), false)
  or (type = 'function' and starts_with(name, 'Test')) or (type = 'method' and name = 'ServeHTTP') or (type = 'function' and name = 'main'))"""
JOBS = f"""{CLOSURE}, lastt as (select repo, node_stable_id stable_id, max(generated_at) at_ts from {{d_specs}} group by all),
  upd as (select 'o:'||o_orderkey node, o_orderdate updated_at from orders),
  changed as (select distinct r.entry stable_id from reach r join upd u on u.node = r.node join lastt l on l.stable_id = r.entry where u.updated_at > l.at_ts),
  jobs as (select d.stable_id, d.name, d.file_path, case when l.at_ts is null then 2 when c.stable_id is not null then 3 else 1 end priority, d.repo,
    case when file_path like '%.go' then 'go' else 'python' end "language" from {{d_nodes}} d left join lastt l on l.repo = d.repo and l.stable_id = d.stable_id left join changed c on c.stable_id = d.stable_id where {ENTRY_WHERE})"""


def _changed(t):
    updated = t.orders.select(F.concat(F.lit("o:"), "o_orderkey").alias("stable_id"), F.col("o_orderdate").alias("updated_at"))
    return cl.entries_with_changed_dependencies(t.g_calls, updated, ds.last_traced(t.d_specs))


def _jobs(t):
    return ds.jobs(ds.entrypoints(t.d_nodes), ds.last_traced(t.d_specs), _changed(t))


@query("prj10_entrypoints", f"select stable_id, name, file_path, repo from {{d_nodes}} where {ENTRY_WHERE}")
def _(t):
    return ds.entrypoints(t.d_nodes)


@query("ag9_last_traced", "select repo, node_stable_id stable_id, cast(epoch(max(generated_at)) as bigint) last_s from {d_specs} group by all")
def _(t):
    return ds.last_traced(t.d_specs).select("repo", "stable_id", F.unix_timestamp(F.col("last_traced_at").cast("timestamp")).alias("last_s"))


@query("gr3_changed_dependencies", f"{JOBS} select stable_id from changed")
def _(t):
    return _changed(t)


@query("jn18_entrypoint_jobs", f"{JOBS} select * from jobs")
def _(t):
    return _jobs(t)


@query("prj11_priority", f"{JOBS} select repo, priority, count(*) n from jobs group by all")
def _(t):
    return _jobs(t).groupBy("repo", "priority").agg(F.count("*").alias("n"))


@query("tk6_jobs_by_priority", f"{JOBS} select stable_id, priority from jobs order by priority desc, stable_id")
def _(t):
    return ds.by_priority(_jobs(t)).select("stable_id", "priority")


@query("prj2_job_language", f"select stable_id, case when file_path like '%.go' then 'go' else 'python' end \"language\" from {{d_nodes}}")
def _(t):
    return t.d_nodes.select("stable_id", text.job_language(F.col("file_path")).alias("language"))


@query("prj32_entrypoint_kind", "select stable_id, case when starts_with(name, 'Test') then 'test' else 'function' end kind from {d_nodes}")
def _(t):
    return t.d_nodes.select("stable_id", text.entrypoint_kind(F.col("name")).alias("kind"))


@query("ag20_discovery_counters", f"{JOBS} select repo, count(*) discovered, cast(sum(case when priority > 1 then 1 else 0 end) as bigint) queued from jobs group by repo")
def _(t):
    return ds.counters(ds.entrypoints(t.d_nodes), _jobs(t).filter("priority > 1"))


@query("set9_distinct_repos", "select distinct repo from {d_nodes}")
def _(t):
    return ds.repositories(t.d_nodes)


@query(
    "jn22_work_skip",
    "select o_orderkey, commit_sha, stable_id from (select o_orderkey, o_orderstatus commit_sha, 'c:'||o_custkey stable_id from orders) j where not exists (select 1 from orders c where c.o_orderstatus = j.commit_sha and 'c:'||c.o_custkey = j.stable_id and timestamp '1998-01-01 12:00:00' - c.o_orderdate < interval 24 hour)",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("commit_sha"), F.concat(F.lit("c:"), "o_custkey").alias("stable_id"))
    cache = t.orders.select(F.col("o_orderstatus").alias("commit_sha"), F.concat(F.lit("c:"), "o_custkey").alias("stable_id"), F.col("o_orderdate").alias("traced_at"))
    return ds.not_yet_traced(rows, cache, F.lit("1998-01-01 12:00:00").cast("timestamp")).select("o_orderkey", "commit_sha", "stable_id")


# ---- provenance: every order is a trace of its customer ----------------------------------
VIEWS["p_nodes"] = """
select stable_id, name, type, case when runs > 0 then runs end observed_calls, cast(null as double) avg_latency_ms, coverage branch_coverage,
  case when type = 'method' and runs % 2 = 0 then timestamp '1997-01-01' end last_traced_at,
  case when type = 'function' then timestamp '1996-06-01' else timestamp '1995-01-01' end updated_at from {g_nodes}
"""
VIEWS["p_edges"] = """
select source, target, type, provenance, case when provenance = 'dynamic' then cast(2 as bigint) end observed_count,
  case when provenance = 'confirmed' then case when length(target) % 2 = 0 then timestamp '1996-01-01' else timestamp '1997-01-01' end end confirmed_at, '' detail from {g_edges}
"""
VIEWS["p_paths"] = "select o_orderkey trace_id, o_orderkey trace_no, 'c:'||cast(o_custkey as string) entry, o_totalprice / 1000.0e0 timing_p50_ms from {orders}"
VIEWS["p_calls"] = """
select l_orderkey trace_id, l_orderkey trace_no, cast(l_linenumber as bigint) seq, 'p:'||cast(l_partkey as string) stable_id, l_quantity avg_ms, 1 - l_discount frequency_ratio from {lineitem} where l_linestatus = 'F'
union all select o_orderkey, o_orderkey, cast(-1 as bigint), 'o:'||cast(o_orderkey as string), 1.5e0, 1.0e0 from {orders} where o_orderpriority <> '1-URGENT'
union all select o_orderkey, o_orderkey, cast(0 as bigint), 'c:'||cast(o_custkey as string), 2.5e0, 0.5e0 from {orders} where o_orderpriority = '2-HIGH'
"""
VIEWS["p_dynamic"] = """
select 'c:'||cast(o_custkey as string) source, 'p:'||cast(l_partkey as string) target, cast(1 as bigint) count from {orders} join {lineitem} on l_orderkey = o_orderkey where l_returnflag = 'R'
union all select 'o:'||cast(l_orderkey as string), 'p:'||cast(l_partkey as string), cast(1 as bigint) from {lineitem} where l_tax > 0.06
union all select 'o:'||cast(l_orderkey as string), 'x:'||cast(l_partkey as string), cast(1 as bigint) from {lineitem}
"""


def now():
    return F.lit("2000-01-01").cast("timestamp_ntz")


RECORDS = """recs as (select trace_id, trace_no, seq, stable_id, avg_ms latency, frequency_ratio coverage from {p_calls}
  union all select trace_id, trace_no, null, entry, timing_p50_ms, 1.0 from {p_paths} p where not exists (select 1 from {p_calls} c where c.trace_id = p.trace_id and c.stable_id = p.entry)),
upd as (select stable_id, count(*) n, max({'a': trace_no, 'b': coalesce(seq, -1000), 'c': latency, 'd': coverage}) l from recs group by stable_id),
nodes2 as (select n.stable_id, case when u.n is null then n.observed_calls else coalesce(n.observed_calls, 0) + u.n end observed_calls,
  case when u.n is null then n.avg_latency_ms else u.l.c end avg_latency_ms, case when u.n is null then n.branch_coverage else u.l.d end branch_coverage,
  case when u.n is null then n.last_traced_at else timestamp '2000-01-01' end last_traced_at, n.updated_at from {p_nodes} n left join upd u on u.stable_id = n.stable_id)"""
EDGE_PASSES = f"""{RECORDS},
dyn as (select source, target, sum("count") n from {{p_dynamic}} where source in (select stable_id from {{p_nodes}}) and target in (select stable_id from {{p_nodes}}) group by all),
e1 as (select coalesce(e.source, d.source) source, coalesce(e.target, d.target) target, coalesce(e.type, 'CALLS') "type",
  case when d.n is null or e.provenance in ('static','confirmed','conflict') then e.provenance else 'dynamic' end provenance,
  case when d.n is null then e.observed_count else coalesce(e.observed_count, 0) + d.n end observed_count, e.confirmed_at, e.detail
  from {{p_edges}} e full join dyn d on d.source = e.source and d.target = e.target and e.type = 'CALLS'),
obs as (select distinct trace_id, stable_id from recs),
hits as (select distinct e.source, e.target from e1 e join obs a on a.stable_id = e.source join obs b on b.trace_id = a.trace_id and b.stable_id = e.target where e.type = 'CALLS' and e.provenance = 'static'),
e2 as (select e.source, e.target, e.type, case when h.source is not null and provenance = 'static' then 'confirmed' else provenance end provenance,
  case when h.source is not null and provenance = 'static' then coalesce(observed_count, 0) + 1 else observed_count end observed_count,
  case when h.source is not null and provenance = 'static' then timestamp '2000-01-01' else confirmed_at end confirmed_at, detail
  from e1 e left join hits h on h.source = e.source and h.target = e.target and e.type = 'CALLS'),
e3 as (select e.*, n.last_traced_at traced, n.updated_at upd_at, type = 'CALLS' and provenance = 'static' and observed_count is null and n.last_traced_at is not null is_conflict,
  coalesce(type = 'CALLS' and provenance = 'confirmed' and n.updated_at > confirmed_at, false) is_stale from e2 e left join nodes2 n on n.stable_id = e.source),
e4 as (select source, target, type, case when is_conflict then 'conflict' when is_stale then 'static' else provenance end provenance,
  case when is_stale then null else observed_count end observed_count, case when is_stale then null else confirmed_at end confirmed_at,
  case when is_conflict then 'in AST but never observed in traces' else coalesce(detail, '') end detail from e3)"""
EDGE_OUT = "select source, target, type, provenance, cast(coalesce(observed_count, -1) as bigint) observed_count, coalesce(cast(epoch(confirmed_at) as bigint), 0) confirmed_s, coalesce(detail, '') detail from "


def _edge_out(df):
    return df.select(
        "source", "target", "type", "provenance", F.coalesce("observed_count", F.lit(-1)).cast("bigint").alias("observed_count"),
        F.coalesce(F.unix_timestamp(F.col("confirmed_at").cast("timestamp")), F.lit(0)).alias("confirmed_s"), F.coalesce("detail", F.lit("")).alias("detail"),
    )


def _records(t):
    records = pv.node_records(t.p_paths, t.p_calls)
    return records.withColumn("seq", F.coalesce("seq", F.lit(-1000)))


@query(
    "ag10_node_updates",
    f"with {RECORDS} select stable_id, cast(coalesce(observed_calls, -1) as bigint) observed_calls, round(coalesce(avg_latency_ms, -1), 6) latency, round(branch_coverage, 6) coverage, coalesce(cast(epoch(last_traced_at) as bigint), 0) traced_s from nodes2",
)
def _(t):
    out = pv.update_nodes(t.p_nodes, _records(t), now())
    return out.select(
        "stable_id", F.coalesce("observed_calls", F.lit(-1)).cast("bigint").alias("observed_calls"),
        F.round(F.coalesce("avg_latency_ms", F.lit(-1.0)), 6).alias("latency"), F.round("branch_coverage", 6).alias("coverage"),
        F.coalesce(F.unix_timestamp(F.col("last_traced_at").cast("timestamp")), F.lit(0)).alias("traced_s"),
    )


@query("ag11_dynamic_edges", f"with {EDGE_PASSES} {EDGE_OUT} e1")
def _(t):
    return _edge_out(pv.upsert_dynamic_edges(t.p_edges, t.p_dynamic, t.p_nodes))


@query("jn17_confirm_static_edges", f"with {EDGE_PASSES} {EDGE_OUT} e2")
def _(t):
    linked = written(pv.upsert_dynamic_edges(t.p_edges, t.p_dynamic, t.p_nodes), "linked")
    observed = written(_records(t).select("trace_id", "stable_id"), "observed")
    return _edge_out(pv.confirm_static_edges(linked, observed, now()))


@query(
    "gr4_conflict_detector",
    f"with e3 as (select e.*, e.type = 'CALLS' and provenance = 'static' and e.observed_count is null and n.last_traced_at is not null is_conflict from {{p_edges}} e left join {{p_nodes}} n on n.stable_id = e.source) {EDGE_OUT} (select source, target, type, case when is_conflict then 'conflict' else provenance end provenance, observed_count, confirmed_at, case when is_conflict then 'in AST but never observed in traces' else detail end detail from e3)",
)
def _(t):
    return _edge_out(pv.settle_edges(t.p_edges, t.p_nodes, downgrade_stale=False))


@query(
    "gr5_staleness_downgrade",
    f"with e3 as (select e.*, coalesce(e.type = 'CALLS' and provenance = 'confirmed' and n.updated_at > confirmed_at, false) is_stale from {{p_edges}} e left join {{p_nodes}} n on n.stable_id = e.source) {EDGE_OUT} (select source, target, type, case when is_stale then 'static' else provenance end provenance, case when is_stale then null else observed_count end observed_count, case when is_stale then null else confirmed_at end confirmed_at, detail from e3)",
)
def _(t):
    return _edge_out(pv.settle_edges(t.p_edges, t.p_nodes, detect_conflicts=False))


@query("gr6_provenance_pass", f"with {EDGE_PASSES} {EDGE_OUT} e4")
def _(t):
    _, edges = pv.provenance_pass(t.p_nodes, t.p_edges, t.p_paths, t.p_calls, t.p_dynamic, now())
    return _edge_out(edges)


# ---- specs: every order is a path, its line items are calls and effects ------------------
VIEWS["s_effects"] = """
select l_orderkey trace_id, l_linenumber * cast(10000000 as bigint) + l_partkey * 1000 + l_suppkey seq, case l_linenumber % 6 when 0 then 'db_read' when 1 then 'db_write' when 2 then 'http_out' when 3 then 'cache_set' when 4 then 'fs_write' else 'db_read' end type,
  case l_linenumber % 6 when 0 then 'SELECT a FROM  t'||cast(l_partkey % 7 as string)||' WHERE x' when 1 then case l_suppkey % 3 when 0 then 'insert into (t'||cast(l_partkey % 7 as string)||') values' when 1 then 'UPDATE t'||cast(l_partkey % 7 as string)||' SET y' else 'fn t'||cast(l_partkey % 7 as string) end
    when 2 then case l_suppkey % 2 when 0 then 'POST https://h'||cast(l_partkey % 5 as string)||'.example/x' else 'call h'||cast(l_partkey % 5 as string)||'.example' end
    when 5 then 'values t'||cast(l_partkey % 7 as string)||',' else 'fn:k'||cast(l_partkey % 9 as string) end detail,
  case l_linenumber % 6 when 1 then case l_suppkey % 3 when 2 then 'fn' else 't'||cast(l_partkey % 7 as string) end else 't'||cast(l_partkey % 7 as string) end table_name, 'h'||cast(l_partkey % 5 as string)||'.example' host,
  cast(l_quantity % 4 as int) hop_depth from {lineitem}
"""
VIEWS["s_calls"] = """
select l_orderkey trace_id, l_linenumber * cast(10000000 as bigint) + l_partkey * 1000 + l_suppkey seq, 'p:'||cast(l_partkey as string) stable_id, 'fn'||cast(l_partkey as string) shown, 1 - l_discount frequency_ratio,
  l_quantity + 0.04e0 avg_ms, case when l_tax > 0.04 then 'x='||l_returnflag end args from {lineitem}
"""
VIEWS["s_paths"] = "select o_orderkey trace_id, 'entry '||o_orderpriority name, case when o_orderstatus <> 'P' then (o_orderkey % 100) / 100.0e0 end coverage_pct from {orders}"
VIEWS["s_dynamic"] = "select distinct l_orderkey trace_id, 'p:'||cast(l_partkey as string) target from {lineitem} where l_returnflag = 'R'"
VIEWS["s_never"] = "select distinct l_orderkey trace_id, l_suppkey seq, 's:'||cast(l_suppkey as string) target from {lineitem} where l_linestatus = 'O'"


@query("sc1_table_name", "select trace_id, seq, detail, table_name from {s_effects} where type in ('db_read', 'db_write')")
def _(t):
    rows = t.s_effects.filter("type in ('db_read', 'db_write')")
    return rows.select("trace_id", "seq", "detail", sqltext.table_name(F.col("detail")).alias("table_name"))


@query("sc2_service_name", "select trace_id, seq, detail, host from {s_effects} where type = 'http_out'")
def _(t):
    return t.s_effects.filter("type = 'http_out'").select("trace_id", "seq", "detail", sqltext.service_name(F.col("detail")).alias("host"))


@query("prj15_confidence_band", "select trace_id, case when coverage_pct is null then 'MEDIUM' when coverage_pct >= 0.8 then 'HIGH' when coverage_pct >= 0.4 then 'MEDIUM' else 'LOW' end band from {s_paths}")
def _(t):
    return t.s_paths.select("trace_id", labels.confidence_band(F.col("coverage_pct")).alias("band"))


IMPACT = """tabs as (select trace_id, table_name, min(case when type = 'db_read' then seq end) r, min(case when type = 'db_write' then seq end) w, min(seq) f from {s_effects} where type in ('db_read','db_write') group by all),
tabt as (select trace_id, table_name, case when w is null then 'r' when r is null then 'w' when r < w then 'r/w' else 'w/r' end access, f from tabs),
svcs as (select trace_id, host, bool_or(hop_depth > 1) cond, min(seq) f from {s_effects} where type = 'http_out' group by all)"""


@query(
    "ag17_change_impact",
    f"with {IMPACT} select trace_id, table_name \"name\", access, f first_seq from tabt union all select trace_id, host, case when cond then 'conditional' else 'always' end, f from svcs",
)
def _(t):
    tables = sp.table_impact(t.s_effects, ["trace_id"])
    services = sp.service_impact(t.s_effects, ["trace_id"]).select("trace_id", "name", F.when(F.col("conditional"), "conditional").otherwise("always").alias("access"), "first_seq")
    return tables.unionByName(services)


SPEC_LINES = f"""{IMPACT}, lines as (
  select trace_id, 0 section, 0 pos, 'PATH '||name||'  ('||case when coverage_pct is null then 'MEDIUM' when coverage_pct >= 0.8 then 'HIGH' when coverage_pct >= 0.4 then 'MEDIUM' else 'LOW' end||' confidence · '||cast(round_even(coalesce(coverage_pct, 0) * 100, 0) as int)||'% branch coverage)' "text" from {{s_paths}}
  union all select trace_id, 1, 0, '⚠ LOW COVERAGE — spec reflects partial observation only' from {{s_paths}} where coverage_pct < 0.4
  union all select c.trace_id, 2, c.seq, '  '||row_number() over (partition by c.trace_id order by c.seq)||'.  '||shown||printf('    %.2f    ~%.1fms    ', frequency_ratio, avg_ms)||case when d.target is not null then '[dynamic-only]' else '[confirmed]' end||case when args is not null then '    args: '||args else '' end
    from {{s_calls}} c left join {{s_dynamic}} d on d.trace_id = c.trace_id and d.target = c.stable_id
  union all select trace_id, 3, seq, '  ⚠ '||target||'   static-only — present in AST but never observed' from {{s_never}}
  union all select trace_id, 4, 0, '' from {{s_paths}}
  union all select distinct trace_id, 5, 0, 'SIDE_EFFECTS:' from {{s_effects}}
  union all select trace_id, 6, seq, '  '||case type when 'db_read' then 'DB READ' when 'db_write' then 'DB WRITE' when 'cache_set' then 'CACHE SET' when 'http_out' then 'HTTP OUT' else 'FS WRITE' end||'   '||detail||case when hop_depth > 1 then '   (conditional)' else '' end from {{s_effects}}
  union all select distinct trace_id, 7, 0, '' from {{s_effects}}
  union all select distinct trace_id, 8, 0, 'CHANGE_IMPACT:' from (select trace_id from tabt union select trace_id from svcs)
  union all select trace_id, 9, 0, '  tables affected    '||string_agg(table_name||' ('||access||')', '  ' order by f, table_name) from tabt group by trace_id
  union all select trace_id, 10, 0, '  external services  '||string_agg(host||case when cond then ' (conditional)' else '' end, '  ' order by f, host) from svcs group by trace_id)"""


def _spec_lines(t):
    return sp.spec_lines(t.s_paths, t.s_calls, t.s_effects, t.s_dynamic, t.s_never, ["trace_id"])


@query("doc1_spec_lines", f"with {SPEC_LINES} select trace_id, section, \"text\" from lines")
def _(t):
    return _spec_lines(t).select("trace_id", "section", "text")


@query("doc1_spec_text", f"with {SPEC_LINES} select trace_id, sha256(string_agg(\"text\", chr(10) order by section, pos, \"text\")) digest from lines group by trace_id")
def _(t):
    return sp.spec_texts(_spec_lines(t), ["trace_id"]).select("trace_id", F.sha2("spec_text", 256).alias("digest"))


@query(
    "doc1_spec_pieces",
    f"""with {SPEC_LINES}, whole as (select trace_id, string_agg("text", chr(10) order by section, pos, "text") spec from lines group by trace_id),
    cut as (select *, unnest(generate_series(0, greatest(length(spec) - 1, 0) // 200)) piece from whole)
    select trace_id, piece, piece * 200 "start", substr(spec, cast(piece * 200 + 1 as bigint), 200) "text" from cut""",
)
def _(t):
    return sp.spec_pieces(_spec_lines(t), ["trace_id"], 200).select("trace_id", "piece", "start", "text")


# Stored specs: one per customer and status; the batch: every order of the second half of the keys' statuses.
VIEWS["sp_stored"] = "select 'c:'||cast(o_custkey as string) node_stable_id, 'repo0' repo, o_orderstatus commit_sha, 3 version, 'old' spec_text, 0.5e0 branch_coverage, 1 observed_calls, timestamp '1999-01-01' generated_at from {orders} where o_orderstatus <> 'P' group by 1, 2, 3"
VIEWS["sp_batch"] = "select 'c:'||cast(o_custkey as string) node_stable_id, 'repo0' repo, o_orderstatus commit_sha, 'spec '||cast(o_orderkey as string) spec_text, o_totalprice branch_coverage, cast(o_orderkey % 50 as int) observed_calls, o_orderkey from {orders} where o_orderstatus <> 'F'"


@query(
    "snk5_spec_upsert",
    """with b as (select node_stable_id, repo, commit_sha, count(*) k, max({'o': o_orderkey, 't': spec_text, 'b': branch_coverage, 'c': observed_calls}) l from {sp_batch} group by all)
    select coalesce(s.node_stable_id, b.node_stable_id) node_stable_id, coalesce(s.commit_sha, b.commit_sha) commit_sha, cast(coalesce(s.version, 0) + coalesce(b.k, 0) as integer) "version",
      case when b.k is not null then b.l.t else s.spec_text end spec_text, round(case when b.k is not null then b.l.b else s.branch_coverage end, 4) branch_coverage, case when b.k is not null then b.l.c else s.observed_calls end observed_calls,
      cast(epoch(case when b.k is not null then timestamp '2000-01-01' else s.generated_at end) as bigint) generated_s
    from {sp_stored} s full join b on b.node_stable_id = s.node_stable_id and b.repo = s.repo and b.commit_sha = s.commit_sha""",
)
def _(t):
    out = sp.upsert_specs(t.sp_stored, t.sp_batch, now(), ["o_orderkey"])
    return out.select("node_stable_id", "commit_sha", "version", "spec_text", F.round("branch_coverage", 4).alias("branch_coverage"), "observed_calls",
                      F.unix_timestamp(F.col("generated_at").cast("timestamp")).alias("generated_s"))


@query(
    "snk6_spec_vector_upsert",
    """with b as (select node_stable_id, repo, max({'o': o_orderkey, 'c': commit_sha, 'v': branch_coverage}) l from {sp_batch} group by all), s as (select node_stable_id, repo, max(commit_sha) commit_sha from {sp_stored} group by all)
    select coalesce(s.node_stable_id, b.node_stable_id) node_stable_id, case when b.l is not null then b.l.c else s.commit_sha end commit_sha, case when b.l is not null then 'new' else 'old' end entrypoint_name,
      round(case when b.l is not null then b.l.v else -1 end, 4) coverage_pct from s full join b on b.node_stable_id = s.node_stable_id and b.repo = s.repo""",
)
def _(t):
    stored = t.sp_stored.groupBy("node_stable_id", "repo").agg(F.max("commit_sha").alias("commit_sha")).select(
        "*", F.lit("old").alias("entrypoint_name"), F.lit("LOW").alias("confidence_band"), F.lit(-1.0).alias("coverage_pct"), F.array(F.lit(0.0)).alias("vector"))
    batch = t.sp_batch.select("*", F.lit("new").alias("entrypoint_name"), labels.confidence_band(F.col("branch_coverage")).alias("confidence_band"),
                              F.col("branch_coverage").alias("coverage_pct"), F.array("branch_coverage").alias("vector"))
    return sp.upsert_spec_vectors(stored, batch, ["o_orderkey"]).select("node_stable_id", "commit_sha", "entrypoint_name", F.round("coverage_pct", 4).alias("coverage_pct"))
