"""Change detection, resolution, and table writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.queries.provenance import now
from catalog.registry import query
from catalog.views import VIEWS
from strandline.functions import ids, text
from strandline.operators import diff as df_
from strandline.operators import embed as em
from strandline.operators import resolve as rs
from strandline.sources import tables as tb

VIEWS["paths"] = """
select p_partkey, 'src/'||p_brand||'/'||replace(p_name, ' ', '_')||cast(p_partkey as string)||case p_size % 6 when 0 then '.py' when 1 then '.go' when 2 then '.ts' when 3 then '.tsx' when 4 then '.md' else '' end path, p_size from {part}
"""
LANG = "case p_size % 6 when 0 then 'python' when 1 then 'go' when 2 then 'typescript' when 3 then 'typescript' end"


@query("prj1_language", f"select path, {LANG} \"language\" from {{paths}} where p_size % 6 < 4")
def _(t):
    return t.paths.select("path", text.language_of(F.col("path")).alias("language")).filter("language is not null")


VIEWS["status_lines"] = """
select p_partkey, path, p_size, case p_size % 5 when 0 then 'A\t' when 1 then 'M\t' when 2 then 'D\t' when 3 then 'R09'||cast(p_size % 10 as string)||'\told/'||path||'\t' else 'T\t' end||path line from {paths}
"""


@query("prj3_name_status", f"select path, case p_size % 5 when 0 then 'added' when 2 then 'deleted' else 'modified' end diff_type, {LANG} \"language\" from {{status_lines}} where p_size % 6 < 4")
def _(t):
    return df_.name_status(t.status_lines.select("line"))


@query("prj4_stable_id", "select c_custkey, 'sha256:'||sha256(c_mktsegment||':'||c_nationkey||':method:'||c_name) stable_id from customer")
def _(t):
    return t.customer.select("c_custkey", ids.stable_id(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("method"), F.col("c_name")).alias("stable_id"))


@query("prj5_node_hash", "select doc_id, sha256(lang||source||text) node_hash from documents")
def _(t):
    return t.documents.select("doc_id", ids.node_hash(F.col("lang"), F.col("source"), F.col("text")).alias("node_hash"))


@query(
    "prj6_embed_text",
    "select doc_id, lang||' '||source||case when n_chars % 3 > 0 then ' doc'||n_chars else '' end||case when text <> '' then ' '||substring(text, 1, 512) else '' end embed_text from documents",
)
def _(t):
    docstring = F.when(F.col("n_chars") % 3 > 0, F.concat(F.lit("doc"), "n_chars")).otherwise("")
    return t.documents.select("doc_id", ids.embed_text(F.col("lang"), F.col("source"), docstring, F.col("text")).alias("embed_text"))


@query("prj7_qualified_name", "select doc_id, case when doc_id % 3 = 0 then lang else source end qualified_name from documents")
def _(t):
    q = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("source"))
    return t.documents.select("doc_id", ids.qualified_or_name(q, F.col("lang")).alias("qualified_name"))


DIFF = """chg as (select coalesce(p.stable_id, c.stable_id) stable_id, coalesce(p.repo, c.repo) repo, coalesce(p.file_path, c.file_path) path,
  case when p.stable_id is null then 'added' when c.stable_id is null then 'deleted' when p.node_hash <> c.node_hash then 'changed' end change
  from {snap_prev} p full join {snap_curr} c on c.stable_id = p.stable_id)"""


@query("jn1_snapshot_diff", f"with {DIFF} select stable_id, change from chg where change is not null")
def _(t):
    return df_.snapshot_diff(t.snap_prev, t.snap_curr)


@query("set1_change_counts", f"with {DIFF} select repo, change, count(*) n from chg where change is not null group by all")
def _(t):
    return df_.snapshot_diff(t.snap_prev, t.snap_curr, ("repo", "stable_id")).groupBy("repo", "change").agg(F.count("*").alias("n"))


# Every file of the two snapshots is listed, with a kind by its number.
VIEWS["changed_files"] = """
select distinct lang repo, 'f'||cast(cast(floor(doc_id / 5) as int) as string)||'.py' path, case cast(floor(doc_id / 5) as int) % 4 when 0 then 'modified' when 1 then 'added' when 2 then 'deleted' else 'full_rescan' end diff_type, 'python' language from {documents}
"""
FILE_CHANGES = f"""{DIFF}, fc as (
  select f.repo, f.path, f.diff_type, c.stable_id, 'added' change from {{changed_files}} f join {{snap_curr}} c on c.repo = f.repo and c.file_path = f.path where diff_type in ('added','full_rescan')
  union all select f.repo, f.path, f.diff_type, c.stable_id, 'deleted' from {{changed_files}} f join {{snap_prev}} c on c.repo = f.repo and c.file_path = f.path where diff_type = 'deleted'
  union all select f.repo, f.path, f.diff_type, c.stable_id, c.change from {{changed_files}} f join chg c on c.repo = f.repo and c.path = f.path where diff_type = 'modified' and c.change is not null)"""


def _changes(t):
    return df_.file_changes(t.changed_files, t.snap_prev, t.snap_curr)


@query("set3_file_changes", f"with {FILE_CHANGES} select * from fc")
def _(t):
    return _changes(t)


@query("set2_emit_ids", f"with {FILE_CHANGES} select distinct repo, path, stable_id from fc where change in ('changed','added')")
def _(t):
    return df_.emit_ids(_changes(t))


@query(
    "prj9_file_events",
    f"""with {FILE_CHANGES}, l as (select repo, path, string_agg(stable_id, ',' order by stable_id) filter (where change = 'changed') c, string_agg(stable_id, ',' order by stable_id) filter (where change = 'added') a,
      string_agg(stable_id, ',' order by stable_id) filter (where change = 'deleted') d from fc group by all)
    select f.repo, f.path, f.diff_type, f.language "language", 'h1' commit_sha, coalesce(c, '') changed_nodes, coalesce(a, '') added_nodes, coalesce(d, '') deleted_nodes from {{changed_files}} f left join l on l.repo = f.repo and l.path = f.path""",
)
def _(t):
    events = df_.file_events(t.changed_files, _changes(t), "h1")
    return events.withColumns({c: F.array_join(c, ",") for c in ("changed_nodes", "added_nodes", "deleted_nodes")})


# Edges between neighbouring documents of a file.
VIEWS["doc_edges"] = "select a.repo, a.file_path path, a.stable_id source, b.stable_id target from {snap_curr} a join {snap_curr} b on a.file_path = b.file_path and a.repo = b.repo and a.stable_id <> b.stable_id"
KEPT = f"""{FILE_CHANGES}, emitted as (select distinct repo, path, stable_id from fc where change in ('changed','added')),
kept as (select n.repo, n.file_path path, n.stable_id from {{snap_curr}} n join {{changed_files}} f on f.repo = n.repo and f.path = n.file_path where diff_type in ('added','full_rescan') or (diff_type = 'modified' and (n.repo, n.file_path, n.stable_id) in (select * from emitted)))"""


def _filtered(t):
    nodes = t.snap_curr.withColumnRenamed("file_path", "path").select("repo", "path", "stable_id")
    return df_.apply_diff_filter(nodes, t.doc_edges, t.changed_files, _changes(t))


@query("prj8_diff_filter_nodes", f"with {KEPT} select * from kept")
def _(t):
    return _filtered(t)[0]


@query("prj8_diff_filter_edges", f"with {KEPT} select e.* from {{doc_edges}} e join kept k on k.repo = e.repo and k.path = e.path and k.stable_id = e.source")
def _(t):
    return _filtered(t)[1]


@query("jn5_unchanged_skip", "select c.stable_id, c.node_hash from {snap_curr} c where not exists (select 1 from {snap_prev} p where p.stable_id = c.stable_id and p.node_hash = c.node_hash)")
def _(t):
    return df_.unchanged_skip(t.snap_curr, t.snap_prev).select("stable_id", "node_hash")


VIEWS["embedded"] = "select 'h'||cast(label % 2 as string) commit_sha, 'f'||cast(cast(floor(vec_id / 5) as int) as string)||'.py' file_path, 'd'||cast(vec_id as string) stable_id, embedding vector, 'text '||cast(vec_id as string) embed_text from {embeddings}"


@query("jn4_parsed_embedded_merge", "select n.stable_id, n.file_path, n.node_hash, e.embed_text, len(e.vector) width from {snap_curr} n join {embedded} e on e.commit_sha = 'h0' and e.file_path = n.file_path and e.stable_id = n.stable_id")
def _(t):
    parsed = t.snap_curr.withColumn("commit_sha", F.lit("h0"))
    return df_.merge_embedded(parsed, t.embedded).select("stable_id", "file_path", "node_hash", "embed_text", F.size("vector").cast("bigint").alias("width"))


@query("jn3_edge_endpoints", "select source, target from {doc_edges} where source in (select stable_id from {snap_prev}) and target in (select stable_id from {snap_prev})")
def _(t):
    return rs.existing_ends(t.doc_edges, t.snap_prev).select("source", "target")


# Call references: line items call part names inside the file of their order.
VIEWS["call_nodes"] = """
select 'repo'||cast(l_suppkey % 3 as string) repo, 'f'||cast(l_orderkey % 500 as string) file_path, 'n'||cast(l_partkey % 40 as string) name, 'K.n'||cast(l_partkey % 90 as string) qualified_name,
  cast(l_orderkey as string)||'/'||cast(l_linenumber as string)||'/'||cast(l_partkey as string) stable_id, l_orderkey * 1000 + l_linenumber pos from {lineitem}
"""
VIEWS["call_refs"] = """
select 'repo'||cast(l_suppkey % 3 as string) repo, 'f'||cast(l_orderkey % 500 as string) file_path, cast(l_orderkey as string)||'/'||cast(l_linenumber as string)||'/'||cast(l_partkey as string) source,
  case when l_linenumber % 2 = 0 then 'n'||cast(l_partkey % 37 as string) else 'K.n'||cast(l_partkey % 83 as string) end called_name from {lineitem}
"""


@query(
    "jn2_call_resolution",
    """with m as (select repo, file_path, nm, arg_max(stable_id, (pos, stable_id)) target from (select repo, file_path, name nm, stable_id, pos from {call_nodes} union all select repo, file_path, qualified_name, stable_id, pos from {call_nodes}) group by all)
    select distinct c.repo, c.file_path, c.source, m.target from {call_refs} c join m on m.repo = c.repo and m.file_path = c.file_path and m.nm = c.called_name where c.source <> m.target""",
)
def _(t):
    return rs.resolve_calls(t.call_refs, t.call_nodes)


@query("ag22_distinct_edges", "select distinct repo, file_path, called_name from {call_refs}")
def _(t):
    return rs.distinct_references(t.call_refs)


# Import statements: every order is an import node, customers and parts are their targets.
VIEWS["imports"] = """
select 'i:'||cast(o_orderkey as string) stable_id, 'repo0' repo, 'src/pkg'||cast(o_custkey % 50 as string)||'/d'||cast(o_orderkey % 3 as string)||'/m.py' file_path, o_orderkey, o_custkey,
  case o_orderkey % 6 when 0 then 'import mod'||cast(o_custkey as string) when 1 then 'from src.pkg'||cast(o_custkey % 50 as string)||' import Sym'||cast(o_custkey as string)
    when 2 then 'from . import Sym'||cast(o_custkey as string)||' as s' when 3 then 'from ..low import (\n  Sym'||cast(o_custkey as string)||',\n  Fn'||cast(o_custkey % 97 as string)||' as f,\n)'
    when 4 then 'import mod1.x as y,  mod'||cast(o_custkey as string) else 'from  ...  import  Fn'||cast(o_custkey % 97 as string)||' , Other' end body from {orders}
"""
VIEWS["import_nodes"] = """
select 'c:'||cast(c_custkey as string) stable_id, 'repo0' repo, 'Sym'||cast(c_custkey as string) name, case c_custkey % 3 when 0 then '' else 'K.' end||'Sym'||cast(c_custkey as string) qualified_name,
  'src/pkg'||cast(c_custkey % 50 as string)||'/d'||cast(c_custkey % 3 as string)||'/t.py' file_path, c_acctbal > 0 active from {customer}
union all select 'p:'||cast(p_partkey as string), 'repo0', 'Fn'||cast(p_partkey % 97 as string), 'P.Fn'||cast(p_partkey % 97 as string), 'src/pkg'||cast(p_partkey % 50 as string)||'/d'||cast(p_partkey % 3 as string)||'/t.py', p_size > 5 from {part}
union all select 'i:'||cast(o_orderkey as string), 'repo0', 'import', 'import', 'src/x.py', true from {orders} where o_orderstatus <> 'P'
"""
EXPECTED = """case o_orderkey % 6 when 0 then 'mod'||o_custkey when 1 then 'Sym'||o_custkey when 2 then 'Sym'||o_custkey when 3 then 'Sym'||o_custkey||',Fn'||(o_custkey % 97) when 4 then 'mod1.x,mod'||o_custkey else 'Fn'||(o_custkey % 97)||',Other' end"""
KIND = "case when o_orderkey % 6 in (0, 4) then 'plain' else 'from' end"
HINT = """case o_orderkey % 6 when 1 then 'src/pkg'||(o_custkey % 50) when 2 then 'src/pkg'||(o_custkey % 50)||'/d'||(o_orderkey % 3)||'/' when 3 then 'src/pkg'||(o_custkey % 50)||'/' when 5 then 'src/' else '' end"""


@query(
    "prj26_parse_import",
    f"select stable_id, {KIND} kind, case o_orderkey % 6 when 1 then 'src.pkg'||(o_custkey % 50) when 3 then 'low' else '' end module, case o_orderkey % 6 when 2 then 1 when 3 then 2 when 5 then 3 else 0 end dots, {EXPECTED} \"names\" from {{imports}}",
)
def _(t):
    rows = t.imports.select("stable_id", rs.parse_import(F.col("body")).alias("i")).select("stable_id", "i.*")
    return rows.withColumn("names", F.array_join("names", ","))


@query("prj25_path_hint", f"select stable_id, unnest(string_split({EXPECTED}, ',')) target_name, {HINT} path_hint from {{imports}} where o_orderkey % 6 not in (0, 4)")
def _(t):
    return rs.import_targets(t.imports).filter("kind = 'from'").select(F.col("source").alias("stable_id"), "target_name", "path_hint")


RESOLVED = f"""refs as (select stable_id source, repo, unnest(string_split({EXPECTED}, ',')) target_name, {HINT} path_hint from {{imports}} where o_orderkey % 6 not in (0, 4)),
q as (select repo, qualified_name, min(stable_id) sid from {{import_nodes}} where active group by all),
ex as (select r.*, q.sid from refs r left join q on q.repo = r.repo and q.qualified_name = r.target_name),
near as (select r.source, r.target_name, r.path_hint, min(n.stable_id) sid from refs r join {{import_nodes}} n on n.repo = r.repo and n.name = r.target_name and n.active and contains(n.file_path, r.path_hint) where r.path_hint <> '' group by all),
allr as (select ex.source, ex.repo, ex.target_name, ex.path_hint, coalesce(ex.sid, near.sid) sid, ex.sid is not null exact, ex.source in (select stable_id from {{import_nodes}}) known
  from ex left join near on near.source = ex.source and near.target_name = ex.target_name and near.path_hint = ex.path_hint)"""


def _refs(t):
    return rs.import_targets(t.imports).filter("kind = 'from'").drop("kind")


@query("jn6_import_by_qualified_name", f"with {RESOLVED} select source, target_name, coalesce(sid, '') target from (select source, target_name, sid from ex)")
def _(t):
    return rs.by_qualified_name(_refs(t), t.import_nodes).select("source", "target_name", F.coalesce("target", F.lit("")).alias("target"))


@query("jn7_import_by_path", f"with {RESOLVED} select r.source, r.target_name, coalesce(n.sid, '') target from refs r left join near n on n.source = r.source and n.target_name = r.target_name and n.path_hint = r.path_hint")
def _(t):
    return rs.by_name_and_path(_refs(t), t.import_nodes).select("source", "target_name", F.coalesce("target", F.lit("")).alias("target"))


@query("jn8_import_edges", f"with {RESOLVED} select distinct source, sid target, 'IMPORTS' \"type\", 'static' provenance from allr where sid is not null and known")
def _(t):
    return rs.resolve_imports(_refs(t), t.import_nodes)[0]


@query("jn8_unresolved_imports", f"with {RESOLVED} select source, repo, target_name, path_hint from allr where sid is null or not known")
def _(t):
    return rs.resolve_imports(_refs(t), t.import_nodes)[1]


@query("jn9_package_edges", f"select distinct stable_id source, repo, unnest(string_split({EXPECTED}, ',')) package from {{imports}} where o_orderkey % 6 in (0, 4) and o_orderstatus_known".replace("o_orderstatus_known", "stable_id in (select stable_id from {import_nodes})"))
def _(t):
    refs = rs.import_targets(t.imports).filter("kind = 'plain'")
    return rs.package_edges(refs, t.import_nodes)[1].select("source", "repo", "package")


# Pending references of every unresolved import; attempts and age by order.
VIEWS["pending"] = f"select stable_id source_stable_id, 'Fn'||cast(o_custkey % 120 as string) target_name, 'src/pkg'||cast(o_custkey % 50 as string)||'/' path_hint, 'IMPORTS' edge_type, 'repo'||cast(o_custkey % 2 as string) repo, case when o_orderkey % 4 = 0 then timestamp '1999-12-30' else timestamp '1999-12-31 12:00:00' end attempted_at, cast(o_orderkey % 8 as int) attempt_count from {{imports}}"
PENDING = """due as (select * from {pending} where repo = 'repo0' and attempt_count <= 5 and attempted_at >= timestamp '1999-12-31'),
got as (select d.source_stable_id, d.target_name, d.path_hint, min(n.stable_id) sid from due d join {import_nodes} n on n.repo = d.repo and n.active and n.name = d.target_name and contains(n.file_path, d.path_hint) group by all),
res as (select d.*, g.sid, d.source_stable_id in (select stable_id from {import_nodes}) known from due d left join got g on g.source_stable_id = d.source_stable_id and g.target_name = d.target_name and g.path_hint = d.path_hint)"""


@query(
    "wn13_pending_retry",
    f"with {PENDING} select source_stable_id, target_name, repo, attempt_count from {{pending}} where repo <> 'repo0' union all select source_stable_id, target_name, repo, attempt_count + 1 from res where sid is null or not known",
)
def _(t):
    repos = t.import_nodes.select("repo").distinct()
    return rs.retry_pending(t.pending, t.import_nodes, repos, now())[1].select("source_stable_id", "target_name", "repo", "attempt_count")


@query("wn13_pending_resolved", f"with {PENDING} select distinct source_stable_id source, sid target from res where sid is not null and known")
def _(t):
    repos = t.import_nodes.select("repo").distinct()
    return rs.retry_pending(t.pending, t.import_nodes, repos, now())[0].select("source", "target")


# Node and edge tables before and after a batch.
VIEWS["stored_nodes"] = "select stable_id, 'old' name, file_path, repo, node_hash, doc_no % 3 <> 0 active, doc_no observed_calls, timestamp '1999-01-01' updated_at, cast(null as timestamp) deleted_at from (select *, cast(substring(stable_id, 2) as int) doc_no from {snap_prev}) s"
NODE_OUT = "coalesce(observed_calls, -1) observed_calls, cast(epoch(updated_at) as bigint) updated_s from "


@query(
    "snk1_node_upsert",
    f"select stable_id, \"name\", file_path, repo, node_hash, active, {NODE_OUT} (select coalesce(c.stable_id, p.stable_id) stable_id, case when c.stable_id is null then 'old' else 'new' end \"name\", coalesce(c.file_path, p.file_path) file_path, coalesce(c.repo, p.repo) repo, coalesce(c.node_hash, p.node_hash) node_hash, c.stable_id is not null or p.active active, p.observed_calls, case when c.stable_id is null then p.updated_at else timestamp '2000-01-01' end updated_at from {{stored_nodes}} p full join {{snap_curr}} c on c.stable_id = p.stable_id)",
)
def _(t):
    batch = t.snap_curr.withColumn("name", F.lit("new"))
    out = tb.upsert_nodes(t.stored_nodes.withColumn("updated_at", F.col("updated_at").cast("timestamp")), batch, now().cast("timestamp"))
    return out.select("stable_id", "name", "file_path", "repo", "node_hash", "active", F.coalesce("observed_calls", F.lit(-1)).alias("observed_calls"), F.unix_timestamp("updated_at").alias("updated_s"))


VIEWS["stored_edges"] = "select source, target, 'CALLS' type, case when length(source) > 3 then 'conflict' else 'confirmed' end provenance, timestamp '1999-01-01' updated_at from {doc_edges} where source < target"


@query(
    "snk2_edge_upsert",
    """with b as (select distinct source, target from {doc_edges} where source > 'd4' and source in (select stable_id from {snap_prev}) and target in (select stable_id from {snap_prev}))
    select coalesce(e.source, b.source) source, coalesce(e.target, b.target) target, 'CALLS' "type", case when b.source is not null then 'static' else e.provenance end provenance,
      cast(epoch(case when b.source is not null then timestamp '2000-01-01' else e.updated_at end) as bigint) updated_s from {stored_edges} e full join b on b.source = e.source and b.target = e.target""",
)
def _(t):
    stored = t.stored_edges.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    out = tb.upsert_edges(stored, t.doc_edges.filter("source > 'd4'"), t.snap_prev, now().cast("timestamp"))
    return out.select("source", "target", "type", "provenance", F.unix_timestamp("updated_at").alias("updated_s"))


GONE = "gone as (select p.stable_id from {snap_prev} p where p.stable_id not in (select stable_id from {snap_curr}))"


@query("snk3_tombstone_nodes", f"with {GONE} select stable_id, active and stable_id not in (select * from gone) active, stable_id in (select * from gone) deleted from {{stored_nodes}}")
def _(t):
    gone = df_.snapshot_diff(t.snap_prev, t.snap_curr).filter("change = 'deleted'")
    nodes, _ = tb.tombstone(t.stored_nodes, t.stored_edges, gone, now().cast("timestamp"))
    return nodes.select("stable_id", "active", F.col("deleted_at").isNotNull().alias("deleted"))


@query("snk3_tombstone_edges", "with gone as (select stable_id from {stored_nodes} where observed_calls % 4 = 1) select source, target from {stored_edges} where source not in (select * from gone) and target not in (select * from gone)")
def _(t):
    _, edges = tb.tombstone(t.stored_nodes, t.stored_edges, t.stored_nodes.filter("observed_calls % 4 = 1"), now().cast("timestamp"))
    return edges.select("source", "target")


VIEWS["stored_vectors"] = "select 'd'||cast(vec_id + 100 as string) stable_id, 'old'||cast(vec_id as string) label_text, cast(label as double) first_value from {embeddings}"


@query("snk4_vector_upsert", "with b as (select stable_id, embed_text, round(cast(vector[1] as double), 6) v from {embedded}), g as (select stable_id from {snap_prev} where stable_id not in (select stable_id from {snap_curr})) select * from (select coalesce(b.stable_id, s.stable_id) stable_id, coalesce(b.embed_text, s.label_text) label_text, case when b.stable_id is null then s.first_value else b.v end first_value from {stored_vectors} s full join b on b.stable_id = s.stable_id) where stable_id not in (select * from g)")
def _(t):
    batch = t.embedded.select("stable_id", F.col("embed_text").alias("label_text"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_value"))
    gone = df_.snapshot_diff(t.snap_prev, t.snap_curr).filter("change = 'deleted'")
    return tb.delete_vectors(tb.upsert_vectors(t.stored_vectors, batch), gone)


@query("snk7_metric_append", "select metric_type, entity_id, repo, count(*) n, round(sum(\"value\"), 4) total from {metrics} group by all")
def _(t):
    rows = t.metrics.select("metric_type", "metric_name", "entity_id", "repo", "value", "unit", "commit_sha", "recorded_at")
    back = tb.written_back(rows, "metrics", tb.append_metrics)
    return back.groupBy("metric_type", "entity_id", "repo").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("snk10_job_sink", "select repo, case when file_path like '%.go' then 'go' else 'python' end \"language\", stable_id from {d_nodes}")
def _(t):
    jobs = t.d_nodes.select("stable_id", "name", "file_path", F.lit(1).alias("priority"), "repo", text.job_language(F.col("file_path")).alias("language"))
    return tb.written_back(jobs, "jobs", tb.write_jobs).select("repo", "language", "stable_id")


@query("src8_table_scan", "select stable_id, \"name\", type from {g_nodes} where repo = 'repo0' and active")
def _(t):
    return tb.scan(t.g_nodes, ["stable_id", "name", "type"], "repo0")


@query("prj27_scope_filter", "select stable_id, node_hash from {snap_curr} where repo = 'en' and file_path = 'f3.py'")
def _(t):
    return tb.scan(t.snap_curr, ["stable_id", "node_hash"], "en", scope="f3.py")


@query("ud1_embedding", "select doc_id, 64 width, true unit from documents")
def _(t):
    rows = em.check_dimension(em.embed_by_hashing(t.documents.select("doc_id", F.concat(F.lit("x "), "text").alias("embed_text")), 64), 64)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("doc_id", F.size("vector").alias("width"), (F.abs(norm - 1) < 1e-4).alias("unit"))


@query("ud1_custom_embedding", "select doc_id, cast(length(text) as double) len, cast(length(source) as double) src from documents")
def _(t):
    provider = lambda texts: [[float(len(x.split("\x02")[1])), float(len(x.split("\x02")[0]))] for x in texts]
    rows = t.documents.select("doc_id", F.concat_ws("\x02", "source", "text").alias("embed_text"))
    out = em.embed(rows, provider, dim=2)
    return out.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("len"), F.get("vector", F.lit(1)).cast("double").alias("src"))


@query("st17_high_water_marks", "with newest as (select 'repo'||(user_id % 40) repo, arg_max('s'||event_id, event_id) sha from events group by 1), marks as (select 'repo'||(user_id % 50) repo, arg_max('s'||event_id, event_id) last_sha from events where user_id % 50 <> 7 group by 1) select n.repo, coalesce(m.last_sha, '') prev_sha, n.sha current_sha, m.repo is null full_rescan from newest n left join marks m on m.repo = n.repo where m.last_sha is null or m.last_sha <> n.sha")
def _(t):
    sha = F.concat(F.lit("s"), "event_id")
    commits = t.events.select(F.concat(F.lit("repo"), F.col("user_id") % 40).alias("repo"), F.col("event_id").alias("seq"), sha.alias("sha"))
    marks = t.events.filter("user_id % 50 <> 7").groupBy(F.concat(F.lit("repo"), F.col("user_id") % 50).alias("repo")).agg(F.max_by(sha, "event_id").alias("last_sha"))
    work, _ = df_.advance_marks(marks, commits)
    return work.withColumn("prev_sha", F.coalesce("prev_sha", F.lit("")))
