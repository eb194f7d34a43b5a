"""Typed ingest: events, dead letters, wire lines, coverage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.queries.search import KEYWORDS
from catalog.registry import query
from catalog.views import VIEWS
from strandline.sources import events as ev
from strandline.sources import wire

# Every order is a message: most good, some not JSON, some without a field, some of an unknown kind.
VIEWS["messages"] = """
select o_orderkey, case o_orderkey % 10 when 7 then '{"entrypoint_stable_id": oops '||cast(o_orderkey as string)
  when 8 then '{"entrypoint_stable_id":"c:'||cast(o_custkey as string)||'","commit_sha":"h","repo":"repo0","events":[]}'
  else '{"entrypoint_stable_id":"c:'||cast(o_custkey as string)||'","commit_sha":"h'||o_orderstatus||'","repo":"repo0","duration_ms":'||cast(o_orderkey % 1000 as string)||'.5,"extra":1,"events":[{"type":"call","fn":"f'||cast(o_orderkey % 7 as string)||'","file":"a.py","line":1,"timestamp_ms":1.5},{"type":"'||case when o_orderkey % 10 = 9 then 'jump' else 'return' end||'","fn":"f'||cast(o_orderkey % 7 as string)||'","file":"a.py","line":2,"timestamp_ms":'||cast(o_orderkey % 50 as string)||'.25,"return_val":"x"}]}' end event from {orders}
"""


@query("src1_read_events", "select o_orderkey, 'c:'||o_custkey entrypoint_stable_id, 'h'||o_orderstatus commit_sha, o_orderkey % 1000 + 0.5 duration_ms from orders where o_orderkey % 10 not in (7, 8, 9)".replace("+ 0.5 duration", "+ cast(0.5 as double) duration"))
def _(t):
    return ev.read_events(t.messages, "raw_trace").select("o_orderkey", "entrypoint_stable_id", "commit_sha", "duration_ms")


@query("src2_dead_letters", "select cast(o_orderkey as varchar) msg_id, case o_orderkey % 10 when 7 then 'malformed json' when 8 then 'missing duration_ms' else 'invalid events.type' end error from orders where o_orderkey % 10 in (7, 8, 9)")
def _(t):
    return ev.split_dlq(t.messages, "raw_trace", message_id="o_orderkey")[1].select("msg_id", "error")


@query(
    "src3_explode_events",
    "select o_orderkey, p seq, case p when 0 then 'call' else 'return' end type, 'f'||(o_orderkey % 7) fn, case p when 0 then 1.5e0 else o_orderkey % 50 + 0.25e0 end timestamp_ms from orders, (values (0), (1)) v(p) where o_orderkey % 10 not in (7, 8, 9)",
)
def _(t):
    good = ev.read_events(t.messages, "raw_trace")
    return ev.explode_events(good, ["o_orderkey"]).select("o_orderkey", "seq", "type", "fn", "timestamp_ms")


# One JSON document per part: a file with two nodes, an edge and a deleted id.
VIEWS["parsed_files"] = """
select p_partkey, '{"file_path":"f'||cast(p_partkey as string)||'.py","language":"python","repo":"r","commit_sha":"h","nodes":[{"stable_id":"a'||cast(p_partkey as string)||'","name":"n1"},{"stable_id":"b'||cast(p_partkey as string)||'","name":"n2"}],'
  ||'"intra_file_edges":[{"source_stable_id":"a'||cast(p_partkey as string)||'","target_stable_id":"b'||cast(p_partkey as string)||'"}],"deleted_nodes":["d'||cast(p_size as string)||'"]}' event from {part}
"""


@query("src3_explode_nodes", "select 'f'||p_partkey||'.py' file_path, x.pos pos, x.pre||p_partkey stable_id from part, (values (0, 'a'), (1, 'b')) x(pos, pre)")
def _(t):
    return ev.explode_nodes(ev.read_events(t.parsed_files, "parsed_file")).select("file_path", "pos", "stable_id")


@query("src3_explode_edges", "select 'f'||p_partkey||'.py' file_path, 'a'||p_partkey source, 'b'||p_partkey target, 'CALLS' type, 'd'||p_size deleted from part")
def _(t):
    files = ev.read_events(t.parsed_files, "parsed_file")
    edges = ev.explode_edges(files).select("file_path", "source", "target", "type")
    return edges.join(ev.explode_deleted(files).select("file_path", F.col("stable_id").alias("deleted")), "file_path")


# Wire lines of every trace event, some broken.
VIEWS["wire_lines"] = """
select entry_id, seq, case when seq % 13 = 5 then '{"t":"call","f":' when seq % 13 = 6 then '{"t":"call","f":"x","ts":"late"}' else
  '{"t":"'||case type when 'return' then 'ret' when 'exception' then 'panic' else type end||'","f":"'||fn||'","file":"'||file||'","l":'||cast(line as string)||',"ts":'||cast(seq % 977 as string)||'.5,"g":'||cast(seq % 3 as string)||',"s":1}' end line from {t_events}
"""
GOOD = "seq % 13 not in (5, 6)"


@query("src4_wire_traces", f"select entry_id, seq, type, fn, file, line, seq % 977 + 0.5e0 timestamp_ms, seq % 3 goroutine_id from {{t_events}} where {GOOD}")
def _(t):
    return wire.read_wire_traces(t.wire_lines, ["entry_id", "seq"]).select("entry_id", "seq", "type", "fn", "file", "line", "timestamp_ms", "goroutine_id")


@query("src4_session_durations", f"select entry_id, max(seq % 977 + 0.5e0) duration_ms from {{t_events}} where {GOOD} group by entry_id")
def _(t):
    return wire.session_durations(wire.read_wire_traces(t.wire_lines, ["entry_id", "seq"]), ["entry_id"])


@query("src5_fan_out", "select 'o:'||o_orderkey stable_id, e.entry_id, e.seq, e.fn from {t_events} e join orders on o_custkey = e.entry_id")
def _(t):
    entrypoints = t.orders.select(F.col("o_custkey").alias("entry_id"), F.concat(F.lit("o:"), "o_orderkey").alias("stable_id"))
    return wire.fan_out(t.t_events, entrypoints, "entry_id").select("stable_id", "entry_id", "seq", "fn")


VIEWS["coverage_reports"] = """
select o_orderkey, '{"meta":{"v":1},"files":{"a'||cast(o_orderkey as string)||'.py":{"executed_lines":['||case when o_orderkey % 3 = 0 then '' else '1,2' end||'],"missing":[3]},"b'||cast(o_custkey as string)||'.py":{"executed_lines":[7]}},"totals":{"percent_covered":'||cast(o_orderkey % 100 as string)||'.25}}' report from {orders}
"""


@query("src6_coverage_files", "select o_orderkey, 'b'||o_custkey||'.py' file, o_orderkey % 100 + 0.25e0 percent_covered from orders union all select o_orderkey, 'a'||o_orderkey||'.py', o_orderkey % 100 + 0.25e0 from orders where o_orderkey % 3 <> 0")
def _(t):
    return wire.coverage_files(t.coverage_reports, ["o_orderkey"])


VIEWS["coverage_lines"] = """
select p_partkey, case p_size % 6 when 0 then 'total:\t\t(statements)\t80.0%' when 1 then 'short line' else 'example.org/m/f'||cast(p_partkey as string)||'.go:'||cast(p_size as string)||':\t\tFn'||cast(p_size as string)||'\t\t'||case p_size % 4 when 0 then '0.0%' else cast(p_size as string)||'.5%' end end line from {part}
"""


@query("src7_coverage_functions", "select p_partkey, 'example.org/m/f'||p_partkey||'.go:Fn'||p_size \"function\", p_size % 4 <> 0 covered from part where p_size % 6 > 1")
def _(t):
    return wire.coverage_functions(t.coverage_lines, ["p_partkey"])


VIEWS["intents"] = """
select item_id, text, case item_id % 4 when 0 then '{"keywords":["k'||cast(item_id as string)||'"],"symbols":["S"],"query_type":"lookup","embed_query":"e"}' when 1 then '{"keywords":["k"],"symbols":[],"query_type":"why","embed_query":"e"}'
  when 2 then 'no json at all' else '{"keywords":["a","b"],"symbols":[],"query_type":"impact","embed_query":"e","scope":"src/x.py"}' end answer from {benchmark}
union all select 100000 + conv_id * 100 + turn, text, '{"keywords":["c'||cast(turn as string)||'"],"symbols":[],"query_type":"'||case when role = 'user' then 'flow' else role end||'","embed_query":"q"}' from {conversations}
"""


@query(
    "prj23_intent_validation",
    """with c as (select *, case when item_id < 100000 then case item_id % 4 when 0 then 'k'||item_id when 3 then 'a b' end when contains(answer, '"flow"') then 'c'||((item_id - 100000) % 100) end good,
      case when item_id < 100000 then case item_id % 4 when 0 then 'lookup' when 3 then 'impact' end when contains(answer, '"flow"') then 'flow' end kind from {intents})
    select item_id, coalesce(kind, 'flow') query_type, coalesce(good, array_to_string(KW, ' ')) keywords, kind is not null valid from c""".replace("KW", KEYWORDS.replace("question", "text")),
)
def _(t):
    from strandline.plans.intents import intents

    out = intents(t.intents, "text", "answer")
    return out.select("item_id", "query_type", F.array_join("keywords", " ").alias("keywords"), "valid")
