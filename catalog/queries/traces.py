"""Trace pairing, frequencies, side effects, timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from strandline.functions import labels, scan
from strandline.operators import traces as tr
from strandline.plans.execution_path import execution_paths

TRACE = ["repo", "entry_id", "trace_id"]

# Stack pairing by window algebra over whole traces.
PAIRS = """
steps as (select repo, entry_id, trace_id, run_no, coalesce(task_id, 0) task, seq, type, fn, timestamp_ms,
    case when type = 'call' then 1 else -1 end step from {t_events} where type in ('call','return','exception')),
sums as (select *, sum(step) over (partition by trace_id, task order by seq rows unbounded preceding) s from steps),
floors as (select *, least(0, coalesce(min(s) over (partition by trace_id, task order by seq rows between unbounded preceding and 1 preceding), 0)) m from sums),
levels as (select *, case when step > 0 then s - m - 1 else s - m end lvl from floors where not (step < 0 and s < m)),
opened as (select *, lag(type) over w ptype, lag(fn) over w pfn, lag(timestamp_ms) over w pts, lag(seq) over w pseq from levels
    window w as (partition by trace_id, task, lvl order by seq)),
pairs as (select repo, entry_id, trace_id, run_no, task, seq, pseq call_seq, pfn fn, cast(lvl as integer) hop, greatest(0.0, timestamp_ms - pts) avg_ms
    from opened where type <> 'call' and ptype = 'call')
"""


@query(
    "wn1_stack_pairing",
    f"with {PAIRS} select trace_id, cast(task as bigint) task, seq, call_seq, fn, hop, round(avg_ms, 6) avg_ms from pairs",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, TRACE)
    return pairs.select("trace_id", "task", "seq", "call_seq", "fn", "hop", F.round("avg_ms", 6).alias("avg_ms"))


@query(
    "wn2_task_pairing",
    f"with {PAIRS} select trace_id, cast(task as bigint) task, count(*) n, cast(max(hop) as integer) deepest, round(sum(avg_ms), 3) total_ms from pairs group by all",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, TRACE)
    return pairs.groupBy("trace_id", "task").agg(
        F.count("*").alias("n"), F.max("hop").alias("deepest"), F.round(F.sum("avg_ms"), 3).alias("total_ms")
    )


@query(
    "jn23_async_link",
    f"""with {PAIRS},
    tasked as (select trace_id from {{t_events}} group by trace_id having count(task_id) > 0),
    links as (select trace_id, coalesce(task_id, 0) task, seq link_pos from {{t_events}} where type = 'async_call' and trace_id in (select trace_id from tasked))
    select trace_id, link_pos, seq, fn, hop, row_number() over (partition by trace_id order by link_pos, seq) pos from (
      select trace_id, cast(-1 as bigint) link_pos, seq, fn, hop from pairs where task = 0
      union all select p.trace_id, l.link_pos, p.seq, p.fn, p.hop from pairs p join links l on p.trace_id = l.trace_id and p.task = l.task) x""",
)
def _(t):
    calls = tr.linked_calls(t.t_events, tr.paired_calls(t.t_events, TRACE), TRACE)
    order = ["link_pos", "seq"]
    placed = scan.numbered(scan.range_chunks(calls.select("trace_id", *order, "fn", "hop"), ["trace_id"], order), ["trace_id"], order, "pos")
    return placed.select("trace_id", "link_pos", "seq", "fn", "hop", F.col("pos").cast("bigint").alias("pos"))


NAMED = """
nsteps as (select repo, entry_id, trace_id, seq, type, fn, file, timestamp_ms, case when type = 'call' then 1 else -1 end step
    from {t_events} where type in ('call','return')),
nsums as (select *, sum(step) over (partition by trace_id, fn order by seq rows unbounded preceding) s from nsteps),
nfloors as (select *, least(0, coalesce(min(s) over (partition by trace_id, fn order by seq rows between unbounded preceding and 1 preceding), 0)) m from nsums),
nlevels as (select *, case when step > 0 then s - m - 1 else s - m end lvl from nfloors where not (step < 0 and s < m)),
nopened as (select *, lag(type) over w ptype, lag(timestamp_ms) over w pts from nlevels window w as (partition by trace_id, fn, lvl order by seq)),
named as (select repo, entry_id, trace_id, seq, fn, file||':'||fn entity_id, timestamp_ms - pts duration_ms from nopened where type = 'return' and ptype = 'call')
"""


@query(
    "wn3_name_matched_pairing",
    f"with {NAMED} select trace_id, seq, fn, entity_id, round(duration_ms, 6) duration_ms from named",
)
def _(t):
    named = tr.name_matched_calls(t.t_events, TRACE)
    return named.select("trace_id", "seq", "fn", "entity_id", F.round("duration_ms", 6).alias("duration_ms"))


EFFECTS = """
esteps as (select repo, entry_id, trace_id, seq, type, fn, case when type = 'call' then 1 else -1 end step from {t_events} where type in ('call','return','exception')),
esums as (select *, sum(step) over (partition by trace_id order by seq rows unbounded preceding) s from esteps),
efloors as (select *, least(0, coalesce(min(s) over (partition by trace_id order by seq rows between unbounded preceding and 1 preceding), 0)) m from esums),
ekinds as (select repo, entry_id, trace_id, seq, fn, cast(s - m - 1 as integer) depth, case
    when fn = 'fetchall' then 'db_read' when fn = 'execute' then 'db_write' when fn in ('redis_set','hset') then 'cache_set'
    when fn = 'cache_get_item' then 'cache_read' when fn in ('_send_request','httpx_request') then 'http_out'
    when fn in ('write_file','Open') then 'fs_write' end kind from efloors where type = 'call'),
effects as (select repo, entry_id, trace_id, kind "type", 'fn:'||fn detail, arg_min(depth, seq) hop_depth, min(seq) seq from ekinds where kind is not null
    group by repo, entry_id, trace_id, kind, fn)
"""


@query("wn4_side_effect_depth", f"with {EFFECTS} select trace_id, type, detail, hop_depth, seq from effects")
def _(t):
    return tr.side_effects(t.t_events, TRACE).select("trace_id", "type", "detail", "hop_depth", "seq")


@query(
    "prj14_side_effect_class",
    """select fn, kind, count(*) n from (select fn, case
    when fn = 'fetchall' then 'db_read' when fn = 'execute' then 'db_write' when fn in ('redis_set','hset') then 'cache_set'
    when fn = 'cache_get_item' then 'cache_read' when fn in ('_send_request','httpx_request') then 'http_out'
    when fn in ('write_file','Open') then 'fs_write' else 'none' end kind from {t_events}) group by fn, kind""",
)
def _(t):
    kind = F.coalesce(labels.side_effect(F.col("fn")), F.lit("none"))
    return t.t_events.groupBy("fn", kind.alias("kind")).agg(F.count("*").alias("n"))


FREQ = """
perrun as (select {keys}, fn, run_no, count(*) n, sum(cast(avg_ms as decimal(28,9))) ms from pairs group by all),
cumul as (select *, sum(n) over w runs, sum(ms) over w total_ms from perrun window w as (partition by {keys}, fn order by run_no rows unbounded preceding)),
tops as (select {keys}, run_no, max(runs) top from cumul group by all),
totals as (select *, coalesce(max(top) over (partition by {keys} order by run_no rows between unbounded preceding and 1 preceding), 0) + 1 total_runs from tops)
"""


@query(
    "wn5_cross_run_frequency",
    f"with {PAIRS}, {FREQ.replace('{keys}', 'repo, entry_id')}"
    """ select p.trace_id, p.task, p.seq, p.fn, cast(c.runs as bigint) runs, cast(t.total_runs as bigint) total_runs,
      round(case when t.total_runs >= 5 then least(1.0, c.runs / cast(t.total_runs as double)) else 1.0 end, 6) frequency_ratio,
      case when t.total_runs >= 5 then cast(c.total_ms as double) / c.runs else p.avg_ms end avg_ms
    from pairs p join cumul c on p.repo = c.repo and p.entry_id = c.entry_id and p.fn = c.fn and p.run_no = c.run_no
      join totals t on p.repo = t.repo and p.entry_id = t.entry_id and p.run_no = t.run_no""",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, [*TRACE, "run_no"])
    out = tr.cross_run_frequencies(pairs, ["repo", "entry_id"], "run_no")
    return out.select(
        "trace_id", "task", "seq", "fn", "runs", "total_runs",
        F.round("frequency_ratio", 6).alias("frequency_ratio"), "avg_ms",
    )


# From the third week on, two thirds of the entries run eight days later, so some gaps exceed seven days.
LATER = "entry_id % 3 <> 0 and run_no >= 2"
EPOCHS = f"""
shifted as (select * replace (case when {LATER} then started + interval 8 days else started end as started) from {{t_traces}}),
gaps as (select *, case when epoch_us(started) - epoch_us(lag(started) over (partition by repo, entry_id order by run_no)) > 604800000000 then 1 else 0 end reset from shifted),
epochs as (select *, cast(sum(reset) over (partition by repo, entry_id order by run_no rows unbounded preceding) as bigint) epoch from gaps)
"""


def shifted(rows, column):
    """The rows with the time of ``column`` moved where ``LATER`` says so."""
    at = F.col(column).cast("timestamp")
    return rows.withColumn(column, F.when(F.expr(LATER), at + F.expr("interval 8 days")).otherwise(at))


def _epochs(t):
    return tr.expiry_epochs(shifted(t.t_traces, "started"), ["repo", "entry_id"], "run_no", "started")


@query("wn6_expiry_epochs", f"with {EPOCHS} select trace_id, run_no, epoch from epochs")
def _(t):
    return _epochs(t).select("trace_id", "run_no", "epoch")


WITH_EXPIRY = (
    f"with {PAIRS.replace('from {t_events} where', 'from {t_events} join epochs using (repo, entry_id, trace_id, run_no) where').replace('steps as', EPOCHS.strip() + ', steps as', 1).replace('run_no, task, seq, pseq', 'run_no, epoch, task, seq, pseq').replace('run_no, coalesce', 'run_no, epoch, coalesce')}, "
    f"{FREQ.replace('{keys}', 'repo, entry_id, epoch')}"
    """ select p.trace_id, {more} p.seq, p.fn, cast(c.runs as bigint) runs, cast(t.total_runs as bigint) total_runs
    from pairs p join cumul c on p.repo = c.repo and p.entry_id = c.entry_id and p.epoch = c.epoch and p.fn = c.fn and p.run_no = c.run_no
      join totals t on p.repo = t.repo and p.entry_id = t.entry_id and p.epoch = t.epoch and p.run_no = t.run_no"""
)


@query("wn6_frequency_with_expiry", WITH_EXPIRY.replace("{more}", "p.task,"))
def _(t):
    epochs = _epochs(t).select(*TRACE, "epoch")
    events = t.t_events.join(epochs, TRACE)
    pairs = tr.paired_calls(events, [*TRACE, "run_no", "epoch"])
    out = tr.cross_run_frequencies(pairs, ["repo", "entry_id", "epoch"], "run_no")
    return out.select("trace_id", "task", "seq", "fn", "runs", "total_runs")


@query(
    "ag6_path_timings",
    f"""with {PAIRS}, pos as (select trace_id, list_sort(list(avg_ms)) v from pairs where avg_ms > 0 group by trace_id)
    select t.trace_id, round(coalesce((v[cast(floor((len(v) - 1) / 2.0) as int) + 1] + v[cast(floor(len(v) / 2.0) as int) + 1]) / 2.0, t.duration_ms), 6) timing_p50_ms,
      round(coalesce(v[least(cast(floor(len(v) * cast(0.99 as double)) as int), len(v) - 1) + 1], t.duration_ms), 6) timing_p99_ms
    from {{t_traces}} t left join pos using (trace_id)""",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, TRACE)
    out = tr.path_timings(pairs, t.t_traces, TRACE)
    return out.select("trace_id", F.round("timing_p50_ms", 6).alias("timing_p50_ms"), F.round("timing_p99_ms", 6).alias("timing_p99_ms"))


RATED = f"""{FREQ.replace('{keys}', 'repo, entry_id')}, rated as (select p.*, case when t.total_runs >= 5 then least(1.0, c.runs / cast(t.total_runs as double)) else 1.0 end ratio,
      case when t.total_runs >= 5 then cast(c.total_ms as double) / c.runs else p.avg_ms end mean_ms
    from pairs p join cumul c on p.repo = c.repo and p.entry_id = c.entry_id and p.fn = c.fn and p.run_no = c.run_no
      join totals t on p.repo = t.repo and p.entry_id = t.entry_id and p.run_no = t.run_no)"""


@query(
    "ag7_path_coverage",
    f"""with {PAIRS}, {RATED}, sh as (select trace_id, avg(case when ratio > 0 then 1.0 else 0.0 end) share from rated group by trace_id)
    select t.trace_id, round(coalesce(case when t.run_no = 1 then 0.5 end, share, -1), 6) coverage_pct from {{t_traces}} t left join sh using (trace_id)""",
)
def _(t):
    calls = tr.cross_run_frequencies(tr.paired_calls(t.t_events, [*TRACE, "run_no"]), ["repo", "entry_id"], "run_no")
    traces = t.t_traces.withColumn("reported", F.when(F.col("run_no") == 1, 0.5))
    out = tr.path_coverage(calls, traces, TRACE, "reported")
    return out.select("trace_id", F.round(F.coalesce("coverage_pct", F.lit(-1.0)), 6).alias("coverage_pct"))


@query("ag8_observed_functions", "select distinct trace_id, fn from {t_events} where type = 'call'")
def _(t):
    return tr.observed_functions(t.t_events, ["trace_id"])


@query(
    "prj12_prune_events",
    """select e.trace_id, e.seq, e.file from {t_events} e where not starts_with(e.file, '/usr/lib/python3')
    and exists (select 1 from {t_events} c where c.repo = e.repo and c.file = e.file and c.type = 'async_call')""",
)
def _(t):
    covered = t.t_events.filter("type = 'async_call'").select("repo", "file").distinct()
    return tr.prune_events(t.t_events, ["/usr/lib/python3"], covered).select("trace_id", "seq", "file")


@query(
    "prj13_argument_retention",
    """select trace_id, seq, fn, case when type = 'call' and (fn like 'test\\_%' escape '\\' or fn like '%\\_view' escape '\\') then args else '-' end args,
    case when type = 'return' and (fn like 'test\\_%' escape '\\' or fn like '%\\_view' escape '\\') then return_val else '-' end return_val from {t_events}""",
)
def _(t):
    kept = tr.retain_arguments(t.t_events)
    return kept.select("trace_id", "seq", "fn", F.coalesce("args", F.lit("-")).alias("args"), F.coalesce("return_val", F.lit("-")).alias("return_val"))


# Nodes for the trace functions: one per (repo, fn, file) seen, named after the function.
FN_NODES = """
fn_nodes as (select repo, fn "name", file file_path, repo||'/'||file||'#'||fn stable_id, fn||'!' qualified_name from
  (select distinct repo, fn, file from {t_events} where fn not in ('hset', 'execute') and not starts_with(file, '/usr')))
"""


def fn_nodes(t):
    seen = t.t_events.filter("fn not in ('hset', 'execute') and not startswith(file, '/usr')").select("repo", "fn", "file").distinct()
    return seen.select(
        "repo", F.col("fn").alias("name"), F.col("file").alias("file_path"),
        F.concat("repo", F.lit("/"), "file", F.lit("#"), "fn").alias("stable_id"),
        F.concat("fn", F.lit("!")).alias("qualified_name"), F.lit(True).alias("active"),
    )


@query(
    "jn24_resolve_functions",
    f"""with {FN_NODES}, near as (select repo, name, file_path, min(stable_id) sid from fn_nodes group by all),
    far as (select repo, name, min(stable_id) sid from fn_nodes group by all)
    select e.trace_id, e.seq, e.fn, coalesce(n.sid, f.sid, e.fn) stable_id, coalesce(n.sid, f.sid) is not null resolved
    from {{t_events}} e left join near n on n.repo = e.repo and n.name = e.fn and n.file_path = e.file left join far f on f.repo = e.repo and f.name = e.fn""",
)
def _(t):
    return tr.resolve_functions_in_files(t.t_events, fn_nodes(t)).select("trace_id", "seq", "fn", "stable_id", "resolved")


# Static edges of an entry: a ring over the functions of its repository, by the order of their ids, three steps long.
STATIC = """
ring as (select repo, stable_id, row_number() over (partition by repo order by stable_id) k, count(*) over (partition by repo) n from fn_nodes),
entries as (select distinct repo, entry_id from {t_traces}),
static as (select cast(e.entry_id as varchar) entry, a.stable_id source, b.stable_id target from entries e join ring a on a.repo = e.repo join ring b on b.repo = a.repo and b.k = a.k % a.n + 1
  where (a.k + e.entry_id) % 7 < 3)
"""


def static_edges(t):
    ring = fn_nodes(t).withColumns({c: F.expr(f"{e} over (partition by repo{o})") for c, e, o in (("k", "row_number()", " order by stable_id"), ("n", "count(*)", ""))})
    ahead = ring.select("repo", F.col("k").alias("next"), F.col("stable_id").alias("target"))
    steps = ring.withColumn("next", F.col("k") % F.col("n") + 1).join(ahead, ["repo", "next"])
    entries = t.t_traces.select("repo", "entry_id").distinct()
    return entries.join(steps, "repo").where("(k + entry_id) % 7 < 3").select(F.col("entry_id").cast("string").alias("entry"), F.col("stable_id").alias("source"), "target")


@query(
    "plan_execution_path",
    f"""with {PAIRS}, {RATED}, {EFFECTS}, {FN_NODES}, {STATIC}, far as (select repo, name, min(stable_id) sid from fn_nodes group by all),
    named_calls as (select r.*, coalesce(f.sid, r.fn) stable_id from rated r left join far f on f.repo = r.repo and f.name = r.fn),
    seen as (select distinct cast(entry_id as varchar) entry, stable_id fn from named_calls),
    mentioned as (select entry, source fn from static union select entry, target from static),
    dynamic as (select entry, count(*) n from seen where (entry, fn) not in (select entry, fn from mentioned) group by entry),
    never as (select entry, count(*) n from (select distinct * from static) where (entry, target) not in (select entry, fn from seen) group by entry),
    pos as (select trace_id, list_sort(list(mean_ms)) v from named_calls where mean_ms > 0 group by trace_id),
    c as (select trace_id, count(*) n, avg(case when ratio > 0 then 1.0 else 0.0 end) share from named_calls group by trace_id), e as (select trace_id, count(*) n from effects group by trace_id)
    select t.trace_id, cast(t.entry_id as varchar) entry, coalesce(c.n, 0) n_calls, coalesce(e.n, 0) n_effects, coalesce(d.n, 0) n_dynamic_only, coalesce(m.n, 0) n_never_observed,
      round(coalesce((v[cast(floor((len(v) - 1) / 2.0) as int) + 1] + v[cast(floor(len(v) / 2.0) as int) + 1]) / 2.0, t.duration_ms), 4) timing_p50_ms,
      round(coalesce(v[least(cast(floor(len(v) * cast(0.99 as double)) as int), len(v) - 1) + 1], t.duration_ms), 4) timing_p99_ms, round(coalesce(c.share, -1), 6) coverage_pct
    from {{t_traces}} t left join c using (trace_id) left join e using (trace_id) left join pos using (trace_id)
      left join dynamic d on d.entry = cast(t.entry_id as varchar) left join never m on m.entry = cast(t.entry_id as varchar)""",
)
def _(t):
    found = execution_paths(t.t_events, t.t_traces, fn_nodes(t), static_edges(t), TRACE, "entry_id", "run_no")
    rounded = [F.round(c, 4).alias(c) for c in ("timing_p50_ms", "timing_p99_ms")]
    coverage = F.round(F.coalesce("coverage_pct", F.lit(-1.0)), 6).alias("coverage_pct")
    return found.paths.select("trace_id", "entry", "n_calls", "n_effects", "n_dynamic_only", "n_never_observed", *rounded, coverage)
