"""Structured Streaming over the events table, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.queries.index import RESOLVED
from catalog.queries.metrics import LAGS, MESSAGES
from catalog.queries.provenance import now
from catalog.queries.traces import EFFECTS, PAIRS, TRACE, WITH_EXPIRY, shifted
from catalog.registry import query
from catalog.views import VIEWS
from strandline.session import run_folder
from strandline.sources.tables import ChangeLog, Snapshots
from strandline.streaming import consume as cs
from strandline.streaming import maintain as mn
from strandline.streaming import windows as wn


# Which batch a row arrives in: events week by week, others dealt out by key.
BATCHES = {"events": "cast(floor((day(ts) - 1) / 7) as int)", "orders": "cast(o_orderkey % 4 as int)", "documents": "cast(doc_id % 4 as int)"}


# Rows of a stream's file, about, where its smallest batch has as many.
FILE_ROWS = 20_000


def stream(t, table: str, by: str | None = None):
    """The whole given table as a stream of one micro-batch per value of ``by`` (else ``BATCHES``).

    All batches have the same number of files, by the rows of the smallest, and a trigger takes that many; files are
    written and read by as many tasks.
    """
    rows, by = getattr(t, table), by or BATCHES[table]
    path = run_folder(t.spark, f"stream-{table}")
    sizes = {r[0]: r[1] for r in rows.selectExpr(f"{by} n").groupBy("n").count().orderBy("n").collect()}
    files = max(1, min(sizes.values(), default=0) // FILE_ROWS)
    for n in sizes:
        batch = rows.filter(f"{by} = {n}")
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
    if files > 1 and len(t.spark.read.schema(rows.schema).parquet(path).inputFiles()) != files * len(sizes):
        raise RuntimeError(f"a batch of {table} has not {files} files")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def over(t, view: str, source: str, rows):
    """The view over rows of a stream or micro-batch instead of its table."""
    return t.sql(VIEWS[view], **{source: rows})


# Windows close when the watermark (latest event minus ten minutes) passes their end.
@query(
    "st9_sliding_throughput",
    """with a as (select event_type, cast(floor(epoch_us(ts) / 5000000.0) as bigint) * 5 last_start from events), s as (select event_type, last_start - 5 * j w from a, generate_series(0, 11) g(j)),
    mark as (select floor(epoch_us(max(ts)) / 1000.0) - 600000 ms from events)
    select event_type entity_id, w + 60 window_end_s, round(count(*) / 60.0e0, 6) "value" from s, mark where (w + 60) * 1000 <= ms group by all""",
)
def _(t):
    out = cs.to_table(wn.sliding_rates(stream(t, "events"), "event_type", "ts"), "rates")
    return out.select("entity_id", F.unix_timestamp("window_end").alias("window_end_s"), F.round("value", 6).alias("value"))


@query(
    "st16_idle_sessions",
    """with g as (select user_id, ts, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) >= 86400000000 then 1 else 0 end fresh from events window w as (partition by user_id order by ts)),
    n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from g), mark as (select floor(epoch_us(max(ts)) / 1000.0) - 86400000 ms from events)
    select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 86400000000 end_us, count(*) events from n, mark group by user_id, s, ms having floor((epoch_us(max(ts)) + 86400000000) / 1000.0) <= ms""",
)
def _(t):
    out = cs.to_table(wn.idle_sessions(stream(t, "events"), ["user_id"], "ts", "1 day"), "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")


@query(
    "st6_work_dedup",
    """with recursive e as materialized (select distinct user_id, event_type, epoch_us(ts) us from events),
    acc as (select user_id, event_type, min(us) us from e group by all
      union all select a.user_id, a.event_type, min(e.us) from acc a join e on e.user_id = a.user_id and e.event_type = a.event_type and e.us >= a.us + 86400000000 group by all)
    select user_id, event_type, us accepted_us from acc""",
)
def _(t):
    log, rows = ChangeLog(t.spark, run_folder(t.spark, "dedup")), stream(t, "events")
    handler, schema = wn.readmit_batches(rows, ["user_id", "event_type"], "ts", log)
    cs.run(cs.start(rows, handler))
    return log.read(schema).select("user_id", "event_type", F.col("us").alias("accepted_us"))


@query(
    "st15_watermarked_counts",
    """with mark as (select floor(epoch_us(max(ts)) / 1000.0) - 3600000 ms from events), w as (select event_type, cast(floor(epoch_us(ts) / 3600000000.0) as bigint) * 3600 s from events)
    select event_type, s window_start_s, count(*) n from w, mark where (s + 3600) * 1000 <= ms group by all""",
)
def _(t):
    rows = wn.with_time(stream(t, "events"), "ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").count()
    out = cs.to_table(rows.select("event_type", F.col("window.start").alias("s"), "count"), "hours")
    return out.select("event_type", F.unix_timestamp("s").alias("window_start_s"), F.col("count").alias("n"))


@query(
    "st4_stream_correlation",
    "select a.event_id parsed, b.event_id embedded from events a join events b on a.user_id = b.user_id and b.ts >= a.ts - interval 1 hour and b.ts <= a.ts + interval 1 hour where a.event_type = 'click' and b.event_type = 'view'",
)
def _(t):
    left = stream(t, "events").filter("event_type = 'click'").select("user_id", F.col("event_id").alias("parsed"), "ts")
    right = stream(t, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("embedded"), "ts")
    return cs.to_table(wn.correlate(left, right, ["user_id"]).select("parsed", "embedded"), "pairs")


@query("st1_event_consumption", "select 'c:'||o_custkey entrypoint_stable_id, count(*) n from orders where o_orderkey % 10 not in (7, 8, 9) group by 1")
def _(t):
    out = ChangeLog(t.spark, run_folder(t.spark, "consumed"))
    messages = over(t, "messages", "orders", stream(t, "orders"))
    cs.run(cs.consume(messages, "raw_trace", lambda good, n: out.append(good.select("entrypoint_stable_id"), n), run_folder(t.spark, "dead")))
    return out.read("entrypoint_stable_id string").groupBy("entrypoint_stable_id").agg(F.count("*").alias("n"))


@query("st2_dead_letters", "select case o_orderkey % 10 when 7 then 'malformed json' when 8 then 'missing duration_ms' else 'invalid events.type' end error, count(*) n from orders where o_orderkey % 10 in (7, 8, 9) group by 1")
def _(t):
    path = run_folder(t.spark, "dead")
    cs.run(cs.consume(over(t, "messages", "orders", stream(t, "orders")), "raw_trace", lambda good, n: None, path, message_id="o_orderkey"))
    return ChangeLog(t.spark, path).read("msg_id string, error string, data string").groupBy("error").agg(F.count("*").alias("n"))


@query(
    "st3_graph_maintenance",
    """with n as (select 'd'||doc_id stable_id, doc_id, lang, sha256(text) node_hash from documents), gone as (select stable_id from n where doc_id % 7 = 3),
    e as (select 'd'||doc_id source, 'd'||cast(floor(doc_id / 2) as bigint) target from documents)
    select 'node' kind, stable_id a, node_hash b, doc_id % 7 <> 3 active from n union all
    select 'edge', source, target, true from e where source not in (select * from gone) and target not in (select * from gone) and target in (select stable_id from n)""",
)
def _(t):
    log = mn.GraphLog(t.spark, run_folder(t.spark, "graph"))

    def split(batch):
        node = F.concat(F.lit("d"), "doc_id")
        nodes = batch.select(node.alias("stable_id"), F.col("lang").alias("name"), F.lit("file").alias("type"), "source", F.col("lang").alias("repo"), F.sha2("text", 256).alias("node_hash"))
        edges = batch.select(node.alias("source"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2)).alias("target"))
        return nodes.withColumnRenamed("source", "file_path"), edges, batch.filter("doc_id % 7 = 3").select(node.alias("stable_id"))

    cs.run(cs.start(stream(t, "documents"), log.handler(split)))
    base_nodes = t.spark.createDataFrame([], mn.GraphLog.NODES + ", active boolean, updated_at timestamp, deleted_at timestamp")
    base_edges = t.spark.createDataFrame([], "source string, target string, type string, provenance string, updated_at timestamp")
    nodes, edges = log.current(base_nodes, base_edges, now().cast("timestamp"))
    return nodes.select(F.lit("node").alias("kind"), F.col("stable_id").alias("a"), F.col("node_hash").alias("b"), "active").union(
        edges.select(F.lit("edge"), "source", "target", F.lit(True))
    )


@query(
    "st5_pending_imports",
    f"with {RESOLVED} select source source_stable_id, target_name, path_hint, cast(4 - cast(substr(source, 3) as bigint) % 4 as integer) attempt_count from allr where sid is null or not known",
)
def _(t):
    state, edges = Snapshots(t.spark, run_folder(t.spark, "pending")), ChangeLog(t.spark, run_folder(t.spark, "imports"))
    imports = over(t, "imports", "orders", stream(t, "orders"))
    cs.run(cs.start(imports, mn.import_handler(state, edges, lambda: t.import_nodes, lambda: now().cast("timestamp"))))
    return state.read(mn.PENDING_STATE).select("source_stable_id", "target_name", "path_hint", "attempt_count")


@query("st7_running_frequency", WITH_EXPIRY.replace("{more}", ""))
def _(t):
    state, out = Snapshots(t.spark, run_folder(t.spark, "freq-state")), ChangeLog(t.spark, run_folder(t.spark, "freq"))
    cs.run(cs.start(shifted(over(t, "t_events", "events", stream(t, "events")), "ts"), mn.frequency_handler(state, out)))
    schema = "repo string, entry_id bigint, trace_id string, seq bigint, fn string, hop int, frequency_ratio double, avg_ms double, runs bigint, total_runs bigint"
    return out.read(schema).select("trace_id", "seq", "fn", "runs", "total_runs")


@query(
    "st8_execution_paths",
    f"""with {PAIRS}, {EFFECTS},
    links as (select trace_id, task_id task, seq from {{t_events}} where type = 'async_call' and task_id is not null
      union all select trace_id, 0, seq from {{t_events}} where type = 'async_call' and task_id is null and trace_id in (select trace_id from {{t_events}} where task_id is not null))
    select trace_id, sum(c)::bigint n_calls, sum(k)::bigint n_linked, sum(e)::bigint n_effects from (select trace_id, 1 c, 0 k, 0 e from pairs where task = 0
      union all select p.trace_id, 0, 1, 0 from pairs p join links l on l.trace_id = p.trace_id and l.task = p.task union all select trace_id, 0, 0, 1 from effects) group by trace_id""",
)
def _(t):
    calls, effects = (ChangeLog(t.spark, run_folder(t.spark, n)) for n in ("calls", "effects"))
    cs.run(cs.start(over(t, "t_events", "events", stream(t, "events")), mn.path_handler(calls, effects, TRACE)))
    key = "repo string, entry_id bigint, trace_id string"
    linked = F.col("link_pos") >= 0
    rows = calls.read(f"{key}, task bigint, link_pos bigint").select(
        "trace_id", F.when(linked, 0).otherwise(1).alias("c"), F.when(linked, 1).otherwise(0).alias("k"), F.lit(0).alias("e")
    )
    rows = rows.unionAll(effects.read(key).select("trace_id", F.lit(0), F.lit(0), F.lit(1)))
    return rows.groupBy("trace_id").agg(F.sum("c").alias("n_calls"), F.sum("k").alias("n_linked"), F.sum("e").alias("n_effects"))


@query("st10_stream_lag", f"with {LAGS} select repo, cast(user_id as varchar) entity, event_id position, round(lag_s, 6) lag_s from lags")
def _(t):
    state, out = Snapshots(t.spark, run_folder(t.spark, "lag-state")), ChangeLog(t.spark, run_folder(t.spark, "lags"))
    rows = t.sql(MESSAGES, events=stream(t, "events")).select("repo", F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("position"), "ts", "kind")
    cs.run(cs.start(rows, mn.lag_handler(state, out)))
    return out.read("repo string, entity string, position bigint, lag_s double").select("repo", "entity", "position", F.round("lag_s", 6).alias("lag_s"))


@query("st11_dual_cadence", "select 'snapshot' part, event_type, round(arg_max(\"value\", event_id), 4) \"value\" from events group by event_type union all select 'history', event_type, cast(count(*) as double) from events group by event_type")
def _(t):
    live, past = (ChangeLog(t.spark, run_folder(t.spark, n)) for n in ("live", "history"))
    last = lambda batch: batch.groupBy("event_type").agg(F.max(F.struct("event_id", "value")).alias("l")).select("event_type", "l.*")
    # Both writers read the stream on their own; here each runs until the data ends.
    cs.run(cs.start(stream(t, "events"), mn.log_handler(live, last)))
    cs.run(cs.start(stream(t, "events"), mn.log_handler(past, lambda b: b.select("event_type", "value"))))
    snapshot = live.read("event_type string, event_id bigint, value double").groupBy("event_type").agg(F.max_by("value", "event_id").alias("value"))
    counts = past.read("event_type string, value double").groupBy("event_type").agg(F.count("*").cast("double").alias("value"))
    return snapshot.select(F.lit("snapshot").alias("part"), "event_type", F.round("value", 4).alias("value")).union(counts.select(F.lit("history"), "event_type", "value"))


@query(
    "st12_provenance_stream",
    # A customer's orders arrive in one batch; before it, a static edge of a customer traced earlier is a conflict, which stays.
    """select 'c:'||o_custkey source, 'o:'||o_orderkey target, case o_orderstatus when 'F' then 'confirmed' when 'O' then
      case when o_custkey % 4 <> 0 and n.last_traced_at is not null then 'conflict' else 'confirmed' end else 'dynamic' end provenance
    from orders left join {p_nodes} n on n.stable_id = 'c:'||o_custkey""",
)
def _(t):
    nodes, edges = Snapshots(t.spark, run_folder(t.spark, "nodes")), Snapshots(t.spark, run_folder(t.spark, "edges"))
    nodes.write(t.p_nodes.withColumns({c: F.col(c).cast("timestamp") for c in ("updated_at", "last_traced_at")}))
    mine = t.p_edges.filter("source like 'c:%'").withColumn("confirmed_at", F.when(F.col("provenance") == "confirmed", F.lit("1997-06-01").cast("timestamp")))
    edges.write(mine)

    def split(orders):
        paths = over(t, "p_paths", "orders", orders)
        order = orders.select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderkey").alias("trace_no"), F.lit(-1).cast("bigint").alias("seq"), F.concat(F.lit("o:"), "o_orderkey").alias("stable_id"), F.lit(1.5).alias("avg_ms"), F.lit(1.0).alias("frequency_ratio"))
        return paths, order, t.spark.createDataFrame([], "source string, target string, count bigint")

    node_schema = "stable_id string, name string, type string, observed_calls int, avg_latency_ms double, branch_coverage double, last_traced_at timestamp, updated_at timestamp"
    edge_schema = "source string, target string, type string, provenance string, observed_count bigint, confirmed_at timestamp, detail string"
    # Batch numbers start at 0 like the seeded snapshots, so the batches are moved up by one.
    each = mn.provenance_handler(nodes, edges, node_schema, edge_schema, split, lambda: now().cast("timestamp"))
    cs.run(cs.start(stream(t, "orders", "cast(o_custkey % 4 as int)"), lambda batch, n: each(batch, n + 1)))
    return edges.read(edge_schema).select("source", "target", "provenance")


@query(
    "st13_spec_stream",
    "select node_stable_id, commit_sha, cast(count(*) as integer) \"version\", arg_max(spec_text, o_orderkey) spec_text from {sp_batch} group by node_stable_id, commit_sha",
)
def _(t):
    log = ChangeLog(t.spark, run_folder(t.spark, "specs"))
    top = t.orders.agg(F.max("o_orderkey")).first()[0]
    ordered = stream(t, "orders", f"cast(o_orderkey * 4 div {top + 1} as int)")
    cs.run(cs.start(over(t, "sp_batch", "orders", ordered), mn.log_handler(log)))
    schema = "node_stable_id string, repo string, commit_sha string, spec_text string, branch_coverage double, observed_calls int, o_orderkey bigint"
    base = t.spark.createDataFrame([], "node_stable_id string, repo string, commit_sha string, version int, spec_text string, branch_coverage double, observed_calls int, generated_at timestamp")
    out = mn.current_specs(base, log, schema, now().cast("timestamp"), ["o_orderkey"])
    return out.select("node_stable_id", "commit_sha", "version", "spec_text")


@query("st14_vector_deletes", "select 'd'||vec_id stable_id from embeddings where 'd'||vec_id not in (select 'd'||doc_id from documents where n_chars % 3 = 0)")
def _(t):
    log = ChangeLog(t.spark, run_folder(t.spark, "gone"))
    select = lambda b: b.filter("n_chars % 3 = 0").select(F.concat(F.lit("d"), "doc_id").alias("stable_id"))
    cs.run(cs.start(stream(t, "documents"), mn.log_handler(log, select)))
    vectors = t.embeddings.select(F.concat(F.lit("d"), "vec_id").alias("stable_id"))
    return mn.current_vectors(vectors, None, log.read("stable_id string"))


# Each week is a batch: a repository's work goes from the last commit of its last batch to that of this one.
@query(
    "st17_commit_marks_stream",
    """select repo, coalesce(lag(current_sha) over (partition by repo order by wk), '') prev_sha, current_sha
    from (select 'repo'||(user_id % 40) repo, floor((day(ts) - 1) / 7) wk, arg_max('s'||event_id, event_id) current_sha from events group by 1, 2)""",
)
def _(t):
    state, work = Snapshots(t.spark, run_folder(t.spark, "marks")), ChangeLog(t.spark, run_folder(t.spark, "work"))
    commits = stream(t, "events").select(F.concat(F.lit("repo"), F.col("user_id") % 40).alias("repo"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), "event_id").alias("sha"))
    cs.run(cs.start(commits, mn.commit_handler(state, work.append)))
    return work.read("repo string, prev_sha string, current_sha string, full_rescan boolean").select("repo", F.coalesce("prev_sha", F.lit("")).alias("prev_sha"), "current_sha")


@query(
    "st18_counters",
    """select 'raw_trace' kind, count(*) received, count(*) filter (where o_orderkey % 10 not in (7, 8, 9)) processed, count(*) filter (where o_orderkey % 10 in (7, 8, 9)) failed,
    count(*) filter (where o_orderkey % 10 not in (7, 8, 9)) written from orders""",
)
def _(t):
    counters, out = (ChangeLog(t.spark, run_folder(t.spark, n)) for n in ("counters", "out"))
    handle = lambda good, n: out.append(good.select("entrypoint_stable_id"), n)
    cs.run(cs.consume(over(t, "messages", "orders", stream(t, "orders")), "raw_trace", handle, run_folder(t.spark, "dead"), counters=counters))
    written = out.read("entrypoint_stable_id string").agg(F.count(F.lit(1)).alias("written"))
    return cs.counter_totals(counters).crossJoin(written)
