"""Metrics, trends, regressions, bottlenecks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.queries.traces import EFFECTS, NAMED, PAIRS, TRACE
from catalog.registry import query
from strandline.functions import text
from strandline.operators import bottlenecks as bn
from strandline.operators import metrics as mt
from strandline.operators import traces as tr

ROUND = lambda c="value": F.round(c, 4).alias(c)
# A mean from an exact sum, for DuckDB.
EXACT = 'cast(sum(cast({0} as decimal(28,9))) as double) / count({0})'
METRIC_COLS = ["metric_type", "metric_name", "entity_id", "trace_id", "unit"]


@query(
    "ag2_fn_duration",
    f"with {NAMED} select 'user_code' metric_type, 'fn_duration' metric_name, entity_id, trace_id, 'ms' unit, {EXACT.format("duration_ms")} \"value\" from named group by trace_id, entity_id",
)
def _(t):
    return mt.fn_durations(tr.name_matched_calls(t.t_events, TRACE), TRACE).select(*METRIC_COLS, "value")


@query(
    "ag3_call_frequency",
    "select 'call_frequency' metric_name, file||':'||fn entity_id, trace_id, cast(count(*) as double) \"value\" from {t_events} where type = 'call' group by trace_id, file, fn",
)
def _(t):
    return mt.call_frequencies(t.t_events, TRACE).select("metric_name", "entity_id", "trace_id", "value")


@query(
    "ag4_entrypoint_duration",
    "select 'entrypoint_duration' metric_name, cast(entry_id as varchar) entity_id, trace_id, round(duration_ms, 4) \"value\" from {t_traces}",
)
def _(t):
    return mt.entrypoint_durations(t.t_traces, ["repo", "trace_id"], "entry_id").select("metric_name", "entity_id", "trace_id", ROUND())


@query(
    "ag5_path_metrics",
    f"""with {PAIRS}, {EFFECTS}, pos as (select trace_id, list_sort(list(avg_ms)) v from pairs where avg_ms > 0 group by trace_id),
    d as (select trace_id, max(hop) + 1 depth from pairs group by trace_id), c as (select trace_id, count(*) n from effects group by trace_id),
    wide as (select t.trace_id, t.entry_id, coalesce(d.depth, 0) depth, coalesce(c.n, 0) n,
      coalesce((v[cast(floor((len(v) - 1) / 2.0) as int) + 1] + v[cast(floor(len(v) / 2.0) as int) + 1]) / 2.0, t.duration_ms) p50,
      coalesce(v[least(cast(floor(len(v) * cast(0.99 as double)) as int), len(v) - 1) + 1], t.duration_ms) p99
      from {{t_traces}} t left join d using (trace_id) left join c using (trace_id) left join pos using (trace_id))
    select trace_id, cast(entry_id as varchar) entity_id, 'call_depth' metric_name, cast(depth as double) "value", 'count' unit from wide
    union all select trace_id, cast(entry_id as varchar), 'side_effect_count', cast(n as double), 'count' from wide
    union all select trace_id, cast(entry_id as varchar), 'timing_p50', round(p50, 4), 'ms' from wide
    union all select trace_id, cast(entry_id as varchar), 'timing_p99', round(p99, 4), 'ms' from wide""",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, TRACE)
    effects = tr.side_effects(t.t_events, TRACE)
    timings = tr.path_timings(pairs, t.t_traces, TRACE)
    rows = mt.path_metrics_from_rows(t.t_traces, pairs, effects, timings, TRACE, "entry_id")
    return rows.select("trace_id", "entity_id", "metric_name", ROUND(), "unit")


@query(
    "set5_metric_union",
    f"""with {NAMED} select metric_name, unit, count(*) n, round(sum("value") / 1000000.0e0, 3) total from (
      select 'fn_duration' metric_name, 'ms' unit, avg(duration_ms) "value" from named group by trace_id, entity_id
      union all select 'call_frequency', 'count', count(*) from {{t_events}} where type = 'call' group by trace_id, file, fn
      union all select 'entrypoint_duration', 'ms', duration_ms from {{t_traces}}) group by all""",
)
def _(t):
    whole = mt.union_metrics(
        mt.fn_durations(tr.name_matched_calls(t.t_events, TRACE), TRACE),
        mt.call_frequencies(t.t_events, TRACE),
        mt.entrypoint_durations(t.t_traces, TRACE, "entry_id"),
    )
    return whole.groupBy("metric_name", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value") / 1e6, 3).alias("total"))


@query("ag13_metric_counts", "select repo, metric_type, count(*) cnt from {metrics} group by all")
def _(t):
    return mt.metric_counts(t.metrics)


# Line items double as frequency rows of the same entities.
FREQ_ROWS = """
select metric_name, entity_id, repo, value, order_key, l_partkey, l_suppkey from {metrics}
union all select 'call_frequency', entity_id, repo, l_quantity, order_key, l_partkey, l_suppkey from {metrics} where l_discount > 0.05
"""
ORDER = ["order_key", "l_partkey", "l_suppkey", "value"]
HOT = f"""last as (select repo, entity_id, metric_name, arg_max("value", (order_key, l_partkey, l_suppkey, "value")) v from ({FREQ_ROWS}) group by all),
hot as (select d.repo, d.entity_id, d.v * coalesce(f.v, 1.0) cumulative_ms from last d left join last f on f.repo = d.repo and f.entity_id = d.entity_id and f.metric_name = 'call_frequency'
  where d.metric_name = 'fn_duration')"""


@query(
    "jn21_hot_score",
    f"with {HOT} select repo, entity_id, round(cumulative_ms, 4) cumulative_ms from hot",
)
def _(t):
    return mt.hot_scores(t.sql(FREQ_ROWS), ORDER).select("repo", "entity_id", F.round("cumulative_ms", 4).alias("cumulative_ms"))


@query(
    "tk5_hot_functions",
    f"with {HOT} select repo, entity_id, round(cumulative_ms, 4) cumulative_ms, cast(rank as integer) rank from (select *, row_number() over (partition by repo order by cumulative_ms desc, entity_id) rank from hot) where rank <= 20",
)
def _(t):
    return mt.hot_functions(t.sql(FREQ_ROWS), ORDER).select("repo", "entity_id", F.round("cumulative_ms", 4).alias("cumulative_ms"), "rank")


SLOW = """slow as (select *, row_number() over (partition by repo order by "value" desc, entity_id, order_key, l_partkey) rank from {metrics})"""
TIES = ("entity_id", "order_key", "l_partkey")


@query(
    "tk4_slow_functions",
    f"with {SLOW} select repo, entity_id, round(\"value\", 4) \"value\", unit, commit_sha, cast(rank as integer) rank from slow where rank <= 20",
)
def _(t):
    return mt.slow_functions(t.metrics, 20, ties=TIES).select("repo", "entity_id", ROUND(), "unit", "commit_sha", "rank")


@query(
    "tk4_slow_functions_of_commit",
    "select repo, entity_id, round(\"value\", 4) \"value\", cast(rank as integer) rank from (select *, row_number() over (partition by repo order by \"value\" desc, entity_id, order_key, l_partkey) rank from {metrics} where commit_sha = '1998') where rank <= 50",
)
def _(t):
    return mt.slow_functions(t.metrics, 50, "1998", TIES).select("repo", "entity_id", ROUND(), "rank")


@query(
    "tk8_slow_function_severity",
    f"with {SLOW} select repo, entity_id, split_part(entity_id, ':', -1) entity_name, 'slow_fn' category, case when \"value\" >= 1000 then 'critical' when \"value\" >= 200 then 'warning' else 'info' end severity, round(\"value\", 4) \"value\" from slow where rank <= 20",
)
def _(t):
    return bn.slow_function_rows(t.metrics, ties=TIES).select("repo", "entity_id", "entity_name", "category", "severity", ROUND())


@query(
    "tk7_trend_points",
    "select entity_id, repo, epoch(recorded_at)::bigint at_s, round(\"value\", 4) \"value\" from {metrics} where recorded_at > timestamp '2000-01-01' - interval 168 hour",
)
def _(t):
    points = mt.trend_points(t.metrics, F.lit("2000-01-01").cast("timestamp"), text.window_hours(F.lit("7d")))
    return points.select("entity_id", "repo", F.unix_timestamp(F.col("recorded_at").cast("timestamp")).alias("at_s"), ROUND())


@query(
    "ag15_trend_slope",
    """with n as (select repo, entity_id, "value", row_number() over (partition by repo, entity_id order by recorded_at, order_key, l_partkey, l_suppkey, "value") - 1 i from {metrics}),
    s as (select repo, entity_id, coalesce(regr_slope("value", i), 0) slope, count(*) points from n group by all)
    select repo, entity_id, round(slope, 6) slope, points, case when slope > 0.01 then 'increasing' when slope < -0.01 then 'decreasing' else 'stable' end direction from s""",
)
def _(t):
    out = mt.trend_slopes(t.metrics, ["repo", "entity_id"], ["recorded_at", "order_key", "l_partkey", "l_suppkey"])
    return out.select("repo", "entity_id", F.round("slope", 6).alias("slope"), "points", "direction")


@query(
    "ag12_regressions",
    f"""with b as (select repo, entity_id, {EXACT.format('"value"')} v from {{metrics}} where commit_sha = '1996' group by all),
    h as (select repo, entity_id, {EXACT.format('"value"')} v from {{metrics}} where commit_sha = '1997' group by all)
    select h.repo, h.entity_id, b.v base_val, h.v head_val, (h.v - b.v) / nullif(b.v, 0) * 100 pct_change
    from h join b on h.repo = b.repo and h.entity_id = b.entity_id where (h.v - b.v) / nullif(b.v, 0) * 100 > 20""",
)
def _(t):
    return mt.regressions(t.metrics, "1996", "1997").select("repo", "entity_id", "base_val", "head_val", "pct_change")


@query(
    "jn19_commit_regressions",
    f"""with m as (select repo, entity_id, commit_sha, {EXACT.format('"value"')} v from {{metrics}} group by all)
    select h.repo, h.entity_id, b.commit_sha base_sha, h.commit_sha head_sha, (h.v - b.v) / nullif(b.v, 0) * 100 pct_change
    from m h join m b on h.repo = b.repo and h.entity_id = b.entity_id and cast(h.commit_sha as int) = cast(b.commit_sha as int) + 1
    where (h.v - b.v) / nullif(b.v, 0) * 100 > 20""",
)
def _(t):
    seen = t.metrics.select("repo", F.col("commit_sha").alias("base_sha")).distinct()
    pairs = seen.withColumn("head_sha", (F.col("base_sha").cast("int") + 1).cast("string"))
    return mt.commit_regressions(t.metrics, pairs).select("repo", "entity_id", "base_sha", "head_sha", "pct_change")


# Messages: one stream per event type; the kinds play traces and paths of one key per user.
MESSAGES = """select event_id, 'stream:'||event_type stream, 'repo'||cast(user_id % 3 as string) repo, user_id, ts,
  case when event_type in ('click', 'view') then 'trace' else 'path' end kind from {events}"""


@query(
    "ag18_queue_depth",
    f"select stream entity_id, cast(count(*) filter (where ts + interval 168 hour > timestamp '2024-01-28') as double) \"value\" from ({MESSAGES}) group by stream",
)
def _(t):
    messages = t.sql(MESSAGES).withColumn("expires_at", F.col("ts").cast("timestamp") + F.expr("interval 168 hours"))
    return mt.queue_depths(messages, F.lit("2024-01-28").cast("timestamp")).select("entity_id", "value")


@query(
    "wn12_arrival_rate",
    f"""with a as (select stream, cast(ceil(epoch_us(ts) / 5000000.0) as bigint) * 5 first from ({MESSAGES})),
    s as (select stream, first + 5 * j tick from a, generate_series(0, 11) g(j))
    select stream entity_id, tick, round(count(*) / 60.0, 6) "value" from s group by stream, tick""",
)
def _(t):
    return mt.arrival_rates(t.sql(MESSAGES), "stream", "ts").select("entity_id", "tick", F.round("value", 6).alias("value"))


LAGS = f"""lagged as (select repo, user_id, event_id, kind, ts, lag(kind) over w pk, lag(ts) over w pt from ({MESSAGES}) window w as (partition by repo, user_id order by event_id)),
lags as (select repo, user_id, event_id, (epoch_us(ts) - epoch_us(pt)) / 1000000.0 lag_s from lagged where kind = 'path' and pk = 'trace')"""


@query("jn20_processing_lag", f"with {LAGS} select repo, user_id, event_id, round(lag_s, 6) lag_s from lags")
def _(t):
    out = mt.processing_lags(t.sql(MESSAGES), ["repo", "user_id"], "event_id", "ts")
    return out.select("repo", "user_id", "event_id", F.round("lag_s", 6).alias("lag_s"))


@query(
    "ag14_lag_bottleneck",
    f"with {LAGS}, a as (select avg(lag_s) v from lags) select 'trace-normalizer' entity_id, 'pipeline' category, case when v > 20 then 'critical' else 'warning' end severity, round(v, 4) \"value\" from a where v > 10",
)
def _(t):
    lags = mt.processing_lags(t.sql(MESSAGES), ["repo", "user_id"], "event_id", "ts")
    return bn.processing_lag(lags).select("entity_id", "category", "severity", ROUND())


# Depth and rate of a stream per twelve-hour tick.
TICKS = f"select stream entity_id, cast(floor(day(ts) * 2 + hour(ts) / 12) as bigint) tick, count(*) depth, count(*) / 43200.0e0 \"value\" from ({MESSAGES}) group by 1, 2"
SPARK_TICKS = TICKS.replace('"value"', "value")


@query(
    "wn10_queue_buildup",
    f"""with k as ({TICKS}), g as (select c.entity_id, c.tick, c.depth - coalesce(p.depth, 0) growth from k c left join k p on p.entity_id = c.entity_id and p.tick = c.tick - 1
      where c.tick - 1 in (select tick from k))
    select entity_id, tick, split_part(entity_id, ':', -1)||' stream' entity_name, case when growth < 50 then 'warning' else 'critical' end severity, cast(growth as double) "value" from g where growth > 5""",
)
def _(t):
    return bn.queue_buildup(t.sql(SPARK_TICKS)).select("entity_id", "tick", "entity_name", "severity", "value")


@query(
    "wn11_throughput_drop",
    f"""with k as ({TICKS}), g as (select c.entity_id, c.tick, (p."value" - c."value") / p."value" * 100 pct from k c join k p on p.entity_id = c.entity_id and p.tick = c.tick - 1 where c."value" < p."value")
    select entity_id, tick, case when pct > 30 then 'critical' else 'warning' end severity, round(pct, 4) "value" from g where pct >= 20""",
)
def _(t):
    return bn.throughput_drop(t.sql(SPARK_TICKS), threshold_pct=20.0).select("entity_id", "tick", "severity", ROUND())


@query(
    "wn11_throughput_drop_rolling",
    f"""with k as ({TICKS}), b as (select *, avg("value") over (partition by entity_id order by tick range between 2 preceding and 1 preceding) base from k),
    g as (select *, (base - "value") / base * 100 pct from b where base > 0 and "value" < base)
    select entity_id, tick, round(pct, 4) "value" from g where pct >= 20""",
)
def _(t):
    return bn.throughput_drop(t.sql(SPARK_TICKS), threshold_pct=20.0, baseline="rolling_1h", tick_s=1800).select("entity_id", "tick", ROUND())


@query(
    "tk9_deep_chains",
    f"""with {PAIRS}, d as (select trace_id, entry_id, max(hop) + 1 depth from pairs group by all)
    select cast(entry_id as varchar) entity_id, trace_id, cast(depth as double) "value", 'deep_chain' category, 'Call depth '||depth||' exceeds max 2' detail from d where depth > 2""",
)
def _(t):
    pairs = tr.paired_calls(t.t_events, TRACE)
    timings = tr.path_timings(pairs, t.t_traces, TRACE)
    rows = mt.path_metrics_from_rows(t.t_traces, pairs, tr.side_effects(t.t_events, TRACE), timings, TRACE, "entry_id")
    found = bn.deep_chains(rows.withColumn("entity_id", F.concat_ws("|", "entity_id", "trace_id")), max_depth=2)
    split = F.split("entity_id", r"\|")
    return found.select(split[0].alias("entity_id"), split[1].alias("trace_id"), "value", "category", "detail")


@query(
    "snk8_realtime_snapshot",
    'select repo, \'fn_duration:\'||entity_id "key", round(arg_max("value", (order_key, l_partkey, l_suppkey, "value")), 4) "value" from {metrics} group by all',
)
def _(t):
    return mt.realtime_snapshot(t.metrics, ORDER).select("repo", "key", ROUND())


# Slow line items observed as bottlenecks through the last minutes of each ship date.
SEEN = """select repo, entity_id, 'slow_fn' category, case when value >= 900 then 'critical' else 'warning' end severity, value,
  recorded_at as detected_at, l_partkey from {metrics}"""


@query(
    "snk9_active_bottlenecks",
    f"select repo, entity_id, round(\"value\", 4) \"value\" from ({SEEN.replace('value', '\"value\"')}) where epoch_us(timestamp '2000-01-01 00:00:30') - epoch_us(detected_at) < 60000000",
)
def _(t):
    return bn.active_bottlenecks(t.sql(SEEN), F.lit("2000-01-01 00:00:30").cast("timestamp")).select("repo", "entity_id", ROUND())


@query(
    "prj28_bottleneck_filter",
    f"select repo, entity_id, count(*) n from ({SEEN.replace('value', '\"value\"')}) where category = 'slow_fn' and severity = 'critical' group by all",
)
def _(t):
    rows = bn.filter_bottlenecks(t.sql(SEEN), "slow_fn", "critical")
    return rows.groupBy("repo", "entity_id").agg(F.count("*").alias("n"))


@query(
    "set6_bottleneck_union",
    f"""with {LAGS}, {SLOW}, k as ({TICKS}), a as (select avg(lag_s) v from lags),
    g as (select c.entity_id, c.depth - coalesce(p.depth, 0) growth from k c left join k p on p.entity_id = c.entity_id and p.tick = c.tick - 1 where c.tick - 1 in (select tick from k))
    select category, severity, count(*) n from (
      select 'pipeline' category, case when v > 20 then 'critical' else 'warning' end severity from a where v > 10
      union all select 'pipeline', case when growth < 50 then 'warning' else 'critical' end from g where growth > 5
      union all select 'slow_fn', case when "value" >= 1000 then 'critical' when "value" >= 200 then 'warning' else 'info' end from slow where rank <= 20) group by all""",
)
def _(t):
    lags = mt.processing_lags(t.sql(MESSAGES), ["repo", "user_id"], "event_id", "ts")
    whole = bn.all_bottlenecks(bn.processing_lag(lags), bn.queue_buildup(t.sql(SPARK_TICKS)), bn.slow_function_rows(t.metrics, ties=TIES))
    return whole.groupBy("category", "severity").agg(F.count("*").alias("n"))


@query(
    "ag19_summary_report",
    f"""with slow as (select *, row_number() over (partition by repo order by "value" desc, entity_id) rank from {{metrics}}) select repo, section, "key", round("value", 4) "value" from (
      select repo, 'pipeline_health' section, 'fn_duration:'||entity_id "key", arg_max("value", (order_key, l_partkey, l_suppkey, "value")) "value" from {{metrics}} group by repo, entity_id
      union all select repo, 'top_slow_functions', rank||'#'||entity_id, "value" from slow where rank <= 5
      union all select repo, 'active_bottlenecks', 'slow_fn/'||entity_id, "value" from ({SEEN.replace('value', '"value"')}) where severity = 'critical' and detected_at > timestamp '1999-12-31 23:59:30'
      union all select repo, 'metric_counts', metric_type, count(*) from {{metrics}} group by repo, metric_type)""",
)
def _(t):
    active = bn.active_bottlenecks(bn.filter_bottlenecks(t.sql(SEEN), severity="critical"), F.lit("2000-01-01 00:00:30").cast("timestamp"))
    return mt.summary(t.metrics, mt.realtime_snapshot(t.metrics, ORDER), active).select("repo", "section", "key", ROUND())


@query(
    "prj29_window_hours",
    "select win, case when n % 4 = 0 then cast(n as int) * 24 when n % 4 in (1, 2) then cast(n as int) else 24 end n_hours from (select l_linenumber + l_orderkey n, case (l_linenumber + l_orderkey) % 4 when 0 then (l_linenumber + l_orderkey)||'d' when 1 then ' '||(l_linenumber + l_orderkey)||'H' when 2 then (l_linenumber + l_orderkey)||'h' else (l_linenumber + l_orderkey)||'m' end win from lineitem)",
)
def _(t):
    n = F.col("l_linenumber") + F.col("l_orderkey")
    win = F.when(n % 4 == 0, F.concat(n, F.lit("d"))).when(n % 4 == 1, F.concat(F.lit(" "), n, F.lit("H"))).when(n % 4 == 2, F.concat(n, F.lit("h"))).otherwise(F.concat(n, F.lit("m")))
    return t.lineitem.select(win.alias("win")).select("win", text.window_hours(F.col("win")).alias("n_hours"))


@query("prj30_entity_name", "select distinct file||':'||fn entity_id, fn entity_name from {t_events}")
def _(t):
    ids = t.t_events.select(F.concat_ws(":", "file", "fn").alias("entity_id")).distinct()
    return ids.select("entity_id", text.last_segment(F.col("entity_id")).alias("entity_name"))
