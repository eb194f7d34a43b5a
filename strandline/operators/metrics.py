"""Metric rows from traces and execution paths, and the reports read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import ranks, scan

PIPELINE = "_pipeline"
# Arrival window and tick of the throughput rate, in seconds.
RATE_WINDOW_S, RATE_TICK_S = 60, 5
# A slope beyond this either way is a direction.
SLOPE_LIMIT = 0.01


def _metric(rows: DataFrame, keys: Sequence[str], name: str, entity: Column, value: Column, unit: str,
            metric_type: str = "user_code") -> DataFrame:
    return rows.select(
        F.lit(metric_type).alias("metric_type"), F.lit(name).alias("metric_name"),
        entity.cast("string").alias("entity_id"), *keys, value.cast("double").alias("value"), F.lit(unit).alias("unit"),
    )


def fn_durations(named_calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean duration per ``file:function`` within the keys (name-matched pairs in)."""
    means = named_calls.groupBy(*keys, "entity_id").agg(ranks.exact_mean(F.col("duration_ms")).alias("v"))
    return _metric(means, keys, "fn_duration", F.col("entity_id"), F.col("v"), "ms")


def call_frequencies(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = events.filter(F.col("type") == "call").groupBy(*keys, F.concat_ws(":", "file", "fn").alias("e")).count()
    return _metric(counts, keys, "call_frequency", F.col("e"), F.col("count"), "count")


def entrypoint_durations(traces: DataFrame, keys: Sequence[str], entity: str = "entrypoint_stable_id") -> DataFrame:
    return _metric(traces, keys, "entrypoint_duration", F.col(entity), F.col("duration_ms"), "ms")


def path_metrics(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth, side-effect count and timings of nested execution paths, one row each."""
    depth = F.coalesce(F.array_max(F.transform("call_sequence", lambda c: c["hop"])) + 1, F.lit(0))
    return _unpivot(
        paths.select(
            *keys, F.col("entrypoint_stable_id").alias("__e"), depth.cast("double").alias("call_depth"),
            F.size("side_effects").cast("double").alias("side_effect_count"),
            F.col("timing_p50_ms").alias("timing_p50"), F.col("timing_p99_ms").alias("timing_p99"),
        ),
        keys,
    )


def path_metrics_from_rows(traces: DataFrame, calls: DataFrame, effects: DataFrame, timings: DataFrame,
                           keys: Sequence[str], entity: str) -> DataFrame:
    """The same from flat rows, for paths too long to nest."""
    keys = list(keys)
    depth = calls.groupBy(*keys).agg((F.max("hop") + 1).cast("double").alias("call_depth"))
    count = effects.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("side_effect_count"))
    wide = traces.select(*keys, F.col(entity).alias("__e")).join(depth, keys, "left").join(count, keys, "left").join(timings, keys)
    return _unpivot(
        wide.select(
            *keys, "__e", F.coalesce("call_depth", F.lit(0.0)).alias("call_depth"),
            F.coalesce("side_effect_count", F.lit(0.0)).alias("side_effect_count"),
            F.col("timing_p50_ms").alias("timing_p50"), F.col("timing_p99_ms").alias("timing_p99"),
        ),
        keys,
    )


def _unpivot(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = ["call_depth", "side_effect_count", "timing_p50", "timing_p99"]
    long = wide.unpivot([*keys, "__e"], names, "metric_name", "value")
    unit = F.when(F.col("metric_name").startswith("timing"), "ms").otherwise("count")
    return long.select(
        F.lit("user_code").alias("metric_type"), "metric_name", F.col("__e").cast("string").alias("entity_id"), *keys,
        "value", unit.alias("unit"),
    )


def union_metrics(*families: DataFrame) -> DataFrame:
    """One metric table; columns a family lacks become null."""
    whole = families[0]
    for family in families[1:]:
        whole = whole.unionByName(family, allowMissingColumns=True)
    return whole


def queue_depths(messages: DataFrame, as_of: Column, stream: str = "stream", expires: str = "expires_at") -> DataFrame:
    """Unexpired messages per stream at ``as_of``."""
    live = messages.groupBy(stream).agg(F.count_if(F.col(expires) > as_of).alias("v"))
    return live.select(
        F.lit("pipeline").alias("metric_type"), F.lit("queue_depth").alias("metric_name"),
        F.col(stream).alias("entity_id"), F.lit(PIPELINE).alias("repo"), F.col("v").cast("double").alias("value"),
        F.lit("count").alias("unit"),
    )


def arrival_rates(messages: DataFrame, stream: str, ts: str, window_s: int = RATE_WINDOW_S, tick_s: int = RATE_TICK_S) -> DataFrame:
    """Messages per second over the trailing window at every tick that any message touches.

    A message counts at ticks T with T - window < t <= T. Messages are counted per (stream,
    first tick) before the few ticks are spread out, so a hot stream shrinks map-side.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    step = tick_s * 1_000_000
    first = F.ceil(micros / F.lit(step)).cast("bigint") * tick_s
    counted = messages.groupBy(F.col(stream).alias("entity_id"), first.alias("__first")).agg(F.count(F.lit(1)).alias("__n"))
    spread = counted.select(
        "entity_id", "__n",
        F.explode(F.sequence(F.col("__first"), F.col("__first") + (window_s - tick_s), F.lit(tick_s))).alias("tick"),
    )
    return spread.groupBy("entity_id", "tick").agg((F.sum("__n") / F.lit(float(window_s))).alias("value"))


def processing_lags(messages: DataFrame, keys: Sequence[str], order: str, ts: str, kind: str = "kind") -> DataFrame:
    """Lag in seconds of each path behind the latest unmatched trace of its key.

    A trace is consumed by one path, so a path matches exactly when the row before it (by
    ``order`` within the key) is a trace.
    """
    rows = scan.range_chunks(messages, keys, [order])
    rows = scan.previous_row(rows, keys, order, [kind, ts], "__before")
    matched = rows.filter((F.col(kind) == "path") & (F.col(f"__before.{kind}") == "trace"))
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"__before.{ts}").cast("timestamp"))
    return matched.select(*keys, order, (micros / 1e6).alias("lag_s"))


def last_values(metrics: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.max_by("value", F.struct(*order)).alias("value"))


def realtime_snapshot(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last value per ``metric_name:entity_id`` of every repository, pipeline metrics included."""
    keyed = metrics.withColumn("key", F.concat_ws(":", "metric_name", "entity_id"))
    return last_values(keyed, ["repo", "key"], order)


def snapshot_of(snapshot: DataFrame, repo: str) -> DataFrame:
    """What a reader of one repository sees: its own values and those of the pipeline."""
    return snapshot.filter(F.col("repo").isin(repo, PIPELINE))


def hot_scores(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """(repo, entity_id, cumulative_ms): duration times call frequency, 1 when unknown.

    Both last values come from one aggregate over the metric rows, so nothing is joined.
    """
    rows = metrics.filter(F.col("metric_name").isin("fn_duration", "call_frequency"))
    at = F.struct(*order)
    last = lambda name: F.max_by(
        F.when(F.col("metric_name") == name, F.col("value")), F.when(F.col("metric_name") == name, at)
    )
    scored = rows.groupBy("repo", "entity_id").agg(last("fn_duration").alias("__d"), last("call_frequency").alias("__f"))
    return scored.filter(F.col("__d").isNotNull()).select(
        "repo", "entity_id", (F.col("__d") * F.coalesce("__f", F.lit(1.0))).alias("cumulative_ms")
    )


def hot_functions(metrics: DataFrame, order: Sequence[str], limit: int = 20) -> DataFrame:
    """Per repository: the highest scores, ranked."""
    scored = hot_scores(metrics, order)
    return top_rows(scored, ["repo"], [F.desc("cumulative_ms"), F.col("entity_id")], limit)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows per key; the rank filter is pruned per task before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= limit)


def slow_functions(metrics: DataFrame, limit: int = 20, commit_sha: str | None = None,
                   ties: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Per repository: the highest single ``fn_duration`` rows (not grouped)."""
    rows = metrics.filter((F.col("metric_type") == "user_code") & (F.col("metric_name") == "fn_duration"))
    if commit_sha is not None:
        rows = rows.filter(F.col("commit_sha") == commit_sha)
    return top_rows(rows, ["repo"], [F.desc("value"), *map(F.col, ties)], limit)


def slow_functions_of(metrics: DataFrame, repo: str, limit: int = 20, commit_sha: str | None = None) -> DataFrame:
    """The same for one repository as a plain top-n."""
    rows = metrics.filter(
        (F.col("repo") == repo) & (F.col("metric_type") == "user_code") & (F.col("metric_name") == "fn_duration")
    )
    if commit_sha is not None:
        rows = rows.filter(F.col("commit_sha") == commit_sha)
    return rows.orderBy(F.desc("value"), "entity_id").limit(limit)


def trend_points(metrics: DataFrame, as_of: Column, hours: Column | int, metric_name: str = "fn_duration") -> DataFrame:
    """Points of the window that ends at ``as_of``."""
    span = hours if isinstance(hours, Column) else F.lit(hours)
    since = F.timestamp_micros(F.unix_micros(as_of) - span.cast("bigint") * 3_600_000_000)
    return metrics.filter((F.col("metric_name") == metric_name) & (F.col("recorded_at").cast("timestamp") > since))


def trend_slopes(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Least-squares slope of the value over its position in time, with a direction."""
    keys = list(keys)
    placed = scan.range_chunks(points.select(*keys, *order, "value"), keys, order)
    numbered = scan.numbered(placed, keys, order, "__i")
    fitted = numbered.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("value", F.col("__i") - 1), F.lit(0.0)).alias("slope"), F.count(F.lit(1)).alias("points")
    )
    direction = F.when(F.col("slope") > SLOPE_LIMIT, "increasing").when(F.col("slope") < -SLOPE_LIMIT, "decreasing").otherwise("stable")
    return fitted.withColumn("direction", direction)


def regressions(metrics: DataFrame, base_sha: str, head_sha: str, threshold_pct: float = 20.0) -> DataFrame:
    """Entities whose mean grew by more than the threshold; one conditional aggregate, no join."""
    rows = metrics.filter(
        (F.col("metric_type") == "user_code") & (F.col("metric_name") == "fn_duration")
        & F.col("commit_sha").isin(base_sha, head_sha)
    )
    of = lambda sha: ranks.exact_mean(F.when(F.col("commit_sha") == sha, F.col("value")))
    means = rows.groupBy("repo", "entity_id").agg(of(base_sha).alias("base_val"), of(head_sha).alias("head_val"))
    return _grown(means, threshold_pct)


def commit_regressions(metrics: DataFrame, comparisons: DataFrame, threshold_pct: float = 20.0) -> DataFrame:
    """The same for a table of (repo, base_sha, head_sha) comparisons, from one mean per commit."""
    rows = metrics.filter((F.col("metric_type") == "user_code") & (F.col("metric_name") == "fn_duration"))
    means = rows.groupBy("repo", "entity_id", "commit_sha").agg(ranks.exact_mean(F.col("value")).alias("__v"))
    base = comparisons.join(
        means.select("repo", "entity_id", F.col("commit_sha").alias("base_sha"), F.col("__v").alias("base_val")), ["repo", "base_sha"]
    )
    head = means.select("repo", "entity_id", F.col("commit_sha").alias("head_sha"), F.col("__v").alias("head_val"))
    return _grown(base.join(head, ["repo", "entity_id", "head_sha"]), threshold_pct)


def _grown(means: DataFrame, threshold_pct: float) -> DataFrame:
    pct = (F.col("head_val") - F.col("base_val")) / F.nullif(F.col("base_val"), F.lit(0.0)) * 100
    return means.withColumn("pct_change", pct).filter(F.col("pct_change") > threshold_pct)


def metric_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("repo", "metric_type").agg(F.count(F.lit(1)).alias("cnt"))


def summary(metrics: DataFrame, snapshot: DataFrame, bottlenecks: DataFrame, top: int = 5) -> DataFrame:
    """Report rows per repository: (section, key, value), one row per entry."""
    entry = lambda df, section, key, value: df.select(
        "repo", F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value")
    )
    slow = slow_functions(metrics, top)
    return union_metrics(
        entry(snapshot, "pipeline_health", F.col("key"), F.col("value")),
        entry(slow, "top_slow_functions", F.concat_ws("#", F.col("rank"), F.col("entity_id")), F.col("value")),
        entry(bottlenecks, "active_bottlenecks", F.concat_ws("/", "category", "entity_id"), F.col("value")),
        entry(metric_counts(metrics), "metric_counts", F.col("metric_type"), F.col("cnt")),
    )
