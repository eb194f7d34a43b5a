"""Execution paths from call/return event rows.

Events are one row each, keyed by trace columns and ordered by the integer ``seq``. All
pairings are prefix scans (see ``functions.scan``), so a huge trace spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import labels, ranks, scan
from strandline.functions.text import matches_any
from strandline.session import cut_lineage

TASK = "task"
# Cross-run frequencies start at this many runs; state expires after this gap.
MIN_RUNS = 5
EXPIRY_DAYS = 7


def prune_events(events: DataFrame, excluded: Sequence[str], covered: DataFrame | None = None) -> DataFrame:
    """Drop events below excluded path prefixes; keep covered files only when a list is given.

    ``covered`` holds distinct (keys..., file) rows; columns shared with ``events`` are the keys.
    """
    kept = events
    for prefix in excluded:
        kept = kept.filter(~F.col("file").startswith(prefix))
    if covered is not None:
        kept = kept.join(covered, [c for c in covered.columns if c in events.columns], "left_semi")
    return kept


def retain_arguments(events: DataFrame, globs: Sequence[str] = tuple(labels.CAPTURE_GLOBS), keep_slash: bool = False) -> DataFrame:
    """Keep ``args`` of calls and ``return_val`` of returns only for matching functions."""
    wanted = matches_any(F.col("fn"), list(globs), keep_slash)
    return events.withColumns(
        {
            "args": F.when(wanted & (F.col("type") == "call"), F.col("args")),
            "return_val": F.when(wanted & (F.col("type") == "return"), F.col("return_val")),
        }
    )


def assign_tasks(events: DataFrame, keys: Sequence[str], by_goroutine: bool = False) -> DataFrame:
    """Task of each event: when no event of a trace names one, the whole trace is task 0.

    Since missing task ids count as 0, a trace without any is task 0 throughout; only the
    handling of async markers depends on the trace, which ``paired_calls`` deals with.
    """
    parts = [F.col("task_id")]
    if by_goroutine:
        parts.append(F.col("goroutine_id"))
    return events.withColumn(TASK, F.coalesce(*parts, F.lit(0)))


def paired_calls(
    events: DataFrame,
    keys: Sequence[str],
    exception_pops: bool = True,
    by_goroutine: bool = False,
) -> DataFrame:
    """Positional stack pairing per trace and task.

    A return (or exception) closes the latest open call of its task whatever its name; one
    without an open call is ignored. Output: one row per closed call with ``fn`` of the call,
    ``hop`` (depth before the call), ``avg_ms`` and ``seq`` of the return.
    """
    pops = ["return", "exception"] if exception_pops else ["return"]
    rows = assign_tasks(events, keys, by_goroutine).filter(F.col("type").isin("call", *pops))
    rows = rows.select(
        *keys, TASK, "seq", "type", "fn", "timestamp_ms",
        F.when(F.col("type") == "call", 1).otherwise(-1).alias("__step"),
    )
    rows = scan.range_chunks(rows, [*keys, TASK], ["seq"])
    levels = scan.stack_depth(rows, [*keys, TASK], "seq", "__step").filter(~F.col("orphan"))
    matched = scan.previous_row(
        levels, [*keys, TASK, "level"], "seq", ["type", "fn", "timestamp_ms", "seq"], "__open"
    )
    return matched.filter((F.col("type") != "call") & (F.col("__open.type") == "call")).select(
        *keys, TASK, "seq",
        F.col("__open.seq").alias("call_seq"),
        F.col("__open.fn").alias("fn"),
        F.col("level").alias("hop"),
        F.greatest(F.lit(0.0), F.col("timestamp_ms") - F.col("__open.timestamp_ms")).alias("avg_ms"),
    )


def linked_calls(events: DataFrame, pairs: DataFrame, keys: Sequence[str], by_goroutine: bool = False) -> DataFrame:
    """Order of the call sequence: the root task, then each linked child task.

    Adds ``link_pos`` (-1 for the root task, else ``seq`` of the async call). A task that is
    never linked is dropped; a task linked twice appears twice. Traces without task ids have
    only task 0. With ``by_goroutine``, as given to ``paired_calls``, every goroutine of a trace
    is a root of its own: no marker links goroutines.
    """
    root_rows = F.col(TASK) == 0
    if by_goroutine:
        own = events.filter(F.col("task_id").isNull() & F.col("goroutine_id").isNotNull())
        roots = own.select(*keys, F.col("goroutine_id").cast("bigint").alias(TASK)).distinct().withColumn("__root", F.lit(True))
        pairs = pairs.join(roots, [*keys, TASK], "left")
        root_rows = root_rows | F.coalesce("__root", F.lit(False))
    links = assign_tasks(
        events.filter((F.col("type") == "async_call") & F.col("task_id").isNotNull()), keys
    ).select(*keys, TASK, F.col("seq").alias("link_pos"))
    # An async marker without a task id links task 0 again, but only in traces that use task ids.
    unnamed = events.filter((F.col("type") == "async_call") & F.col("task_id").isNull())
    tasked = events.filter(F.col("task_id").isNotNull()).select(*keys).distinct()
    relinked = unnamed.join(tasked, list(keys), "left_semi").select(*keys, F.lit(0).cast("bigint").alias(TASK), F.col("seq").alias("link_pos"))
    root = pairs.filter(root_rows).drop("__root").withColumn("link_pos", F.lit(-1).cast("bigint"))
    children = pairs.drop("__root").join(links.unionByName(relinked), [*keys, TASK])
    return root.unionByName(children.select(root.columns))


def name_matched_calls(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairing by name: a return closes the latest open call of the same function.

    Exceptions are ignored. ``entity_id`` is file and function of the return; durations are
    raw differences.
    """
    rows = events.filter(F.col("type").isin("call", "return")).select(
        *keys, "seq", "type", "fn", "file", "timestamp_ms",
        F.when(F.col("type") == "call", 1).otherwise(-1).alias("__step"),
    )
    rows = scan.range_chunks(rows, [*keys, "fn"], ["seq"])
    levels = scan.stack_depth(rows, [*keys, "fn"], "seq", "__step").filter(~F.col("orphan"))
    matched = scan.previous_row(levels, [*keys, "fn", "level"], "seq", ["type", "timestamp_ms"], "__open")
    return matched.filter((F.col("type") == "return") & (F.col("__open.type") == "call")).select(
        *keys, "seq", "fn",
        F.concat_ws(":", "file", "fn").alias("entity_id"),
        (F.col("timestamp_ms") - F.col("__open.timestamp_ms")).alias("duration_ms"),
    )


def side_effects(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First occurrence of each (class, detail) per trace with the call depth it happened at.

    The depth counts every call, return and exception of the trace, whatever its task.
    """
    rows = events.filter(F.col("type").isin("call", "return", "exception")).select(
        *keys, "seq", "type", "fn", F.when(F.col("type") == "call", 1).otherwise(-1).alias("__step")
    )
    rows = scan.range_chunks(rows, keys, ["seq"])
    levels = scan.stack_depth(rows, list(keys), "seq", "__step").filter(F.col("type") == "call")
    found = levels.withColumn("kind", labels.side_effect(F.col("fn"))).filter(F.col("kind").isNotNull())
    return (
        found.groupBy(*keys, "kind", F.concat(F.lit("fn:"), F.col("fn")).alias("detail"))
        .agg(F.min(F.struct("seq", "level")).alias("__first"))
        .select(*keys, F.col("kind").alias("type"), "detail", F.col("__first.level").alias("hop_depth"), F.col("__first.seq").alias("seq"))
    )


def expiry_epochs(traces: DataFrame, keys: Sequence[str], run: str, ts: str, days: int = EXPIRY_DAYS) -> DataFrame:
    """Epoch of each trace: grows by one whenever the gap to the previous trace exceeds ``days``."""
    rows = scan.range_chunks(traces, keys, [run])
    rows = scan.previous_row(rows, keys, run, [ts], "__before")
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"__before.{ts}"))
    rows = rows.withColumn("__reset", F.when(gap > days * 86_400_000_000, 1).otherwise(0))
    return scan.running_sums(rows, keys, run, {"epoch": F.col("__reset")}).drop("__reset", "__before", scan.CHUNK)


def cross_run_frequencies(
    pairs: DataFrame, keys: Sequence[str], run: str, min_runs: int = MIN_RUNS, distinct_runs: bool = False,
    history: DataFrame | None = None,
) -> DataFrame:
    """Frequency ratio and mean time of each paired call against all runs so far.

    ``keys`` identify the entrypoint (with the expiry epoch when used) and ``run`` numbers its
    traces in order. Occurrences count once each unless ``distinct_runs``. Occurrences are
    summed per (entrypoint, function, run) first; only those rows enter the scans. ``history``
    (keys, fn, n, ms) is what was seen before these pairs and counts as run -1.
    """
    keys = list(keys)
    pairs = cut_lineage(pairs)  # read by three branches below
    per_run = pairs.groupBy(*keys, "fn", run).agg(
        F.count(F.lit(1)).alias("__n"), ranks.exact_sum(F.col("avg_ms")).alias("__ms")
    )
    if history is not None:
        per_run = per_run.unionByName(
            history.select(*keys, "fn", F.lit(-1).cast("bigint").alias(run), F.col("n").alias("__n"), F.col("ms").cast(ranks.SUM_TYPE).alias("__ms"))
        )
    occurrences = F.lit(1).cast("bigint") if distinct_runs else F.col("__n")
    per_run = scan.range_chunks(per_run, [*keys, "fn"], [run])
    cumulative = scan.running_sums(
        per_run, [*keys, "fn"], run, {"runs": occurrences, "total_n": F.col("__n"), "total_ms": F.col("__ms")}
    ).drop(scan.CHUNK, "__n", "__ms")
    tops = cumulative.groupBy(*keys, run).agg(F.max("runs").alias("__top"))
    earlier = scan.running_max_before(scan.range_chunks(tops, keys, [run]), keys, run, "__top", "__earlier")
    totals = earlier.select(*keys, run, (F.coalesce("__earlier", F.lit(0)) + 1).alias("total_runs"))
    joined = pairs.join(cumulative, [*keys, "fn", run]).join(totals, [*keys, run])
    enough = F.col("total_runs") >= min_runs
    mean = F.col("total_ms").cast("double") / F.col("total_n" if distinct_runs else "runs")
    return joined.withColumns(
        {
            "frequency_ratio": F.when(enough, F.least(F.lit(1.0), F.col("runs") / F.col("total_runs"))).otherwise(1.0),
            "avg_ms": F.when(enough, mean).otherwise(F.col("avg_ms")),
        }
    ).drop("total_ms", "total_n")


def path_timings(calls: DataFrame, traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p50 and p99 of the positive call times of each trace, else of the trace duration itself."""
    measured = ranks.median_and_p99(calls.filter(F.col("avg_ms") > 0).select(*keys, "avg_ms"), keys, "avg_ms")
    return traces.select(*keys, "duration_ms").join(measured, list(keys), "left").select(
        *keys,
        F.coalesce("p50", "duration_ms").alias("timing_p50_ms"),
        F.coalesce("p99", "duration_ms").alias("timing_p99_ms"),
    )


def path_coverage(calls: DataFrame, traces: DataFrame, keys: Sequence[str], reported: str | None = None) -> DataFrame:
    """Share of calls with a positive frequency; null without calls; a reported value wins."""
    share = calls.groupBy(*keys).agg(F.avg((F.col("frequency_ratio") > 0).cast("double")).alias("__share"))
    joined = traces.join(share, list(keys), "left")
    value: Column = F.col("__share") if reported is None else F.coalesce(F.col(reported), F.col("__share"))
    return joined.select(*keys, value.alias("coverage_pct"))


def observed_functions(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.filter(F.col("type") == "call").select(*keys, "fn").distinct()


def resolve_functions(rows: DataFrame, nodes: DataFrame, name: str = "fn") -> DataFrame:
    """Node id of each (repo, function): active node of that name, smallest id first.

    Rows that resolve to nothing keep the name as their id. The join runs on one row per
    (repo, name), so a name shared by many nodes never multiplies the calls.
    """
    best = (
        nodes.filter(F.col("active"))
        .groupBy("repo", F.col("name").alias(name))
        .agg(F.min(F.struct("stable_id", "qualified_name")).alias("__n"))
    )
    joined = rows.join(best, ["repo", name], "left")
    return joined.select(
        *rows.columns,
        F.coalesce("__n.stable_id", F.col(name)).alias("stable_id"),
        F.col("__n.qualified_name").alias("qualified_name"),
        F.col("__n.stable_id").isNotNull().alias("resolved"),
    )


def resolve_functions_in_files(rows: DataFrame, nodes: DataFrame, name: str = "fn") -> DataFrame:
    """As ``resolve_functions``, preferring a node of the event's own ``file``."""
    active = nodes.filter(F.col("active"))
    local = active.groupBy("repo", F.col("name").alias(name), F.col("file_path").alias("file")).agg(
        F.min(F.struct("stable_id", "qualified_name")).alias("__near")
    )
    anywhere = active.groupBy("repo", F.col("name").alias(name)).agg(
        F.min(F.struct("stable_id", "qualified_name")).alias("__far")
    )
    joined = rows.join(local, ["repo", name, "file"], "left").join(anywhere, ["repo", name], "left")
    node = F.coalesce("__near", "__far")
    return joined.select(
        *rows.columns,
        F.coalesce(node["stable_id"], F.col(name)).alias("stable_id"),
        node["qualified_name"].alias("qualified_name"),
        node.isNotNull().alias("resolved"),
    )


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return packed.select(*keys, "__r.*")


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return packed.select(*keys, "__r.*").select(df.columns)

