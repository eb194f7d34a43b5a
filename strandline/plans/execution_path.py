"""Trace events to execution paths, end to end: pairing, frequencies, effects, timings, coverage, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import closure, metrics
from strandline.operators import traces as tr
from strandline.session import written


@dataclass
class ExecutionPaths:
    """Rows of the paths of all traces; nothing of a trace is gathered, so a path may have any length."""

    calls: DataFrame  # keys, task, seq, fn, hop, avg_ms, frequency_ratio, stable_id, resolved
    effects: DataFrame  # keys, type, detail, hop_depth, seq
    dynamic_only: DataFrame  # entry, target
    never_observed: DataFrame  # entry, source, target
    paths: DataFrame  # keys, entry, timing_p50_ms, timing_p99_ms, coverage_pct, n_calls, n_effects, n_dynamic_only, n_never_observed
    metrics: DataFrame  # metric rows of each path


def execution_paths(events: DataFrame, traces: DataFrame, nodes: DataFrame, static: DataFrame, keys: Sequence[str],
                    entry: str, run: str, reported: str | None = None) -> ExecutionPaths:
    """Paths of ``traces`` (keys, entry, run, duration_ms) from their ``events``.

    ``nodes``: (stable_id, repo, name, qualified_name, file_path, active); ``static``: (entry, source, target) edges that
    the code of an entry can reach. A frequency counts runs of the same (repo, entry); observed functions of all
    runs of an entry are compared with its static edges. Calls that resolve to no node keep their name as id.
    """
    keys = list(keys)
    groups = list(dict.fromkeys(["repo", entry]))
    paired = tr.paired_calls(events, [*keys, run])
    calls = tr.cross_run_frequencies(paired, groups, run)
    # Timings, coverage, records and reconciliation read the calls again.
    calls = written(tr.resolve_functions(calls, nodes), "path-calls")
    effects = written(tr.side_effects(events, keys), "path-effects")
    timings = tr.path_timings(calls, traces, keys)
    coverage = tr.path_coverage(calls, traces, keys, reported)
    observed = calls.select(F.col(entry).cast("string").alias("entry"), F.col("stable_id").alias("fn")).distinct()
    differences = closure.reconcile(observed, static)
    dynamic = written(differences["dynamic_only"].distinct(), "dynamic-only")
    never = written(differences["never_observed"].distinct(), "never-observed")
    count = lambda df, by, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    paths = traces.select(*keys, F.col(entry).cast("string").alias("entry")).join(timings, keys).join(coverage, keys)
    paths = paths.join(count(calls, keys, "n_calls"), keys, "left").join(count(effects, keys, "n_effects"), keys, "left")
    paths = paths.join(count(dynamic, ["entry"], "n_dynamic_only"), "entry", "left").join(count(never, ["entry"], "n_never_observed"), "entry", "left")
    paths = paths.fillna(0, ["n_calls", "n_effects", "n_dynamic_only", "n_never_observed"])
    return ExecutionPaths(calls, effects, dynamic, never, paths, metrics.path_metrics_from_rows(traces, calls, effects, timings, keys, entry))
