"""Stream handlers that keep tables up to date. Each returns a ``foreachBatch`` function.

State lives in change logs (merged on read) or numbered snapshots; both are written under the
batch number, so replaying a batch leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import diff, metrics, provenance, resolve, specs, traces
from strandline.session import cut_lineage
from strandline.sources.tables import ChangeLog, Snapshots, delete_vectors, tombstone, upsert_edges, upsert_nodes, upsert_vectors

Handler = Callable[[DataFrame, int], None]


class GraphLog:
    """Nodes, edges and tombstones of a change stream, applied when read.

    Ends of an edge are checked at reading time, so an edge may arrive before its nodes.
    """

    NODES = "stable_id string, name string, type string, file_path string, repo string, node_hash string"
    EDGES = "source string, target string"
    GONE = "stable_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.nodes, self.edges, self.gone = (ChangeLog(spark, f"{path}/{part}") for part in ("nodes", "edges", "gone"))

    def handler(self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]) -> Handler:
        """``split`` turns a batch into (node rows, edge rows, deleted ids)."""

        def each(batch: DataFrame, batch_id: int) -> None:
            for log, rows in zip((self.nodes, self.edges, self.gone), split(batch)):
                log.append(rows, batch_id)

        return each

    def current(self, nodes: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """Base tables with all logged changes; within a batch deletions come last."""
        changed, linked, gone = self.nodes.read(self.NODES), self.edges.read(self.EDGES), self.gone.read(self.GONE)
        deleted_at = gone.groupBy("stable_id").agg(F.max("batch").alias("__gone_in"))
        seen_at = changed.groupBy("stable_id").agg(F.max("batch").alias("__seen_in"))
        final = deleted_at.join(seen_at, "stable_id", "left").filter(F.coalesce("__seen_in", F.lit(-1)) <= F.col("__gone_in"))
        merged = upsert_nodes(nodes, changed, now, ["batch"])
        # Edges survive a deletion of one end only when they were written after it.
        newest = linked.groupBy("source", "target").agg(F.max("batch").alias("__in"))
        base = edges
        for end in ("source", "target"):
            at_end = deleted_at.withColumnRenamed("stable_id", end)
            newest = newest.join(at_end, end, "left").filter(F.col("__gone_in").isNull() | (F.col("__in") > F.col("__gone_in"))).drop("__gone_in")
            base = base.join(at_end.select(end), end, "left_anti")
        flagged, _ = tombstone(merged, edges, final, now)
        return flagged, upsert_edges(base.select(edges.columns), newest, flagged.filter(F.col("active")), now)


def log_handler(log: ChangeLog, select: Callable[[DataFrame], DataFrame] = lambda b: b) -> Handler:
    """Append ``select(batch)`` under the batch number (spec upserts, vector deletes, metrics)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.append(select(batch), batch_id)

    return each


def current_specs(base: DataFrame, log: ChangeLog, schema: str, now: Column, order: Sequence[str]) -> DataFrame:
    """Specs from their log: as many versions as logged rows, the last row's text."""
    return specs.upsert_specs(base, log.read(schema), now, ["batch", *order])


def current_vectors(base: DataFrame, upserts: DataFrame | None, deleted: DataFrame) -> DataFrame:
    merged = base if upserts is None else upsert_vectors(base, upserts, order=["batch"])
    return delete_vectors(merged, deleted)


FREQUENCY_STATE = "repo string, entry_id bigint, fn string, n bigint, ms double, last_ts timestamp"


def frequency_handler(state: Snapshots, out: ChangeLog, days: int = traces.EXPIRY_DAYS) -> Handler:
    """Running frequencies per (repo, entry, function) over batches of trace events.

    The state holds one row per function; an entry idle for longer than ``days`` starts anew.
    Inside a batch the scans of ``traces.cross_run_frequencies`` apply.
    """
    entry = ["repo", "entry_id"]

    def each(events: DataFrame, batch_id: int) -> None:
        before = state.read(FREQUENCY_STATE, before=batch_id)
        runs = events.groupBy(*entry, "trace_id", "run_no").agg(F.min(F.col("ts").cast("timestamp")).alias("started"))
        previous = before.groupBy(*entry).agg(F.max("last_ts").alias("started"))
        marked = runs.unionByName(previous.select(*entry, F.lit(None).cast("string").alias("trace_id"), F.lit(-1).cast("bigint").alias("run_no"), "started"))
        epochs = traces.expiry_epochs(marked, entry, "run_no", "started", days).filter(F.col("trace_id").isNotNull()).select(*entry, "trace_id", "epoch")
        epochs = cut_lineage(epochs)
        pairs = cut_lineage(traces.paired_calls(events.join(epochs, [*entry, "trace_id"]), [*entry, "trace_id", "run_no", "epoch"]))
        history = before.select(*entry, "fn", "n", "ms").withColumn("epoch", F.lit(0).cast("bigint"))
        rated = traces.cross_run_frequencies(pairs, [*entry, "epoch"], "run_no", history=history)
        out.append(rated.select(*entry, "trace_id", "seq", "fn", "hop", "frequency_ratio", "avg_ms", "runs", "total_runs"), batch_id)
        last = runs.join(epochs, [*entry, "trace_id"]).groupBy(*entry).agg(F.max("started").alias("__last"), F.max("epoch").alias("__epoch"))
        fresh = pairs.join(last, entry).filter(F.col("epoch") == F.col("__epoch")).groupBy(*entry, "fn").agg(
            F.count(F.lit(1)).alias("n"), F.sum("avg_ms").alias("ms")
        )
        kept = before.join(last, entry, "left").filter(F.coalesce("__epoch", F.lit(0)) == 0).select(*entry, "fn", "n", "ms", "last_ts")
        whole = kept.select(*entry, "fn", "n", "ms").unionByName(fresh).groupBy(*entry, "fn").agg(F.sum("n").alias("n"), F.sum("ms").alias("ms"))
        times = kept.groupBy(*entry).agg(F.max("last_ts").alias("__old")).join(last.select(*entry, "__last"), entry, "full")
        state.write(whole.join(times, entry).select(*entry, "fn", "n", "ms", F.coalesce("__last", "__old").alias("last_ts")), batch_id)

    return each


def path_handler(calls: ChangeLog, effects: ChangeLog, keys: Sequence[str]) -> Handler:
    """Trace events to path rows: linked calls and side effects. A trace arrives in one batch."""

    def each(events: DataFrame, batch_id: int) -> None:
        pairs = traces.paired_calls(events, keys)
        calls.append(traces.linked_calls(events, pairs, keys), batch_id)
        effects.append(traces.side_effects(events, keys), batch_id)

    return each


LAG_STATE = "repo string, entity string, position bigint, ts timestamp, kind string"


def lag_handler(state: Snapshots, out: ChangeLog) -> Handler:
    """Lag of paths behind traces across batches: the last message of a key is carried over."""

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = state.read(LAG_STATE, before=batch_id)
        rows = carried.unionByName(batch.select("repo", "entity", "position", F.col("ts").cast("timestamp").alias("ts"), "kind"))
        out.append(metrics.processing_lags(rows, ["repo", "entity"], "position", "ts"), batch_id)
        state.write(traces.latest_row(rows, ["repo", "entity"], ["position"]).select(carried.columns), batch_id)

    return each


PENDING_STATE = "source_stable_id string, target_name string, path_hint string, edge_type string, repo string, attempted_at timestamp, attempt_count int"


def import_handler(state: Snapshots, edges: ChangeLog, nodes: Callable[[], DataFrame], now: Callable[[], Column]) -> Handler:
    """Import nodes to edges; what stays unresolved waits and is retried with the repository's next batch."""

    def each(imports: DataFrame, batch_id: int) -> None:
        known = nodes()
        refs = resolve.import_targets(imports)
        found, unresolved = resolve.resolve_imports(refs.filter(F.col("kind") == "from").drop("kind"), known, once=True)
        waiting = state.read(PENDING_STATE, before=batch_id)
        # Fresh failures are retried right away together with the older ones.
        waiting = waiting.unionByName(resolve.new_pending(unresolved, now()).select(waiting.columns))
        retried, pending = resolve.retry_pending(waiting, known, imports.select("repo").distinct(), now(), once=True)
        edges.append(found.unionByName(retried).distinct(), batch_id)
        state.write(pending, batch_id)

    return each


def provenance_handler(nodes: Snapshots, edges: Snapshots, node_schema: str, edge_schema: str,
                       split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], now: Callable[[], Column]) -> Handler:
    """Provenance pass per batch. It rewrites both snapshots, so give it a coarse trigger."""

    def each(batch: DataFrame, batch_id: int) -> None:
        paths, calls, dynamic = split(batch)
        updated, settled = provenance.provenance_pass(
            nodes.read(node_schema, before=batch_id), edges.read(edge_schema, before=batch_id), paths, calls, dynamic, now()
        )
        nodes.write(updated, batch_id)
        edges.write(settled, batch_id)

    return each


MARK_STATE = "repo string, last_sha string"


def commit_handler(state: Snapshots, emit: Callable[[DataFrame, int], None]) -> Handler:
    """New commits per repository; the mark advances only after the work was emitted."""

    def each(commits: DataFrame, batch_id: int) -> None:
        work, marks = diff.advance_marks(state.read(MARK_STATE, before=batch_id), commits)
        emit(work, batch_id)
        state.write(marks, batch_id)

    return each
