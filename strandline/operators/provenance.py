"""Folding execution paths back into the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import written

# Traces of a chunk; a list of observations holds one id's traces of a chunk.
CHUNK_TRACES = 4096
# Fixed value: detail of a conflicting edge.
CONFLICT_DETAIL = "in AST but never observed in traces"


def node_records(paths: DataFrame, calls: DataFrame) -> DataFrame:
    """One record per call of every path, plus the entrypoint where its path lacks it.

    ``paths``: (trace_id, trace_no, entry, timing_p50_ms); ``calls``: (trace_id, trace_no, seq,
    stable_id, avg_ms, frequency_ratio).
    """
    records = calls.select("trace_id", "trace_no", "seq", "stable_id", F.col("avg_ms").alias("latency"), F.col("frequency_ratio").alias("coverage"))
    entry = paths.select(
        "trace_id", "trace_no", F.lit(None).cast("bigint").alias("seq"), F.col("entry").alias("stable_id"),
        F.col("timing_p50_ms").alias("latency"), F.lit(1.0).alias("coverage"),
    )
    missing = entry.join(calls.select("trace_id", "stable_id"), ["trace_id", "stable_id"], "left_anti")
    return records.unionByName(missing)


def update_nodes(nodes: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Counts add up; the last record's latency and coverage win; unknown ids are ignored."""
    last = F.struct("trace_no", "seq", "latency", "coverage")
    totals = records.groupBy("stable_id").agg(F.count(F.lit(1)).cast("int").alias("__n"), F.max(last).alias("__last"))
    joined = nodes.join(totals, "stable_id", "left")
    seen = F.col("__n").isNotNull()
    return joined.select(
        *[c for c in nodes.columns if c not in ("observed_calls", "avg_latency_ms", "branch_coverage", "last_traced_at")],
        F.when(seen, F.coalesce("observed_calls", F.lit(0)) + F.col("__n")).otherwise(F.col("observed_calls")).alias("observed_calls"),
        F.when(seen, F.col("__last.latency")).otherwise(F.col("avg_latency_ms")).alias("avg_latency_ms"),
        F.when(seen, F.col("__last.coverage")).otherwise(F.col("branch_coverage")).alias("branch_coverage"),
        F.when(seen, now).otherwise(F.col("last_traced_at")).alias("last_traced_at"),
    )


def calls_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(CALLS edges, all others): only the former can change here, so the others take part in no join."""
    calls = F.col("type").eqNullSafe("CALLS")
    return edges.filter(calls), edges.filter(~calls)


def upsert_dynamic_edges(edges: DataFrame, dynamic: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dynamic CALLS edges whose ends exist: counts add up, an assigned provenance stays."""
    counted = dynamic.groupBy("source", "target").agg(F.sum("count").alias("__n"))
    ids = nodes.select("stable_id")
    for end in ("source", "target"):
        counted = counted.join(ids.withColumnRenamed("stable_id", end), end, "left_semi")
    counted = counted.withColumn("type", F.lit("CALLS"))
    calls, others = calls_of(edges)
    joined = calls.join(counted, ["source", "target", "type"], "full")
    seen = F.col("__n").isNotNull()
    kept = F.col("provenance").isin("static", "confirmed", "conflict")
    provenance = F.when(~seen | kept, F.col("provenance")).otherwise("dynamic")
    count = F.when(seen, F.coalesce("observed_count", F.lit(0)) + F.col("__n")).otherwise(F.col("observed_count"))
    return joined.withColumns({"provenance": provenance, "observed_count": count}).select(edges.columns).unionByName(others)


def trace_lists(observed: DataFrame, ends: DataFrame) -> DataFrame:
    """(stable_id, chunk, traces): the traces that observed each id of ``ends`` (stable_id), in lists of one chunk.

    Traces are dealt to chunks of about ``CHUNK_TRACES`` by hash, so that a list is short however often an id was
    observed, and two ids met in a trace exactly when their lists of some chunk overlap.
    """
    pairs = observed.select("trace_id", "stable_id").where("trace_id is not null")
    chunks = max(1, -(-pairs.select("trace_id").distinct().count() // CHUNK_TRACES))
    asked = pairs.join(ends.select("stable_id").distinct(), "stable_id", "left_semi").distinct()
    chunk = F.pmod(F.xxhash64("trace_id"), F.lit(chunks)).alias("chunk")
    return written(asked.groupBy("stable_id", chunk).agg(F.collect_list("trace_id").alias("traces")), "trace-lists")


def met_pairs(pairs: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct (source, target) of ``pairs`` with both ends observed in one trace.

    The end that fewer traces observed leads: its lists are compared with the other's of the same chunk. One chunk
    of each pair is looked at first, which settles pairs of frequent ends; only pairs without a hit go on to all chunks.
    """
    # The ends, the counts and both rounds read the pairs.
    wanted = written(pairs.select("source", "target").distinct(), "pairs")
    ends = wanted.select(F.col("source").alias("stable_id")).unionAll(wanted.select(F.col("target").alias("stable_id")))
    lists = trace_lists(observed, ends)
    counts = lists.groupBy("stable_id").agg(F.sum(F.size("traces")).alias("n"))
    of = lambda end: counts.select(F.col("stable_id").alias(end), F.col("n").alias(f"n_{end}"))
    both = wanted.join(of("source"), "source").join(of("target"), "target")
    rarer = F.col("n_source") <= F.col("n_target")
    lead, other = F.when(rarer, F.col("source")).otherwise(F.col("target")), F.when(rarer, F.col("target")).otherwise(F.col("source"))
    led = both.select("source", "target", lead.alias("lead"), other.alias("other"))
    others = lists.select(F.col("stable_id").alias("other"), "chunk", F.col("traces").alias("met"))

    def hits(some: DataFrame, leading: DataFrame) -> DataFrame:
        placed = some.join(leading.withColumnRenamed("stable_id", "lead"), "lead").join(others, ["other", "chunk"])
        return placed.where(F.arrays_overlap("traces", "met")).select("source", "target").distinct()

    low = lists.groupBy("stable_id").agg(F.min("chunk").alias("chunk"))
    settled = written(hits(led, lists.join(low, ["stable_id", "chunk"], "left_semi")), "settled")
    return settled.unionAll(hits(led.join(settled, ["source", "target"], "left_anti"), lists))


def confirm_static_edges(edges: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """Static CALLS edges with both ends observed in one trace become confirmed, counted once.

    Both inputs are read twice; callers write what is not a table.
    """
    fits = F.coalesce((F.col("provenance") == "static") & (F.col("type") == "CALLS"), F.lit(False))
    static = edges.filter(fits)
    hit = met_pairs(static, observed).withColumn("__hit", F.lit(True))
    joined = static.join(hit, ["source", "target"], "left")
    confirmed = F.col("__hit").isNotNull()
    joined = joined.withColumns(
        {
            "observed_count": F.when(confirmed, F.coalesce("observed_count", F.lit(0)) + 1).otherwise(F.col("observed_count")),
            "confirmed_at": F.when(confirmed, now).otherwise(F.col("confirmed_at")),
            "provenance": F.when(confirmed, "confirmed").otherwise(F.col("provenance")),
        }
    )
    return joined.select(edges.columns).unionByName(edges.filter(~fits))


def settle_edges(edges: DataFrame, nodes: DataFrame, detect_conflicts: bool = True, downgrade_stale: bool = True) -> DataFrame:
    """Conflicts, then stale confirmations, decided from one join with the source node.

    A static, never counted CALLS edge of a traced source conflicts. A confirmed one whose
    source changed after the confirmation is static again, without counters.
    """
    sources = nodes.select(F.col("stable_id").alias("source"), F.col("last_traced_at").alias("__traced"), F.col("updated_at").alias("__updated"))
    joined = edges.join(sources, "source", "left")
    calls = F.col("type") == "CALLS"
    conflict = F.lit(False)
    if detect_conflicts:
        conflict = calls & (F.col("provenance") == "static") & F.col("observed_count").isNull() & F.col("__traced").isNotNull()
    stale = F.lit(False)
    if downgrade_stale:
        stale = F.coalesce(calls & (F.col("provenance") == "confirmed") & (F.col("__updated") > F.col("confirmed_at")), F.lit(False))
    return joined.withColumns(
        {
            "detail": F.when(conflict, CONFLICT_DETAIL).otherwise(F.col("detail")),
            "observed_count": F.when(stale, F.lit(None)).otherwise(F.col("observed_count")),
            "confirmed_at": F.when(stale, F.lit(None)).otherwise(F.col("confirmed_at")),
            "provenance": F.when(conflict, "conflict").when(stale, "static").otherwise(F.col("provenance")),
        }
    ).select(edges.columns)


def provenance_pass(nodes: DataFrame, edges: DataFrame, paths: DataFrame, calls: DataFrame, dynamic: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One batch in fixed order: nodes, dynamic edges, confirmation, conflicts, staleness."""
    # The node update, the edge confirmation and its two passes read both again.
    records = written(node_records(paths, calls), "records")
    updated = update_nodes(nodes, records, now)
    linked = written(upsert_dynamic_edges(edges, dynamic, nodes), "linked")
    observed = records.select("trace_id", "stable_id")
    calls, others = calls_of(linked)
    settled = settle_edges(confirm_static_edges(calls, observed, now), updated)
    return updated, settled.unionByName(others)
