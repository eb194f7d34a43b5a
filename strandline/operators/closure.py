"""Reachability over call edges, and what is derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written

# Rounds of single edges before runs are contracted.
SHALLOW = 6


def contract_chains(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between crossings, and what lies between them.

    A node inside a chain has one edge in, one edge out and is not in ``keep`` (node). Result: ``edges`` (source, target,
    chain) between all other nodes, a run of inner nodes being one edge that carries the run's first node as its chain;
    and ``members`` (chain, node). First nodes are found by doubling the distance looked back, so a run of any
    length takes as many rounds as its length has binary digits. A ring without a kept node has no way in from
    outside; it is left out.
    """
    pairs = written(edges.select("source", "target").where("source is not null and target is not null").distinct(), "pairs")
    into = pairs.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("source").alias("before"))
    out = pairs.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("target").alias("after"))
    single = into.join(out, "node").where("n_in = 1 and n_out = 1 and before <> node")
    inner = written(single.join(keep.select("node").distinct(), "node", "left_anti").select("node", "before", "after"), "inner")
    names = inner.select(F.col("node").alias("__b"))
    linked = inner.join(names, F.col("before") == F.col("__b"), "left")
    jumps = written(linked.select("node", F.coalesce("__b", "node").alias("first"), F.col("__b").isNull().alias("head")), "jumps")
    heads = jumps.where("head").select(F.col("node").alias("chain"))
    for _ in range(max(1, inner.count()).bit_length()):
        ahead = jumps.select(F.col("node").alias("first"), F.col("first").alias("__next"))
        # A first node points at itself; the others move on until they all point at first nodes.
        moved = jumps.join(ahead, "first").select("node", F.col("__next").alias("first"), (F.col("first") != F.col("__next")).alias("head"))
        jumps = written(moved, "jumps")
        if jumps.where("head").isEmpty():
            break
    members = written(jumps.select(F.col("first").alias("chain"), "node").join(heads, "chain", "left_semi"), "members")
    # A run starts behind the node before its first one and ends in front of the node behind its last one.
    runs = members.join(inner, "node")
    begins = runs.where("chain = node").select("chain", F.col("before").alias("source"))
    ends = runs.join(names, F.col("after") == F.col("__b"), "left_anti").select("chain", F.col("after").alias("target"))
    whole = begins.join(ends, "chain").select("source", "target", "chain")
    outer = inner.select("node")
    plain = pairs.join(outer, F.col("source") == F.col("node"), "left_anti").join(outer, F.col("target") == F.col("node"), "left_anti")
    none = F.lit(None).cast(dict(pairs.dtypes)["source"])
    return written(plain.select("source", "target", none.alias("chain")).unionByName(whole), "crossings"), members


def transitive_closure(entries: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Distinct (entry, node) pairs with at least one call path from entry to node.

    Semi-naive: only pairs found in the last round are extended, pairs already known are removed by an anti-join, so
    cycles end. Each round is written once. An entry is its own node only when a cycle leads back to it. Where paths go
    on after ``SHALLOW`` rounds, runs of nodes without branches are contracted, so that a run is one further step; what
    lies inside of runs is attached at the end. With ``max_hops`` every edge is a step.
    """
    asked = entries.select("entry").distinct()
    links = edges.select("source", "target")
    near, ended = _steps(asked, links, SHALLOW if max_hops is None else max_hops)
    if ended or max_hops is not None:
        return near
    crossings, members = contract_chains(edges, asked.select(F.col("entry").alias("node")))
    reached = written(_steps(asked, crossings.select("source", "target").distinct())[0], "reached")
    starts = reached.unionAll(asked.select("entry", F.col("entry").alias("node"))).distinct()
    through = crossings.where("chain is not null").select(F.col("source").alias("node"), "chain")
    inside = starts.join(through, "node").select("entry", "chain").distinct().join(members, "chain").select("entry", "node")
    return reached.unionAll(inside)


def _steps(entries: DataFrame, edges: DataFrame, max_hops: int | None = None) -> tuple[DataFrame, bool]:
    """Pairs within ``max_hops`` rounds, and whether the last round found nothing more."""
    steps = edges.select(F.col("source").alias("__at"), F.col("target").alias("node"))
    found = entries.withColumn("__at", F.col("entry")).join(steps, "__at")
    rounds, ended = [written(found.select("entry", "node").distinct(), "round")], False

    def known() -> DataFrame:
        whole = rounds[0]
        for later in rounds[1:]:
            whole = whole.unionAll(later)
        return whole

    while not ended and (max_hops is None or len(rounds) < max_hops):
        ahead = rounds[-1].select("entry", F.col("node").alias("__at")).join(steps, "__at").select("entry", "node").distinct()
        fresh = written(ahead.join(known(), ["entry", "node"], "left_anti"), "round")
        ended = fresh.isEmpty()
        if not ended:
            rounds.append(fresh)
    return known(), ended


def greatest_reachable(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the greatest value (node, value) on any node that a path of ``edges`` leads to.

    A fixed point over (max, max): values flow back along edges, a round moves only those that rose in the last one, and
    each node keeps one value. No pairs of nodes are formed, cycles end since a value only rises. Null values count
    for nothing.
    """
    links = edges.select("source", F.col("target").alias("node")).where("source is not null and node is not null")
    own = values.where("value is not null").groupBy("node").agg(F.max("value").alias("value"))
    best = written(_raised(own, links), "greatest")
    rose = best
    while not rose.isEmpty():
        offered = _raised(rose, links).withColumnRenamed("value", "offer")
        joined = offered.join(best, "node", "left")
        rose = written(joined.where("value is null or offer > value").select("node", F.col("offer").alias("value")), "rose")
        best = written(best.unionAll(rose).groupBy("node").agg(F.max("value").alias("value")), "greatest")
    return best


def _raised(values: DataFrame, links: DataFrame) -> DataFrame:
    """The greatest value that each node's targets hold; combined in the tasks that read the edges."""
    return links.join(values, "node").groupBy(F.col("source").alias("node")).agg(F.max("value").alias("value"))


def entries_with_changed_dependencies(edges: DataFrame, nodes: DataFrame, last_traced: DataFrame) -> DataFrame:
    """Traced entries that reach a node updated after their last trace, by ``edges`` (source, target)."""
    updated = nodes.select(F.col("stable_id").alias("node"), F.col("updated_at").alias("value"))
    newest = greatest_reachable(edges, updated)
    traced = last_traced.select(F.col("stable_id").alias("node"), "last_traced_at")
    return newest.join(traced, "node").filter(F.col("value") > F.col("last_traced_at")).select(F.col("node").alias("stable_id"))


def reconcile(observed: DataFrame, static: DataFrame, names: Sequence[str] = ("entry", "target")) -> dict[str, DataFrame]:
    """Observed functions against the static closure of each entry.

    ``observed``: distinct (entry, fn). ``static``: distinct (entry, source, target) by name.
    Result: ``dynamic_only`` (entry, target), ``never_observed`` (entry, source, target) and
    ``confirmed`` (entry, source, target), the part in neither list.
    """
    mentioned = static.select("entry", F.col("target").alias("fn")).unionAll(static.select("entry", F.col("source").alias("fn")))
    seen = observed.select("entry", F.col("fn").alias("target"))
    return {
        "dynamic_only": observed.join(mentioned, ["entry", "fn"], "left_anti").select("entry", F.col("fn").alias("target")),
        "never_observed": static.join(seen, ["entry", "target"], "left_anti").select("entry", "source", "target"),
        "confirmed": static.join(seen, ["entry", "target"], "left_semi").select("entry", "source", "target"),
    }
