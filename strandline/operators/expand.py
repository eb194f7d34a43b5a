"""Best-score graph expansion, budget pruning and edge collection for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import labels
from strandline.operators.search import DECAY, HOP_DEPTH, MAX_TOKENS
from strandline.session import SORTED_LISTS, removed, run_folder, setting, written

# A query with more rows to go on from, or with a row of more steps than that, has its finds in parts.
FRONTIER, HUB, PARTS = 1_000, 10_000, 64
# Queries, and nodes with their steps, are dealt to slices; as many are worked on at once as have about so many rows.
SLICES, SLICE_ROWS = 8, 3_000_000
# The slice of a node, in tables that have a folder for each.
AT = "__at"
# 64-bit words of the sketch of a query's nodes.
WORDS = 4

# Edge types a query type follows, and whether along or against them.
RULES = {
    "flow": ("out", ["CALLS", "IMPORTS", "INHERITS"]),
    "lookup": ("out", ["DEFINES", "IMPORTS", "INHERITS"]),
    "impact": ("in", ["CALLS", "TESTED_BY"]),
}


def direction(query_type: Column) -> Column:
    chain = F
    for name, (way, _) in RULES.items():
        chain = chain.when(query_type == name, way)
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown query_type "), query_type)))


def follows(query_type: Column, edge_type: Column) -> Column:
    allowed = F.lit(False)
    for name, (_, types) in RULES.items():
        allowed = allowed | ((query_type == name) & edge_type.isin(types))
    return allowed


def moves(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Edges as steps (way, parent_id, stable_id, edge_type, provenance).

    Types of no weight would be scored 0 and dropped, so they are left out before any join;
    backward steps exist only for the types some query follows backwards.
    """
    weighted = edges.filter(labels.edge_weight(F.col("type"), weights) > 0)
    # The same edge stored twice offers the same step twice; the best of equals is one row.
    backward = sorted({kind for way, kinds in RULES.values() if way == "in" for kind in kinds})
    step = lambda way, parent, child: F.struct(F.lit(way).alias("way"), F.col(parent).alias("parent_id"), F.col(child).alias("stable_id"))
    out, back = step("out", "source", "target"), step("in", "target", "source")
    # Edges may be costly to make: they are read once for both ways.
    ways = F.explode(F.when(F.col("type").isin(backward), F.array(out, back)).otherwise(F.array(out)))
    return weighted.select(ways.alias("s"), F.col("type").alias("edge_type"), "provenance").select("s.*", "edge_type", "provenance")


def bundles(steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """Steps of one kind from one node as one row (way, parent_id, edge_type, provenance, ``ends``).

    They score alike, so they meet a frontier row and move as one. A node with very many steps has them in parts, dealt to
    several tasks; ``hubs`` holds (way, parent_id, n) of such nodes.
    """
    dealt = F.coalesce(F.pmod(F.xxhash64("stable_id"), F.ceil(F.col("n") / HUB)), F.lit(0))
    dealt_steps = steps.join(hubs, ["parent_id", "way"], "left").withColumn("__deal", dealt).drop("n")
    kind = ["parent_id", "way", "edge_type", "provenance", "__deal"]
    # There are nearly as many kinds as steps: they are not gathered before they move.
    return dealt_steps.repartition("parent_id", "way", "__deal").groupBy(*kind).agg(F.collect_list("stable_id").alias("ends")).drop("__deal")


def neighbors(frontier: DataFrame, steps: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Frontier rows (query_id, query_type, stable_id, score, ``carried``) joined to the steps they may take."""
    asked = frontier.select(
        "query_id", "query_type", direction(F.col("query_type")).alias("way"), F.col("stable_id").alias("parent_id"), "score", *carried
    )
    # Rows are compared by the first key, which tells most of them apart.
    joined = asked.join(steps, ["parent_id", "way"])
    return joined.filter(follows(F.col("query_type"), F.col("edge_type"))).drop("way")


def expand(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = HOP_DEPTH,
           decay: float = DECAY, **weights) -> DataFrame:
    """Visited nodes (query_id, query_type, stable_id, score, hop, parent_id, edge_type, provenance).

    Seeds score 1 at hop 0. Every hop follows the rows now at that hop; a strictly better score
    replaces the row with its hop and parent.
    """
    return expanded(queries, seeds, nodes, edges, hops, decay, **weights).drop("__part")


def expanded(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = HOP_DEPTH,
             decay: float = DECAY, carried: Sequence[str] = (), **weights) -> DataFrame:
    """``expand`` with ``__part`` and the ``carried`` columns of queries.

    Rows of one (query, part) are in one task; only large queries have several parts.
    """
    return candidates(queries, seeds, nodes, edges, hops, decay, carried, **weights)(lambda best: best)


def candidates(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = HOP_DEPTH,
               decay: float = DECAY, carried: Sequence[str] = (), **weights) -> Callable[..., DataFrame]:
    """All hops but the choice among the last one's candidates: a function that gives ``expanded`` rows with ``__slice``
    behind a step of its own, which gets all rows of a (query, part) in one task. It can be called once.

    Steps to inactive nodes are left out once, before any hop, and lie in bundles. A hop's candidates are written as
    bundles, and move once, by query and part; they are told apart where the choice is made. Both go a group of slices
    after another, the former by slices of nodes, the latter of queries: only what one group moves is on disk at a time,
    and slices of tables that were read for the last time go with their group. The best of each node is then taken where
    they are.
    """
    spark = queries.sparkSession
    active = nodes.filter(F.col("active")).select("stable_id")
    drawn = run_folder(spark, "edges")
    known_edges = edges if AT in edges.columns else edge_table(edges, drawn)
    steps = moves(known_edges, weights.get("edge_weights"))
    hubs = written(hubs_of(steps), "hubs")
    # A task's share of the nodes' ids is small, whatever the steps to one of them: steps are not sorted for it.
    steps = steps.join(active.hint("shuffle_hash"), "stable_id", "left_semi")
    walked = run_folder(spark, "steps")
    with setting(spark, SORTED_LISTS, "false"):
        steps = written(bundles(steps, hubs).withColumn(AT, node_slice("parent_id")), "steps", AT, into=walked)
    removed(spark, drawn)
    hubs = hubs.drop("n")
    empty = F.lit(None).cast("string")
    visited = (
        seeds.select("query_id", "stable_id").distinct().join(queries.select("query_id", "query_type", *carried), "query_id")
        # Here an unknown type raises; behind a join it might be filtered out unseen.
        .select("query_id", F.when(direction(F.col("query_type")).isNotNull(), F.col("query_type")).alias("query_type"), "stable_id",
                F.lit(1.0).alias("score"), F.lit(0).alias("hop"),
                empty.alias("parent_id"), empty.alias("edge_type"), empty.alias("provenance"), *carried, slice_of("query_id"))
    )
    columns, carried = visited.columns, [*carried, "__slice"]
    known = run_folder(spark, "visited")
    visited = written(visited, "visited", "__slice", into=known)
    settled = _settled(visited, _bundled(visited.limit(0)), queries.select("query_id").limit(0), carried, [known])
    for hop in range(hops):
        frontier = visited.filter(F.col("hop") == hop)
        large = large_queries(frontier, hubs)
        offered = run_folder(spark, "found")
        found = _found(frontier, steps, hop, decay, carried, columns, weights, offered, [walked] if hop == hops - 1 else [])
        settled = _settled(visited, found, large, carried, [known, offered])
        if hop < hops - 1:
            # The next candidates and the rows they compete with both come from here.
            known = run_folder(spark, "visited")
            visited = settled(lambda best: best.select(columns), stored=True, into=known)
    return settled


def _bundled(rows: DataFrame) -> DataFrame:
    """Rows of single nodes in the form of candidates: with ``ends`` in place of ``stable_id``."""
    return rows.select(*[F.array("stable_id").alias("ends") if c == "stable_id" else c for c in rows.columns])


def _found(frontier: DataFrame, steps: DataFrame, hop: int, decay: float, carried: Sequence[str], columns: list[str],
           weights: dict, folder: str, spent: Sequence[str]) -> DataFrame:
    """The candidates of a hop as a table by ``__slice``, a group of the nodes to go on from after another."""
    at_once = slices_at_once(frontier, steps)
    many = at_once < SLICES and slices_at_once(frontier) < SLICES
    columns = ["ends" if c == "stable_id" else c for c in columns]
    met = []
    if many:
        # Each group reads its own rows only.
        met = [run_folder(frontier.sparkSession, "frontier")]
        frontier = written(frontier.withColumn(AT, node_slice("stable_id")), "frontier", AT, into=met[0])
    else:
        frontier = frontier.withColumn(AT, node_slice("stable_id"))

    def found(ours):
        rows = neighbors(frontier.filter(ours(F.col(AT))), steps.filter(ours(F.col(AT))).drop(AT), carried)
        rows = rows.withColumn("score", labels.hop_score(F.col("score"), decay, F.col("edge_type"), F.col("provenance"), **weights))
        return rows.filter(F.col("score") > 0).withColumn("hop", F.lit(hop + 1)).select(columns)

    found = _group_by_group(found, "found", at_once, folder, ["__slice"], [(f, AT) for f in [*spent, *met]])
    removed(frontier.sparkSession, *met)
    return found


def _group_by_group(make: Callable[[Callable[[Column], Column]], DataFrame], label: str, at_once: int, folder: str, by: Sequence[str],
                    spent: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``make`` of a filter on slices, written for a group of them after another; the slices of the ``spent`` tables (folder,
    column) go with the group that read them last."""
    for begin in range(0, SLICES, at_once):
        group = range(begin, min(begin + at_once, SLICES))
        rows = written(make(lambda at: at.between(group[0], group[-1])), label, *by, into=folder)  # noqa: B023
        removed(rows.sparkSession, *[f"{table}/{column}={k}" for table, column in spent for k in group])
    return rows


def node_slice(node: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("node"), node), F.lit(SLICES)).cast("int")


def edge_table(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """Edges as a table by slices of their sources, for all that reads them: they may be costly to make."""
    return written(edges.withColumn(AT, node_slice("source")), "edges", AT, into=folder)


def in_node_slices(make: Callable[..., DataFrame], label: str, rows: DataFrame, *by: str, node: str = "stable_id",
                   spent: Sequence[str] = (), into: str | None = None) -> DataFrame:
    """``make`` of ``rows`` and of a filter on a column of nodes, for joins on ``node``: a table.

    Where ``rows`` are many, a group of nodes' slices is joined and written after another. The ``spent`` tables are
    deleted with the last group.
    """
    folder = into or run_folder(rows.sparkSession, label)
    at = lambda table, name: F.col(AT) if AT in table.columns else node_slice(name)
    ours = lambda inside: make(rows.filter(inside(node_slice(node))), lambda table, name: table.filter(inside(at(table, name))))
    at_once = slices_at_once(rows)
    if at_once == SLICES:
        table = written(make(rows, lambda table, name: table), label, *by, into=folder)
    else:
        table = _group_by_group(ours, label, at_once, folder, by)
    removed(rows.sparkSession, *spent)
    return table


def _settled(visited: DataFrame, found: DataFrame, large: DataFrame, carried: Sequence[str], spent: Sequence[str]) -> Callable[..., DataFrame]:
    """The choice among visited and found rows, behind a step, in groups of slices; ``spent`` are the folders of both."""
    parted = not large.isEmpty()

    def choice(step, visited, found):
        rows = _bundled(visited).unionByName(found)
        if parted:
            # Bundles of large queries are taken apart before they move, since their nodes go to several tasks.
            rows = rows.join(large.withColumn("__large", F.lit(True)), "query_id", "left")
            part = lambda node: F.pmod(F.xxhash64(node), F.lit(PARTS)).cast("int")
            single = F.transform("ends", lambda node: F.struct(part(node).alias("part"), F.array(node).alias("ends")))
            whole = F.array(F.struct(F.lit(0).alias("part"), "ends"))
            rows = rows.select("*", F.explode(F.when(F.col("__large"), single).otherwise(whole)).alias("__b"))
            rows = rows.withColumns({"__part": F.col("__b.part"), "ends": F.col("__b.ends")}).drop("__b", "__large")
        else:
            rows = rows.withColumn("__part", F.lit(0))
        rows = rows.repartition("query_id", "__part").withColumn("stable_id", F.explode("ends")).drop("ends")
        return step(_best(rows, carried))

    def settled(step, stored=False, into=None):
        return in_slices(lambda *rows: choice(step, *rows), "chosen", visited, found, stored=stored, spent=spent, into=into)

    return settled


def slice_of(query_id: str) -> Column:
    """``__slice``, the slice of a query."""
    return F.pmod(F.xxhash64(F.lit("slice"), query_id), F.lit(SLICES)).cast("int").alias("__slice")


def slices_at_once(*tables: DataFrame) -> int:
    """How many slices of the tables make up about ``SLICE_ROWS`` rows."""
    return min(SLICES, max(1, SLICES * SLICE_ROWS // max(1, sum(t.count() for t in tables))))


def in_slices(make: Callable[..., DataFrame], label: str, *tables: DataFrame, stored: bool = False, spent: Sequence[str] = (),
              into: str | None = None) -> DataFrame:
    """``make`` of tables with ``__slice``, for results whose rows depend on rows of one query.

    Many rows are taken a group of slices after another, and each group's result is written, so its shuffled rows go
    before the next one starts. Few rows are taken at once. The result is a table by ``__slice`` where ``stored``, else
    it is without that column and, of few rows, not written. ``spent`` are folders of tables by ``__slice`` that nothing
    else reads: what a written result was made of is deleted.
    """
    at_once = slices_at_once(*tables)
    by = ["__slice"] if stored else []
    result = lambda *rows: make(*rows) if stored else make(*rows).drop("__slice")
    if at_once == SLICES and not stored:
        return result(*tables)
    folder = into or run_folder(tables[0].sparkSession, label)
    ours = lambda inside: result(*[t.filter(inside(F.col("__slice"))) for t in tables])
    return _group_by_group(ours, label, at_once, folder, by, [(f, "__slice") for f in spent])


def hubs_of(steps: DataFrame) -> DataFrame:
    """Nodes (way, parent_id, n) with very many steps."""
    return steps.groupBy("parent_id", "way").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB)


def large_queries(frontier: DataFrame, hubs: DataFrame) -> DataFrame:
    """Queries that may find many nodes in one hop: many rows to go on from, or one with very many steps."""
    many = frontier.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FRONTIER).select("query_id")
    asked = frontier.select("query_id", direction(F.col("query_type")).alias("way"), F.col("stable_id").alias("parent_id"))
    return written(many.unionByName(asked.join(hubs, ["way", "parent_id"], "left_semi").select("query_id")).distinct(), "large")


def _best(rows: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Best row per (query, node): score, then the earlier hop, then the smaller parent and edge.

    A minimum of structs is aggregated by sorting; the leading 64-bit hash makes most comparisons of that sort a
    comparison of numbers. Its upper half is of the query, so that a query's rows come out side by side, which is small on
    disk. What depends on the query alone is carried behind the rank.
    """
    rest = ["query_type", *carried]
    rank = F.struct((-F.col("score")).alias("s"), "hop", "parent_id", "edge_type", "provenance", *rest)
    half = F.lit(0xFFFFFFFF).cast("bigint")
    key = F.shiftleft(F.xxhash64("query_id"), 32).bitwiseOR(F.xxhash64("stable_id").bitwiseAND(half)).alias("__h")
    kept = rows.groupBy(key, "query_id", "stable_id", "__part").agg(F.min(rank).alias("r"))
    return kept.select(
        "query_id", "r.query_type", "stable_id", (-F.col("r.s")).alias("score"), "r.hop", "r.parent_id", "r.edge_type", "r.provenance",
        *[F.col(f"r.{c}") for c in carried], "__part",
    )


def shortlist(rows: DataFrame) -> DataFrame:
    """Rows of ``expanded`` with ``max_tokens`` carried that a budget may hold, taken where they are.

    All rows but seeds cost the same, so no more of them than budget / cost can ever fit. The best row of every
    (query, part) stays as well: its ``__n`` is the number of rows there, null in other rows.
    """
    part = Window.partitionBy("query_id", "__part")
    order = part.orderBy(F.col("hop") > 0, F.desc("score"), "hop", "stable_id")
    rows = rows.withColumns({
        "__r": F.row_number().over(order),
        "__n": F.count(F.lit(1)).over(part),
        "__s": F.count(F.when(F.col("hop") == 0, 1)).over(part),
    })
    fits = F.col("__r") - F.col("__s") <= int_div(F.col("max_tokens"), labels.PERIPHERAL)
    rows = rows.filter((F.col("hop") == 0) | fits | (F.col("__r") == 1))
    return rows.withColumn("__n", F.when(F.col("__r") == 1, F.col("__n"))).drop("__r", "__s", "__part")


def latest_specs(specs: DataFrame) -> DataFrame:
    """Latest spec text per (repo, node): an aggregate, since only one row survives."""
    last = specs.groupBy("repo", "node_stable_id").agg(
        F.max_by(F.struct("commit_sha", "spec_text"), F.struct("generated_at", "commit_sha")).alias("s")
    )
    return last.select("repo", F.col("node_stable_id").alias("stable_id"), "s.commit_sha", "s.spec_text")


def attach_specs(visited: DataFrame, specs: DataFrame) -> DataFrame:
    """Seed rows with their latest spec text; ``specs`` holds one row per node."""
    return visited.join(
        specs.select("stable_id", "spec_text"), "stable_id", "left"
    ).withColumn("spec_text", F.when(F.col("hop") == 0, F.col("spec_text")))


def hydrate(rows: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes of active nodes; rows without one stay, sparse."""
    wanted = nodes.filter(F.col("active")).select("stable_id", *columns)
    return rows.join(wanted, "stable_id", "left")


def prune(visited: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Rows that fit the token budget, in score order, with ``cost`` and ``pos``; without ``budgets`` they carry ``max_tokens``.

    Seeds always stay. Costs are summed up by query, so of large expansions give it the ``shortlist``.
    """
    rows = visited if budgets is None else visited.join(budgets.select("query_id", "max_tokens"), "query_id")
    rows = rows.withColumn("cost", labels.token_cost(F.col("hop"), F.col("spec_text").isNotNull()))
    upto = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("hop"), F.col("stable_id"))
    rows = rows.withColumn("__used", F.sum("cost").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.filter((F.col("hop") == 0) | (F.col("__used") <= F.col("max_tokens")))
    return kept.withColumn("pos", F.row_number().over(upto)).drop("__used", "max_tokens")


def int_div(value: Column, by: int) -> Column:
    return F.floor(value / by)


def sketched(rows: DataFrame) -> DataFrame:
    """Adds ``__sketch``, a bit for each of the nodes of a row's query: most nodes outside are told by it."""
    word, bit = _sketch_bit(F.col("stable_id"))
    query = Window.partitionBy("query_id")
    words = [F.coalesce(F.bit_or(F.when(word == i, bit)).over(query), F.lit(0).cast("bigint")) for i in range(WORDS)]
    return rows.withColumn("__sketch", F.array(*words))


def _sketch_bit(node: Column) -> tuple[Column, Column]:
    h = F.xxhash64(node)
    place = F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int")
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def induced_edges(surviving: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends both survive in the same question.

    Where ``surviving`` is ``sketched``, edges to nodes that the sketch rules out do not move to the exact check. Where it
    is a table by ``__slice``, edges meet it ``in_node_slices`` and that check goes ``in_slices``.
    """
    known = [c for c in surviving.columns if c in ("__sketch", "__slice")]
    rest = [c for c in known if c == "__slice"]
    columns = [c for c in edges.columns if c != AT]

    def leaving(rows, ours):
        found = ours(edges, "source").join(rows.select("query_id", F.col("stable_id").alias("source"), *known), "source")
        if "__sketch" in known:
            word, bit = _sketch_bit(F.col("target"))
            found = found.filter(F.get("__sketch", word).bitwiseAND(bit) != 0)
        return found.select("query_id", *columns, *rest)

    check = lambda rows, ends: rows.join(ends.select("query_id", "target"), ["query_id", "target"], "left_semi").select("query_id", *columns)
    ids = surviving.select("query_id", F.col("stable_id").alias("target"), *rest)
    if not rest:
        return check(leaving(surviving, lambda table, name: table), ids)
    folder = run_folder(edges.sparkSession, "leaving")
    return in_slices(check, "induced", in_node_slices(leaving, "leaving", surviving, "__slice", into=folder), ids, spent=[folder])


def conflict_edges(surviving: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of conflicting or dead edges that leave a surviving node."""

    def hits(rows, ours):
        ids = rows.select("query_id", F.col("stable_id").alias("source"))
        columns = [c for c in edges.columns if c != AT]
        return ours(edges.filter(F.col("provenance").isin("conflict", "dead")), "source").join(ids, "source").select("query_id", *columns)

    hit = in_node_slices(hits, "conflicts", surviving) if "__slice" in surviving.columns else hits(surviving, lambda table, name: table)
    detail = F.coalesce("detail", F.lit("")) if "detail" in edges.columns else F.lit("")
    warnings = hit.select(
        "query_id", F.when(F.col("provenance") == "dead", "DEAD").otherwise("CONFLICT").alias("type"), "source", "target", detail.alias("detail")
    )
    return hit, warnings


def all_edges(standard: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Both edge lists, duplicates kept, ``extra`` marks the conflict list."""
    return standard.withColumn("extra", F.lit(0)).unionByName(conflicts.withColumn("extra", F.lit(1)))


def totals(visited: DataFrame, surviving: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Budget used and number of candidates of each question, in one aggregate over a union.

    ``visited`` may be a ``shortlist``, which has the numbers of its rows.
    """
    zero = F.lit(0)
    one = F.coalesce("__n", F.lit(0)) if "__n" in visited.columns else F.lit(1)
    parts = visited.select("query_id", one.alias("c"), zero.alias("u")).unionAll(
        surviving.select("query_id", zero, F.col("cost"))
    ).unionAll(conflicts.select("query_id", zero, F.lit(labels.CONFLICT_EDGE)))
    return parts.groupBy("query_id").agg(F.sum("u").alias("budget_used"), F.sum("c").alias("total_candidates"))
