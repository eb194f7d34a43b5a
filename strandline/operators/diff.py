"""Source changes: file listings, snapshot differences, change events, and what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import language_of

KEEP_ALL = ["full_rescan", "added"]


def name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """Tab-separated status lines to (path, diff_type, language); unsupported files are dropped."""
    parts = F.split(F.col(column), "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    kind = F.when(letter == "A", "added").when(letter == "D", "deleted").otherwise("modified")
    rows = lines.filter(F.col(column) != "").withColumns({"path": F.element_at(parts, -1), "diff_type": kind})
    rows = rows.withColumn("language", language_of(F.col("path")))
    return rows.filter(F.col("language").isNotNull()).drop(column)


def snapshot_diff(prev: DataFrame, curr: DataFrame, keys: tuple[str, ...] = ("stable_id",)) -> DataFrame:
    """(keys, change) for ids that changed, were added or were deleted between two snapshots."""
    keys = list(keys)
    before = prev.select(*keys, F.col("node_hash").alias("__old"), F.lit(True).alias("__was"))
    after = curr.select(*keys, F.col("node_hash").alias("__new"), F.lit(True).alias("__is"))
    both = before.join(after, keys, "full")
    change = (
        F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "deleted")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change")


def file_changes(files: DataFrame, prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Node changes of listed files: (repo, path, diff_type, stable_id, change).

    Added and fully rescanned files list all current nodes as added, deleted files all previous
    nodes as deleted, others their snapshot difference. ``prev`` and ``curr`` rows carry
    (repo, file_path, stable_id, node_hash).
    """
    listed = files.select("repo", "path", "diff_type")
    now = curr.withColumnRenamed("file_path", "path")
    was = prev.withColumnRenamed("file_path", "path")
    whole = listed.filter(F.col("diff_type").isin(KEEP_ALL)).join(now, ["repo", "path"])
    gone = listed.filter(F.col("diff_type") == "deleted").join(was, ["repo", "path"])
    touched = listed.filter(~F.col("diff_type").isin([*KEEP_ALL, "deleted"]))
    part = lambda rows: rows.join(touched, ["repo", "path"], "left_semi").select("repo", "path", "stable_id", "node_hash")
    changed = snapshot_diff(part(was), part(now), ("repo", "path", "stable_id")).join(touched, ["repo", "path"])
    columns = ["repo", "path", "diff_type", "stable_id", "change"]
    return (
        whole.withColumn("change", F.lit("added")).select(columns)
        .unionByName(gone.withColumn("change", F.lit("deleted")).select(columns))
        .unionByName(changed.select(columns))
    )


def file_events(files: DataFrame, changes: DataFrame, commit_sha: str) -> DataFrame:
    """One change event per listed file with its three id lists (sorted); a file's nodes bound them."""
    ids = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("stable_id"))))
    lists = changes.groupBy("repo", "path").agg(
        ids("changed").alias("changed_nodes"), ids("added").alias("added_nodes"), ids("deleted").alias("deleted_nodes")
    )
    empty = F.array().cast("array<string>")
    joined = files.select("repo", "path", "diff_type", "language").join(lists, ["repo", "path"], "left")
    return joined.select(
        "repo", F.lit(commit_sha).alias("commit_sha"), "path", "language", "diff_type",
        *[F.coalesce(c, empty).alias(c) for c in ("changed_nodes", "added_nodes", "deleted_nodes")],
    )


def emit_ids(changes: DataFrame) -> DataFrame:
    """Ids a modified file emits: changed or added ones."""
    return changes.filter(F.col("change").isin("changed", "added")).select("repo", "path", "stable_id").distinct()


def apply_diff_filter(nodes: DataFrame, edges: DataFrame, files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges a batch of file events lets through.

    Deleted files pass nothing, modified ones their emitted ids and the edges that start there,
    all others everything. Nodes and edges carry (repo, path).
    """
    kinds = files.select("repo", "path", "diff_type")
    ids = emit_ids(changes)

    def passed(rows: DataFrame, key: str) -> DataFrame:
        typed = rows.join(kinds, ["repo", "path"])
        partial = typed.filter(F.col("diff_type") == "modified").join(ids.withColumnRenamed("stable_id", key), ["repo", "path", key], "left_semi")
        return typed.filter(~F.col("diff_type").isin("modified", "deleted")).unionByName(partial).select(rows.columns)

    kept = passed(nodes, "stable_id")
    # An edge of a modified file also needs its source among the nodes really present.
    sources = kept.select("repo", "path", F.col("stable_id").alias("source"))
    kept_edges = passed(edges, "source")
    modified = kinds.filter(F.col("diff_type") == "modified").select("repo", "path")
    certain = kept_edges.join(modified, ["repo", "path"], "left_anti")
    checked = kept_edges.join(modified, ["repo", "path"], "left_semi").join(sources, ["repo", "path", "source"], "left_semi")
    return kept, certain.unionByName(checked.select(certain.columns))


def missing_edges(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges of a full parse that the stored graph lacks (repair of partial updates)."""
    return edges.join(stored, ["source", "target", "type"], "left_anti")


def unchanged_skip(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes whose hash is not the stored one; an unknown or null hash counts as changed."""
    return nodes.join(stored.select("stable_id", "node_hash"), ["stable_id", "node_hash"], "left_anti")


def merge_embedded(parsed: DataFrame, embedded: DataFrame) -> DataFrame:
    """Parsed node attributes with their embedding, per (commit, file, node); unmatched are skipped."""
    columns = ["commit_sha", "file_path", "stable_id"]
    extra = embedded.select(*columns, "vector", "embed_text")
    return parsed.join(extra, columns)


def advance_marks(marks: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, marks): repositories whose newest commit differs from their mark, and the new marks.

    ``commits``: (repo, seq, sha). A repository without a mark needs a full rescan.
    """
    newest = commits.groupBy("repo").agg(F.max_by("sha", "seq").alias("sha"))
    joined = newest.join(marks.select("repo", F.col("last_sha")), "repo", "full")
    work = joined.filter(F.col("sha").isNotNull() & ~F.col("sha").eqNullSafe(F.col("last_sha"))).select(
        "repo", F.col("last_sha").alias("prev_sha"), F.col("sha").alias("current_sha"), F.col("last_sha").isNull().alias("full_rescan")
    )
    return work, joined.select("repo", F.coalesce("sha", "last_sha").alias("last_sha"))
