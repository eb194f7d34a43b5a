"""Call and import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import strip
from strandline.session import cut_lineage

# Retries and age after which an unresolved import is dropped.
MAX_ATTEMPTS, PENDING_HOURS = 5, 24


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct CALLS pairs inside a file; the last definition of a name wins, no self calls.

    ``calls``: (repo, file_path, source, called_name); ``nodes``: (repo, file_path, name,
    qualified_name, stable_id, pos).
    """
    named = nodes.select("repo", "file_path", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("called_name"), "stable_id", "pos")
    latest = named.groupBy("repo", "file_path", "called_name").agg(F.max_by("stable_id", F.struct("pos", "stable_id")).alias("target"))
    wanted = calls.select("repo", "file_path", "source", "called_name").distinct()
    pairs = wanted.join(latest, ["repo", "file_path", "called_name"]).filter(F.col("source") != F.col("target"))
    return pairs.select("repo", "file_path", "source", "target").distinct()


def parse_import(body: Column) -> Column:
    """Struct (kind, module, dots, names) of an import statement; no names when it is neither form."""
    text = strip(F.regexp_replace(F.regexp_replace(body, r"\\\s*\n", " "), r"\s+", " "))
    pattern = r"^from ?(\.*(?: ?\.+)*) ?([\w.]*) ?import ?\(? ?(.*?),? ?\)?$"
    plain = r"^import (.+)$"
    is_from, is_plain = text.rlike(pattern), text.rlike(plain)
    listed = F.when(is_from, F.regexp_extract(text, pattern, 3)).when(is_plain, F.regexp_extract(text, plain, 1))
    names = F.transform(F.split(listed, ","), lambda n: F.regexp_replace(strip(n), r" as .*$", ""))
    names = F.filter(names, lambda n: n != "")
    return F.struct(
        F.when(is_from, "from").otherwise("plain").alias("kind"),
        F.when(is_from, F.regexp_extract(text, pattern, 2)).otherwise("").alias("module"),
        F.when(is_from, F.length(F.regexp_replace(F.regexp_extract(text, pattern, 1), " ", ""))).otherwise(0).alias("dots"),
        F.coalesce(names, F.array().cast("array<string>")).alias("names"),
    )


def path_hint(module: Column, file_path: Column, dots: Column) -> Column:
    """Slash form of an absolute module, or the directory a relative import starts from."""
    parts = F.split(file_path, "/")
    up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    relative = F.when(F.size(up) == 0, "").otherwise(F.concat(F.array_join(up, "/"), F.lit("/")))
    return F.when(dots == 0, F.replace(module, F.lit("."), F.lit("/"))).otherwise(relative)


def import_targets(imports: DataFrame) -> DataFrame:
    """One row per imported name: (source, repo, kind, target_name, path_hint).

    ``imports``: import nodes (stable_id, repo, file_path, body).
    """
    # The explode of a single element keeps the statement from being parsed once per use.
    parsed = imports.withColumn("i", F.explode(F.array(parse_import(F.col("body")))))
    hint = F.when(F.col("i.kind") == "from", path_hint(F.col("i.module"), F.col("file_path"), F.col("i.dots"))).otherwise("")
    return parsed.select(
        F.col("stable_id").alias("source"), "repo", F.col("i.kind").alias("kind"), F.explode("i.names").alias("target_name"), hint.alias("path_hint")
    )


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``target``: smallest active node of that qualified name in the repository, or null."""
    best = nodes.filter(F.col("active")).groupBy("repo", F.col("qualified_name").alias("target_name")).agg(F.min("stable_id").alias("target"))
    return refs.join(best, ["repo", "target_name"], "left").select(*refs.columns, "target")


def by_name_and_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``target``: smallest active node of that name whose path contains the hint, or null.

    Substrings of the paths, of just the lengths the hints of a name have, reduce to their
    smallest node before they meet the hints. So a common name with many files and many hints
    never forms all pairs.
    """
    hinted = refs.select("repo", "target_name", "path_hint").filter(F.col("path_hint") != "")
    lengths = hinted.select("repo", "target_name", F.length("path_hint").alias("__n")).distinct()
    active = nodes.filter(F.col("active")).select("repo", F.col("name").alias("target_name"), "file_path", "stable_id")
    files = active.groupBy("repo", "target_name", "file_path").agg(F.min("stable_id").alias("stable_id"))
    starts = files.join(lengths, ["repo", "target_name"]).filter(F.length("file_path") >= F.col("__n"))
    at = F.explode(F.sequence(F.lit(1), F.length("file_path") - F.col("__n") + 1))
    pieces = starts.withColumn("__i", at).select(
        "repo", "target_name", "stable_id", F.col("file_path").substr(F.col("__i"), F.col("__n")).alias("path_hint")
    )
    best = pieces.groupBy("repo", "target_name", "path_hint").agg(F.min("stable_id").alias("target"))
    return refs.join(best, ["repo", "target_name", "path_hint"], "left").select(*refs.columns, "target")


def resolve_imports(refs: DataFrame, nodes: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): IMPORTS pairs whose importer exists, and everything else for retry.

    The path lookup runs only for rows the qualified name did not find. ``once`` writes the
    looked-up rows, for callers that use both results.
    """
    exact = by_qualified_name(refs, nodes)
    missed = by_name_and_path(exact.filter(F.col("target").isNull()).drop("target"), nodes)
    found = exact.filter(F.col("target").isNotNull()).unionByName(missed)
    importers = nodes.select(F.col("stable_id").alias("source")).distinct().withColumn("__known", F.lit(True))
    checked = found.join(importers, "source", "left")
    if once:
        checked = cut_lineage(checked)
    done = F.col("target").isNotNull() & F.coalesce("__known", F.lit(False))
    edges = checked.filter(done).select("source", "target", F.lit("IMPORTS").alias("type"), F.lit("static").alias("provenance")).distinct()
    return edges, checked.filter(~done).select(refs.columns)


def package_edges(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, edges) of plain imports whose importer exists; others are dropped."""
    known = refs.join(nodes.select(F.col("stable_id").alias("source")), "source", "left_semi")
    edges = known.select("source", "repo", F.col("target_name").alias("package"), F.lit("IMPORTS").alias("type"), F.lit("static").alias("provenance")).distinct()
    return edges.select(F.col("package").alias("name"), "repo").distinct(), edges


def new_pending(unresolved: DataFrame, now: Column) -> DataFrame:
    return unresolved.select(
        F.col("source").alias("source_stable_id"), "target_name", "path_hint", F.lit("IMPORTS").alias("edge_type"), "repo",
        now.alias("attempted_at"), F.lit(0).alias("attempt_count"),
    )


def is_expired(now: Column) -> Column:
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("attempted_at").cast("timestamp"))
    return (F.col("attempt_count") > MAX_ATTEMPTS) | (age > PENDING_HOURS * 3_600_000_000)


def retry_pending(pending: DataFrame, nodes: DataFrame, repos: DataFrame, now: Column, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, pending): one retry cycle for the repositories that had new events.

    Expired rows are dropped, unresolved ones come back with one more attempt.
    """
    idle = pending.join(repos, "repo", "left_anti").select(pending.columns)
    due = pending.join(repos, "repo", "left_semi").filter(~is_expired(now))
    refs = due.withColumnRenamed("source_stable_id", "source")
    edges, failed = resolve_imports(refs, nodes, once)
    again = failed.withColumnRenamed("source", "source_stable_id").withColumns(
        {"attempt_count": F.col("attempt_count") + 1, "attempted_at": now}
    )
    return edges, idle.unionByName(again.select(pending.columns))


def existing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (stable_id)."""
    known = nodes.select("stable_id").distinct()
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("stable_id", end), end, "left_semi")
    return edges


def distinct_references(references: DataFrame, keys: tuple[str, ...] = ("repo", "file_path", "called_name")) -> DataFrame:
    """One row for each reference by its key; repeated ones combine in the task that reads them."""
    return references.select(*keys).dropDuplicates(list(keys))
