"""Entrypoints, their priorities, and the jobs that remain to be traced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import job_language

# Decorator fragments that mark an entrypoint.
DECORATORS = ["app.route", "router.", "click.command"]


def is_entrypoint() -> Column:
    name, kind = F.col("name"), F.col("type")
    marked = name.startswith("test_")
    for fragment in DECORATORS:
        marked = marked | F.coalesce(F.col("decorators").contains(fragment), F.lit(False))
    return (
        marked
        | ((kind == "function") & name.startswith("Test"))
        | ((kind == "method") & (name == "ServeHTTP"))
        | ((kind == "function") & (name == "main"))
    )


def entrypoints(nodes: DataFrame, repo: str | None = None) -> DataFrame:
    active = nodes.filter(F.col("active"))
    if repo is not None:
        active = active.filter(F.col("repo") == repo)
    return active.filter(is_entrypoint()).select("stable_id", "name", "file_path", "repo")


def last_traced(specs: DataFrame) -> DataFrame:
    return specs.groupBy("repo", F.col("node_stable_id").alias("stable_id")).agg(F.max("generated_at").alias("last_traced_at"))


def priority(last: Column, changed: Column) -> Column:
    """2 for never traced, 3 for changed dependencies, else 1."""
    return F.when(last.isNull(), 2).when(changed, 3).otherwise(1)


def jobs(found: DataFrame, traced: DataFrame, changed: DataFrame) -> DataFrame:
    """Entrypoints with priority and language; ``traced`` and ``changed`` hold one row per id."""
    flagged = changed.select("stable_id", F.lit(True).alias("__c"))
    joined = found.join(traced, ["repo", "stable_id"], "left").join(flagged, "stable_id", "left")
    return joined.select(
        "stable_id", "name", "file_path",
        priority(F.col("last_traced_at"), F.coalesce("__c", F.lit(False))).alias("priority"),
        "repo", job_language(F.col("file_path")).alias("language"),
    )


def by_priority(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("priority"), "stable_id")


def not_yet_traced(rows: DataFrame, cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Jobs whose (commit_sha, stable_id) was not traced within the last ``hours``."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("traced_at").cast("timestamp"))
    recent = cache.filter(age < hours * 3_600_000_000).select("commit_sha", "stable_id")
    return rows.join(recent, ["commit_sha", "stable_id"], "left_anti")


def counters(found: DataFrame, queued: DataFrame) -> DataFrame:
    """Per repository: entrypoints discovered and jobs queued."""
    both = found.select("repo", F.lit(1).alias("d"), F.lit(0).alias("q")).unionAll(queued.select("repo", F.lit(0), F.lit(1)))
    return both.groupBy("repo").agg(F.sum("d").alias("discovered"), F.sum("q").alias("queued"))


def repositories(nodes: DataFrame) -> DataFrame:
    """Distinct repositories that hold a node."""
    return nodes.select("repo").where(F.col("repo").isNotNull()).distinct()
