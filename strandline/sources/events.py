"""Typed scans of JSON event payloads, dead-letter split, and flattening (batch or streaming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schemas import CONTRACTS

CORRUPT = "_corrupt"


def _parsed(df: DataFrame, contract: str, column: str) -> DataFrame:
    ddl, _, _ = CONTRACTS[contract]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    payload = F.from_json(column, f"{ddl}, {CORRUPT} string", options)
    # The explode of a single element keeps the optimizer from parsing once per use.
    return df.withColumn("payload", F.explode(F.array(payload)))


def _problem(contract: str, column: str) -> Column:
    """First reason a record breaks its contract, or null."""
    _, required, enums = CONTRACTS[contract]
    checks = F.when(F.col(column).isNull(), F.lit("missing event"))
    checks = checks.when(F.col(f"payload.{CORRUPT}").isNotNull(), F.lit("malformed json"))
    for field in required:
        checks = checks.when(F.col(f"payload.{field}").isNull(), F.lit(f"missing {field}"))
    for path, allowed in enums.items():
        if "." in path:
            array, leaf = path.split(".")
            bad = F.exists(f"payload.{array}", lambda e: ~F.coalesce(e[leaf].isin(allowed), F.lit(False)))
        else:
            bad = ~F.col(f"payload.{path}").isin(allowed)
        checks = checks.when(bad, F.lit(f"invalid {path}"))
    return checks


def read_events(df: DataFrame, contract: str, column: str = "event") -> DataFrame:
    """Records that satisfy the contract, as typed columns (other columns are kept)."""
    good, _ = split_dlq(df, contract, column)
    return good


def split_dlq(
    df: DataFrame, contract: str, column: str = "event", message_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): typed records, and (msg_id, error, data) rows for the dead-letter table."""
    parsed = _parsed(df, contract, column).withColumn("__problem", _problem(contract, column))
    kept = [c for c in df.columns if c != column]
    good = parsed.filter(F.col("__problem").isNull()).select(*kept, "payload.*").drop(CORRUPT)
    msg_id = F.col(message_id).cast("string") if message_id else F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    bad = parsed.filter(F.col("__problem").isNotNull()).select(
        msg_id.alias("msg_id"), F.col("__problem").alias("error"), F.col(column).alias("data")
    )
    return good, bad


def explode_nodes(parsed_files: DataFrame) -> DataFrame:
    """One row per parsed node, with its file's columns; ``pos`` is the definition order."""
    return parsed_files.select(
        "repo", "commit_sha", "file_path", "language", F.posexplode("nodes").alias("pos", "n")
    ).select("repo", "commit_sha", "file_path", "language", "pos", "n.*")


def explode_edges(parsed_files: DataFrame) -> DataFrame:
    """Intra-file edges as (repo, commit_sha, file_path, source, target, type)."""
    return parsed_files.select(
        "repo", "commit_sha", "file_path", F.explode("intra_file_edges").alias("e")
    ).select(
        "repo", "commit_sha", "file_path",
        F.col("e.source_stable_id").alias("source"), F.col("e.target_stable_id").alias("target"),
        F.coalesce("e.type", F.lit("CALLS")).alias("type"),
    )


def explode_deleted(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("repo", "commit_sha", "file_path", F.explode("deleted_nodes").alias("stable_id"))


def explode_events(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trace event; ``seq`` is the array position, which defines the order."""
    return traces.select(*keys, F.posexplode("events").alias("seq", "e")).select(*keys, "seq", "e.*")
