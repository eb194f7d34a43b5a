"""Wire-format trace lines (short keys) and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.schemas import COVERAGE_REPORT, WIRE_EVENT


def read_wire_traces(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """Trace events from JSON lines; lines that do not parse are dropped.

    ``keys`` identify the session and the position columns that came with each line.
    """
    parsed = lines.withColumn(
        "w", F.from_json(column, f"{WIRE_EVENT}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ).filter(F.col("w").isNotNull() & F.col("w._bad").isNull())
    kind = F.col("w.t")
    return parsed.select(
        *keys,
        F.when(kind == "ret", "return").when(kind == "panic", "exception").otherwise(kind).alias("type"),
        F.col("w.f").alias("fn"),
        F.coalesce("w.file", F.lit("")).alias("file"),
        F.coalesce("w.l", F.lit(0)).alias("line"),
        F.col("w.ts").alias("timestamp_ms"),
        F.col("w.g").alias("goroutine_id"),
        F.col("w.s").alias("span_id"),
        F.col("w.args").alias("args"),
        F.col("w.ret").alias("return_val"),
        F.col("w.exc").alias("exc_type"),
    )


def session_durations(events: DataFrame, session: list[str]) -> DataFrame:
    """Trace duration: the highest timestamp, never below zero."""
    return events.groupBy(*session).agg(F.greatest(F.max("timestamp_ms"), F.lit(0.0)).alias("duration_ms"))


def fan_out(events: DataFrame, entrypoints: DataFrame, session: str) -> DataFrame:
    """Every event of a session under every entrypoint requested for that session."""
    return events.join(entrypoints, session)


def coverage_files(reports: DataFrame, keys: list[str], column: str = "report") -> DataFrame:
    """Covered files and total percentage of JSON coverage reports."""
    parsed = reports.withColumn("r", F.from_json(column, COVERAGE_REPORT))
    return (
        parsed.select(*keys, F.col("r.totals.percent_covered").alias("percent_covered"), F.explode("r.files").alias("file", "info"))
        .filter(F.size("info.executed_lines") > 0)
        .select(*keys, "file", "percent_covered")
    )


def coverage_functions(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """Function coverage text lines as (``file:function``, covered)."""
    fields = F.filter(F.split(F.col(column), r"\s+"), lambda p: p != "")
    located = lines.filter(~F.col(column).startswith("total:")).withColumn("__f", fields)
    located = located.filter((F.size("__f") >= 3) & F.element_at("__f", 1).contains(":"))
    return located.select(
        *keys,
        F.concat(F.substring_index(F.element_at("__f", 1), ":", 1), F.lit(":"), F.element_at("__f", 2)).alias("function"),
        (F.element_at("__f", -1) != "0.0%").alias("covered"),
    )
