"""Rules that turn metrics into bottleneck rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import labels
from strandline.functions.scan import sliding_sums
from strandline.functions.text import last_segment
from strandline.operators.metrics import PIPELINE, slow_functions, union_metrics

# Default thresholds.
BUILDUP_MIN, BUILDUP_CRITICAL = 5, 50
LAG_THRESHOLD_S = 10.0
DROP_PCT = 50.0
MAX_DEPTH = 15
EXPIRES_S = 60


def _rows(df: DataFrame, *, entity: Column, name: Column, category: str, severity: Column, value: Column, unit: Column,
          detail: Column, repo: Column, extra: list[str] | None = None) -> DataFrame:
    return df.select(
        *(extra or []), entity.alias("entity_id"), name.alias("entity_name"), F.lit(category).alias("category"),
        severity.alias("severity"), value.cast("double").alias("value"), unit.alias("unit"), detail.alias("detail"), repo.alias("repo"),
    )


def _stream_name(entity: Column) -> Column:
    return F.concat(last_segment(entity), F.lit(" stream"))


def _with_previous_tick(ticks: DataFrame, value: str, previous: str) -> DataFrame:
    """Value of the same stream one tick earlier; ticks without any earlier tick are dropped.

    An equi-join on (entity_id, tick + 1), not an ordered window over a stream's history.
    """
    before = ticks.select("entity_id", (F.col("tick") + 1).alias("tick"), F.col(value).alias(previous))
    known = before.select("tick").distinct()
    return ticks.join(known, "tick", "left_semi").join(before, ["entity_id", "tick"], "left")


def queue_buildup(depths: DataFrame) -> DataFrame:
    """Streams whose depth grew by more than five messages since the previous tick."""
    rows = _with_previous_tick(depths, "depth", "__prev").withColumn("__prev", F.coalesce("__prev", F.lit(0)))
    rows = rows.withColumn("__growth", F.col("depth") - F.col("__prev")).filter(F.col("__growth") > BUILDUP_MIN)
    return _rows(
        rows, extra=["tick"], entity=F.col("entity_id"), name=_stream_name(F.col("entity_id")), category="pipeline",
        severity=F.when(F.col("__growth") < BUILDUP_CRITICAL, "warning").otherwise("critical"), value=F.col("__growth"),
        unit=F.lit("messages"),
        detail=F.format_string("Queue depth grew from %d to %d", F.col("__prev"), F.col("depth")), repo=F.lit(PIPELINE),
    )


def processing_lag(lags: DataFrame, threshold_s: float = LAG_THRESHOLD_S) -> DataFrame:
    """One row when the mean lag exceeds the threshold, critical beyond twice of it."""
    mean = lags.agg(F.avg("lag_s").alias("__v")).filter(F.col("__v") > threshold_s)
    who = F.lit("trace-normalizer")
    return _rows(
        mean, entity=who, name=who, category="pipeline",
        severity=F.when(F.col("__v") > threshold_s * 2, "critical").otherwise("warning"), value=F.col("__v"), unit=F.lit("s"),
        detail=F.format_string(f"Avg processing lag %.1fs exceeds {threshold_s}s threshold", F.col("__v")), repo=F.lit(PIPELINE),
    )


def throughput_drop(rates: DataFrame, threshold_pct: float = DROP_PCT, baseline: str = "previous", tick_s: int = 1) -> DataFrame:
    """Streams whose rate fell by the threshold against the previous tick or the rolling hour.

    ``rates`` holds (entity_id, tick, value). The rolling hour is the mean of the rows in the ticks before, from sums over
    ranges of a stream's history; values count to 15 digits after the point and must stay below 1e13.
    """
    if baseline == "previous":
        rows = _with_previous_tick(rates, "value", "__base")
    else:
        parts = {"__sum": F.col("value").cast("decimal(28,15)"), "__many": F.when(F.col("value").isNotNull(), 1).otherwise(0)}
        rows = sliding_sums(rates, ["entity_id"], "tick", -(3600 // tick_s), -1, parts)
        rows = rows.withColumn("__base", F.col("__sum").cast("double") / F.nullif(F.col("__many"), F.lit(0))).drop("__sum", "__many")
    rows = rows.filter((F.col("__base") > 0) & (F.col("value") < F.col("__base")))
    rows = rows.withColumn("__drop", (F.col("__base") - F.col("value")) / F.col("__base") * 100)
    rows = rows.filter(F.col("__drop") >= threshold_pct)
    return _rows(
        rows, extra=["tick"], entity=F.col("entity_id"), name=_stream_name(F.col("entity_id")), category="pipeline",
        severity=F.when(F.col("__drop") > threshold_pct * 1.5, "critical").otherwise("warning"), value=F.col("__drop"),
        unit=F.lit("%"),
        detail=F.format_string(
            "Throughput dropped %.0f%% (current %.1f msg/s vs avg %.1f msg/s)", F.col("__drop"), F.col("value"), F.col("__base")
        ),
        repo=F.lit(PIPELINE),
    )


def slow_function_rows(metrics: DataFrame, limit: int = 20, critical_ms: float = 1000.0, warning_ms: float = 200.0,
                       ties: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Severity of the slowest rows of each repository; all of them are reported."""
    rows = slow_functions(metrics, limit, ties=ties)
    return _rows(
        rows, entity=F.col("entity_id"), name=last_segment(F.col("entity_id")), category="slow_fn",
        severity=labels.slow_severity(F.col("value"), critical_ms, warning_ms), value=F.col("value"), unit=F.col("unit"),
        detail=F.format_string("Avg duration %.1fms", F.col("value")), repo=F.col("repo"),
    )


def deep_chains(metrics: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    rows = metrics.filter((F.col("metric_name") == "call_depth") & (F.col("value") > max_depth))
    return _rows(
        rows, entity=F.col("entity_id"), name=last_segment(F.col("entity_id")), category="deep_chain", severity=F.lit("warning"),
        value=F.col("value"), unit=F.lit("levels"),
        detail=F.format_string(f"Call depth %d exceeds max {max_depth}", F.col("value").cast("int")), repo=F.col("repo"),
    )


def all_bottlenecks(*detected: DataFrame) -> DataFrame:
    return union_metrics(*detected)


def filter_bottlenecks(rows: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    if category:
        rows = rows.filter(F.col("category") == category)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    return rows


def active_bottlenecks(rows: DataFrame, as_of: Column, seconds: int = EXPIRES_S) -> DataFrame:
    """Rows not yet expired at ``as_of``."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("detected_at").cast("timestamp"))
    return rows.filter(age < seconds * 1_000_000)
