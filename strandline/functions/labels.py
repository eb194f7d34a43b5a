"""Rule tables and labels: weights, bands, severities, side-effect classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of an edge type in a hop score; unknown types weigh nothing.
EDGE_WEIGHTS = {"CALLS": 1.0, "IMPORTS": 0.8, "INHERITS": 0.7, "MODIFIED_BY": 0.6, "TESTED_BY": 0.5}
# Weight of a provenance; unknown or empty ones count as static.
PROVENANCE_WEIGHTS = {"confirmed": 1.0, "dynamic": 0.9, "static": 0.8, "conflict": 0.6}
DEFAULT_PROVENANCE_WEIGHT = 0.8
# Token costs.
SEED_WITH_SPEC, SEED_WITHOUT_SPEC, PERIPHERAL, CONFLICT_EDGE = 60, 120, 20, 15
# Call-name patterns of side effects, first match wins, on the lowercase name.
SIDE_EFFECTS = [
    ("db_read", r"(?:^|[_.])(?:fetchall|fetchone|fetch|select)(?:[_.]|$)"),
    ("db_write", r"(?:^|[_.])(?:execute(?:many)?|insert|update|delete|commit)(?:[_.]|$)"),
    ("cache_set", r"hset|rpush|lpush|zadd|setex|(?:redis|cache)[_.]set|^set$"),
    ("cache_read", r"hget|lrange|zrange|smembers|(?:redis|cache)[_.]get|^get$"),
    ("http_out", r"(?:http|httpx|requests?|client)[_.](?:request|send|get|post|put|patch|delete)|_send_request"),
    ("fs_write", r"(?:^|[_.])write(?:[_.]|$)|(?:^|[_.])open(?:[_.]|$)"),
]
# Printed labels of the side-effect classes.
EFFECT_LABELS = {
    "db_read": "DB READ", "db_write": "DB WRITE", "cache_read": "CACHE READ",
    "cache_set": "CACHE SET", "http_out": "HTTP OUT", "fs_write": "FS WRITE",
}
# Call names whose arguments are kept by default.
CAPTURE_GLOBS = ["test_*", "*_handler", "*_view", "db_*"]


def _lookup(key: Column, table: dict, default: Column) -> Column:
    chain = F
    for name, value in table.items():
        chain = chain.when(key == name, F.lit(value))
    return chain.otherwise(default)


def edge_weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    return _lookup(kind, weights or EDGE_WEIGHTS, F.lit(0.0))


def provenance_weight(provenance: Column, weights: dict[str, float] | None = None) -> Column:
    return _lookup(provenance, weights or PROVENANCE_WEIGHTS, F.lit(DEFAULT_PROVENANCE_WEIGHT))


def hop_score(parent: Column, decay: float, kind: Column, provenance: Column, **weights) -> Column:
    return (
        parent * F.lit(decay)
        * edge_weight(kind, weights.get("edge_weights"))
        * provenance_weight(provenance, weights.get("provenance_weights"))
    )


def token_cost(hop: Column, has_spec: Column) -> Column:
    return F.when(hop == 0, F.when(has_spec, SEED_WITH_SPEC).otherwise(SEED_WITHOUT_SPEC)).otherwise(PERIPHERAL)


def document_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


def side_effect(fn: Column) -> Column:
    name = F.lower(fn)
    chain = F
    for kind, pattern in SIDE_EFFECTS:
        chain = chain.when(name.rlike(pattern), kind)
    return chain.otherwise(F.lit(None).cast("string"))


def effect_label(kind: Column) -> Column:
    return _lookup(kind, EFFECT_LABELS, F.upper(F.replace(kind, F.lit("_"), F.lit(" "))))


def confidence_band(coverage: Column) -> Column:
    return (
        F.when(coverage.isNull(), "MEDIUM").when(coverage >= 0.80, "HIGH").when(coverage >= 0.40, "MEDIUM").otherwise("LOW")
    )


def answer_confidence(runs: Column, coverage: Column, warnings: Column) -> Column:
    """Confidence from the first seed; no seed means no runs."""
    runs = F.coalesce(runs, F.lit(0))
    return (
        F.when((warnings > 0) | (runs == 0), "low")
        .when((runs >= 10) & (F.coalesce(coverage, F.lit(0.0)) >= 0.8), "high")
        .otherwise("medium")
    )


def provenance_pill(provenance: Column, runs: Column, coverage: Column) -> Column:
    runs, coverage = F.coalesce(runs, F.lit(0)), F.coalesce(coverage, F.lit(0.0))
    return (
        F.when(provenance == "runtime-only", "runtime-only")
        .when((runs > 0) | (coverage > 0), F.concat(F.lit("spec."), (coverage * 100).cast("int"), F.lit("%")))
        .otherwise("static")
    )


def slow_severity(value: Column, critical: float = 1000.0, warning: float = 200.0) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("info")
