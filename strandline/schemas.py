"""Fixed schemas of the events and tables (never inferred)."""

from __future__ import annotations

NODE = (
    "stable_id string, node_hash string, type string, name string, qualified_name string, signature string, "
    "docstring string, body string, line_start int, line_end int, parent_id string"
)
EDGE_REF = "source string, target string"
TRACE_EVENT = (
    "type string, fn string, file string, line int, timestamp_ms double, exc_type string, task_id bigint, "
    "goroutine_id bigint, span_id bigint, args string, return_val string"
)
CALL_ITEM = (
    "stable_id string, name string, qualified_name string, hop int, frequency_ratio double, avg_ms double, args string"
)

FILE_CHANGED = (
    "repo string, commit_sha string, path string, language string, diff_type string, "
    "changed_nodes array<string>, added_nodes array<string>, deleted_nodes array<string>"
)
PARSED_FILE = (
    f"file_path string, language string, repo string, commit_sha string, nodes array<struct<{NODE}>>, "
    "intra_file_edges array<struct<source_stable_id string, target_stable_id string, type string>>, "
    "deleted_nodes array<string>"
)
EMBEDDED_NODES = (
    "repo string, commit_sha string, file_path string, nodes array<struct<stable_id string, vector array<float>, "
    "embed_text string, node_hash string, name string, type string, file_path string, language string>>"
)
RAW_TRACE = (
    "entrypoint_stable_id string, commit_sha string, repo string, duration_ms double, "
    f"events array<struct<{TRACE_EVENT}>>, coverage_pct double"
)
EXECUTION_PATH = (
    f"entrypoint_stable_id string, commit_sha string, repo string, call_sequence array<struct<{CALL_ITEM}>>, "
    "side_effects array<struct<type string, detail string, hop_depth int>>, "
    f"dynamic_only_edges array<struct<{EDGE_REF}>>, never_observed_static_edges array<struct<{EDGE_REF}>>, "
    "timing_p50_ms double, timing_p99_ms double, coverage_pct double"
)
QUERY_INTENT = (
    "raw_query string, keywords array<string>, symbols array<string>, query_type string, embed_query string, scope string"
)
WIRE_EVENT = (
    "t string, f string, file string, l int, ts double, g bigint, s bigint, args string, ret string, exc string"
)
COVERAGE_REPORT = (
    "files map<string, struct<executed_lines: array<int>>>, totals struct<percent_covered: double>"
)
METRIC = (
    "metric_type string, metric_name string, entity_id string, repo string, value double, unit string, "
    "commit_sha string, recorded_at timestamp"
)
GRAPH_NODE = (
    f"{NODE}, file_path string, language string, repo string, embed_text string, active boolean, updated_at timestamp, "
    "deleted_at timestamp, observed_calls int, avg_latency_ms double, branch_coverage double, last_traced_at timestamp, "
    "decorators string"
)
GRAPH_EDGE = (
    "source string, target string, type string, provenance string, observed_count bigint, confirmed_at timestamp, "
    "updated_at timestamp, detail string, frequency_ratio double"
)
PENDING_REF = (
    "source_stable_id string, target_name string, path_hint string, edge_type string, repo string, "
    "attempted_at timestamp, attempt_count int"
)
ENTRYPOINT_JOB = "stable_id string, name string, file_path string, priority int, repo string, language string"
BEHAVIOR_SPEC = (
    "node_stable_id string, repo string, commit_sha string, version int, spec_text string, branch_coverage double, "
    "observed_calls int, generated_at timestamp"
)
BOTTLENECK = (
    "entity_id string, entity_name string, category string, severity string, value double, unit string, detail string, "
    "repo string, detected_at timestamp"
)

# Required (non-null) fields and enumerations per contract, used to tell good records from bad.
CONTRACTS = {
    "file_changed": (
        FILE_CHANGED,
        ["repo", "commit_sha", "path", "language", "diff_type", "changed_nodes", "added_nodes", "deleted_nodes"],
        {"diff_type": ["added", "modified", "deleted", "full_rescan"]},
    ),
    "parsed_file": (
        PARSED_FILE,
        ["file_path", "language", "repo", "commit_sha", "nodes", "intra_file_edges", "deleted_nodes"],
        {},
    ),
    "embedded_nodes": (EMBEDDED_NODES, ["repo", "commit_sha", "nodes"], {}),
    "raw_trace": (
        RAW_TRACE,
        ["entrypoint_stable_id", "commit_sha", "duration_ms", "events"],
        {"events.type": ["call", "return", "exception", "async_call", "async_return"]},
    ),
    "execution_path": (
        EXECUTION_PATH,
        [
            "entrypoint_stable_id", "commit_sha", "repo", "call_sequence", "side_effects", "dynamic_only_edges",
            "never_observed_static_edges", "timing_p50_ms", "timing_p99_ms",
        ],
        {"side_effects.type": ["db_read", "db_write", "cache_read", "cache_set", "http_out", "fs_write"]},
    ),
    "query_intent": (
        QUERY_INTENT,
        ["keywords", "symbols", "query_type", "embed_query"],
        {"query_type": ["lookup", "flow", "impact"]},
    ),
}
