"""Registered queries against DuckDB. ``ORACLE_ALL=1`` runs every one, else one per family."""

import os

import pytest

import __spark_entry__  # noqa: F401  (fills the registry)
from catalog.registry import ORACLES, QUERIES
from tests.compare import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "hybrid_seeds", "tk1_vector_topk", "gr1_best_score_expansion", "wn8_display_ids", "doc8_context_document", "wn1_stack_pairing", "wn3_name_matched_pairing",
    "wn5_cross_run_frequency", "ag5_path_metrics", "ag15_trend_slope", "set6_bottleneck_union", "gr2_transitive_closure", "jn18_entrypoint_jobs",
    "gr6_provenance_pass", "doc1_spec_text", "snk5_spec_upsert", "prj9_file_events", "jn8_import_edges", "snk1_node_upsert", "src2_dead_letters",
    "st9_sliding_throughput", "st3_graph_maintenance",
]
NAMES = [n for n in QUERIES if n in ORACLES] if os.environ.get("ORACLE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name]) == ""


def test_every_query_has_a_counterpart():
    # Corpus operators, which register beside these, may do without SQL.
    own = {n for n, run in QUERIES.items() if run.__module__ == "catalog.registry"}
    assert own and own <= set(ORACLES)
