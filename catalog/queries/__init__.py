"""Registered queries, one module per operator family."""

import importlib

for _module in ("sources", "traces", "metrics", "search", "graph", "documents", "index", "provenance", "streams", "scalars"):
    importlib.import_module(f"catalog.queries.{_module}")
