"""Identifiers, hashes and texts derived from node columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters of the body that enter the embedding text.
BODY_CHARS = 512


def stable_id(repo: Column, path: Column, kind: Column, qualified_name: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", repo, path, kind, qualified_name), 256))


def node_hash(name: Column, signature: Column, body: Column) -> Column:
    return F.sha2(F.concat(name, signature, body), 256)


def embed_text(name: Column, signature: Column, docstring: Column, body: Column) -> Column:
    """Name and signature always; docstring and the start of the body only when not empty."""
    optional = F.filter(F.array(docstring, F.substring(body, 1, BODY_CHARS)), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.concat(F.array(name, signature), optional), " ")


def qualified_or_name(qualified_name: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(qualified_name, F.lit("")), name)
