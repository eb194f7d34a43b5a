"""Question understanding: validated model answers, keyword fallback, deduplicated batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import intent_key, keywords
from strandline.operators.search import DECAY, HOP_DEPTH, MAX_SEEDS, MAX_TOKENS
from strandline.schemas import QUERY_INTENT

QUERY_TYPES = ["lookup", "flow", "impact"]


def intents(df: DataFrame, question: str = "question", answer: str | None = None) -> DataFrame:
    """Adds the intent columns. An answer that is no valid intent falls back to keywords.

    The question itself always is ``raw_query``. ``valid`` tells which way was taken.
    """
    parsed = F.from_json(answer, f"{QUERY_INTENT}, _bad string", {"columnNameOfCorruptRecord": "_bad"}) if answer else F.lit(None)
    rows = df.withColumn("__a", parsed if answer else parsed.cast(f"struct<{QUERY_INTENT}>"))
    valid = F.col("__a").isNotNull() & F.col("__a.query_type").isin(QUERY_TYPES)
    for field in ("keywords", "symbols", "embed_query"):
        valid = valid & F.col(f"__a.{field}").isNotNull()
    if answer:
        valid = valid & F.col("__a._bad").isNull()
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    pick = lambda field, fallback: F.when(F.col("valid"), F.col(f"__a.{field}")).otherwise(fallback)
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "raw_query": F.col(question),
            "keywords": pick("keywords", keywords(F.col(question))),
            "symbols": pick("symbols", none),
            "query_type": pick("query_type", F.lit("flow")),
            "embed_query": pick("embed_query", F.col(question)),
            "scope": pick("scope", F.lit(None).cast("string")),
        }
    ).drop("__a")


def distinct_questions(df: DataFrame, question: str = "question", repo: str = "repo") -> DataFrame:
    """One row per cache key, so a question asked often is answered once."""
    rest = [c for c in df.columns]
    keyed = df.withColumn("intent_key", intent_key(F.col(question), F.col(repo)))
    return keyed.groupBy("intent_key").agg(F.min(F.struct(*rest)).alias("r")).select("intent_key", "r.*")


def request_defaults(df: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """Missing or non-positive budgets and seed counts, and the expansion settings, by default."""
    positive = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.col(c)).otherwise(default)
    return df.withColumns(
        {
            "max_tokens": positive("max_tokens", MAX_TOKENS),
            "max_seeds": positive("max_seeds", max_seeds),
            "hop_depth": F.lit(HOP_DEPTH),
            "decay": F.lit(DECAY),
        }
    )
