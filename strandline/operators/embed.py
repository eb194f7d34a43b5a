"""Embedding of node texts through a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: texts handed to a provider at once.
BATCH = 64


def embed(df: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = BATCH, dim: int | None = None,
          text: str = "embed_text") -> DataFrame:
    """Adds ``vector`` from ``provider``, called on each task's texts in batches."""
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            texts = frame[text].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in provider(texts[i:i + batch])]
            yield frame.assign(vector=vectors)

    return check_dimension(df.mapInPandas(run, schema), dim)


def check_dimension(df: DataFrame, dim: int | None) -> DataFrame:
    """Fails the job when a vector has another length than expected."""
    if not dim:
        return df
    wrong = F.concat(F.lit(f"Expected vector dimension {dim}, got "), F.size("vector").cast("string"))
    return df.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(wrong).cast("array<float>")))


def embed_by_hashing(df: DataFrame, dim: int = 256, text: str = "embed_text") -> DataFrame:
    """Deterministic built-in provider: hashed word counts of unit length, all JVM-side."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__w", F.split(F.lower(F.col(text)), r"\W+"))
    counted = HashingTF(numFeatures=dim, inputCol="__w", outputCol="__tf").transform(words)
    unit = Normalizer(inputCol="__tf", outputCol="__v").transform(counted)
    return unit.withColumn("vector", vector_to_array("__v", "float32")).drop("__w", "__tf", "__v")
