"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import run_folder

# White space of the word and line rules, and the word itself.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later readers see the same rows, without its lineage."""
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays, unlike with ``lower``."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """Tells rows of equal doc_id and different texts apart; rows equal in both are interchangeable."""
    return F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")), text.isNull())


def slices(batch: pa.RecordBatch, sizes: pa.Array, taken: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' ``sizes`` (null: 0) sum up to ``taken`` or that are a single row.

    Parts are copied: string kernels such as ``ascii_lower`` go wrong on a slice that shares its batch's buffers.
    """
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + taken, side="right")))
        part = batch.slice(at, upto - at)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
        at = upto
