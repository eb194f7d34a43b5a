"""Distributed prefix sums: range partitions, a running sum in each, and offsets per partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import shuffle_partitions, stored


def _running(group: str, value: str):
    def run(batches):
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            before = np.cumsum(values) - values
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            base = before[starts]
            if last is not None and groups[0] == last:
                base[0] -= carry
            local = before - np.repeat(base, np.diff(np.r_[starts, n]))
            last, carry = groups[-1], int(local[-1] + values[-1])
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_local"])

    return run


def running_total(df: DataFrame, group: str, order: list, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier in ``order``.

    ``group`` and ``value`` are integer columns without nulls. Range partitions split a group of any size; they are
    written once, since a second run would sample other bounds. Only one row per (partition, group) is summed up
    further. Rows equal in ``group`` and ``order`` are taken in any order. An empty frame gives an empty frame.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    sorted_rows = df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    ranged = stored(sorted_rows.mapInArrow(_running(group, value), schema), "prefix")
    pieces = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_piece")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_group", "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = ranged.join(offsets, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_piece")))
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).alias(out))
