"""Ordered scans over groups that may be too large for one task.

A plain window would put a whole group in one task. Here a row gets the number of its chunk from its own (keys, order):
bounds from an even sample cut all rows, so a group holding a third of them spreads over a third of the chunks. A
window runs inside each chunk of a group, one summary row per chunk is carried over the chunks before it, and the carry
is joined back on (keys, chunk). The number is an expression of the row with the bounds as literals, so placing rows takes
no exchange; the windows of a scan need one, by (keys, chunk). The summary rows of a group, one for each chunk at most,
are the only thing one task ever sees together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

CHUNK = "__chunk"
# Rows drawn to place the bound of a chunk; they decide how even chunks are, not what a scan returns.
SAMPLED = 32


def _bounds(df: DataFrame, names: Sequence[str], chunks: int) -> list:
    """Rows of ``names`` that cut ``df`` into about even parts, from ``SAMPLED`` rows a chunk, drawn by hash."""
    columns = [F.col(n) for n in names]
    drawn = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLED * chunks).orderBy(*columns).collect()
    return list(dict.fromkeys(tuple(drawn[len(drawn) * k // chunks]) for k in range(1, chunks))) if len(drawn) >= chunks else []


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the chunk number, which never falls by ``order`` within ``keys``; equal (keys, order) share a chunk.

    The rows become a table first: bounds, local scans and summaries all read them, and each reads other columns.
    """
    return chunked(written(df, "chunks"), keys, order)


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``range_chunks`` of a table. The number is an expression of the row, made where it is read."""
    names = list(dict.fromkeys([*keys, *order]))
    bounds = _bounds(df, names, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = {f.name: f.dataType for f in df.select(*names).schema.fields}
    row = F.struct(*names)

    def place(low: int, high: int) -> Column:
        """The number of bounds at or below the row, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        bound = F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(names, bounds[mid], strict=True)])
        return F.when(row < bound, place(low, mid)).otherwise(place(mid + 1, high))

    return df.withColumn(CHUNK, place(0, len(bounds)).cast("bigint"))


def _columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _local(keys: Sequence[str], order: str | Sequence[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*_columns(order))


def _carry(keys: Sequence[str]):
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    return before, before.rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums by ``order`` within ``keys`` (``df`` carries a chunk column)."""
    keys = list(keys)
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(v).over(upto).alias(f"__l_{n}") for n, v in sums.items()])
    totals = df.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    _, previous = _carry(keys)
    offsets = totals.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"__t_{n}").over(previous), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    joined = local.join(offsets, [*keys, CHUNK])
    return joined.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def running_max_before(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, name: str) -> DataFrame:
    """Maximum of ``value`` over the rows strictly before the current one (null at first)."""
    keys = list(keys)
    before = _local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__l", F.max(value).over(before))
    tops = df.groupBy(*keys, CHUNK).agg(F.max(value).alias("__t"))
    _, previous = _carry(keys)
    carried = tops.select(*keys, CHUNK, F.max("__t").over(previous).alias("__o"))
    joined = local.join(carried, [*keys, CHUNK])
    return joined.select(*df.columns, F.greatest("__l", "__o").alias(name))


def previous_row(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Struct of ``fields`` of the row just before in ``order`` within ``keys`` (null at first)."""
    keys = list(keys)
    packed = F.struct(*fields)
    local = df.withColumn("__l", F.lag(packed).over(_local(keys, order)))
    lasts = df.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.struct(*_columns(order))).alias("__t"))
    ordered, _ = _carry(keys)
    carried = lasts.select(*keys, CHUNK, F.lag("__t").over(ordered).alias("__o"))
    joined = local.join(carried, [*keys, CHUNK])
    return joined.select(*df.columns, F.coalesce("__l", "__o").alias(name))


def as_of(rows: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], name: str) -> DataFrame:
    """``probes`` with a struct of ``values`` of the last of ``rows`` whose ``at`` is not above theirs (null without one).

    The values, compared in their order, must not fall by ``at`` within ``keys``. Rows and probes share one range of chunks,
    so neither a group with many rows nor a time asked for by many probes is one task's. ``at`` is not null.
    """
    keys, carried = list(keys), [c for c in probes.columns if c not in (*keys, at)]
    kept = probes.select(*keys, at, F.lit(1).alias("__kind"), F.struct(F.lit(0).alias("__none"), *carried).alias("__probe"))
    found = rows.select(*keys, at, F.lit(0).alias("__kind"), F.struct(*values).alias("__value"))
    both = range_chunks(found.unionByName(kept, allowMissingColumns=True), keys, [at, "__kind"])
    placed = running_max_before(both, keys, [at, "__kind"], "__value", name).where("__kind = 1")
    return placed.select(*keys, at, *[F.col(f"__probe.{c}").alias(c) for c in carried], name)


def sliding_sums(df: DataFrame, keys: Sequence[str], at: str, low: int, high: int, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over the rows of its group whose ``at`` lies in at + low .. at + high (null without any).

    Differences of running sums at the two edges, so the sums should be of whole numbers or decimals: doubles would lose
    digits. One row stands for equal (keys, at), hence a tick with many rows is summed before anything is put in order. Rows
    without ``at`` or with a null key get null.
    """
    keys = list(keys)
    ticks = df.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__v_{n}") for n, v in sums.items()])
    ticks = range_chunks(ticks, keys, [at])
    upto = {"__rows": F.col("__n"), **{n: F.coalesce(f"__v_{n}", F.lit(0)) for n in sums}}
    prefix = written(running_sums(ticks, keys, at, {f"__p_{n}": v for n, v in upto.items()}), "prefix")
    edges = F.explode(F.array(F.lit(low - 1), F.lit(high)))
    probes = ticks.select(*keys, F.col(at).alias("__of"), edges.alias("__edge")).withColumn(at, F.col("__of") + F.col("__edge"))
    looked = as_of(prefix, probes, keys, at, [f"__p_{n}" for n in upto], "__p")

    def between(field: str) -> Column:
        edge = lambda e: F.coalesce(F.max(F.when(F.col("__edge") == e, F.col(f"__p.__p_{field}"))), F.lit(0))
        return edge(high) - edge(low - 1)

    found = looked.groupBy(*keys, "__of").agg(between("__rows").alias("__rows"), *[between(n).alias(n) for n in sums])
    found = found.select(*keys, F.col("__of").alias(at), *[F.when(F.col("__rows") > 0, F.col(n)).alias(n) for n in sums])
    return df.join(found, [*keys, at], "left").select(*df.columns, *sums)


def numbered(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str) -> DataFrame:
    """1-based position by ``order`` within ``keys``."""
    return running_sums(df, keys, order, {name: F.lit(1)})


def stack_depth(df: DataFrame, keys: Sequence[str], order: str, step: str) -> DataFrame:
    """Depth of a stack driven by ``step`` (+1 push, -1 pop); pops on empty are ignored.

    Adds ``level`` (0-based depth of the frame pushed or popped) and ``orphan``. The raw sum
    minus its running minimum (never above zero) is the depth, which is a prefix scan rather
    than a loop: a chunk is summarised by its total and its lowest point.
    """
    keys = list(keys)
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = _local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__s", F.sum(step).over(upto))
    local = summed.withColumn("__m", F.min("__s").over(before))
    totals = summed.groupBy(*keys, CHUNK).agg(F.sum(step).alias("__t"), F.min("__s").alias("__low"))
    _, previous = _carry(keys)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__t").over(previous), F.lit(0)))
    offsets = offsets.withColumn("__floor", F.min(F.col("__off") + F.col("__low")).over(previous))
    joined = local.join(offsets.select(*keys, CHUNK, "__off", "__floor"), [*keys, CHUNK])
    total = F.col("__off") + F.col("__s")
    floor = F.least(F.lit(0), F.col("__floor"), F.col("__off") + F.col("__m"))
    return _levels(joined, df.columns, step, total, floor)


def _levels(rows: DataFrame, columns: Sequence[str], step: str, total: Column, floor: Column) -> DataFrame:
    depth = total - floor
    return rows.select(
        *columns,
        F.when(F.col(step) > 0, depth - 1).otherwise(depth).cast("int").alias("level"),
        ((F.col(step) < 0) & (depth < 0)).alias("orphan"),
    )
