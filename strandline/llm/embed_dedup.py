"""Embedding near-dedup: int8 tile products with error bounds, full precision only where these leave a doubt."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_partitions, stored
from strandline.llm.components import components
from strandline.llm.simhash import smallest_linked

THRESHOLD = 0.98
# Vectors of one chunk; two chunks make a tile.
TILE = 512
# Vectors from which the directions of the grid are fitted, and how many directions.
SAMPLE, DIRECTIONS = 4096, 2
# Pairs recomputed at once.
PAIRS = 65_536


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def quantised(unit: np.ndarray):
    """(int8 values as float32, scale, length of what they stand for, length of the error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    values = np.rint(unit / scale[:, None])
    stand_for = values * scale[:, None]
    return values.astype(np.float32), scale, np.linalg.norm(stand_for, axis=1), np.linalg.norm(unit - stand_for, axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors whose cosine in double precision reaches ``threshold``.

    With u = q + e, the quantised part and its error, u.v differs from q.q' by at most |e||q'| + |e'||q| + |e||e'|. Pairs that
    are surely below or surely above by that bound are settled by the product of int8 values, which float32 holds
    exactly below 2**24; the others are computed in full.
    """
    qa, sa, la, ea = quantised(a)
    qb, sb, lb, eb = quantised(b)
    product = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        product += qa[:, k : k + 1024] @ qb[:, k : k + 1024].T
    product *= sa[:, None]
    product *= sb[None, :]
    doubt = ea[:, None] * (lb + eb)[None, :] + la[:, None] * eb[None, :] + 1e-9
    sure = product - doubt >= threshold
    i, j = np.nonzero((product + doubt >= threshold) & ~sure)
    keep = np.concatenate([
        np.einsum("nd,nd->n", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) >= threshold for k in range(0, len(i), PAIRS)
    ]) if len(i) else np.zeros(0, bool)
    si, sj = np.nonzero(sure)
    return np.concatenate([si, i[keep]]), np.concatenate([sj, j[keep]])


def _with_cells(directions: dict[int, np.ndarray], width: float):
    """Adds the cell of a grid along some directions: vectors nearer than ``width`` are in one or in neighbouring cells."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros((batch.num_rows, DIRECTIONS), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                along = _unit(_matrix(batch.column("embedding").take(pa.array(rows)), dim)) @ directions.get(int(dim), np.zeros((dim, DIRECTIONS)))
                cells[rows] = np.floor(along / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], names=[*batch.schema.names, "x", "y"])

    return run


def _directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Main directions of a bounded sample, per dimension; any orthonormal ones give right results."""
    rows = classes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("embedding").collect()
    out = {}
    for dim in {len(r[0]) for r in rows}:
        unit = _unit(np.array([r[0] for r in rows if len(r[0]) == dim], np.float64))
        found = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)[2][:DIRECTIONS].T
        out[dim] = np.pad(found, ((0, 0), (0, DIRECTIONS - found.shape[1])))
    return out


def _products(threshold: float):
    """Rows (tile, side, id, weight, dim, embedding) sorted by tile -> (id, links, root) of what is linked in the tile."""

    def linked(table: pa.Table):
        side = table.column("side").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        unit = _unit(_matrix(table.column("embedding").combine_chunks(), table.column("dim")[0].as_py()))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(second):
            i, j = close_pairs(unit[first], unit[second], threshold)
            i, j = first[i], second[j]
        else:
            i, j = close_pairs(unit, unit, threshold)
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        root = ids[order][smallest_linked(len(ids), place[i], place[j])[place]]
        rows = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[rows]), pa.array(links[rows].astype(np.int64)), pa.array(root[rows])], names=["id", "links", "root"]
        )

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("tile")[0].as_py() != tiles[a]:
                    yield linked(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield linked(pa.concat_tables(held))

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, label, embedding).

    Equal vectors of a label are compared once and weighted. The rest is laid on a grid by label; chunks of one cell or
    of neighbouring cells are multiplied tile by tile, and each tile returns counts and one edge per vector, not pairs.
    A row links with nothing when its label or vec_id is null, or its vector is null, empty, zero or holds null or
    non-finite parts, and vectors of different length do not link. Rows of one vec_id count as separate vectors.
    Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    plain = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    valid = plain & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = [F.when(valid, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"h{k}") for k in (1, 2)]
    keyed = stored(rows.select("vec_id", "label", "embedding", *key), "vectors")
    classes = keyed.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")
    )
    # A class has a number of its own: one vec_id may stand on rows of several classes, and of several labels.
    classes = stored(classes.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "classes")
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-9
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", x int, y int"
    placed = stored(classes.mapInArrow(_with_cells(_directions(classes), width), schema), "cells")
    # Chunks of each cell, and the pairs of chunks of this and of neighbouring cells, each pair once.
    cell = ["label", "dim", "x", "y"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = sizes.withColumn("step", F.explode(steps)).withColumns({"x2": F.expr("x + step.dx"), "y2": F.expr("y + step.dy")})
    other = sizes.select("label", "dim", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("chunks").alias("chunks2"))
    pairs = near.join(other, ["label", "dim", "x2", "y2"]).select(
        *cell, "x2", "y2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "chunks2"
    ).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
    pairs = pairs.where("x != x2 or y != y2 or c <= c2").withColumn("tile", F.xxhash64(*cell, "c", "x2", "y2", "c2"))
    first = pairs.select(*cell, "c", "tile", F.lit(0).alias("side"))
    second = pairs.where("x != x2 or y != y2 or c != c2").select(
        "label", "dim", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("c2").alias("c"), "tile", F.lit(1).alias("side")
    )
    members = placed.join(sizes, cell).withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.col("chunks")).cast("int"))
    dealt = members.join(first.unionByName(second), [*cell, "c"]).select("tile", "side", "id", "weight", "dim", "embedding")
    dealt = dealt.repartition(shuffle_partitions(vectors.sparkSession), "tile").sortWithinPartitions("tile")
    found = stored(dealt.mapInArrow(_products(threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    rooted = placed.select("h1", "h2", "id", "vec_id", "weight").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
