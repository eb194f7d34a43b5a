"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored


def _through(parents: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    looked_up = parents.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
    return df.join(looked_up, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_up", column)).drop("_node", "_up")


def _to_roots(parents: DataFrame) -> DataFrame:
    """Parents are smaller than their nodes; each round doubles the length of the steps up."""
    while True:
        known = parents.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        stepped = parents.join(known, F.col("up") == F.col("_node"), "left")
        stepped = stored(stepped.select("node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")), "roots")
        if stepped.where("moved").isEmpty():
            return stepped.select("node", "up")
        parents = stepped.select("node", "up")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest node, the root.

    Per round every node hangs below its smallest neighbour, trees shrink to their roots, and what edges are left
    between roots go on: no node's neighbours are gathered, and rounds grow with the logarithm of a path. Loops,
    repeated edges and nulls are ignored.
    """
    def tidy(df):
        pairs = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("_two"))
        return stored(pairs.where("_two").select("a", "b").distinct(), "edges")

    left, found = tidy(edges), None
    while not left.isEmpty():
        parents = _to_roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))
        found = parents if found is None else stored(_through(parents, found, "up").unionByName(parents), "found")
        left = tidy(_through(parents, _through(parents, left, "a"), "b"))
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.withColumnRenamed("up", "root")
