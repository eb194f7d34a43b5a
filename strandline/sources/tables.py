"""Stored tables: scans, keyed upserts, tombstones, snapshots on a file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import run_folder

NODE_ATTRIBUTES = [
    "name", "type", "signature", "docstring", "body", "file_path", "qualified_name", "language", "repo", "embed_text", "node_hash"
]


def scan(table: DataFrame, columns: Sequence[str], repo: str | None = None, active: bool = True, scope: str | None = None) -> DataFrame:
    """Pruned read: equality filters on repository, activity and path reach the files."""
    rows = table
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    if active and "active" in table.columns:
        rows = rows.filter(F.col("active"))
    if scope is not None:
        rows = rows.filter(F.col("file_path") == scope)
    return rows.select(*columns)


def upsert_nodes(nodes: DataFrame, batch: DataFrame, now: Column, order: Sequence[str] = ()) -> DataFrame:
    """Batch attributes overwrite, the node becomes active, its other properties stay.

    A batch with several rows of one id counts its last by ``order`` only.
    """
    attributes = [c for c in NODE_ATTRIBUTES if c in batch.columns]
    rank = F.struct(*order) if order else F.struct(*attributes)
    last = batch.groupBy("stable_id").agg(F.max_by(F.struct(*attributes), rank).alias("__b"))
    joined = nodes.join(last, "stable_id", "full")
    hit = F.col("__b").isNotNull()
    new = {c: F.col(f"__b.{c}") for c in attributes} | {"active": F.lit(True), "updated_at": now}
    return joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns]
    )


def upsert_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """Static CALLS edges whose ends both exist; an enriched edge becomes static again."""
    ids = nodes.select("stable_id")
    pairs = batch.select("source", "target").distinct()
    for end in ("source", "target"):
        pairs = pairs.join(ids.withColumnRenamed("stable_id", end), end, "left_semi")
    marked = pairs.select("source", "target", F.lit("CALLS").alias("type"), F.lit(True).alias("__new"))
    joined = edges.join(marked, ["source", "target", "type"], "full")
    hit = F.col("__new").isNotNull()
    new = {"provenance": F.lit("static"), "updated_at": now}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in edges.columns])


def tombstone(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Deactivate nodes and drop every edge at either end of them."""
    gone = ids.select("stable_id").distinct()
    flagged = nodes.join(gone.withColumn("__gone", F.lit(True)), "stable_id", "left")
    dead = F.col("__gone").isNotNull()
    new = {"active": F.lit(False), "deleted_at": now}
    kept_nodes = flagged.select(*[F.when(dead, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns])
    kept = edges
    for end in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("stable_id", end), end, "left_anti")
    return kept_nodes, kept.select(edges.columns)


def upsert_vectors(vectors: DataFrame, batch: DataFrame, key: str = "stable_id", order: Sequence[str] = ()) -> DataFrame:
    """Keyed replace: the last row of the batch wins over the stored one."""
    rest = [c for c in vectors.columns if c != key]
    rank = F.struct(*order) if order else F.struct(*rest)
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__b"))
    joined = vectors.join(last, key, "full")
    return joined.select(key, *[F.when(F.col("__b").isNotNull(), F.col(f"__b.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def delete_vectors(vectors: DataFrame, ids: DataFrame, key: str = "stable_id") -> DataFrame:
    return vectors.join(ids.select(key), key, "left_anti").select(vectors.columns)


class Snapshots:
    """A table kept as numbered snapshot folders below one path.

    A write never touches the folder being read: it fills the next one, and readers take the
    highest number whose write finished. A replayed batch writes the same content again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        done = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name[1:]))
        return sorted(done)

    def read(self, schema: str, before: int | None = None) -> DataFrame:
        """Newest finished version, or the newest one below ``before``."""
        done = [v for v in self.versions() if before is None or v < before]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{done[-1]}")

    def write(self, df: DataFrame, version: int | None = None, partition_by: Sequence[str] = ()) -> int:
        """Write as the next version, or again as ``version`` when a batch is replayed."""
        done = self.versions()
        number = version if version is not None else (done[-1] + 1 if done else 0)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/v{number}")
        return number


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").partitionBy("metric_type").parquet(path)


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Jobs by repository and language, highest priority first inside each file.

    Splitting by a hash of the id keeps one busy repository from becoming one task.
    """
    salt = F.pmod(F.xxhash64("stable_id"), F.lit(16))
    laid = jobs.repartition("repo", "language", salt).sortWithinPartitions("repo", "language", F.desc("priority"))
    laid.write.mode("append").partitionBy("repo", "language").parquet(path)


def written_back(df: DataFrame, label: str, writer) -> DataFrame:
    """Run ``writer(df, path)`` into a fresh folder and read the result."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    writer(df, path)
    return spark.read.parquet(path)


class ChangeLog:
    """Append-only batches of keyed rows below one path; readers merge them.

    A stream writes only what its batch holds, never the table. Writing a batch again replaces
    that batch alone, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, schema: str) -> DataFrame:
        """All rows with their ``batch`` number."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", self.path).parquet(self.path)
