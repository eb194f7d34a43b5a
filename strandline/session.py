"""Session helpers: runtime settings, the shared folder and checkpoints."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable options that every plan in this package relies on.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Whether an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Whether lists are gathered in a map of keys, which turns to sorting at 128 of them, or by sorting from the start ("false").
SORTED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session and give its workers the package."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


# By application: whether its workers have the package, and its folder where none is configured.
_SHIPPED: set[str] = set()
_LOCAL_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, wherever the driver was started from.

    Spark's own file service carries the archive, as with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def build(app: str, cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_OPTIONS.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is not set, a temporary folder is made in local mode; on a cluster it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="strandline-"))
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime option for the plans that run inside; what it was before holds again afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str, *by: str, into: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: no lineage, like a checkpoint, and of known size for joins with it.

    With ``by`` it has a folder for each value of those columns; ``into`` names a table to add to, so that it can be
    written in turns. Nothing reads what its plan shuffled once the table is there, so those files go at once.
    """
    spark = df.sparkSession
    folder = into or run_folder(spark, label)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    return table.select(*df.columns) if by else table


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes written tables, or folders of their parts, that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
