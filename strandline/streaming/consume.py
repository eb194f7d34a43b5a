"""Event consumption: batches from a stream to a handler, poison records to a dead-letter log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.session import run_folder
from strandline.sources.events import split_dlq
from strandline.sources.tables import ChangeLog

# Snapshot and history cadence in seconds.
REALTIME_S, HISTORY_S = 5, 60

Handler = Callable[[DataFrame, int], None]


def start(stream: DataFrame, each_batch: Handler, checkpoint: str | None = None, name: str | None = None,
          every_s: int | None = None) -> StreamingQuery:
    """Run ``each_batch`` per micro-batch: on a cadence, or over everything available once.

    A batch that raises is replayed with the same number after a restart, so handlers write
    under that number.
    """
    writer = stream.writeStream.foreachBatch(each_batch).option(
        "checkpointLocation", checkpoint or run_folder(stream.sparkSession, "stream-state")
    )
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=f"{every_s} seconds") if every_s else writer.trigger(availableNow=True)).start()


def consume(stream: DataFrame, contract: str, handle: Handler, dlq_path: str, post_batch: Callable[[int], None] | None = None,
            column: str = "event", message_id: str | None = None, counters: ChangeLog | None = None, **options) -> StreamingQuery:
    """Typed consumption at least once.

    Records that break the contract go to the dead-letter log under the batch number; anything
    the handler raises fails the batch, which is then retried. The batch is parsed once and kept
    while it is worked on. ``counters`` takes a row of counts per batch under its number.
    """
    dlq = ChangeLog(stream.sparkSession, dlq_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_dlq(batch, contract, column, message_id)
            dlq.append(bad, batch_id)
            handle(good, batch_id)
            if counters is not None:
                ok = good.agg(F.count(F.lit(1)).alias("processed"))
                failed = bad.agg(F.count(F.lit(1)).alias("failed"))
                counters.append(ok.crossJoin(failed).select(F.lit(contract).alias("kind"), "processed", "failed"), batch_id)
        finally:
            batch.unpersist()
        if post_batch is not None:
            post_batch(batch_id)

    return start(stream, each, **options)


def counter_totals(counters: ChangeLog) -> DataFrame:
    """(kind, received, processed, failed) over all batches; a replayed batch counts once."""
    rows = counters.read("kind string, processed bigint, failed bigint")
    sums = rows.groupBy("kind").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    return sums.select("kind", (F.col("processed") + F.col("failed")).alias("received"), "processed", "failed")


def dual_cadence(metrics: DataFrame, snapshot: Handler, history: Handler, realtime_s: int = REALTIME_S, history_s: int = HISTORY_S):
    """Two queries over one metric stream: frequent snapshots, slower history writes."""
    return start(metrics, snapshot, every_s=realtime_s), start(metrics, history, every_s=history_s)


def run(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Everything available through a file sink, read back as a table."""
    spark = stream.sparkSession
    path = run_folder(spark, label)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state")
    run(writer.option("path", path).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(path)
