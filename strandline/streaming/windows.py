"""Event-time operators on streams. Watermarks bound the state; late rows beyond them are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scan import as_of
from strandline.session import written
from strandline.sources.tables import ChangeLog


def with_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Cast the event time (files often carry it without a zone) and set its watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sliding_rates(stream: DataFrame, key: str, ts: str, window_s: int = 60, every_s: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Messages per second in every sliding window of each key."""
    counted = with_time(stream, ts, delay).groupBy(
        F.window(ts, f"{window_s} seconds", f"{every_s} seconds"), F.col(key).alias("entity_id")
    ).count()
    return counted.select("entity_id", F.col("window.end").alias("window_end"), (F.col("count") / float(window_s)).alias("value"))


def idle_sessions(stream: DataFrame, keys: list[str], ts: str, gap: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    grouped = with_time(stream, ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("s")).count()
    return grouped.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), F.col("count").alias("events"))


def next_admitted(rows: DataFrame, last: DataFrame, keys: list[str], ts: str, horizon_s: int = 86_400) -> DataFrame:
    """(keys, us) of the rows of one batch that are accepted, after ``last`` (keys, us) of earlier batches: the first of a
    key, then each that comes ``horizon_s`` or later after the last accepted.

    Pointer jumping: every time of a key points to the first one ``horizon_s`` or later, which is one scan over ranges of
    times; from the first accepted time of each key the chain of pointers is then followed in steps of 1, 2, 4, ... pointers.
    The number of rounds is the logarithm of the longest chain there can be. No key's rows are gathered. Of rows at one time one
    is accepted, a row before the last accepted one is a repeat, rows without time are left out. Null is a key like any other.
    """
    horizon = horizon_s * 1_000_000
    # A text for all keys, which joins treat alike whether keys are null or not.
    named = F.to_json(F.struct(*keys)).alias("__key")
    times = rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us is not null").distinct()
    times = written(times.select("*", named), "times")
    before = last.select(named, F.col("us").alias("__last"))
    span = times.groupBy("__key").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    chain = span.agg(F.max(F.floor((F.col("high") - F.col("low")) / horizon)).alias("steps")).first()["steps"]
    if chain is None:
        return times.select(*keys, "us")

    # Ranges run backwards: the last time not above -(us + horizon) is the first one at or behind us + horizon.
    back = times.select("__key", (-F.col("us")).alias("at"))
    known = times.select("__key", "us").unionByName(before.select("__key", F.col("__last").alias("us")).join(span, "__key", "left_semi")).distinct()
    probes = known.withColumn("at", -F.col("us") - F.lit(horizon))
    pointed = as_of(back.withColumn("v", F.col("at")), probes, ["__key"], "at", ["v"], "__to")
    jumps = written(pointed.select("__key", "us", (-F.col("__to.v")).alias("to")).where("to is not null"), "jumps")

    fresh = span.join(before, "__key", "left_anti").select("__key", F.col("low").alias("us"))
    begun = before.withColumnRenamed("__last", "us").join(jumps, ["__key", "us"]).select("__key", F.col("to").alias("us"))
    taken = fresh.unionByName(begun)
    for k in range(int(chain).bit_length()):
        ahead = taken.join(jumps, ["__key", "us"]).select("__key", F.col("to").alias("us"))
        taken = written(taken.unionByName(ahead), "taken")
        if k + 1 < int(chain).bit_length():
            onward = jumps.select("__key", F.col("us").alias("to"), F.col("to").alias("__next"))
            jumps = written(jumps.join(onward, ["__key", "to"]).select("__key", "us", F.col("__next").alias("to")), "jumps")
    return times.join(taken, ["__key", "us"], "left_semi").select(*keys, "us")


def readmit_batches(stream: DataFrame, keys: list[str], ts: str, log: ChangeLog, horizon_s: int = 86_400):
    """``next_admitted`` as (handler for ``foreachBatch``, schema): accepted (keys, us) are a table in ``log``.

    A replayed batch starts from the batches before it and writes the same rows again.
    """
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys) + ", us bigint"

    def each(batch, number):
        before = log.read(schema).where(F.col("batch") < number).groupBy(*keys).agg(F.max("us").alias("us"))
        log.append(next_admitted(batch, before, keys, ts, horizon_s), number)

    return each, schema


def correlate(parsed: DataFrame, embedded: DataFrame, keys: list[str], delay: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Inner join of two streams on ``keys`` within a time bound, whichever side comes first.

    Both carry their event time as ``ts``; state older than the bound is dropped.
    """
    left = with_time(parsed, "ts", delay).withColumnRenamed("ts", "parsed_at").alias("p")
    right = with_time(embedded, "ts", delay).withColumnRenamed("ts", "embedded_at").alias("e")
    condition = (F.col("embedded_at") >= F.col("parsed_at") - F.expr(f"interval {within}")) & (
        F.col("embedded_at") <= F.col("parsed_at") + F.expr(f"interval {within}")
    )
    for key in keys:
        condition = condition & (F.col(f"p.{key}") == F.col(f"e.{key}"))
    extra = [F.col(f"e.{c}") for c in right.columns if c not in keys]
    return left.join(right, condition).select("p.*", *extra)
