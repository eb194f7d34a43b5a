"""Streams over several micro-batches against their batch counterparts."""

import random

from pyspark.sql import functions as F

from strandline.operators import metrics, traces
from strandline.session import run_folder
from strandline.sources.tables import ChangeLog, Snapshots
from strandline.streaming import consume as cs
from strandline.streaming import maintain as mn

EVENTS = "repo string, entry_id bigint, trace_id string, run_no bigint, seq bigint, ts timestamp, type string, fn string, file string, task_id bigint, timestamp_ms double"


def files(spark, frames, schema):
    """One file, hence one micro-batch, per frame."""
    path = run_folder(spark, "input")
    for frame in frames:
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def runs(gap_after=None):
    """Trace events per run; optionally a long pause after one run."""
    rng = random.Random(4)
    batches, seq = [], 0
    for run in range(12):
        day = run + (20 if gap_after is not None and run > gap_after else 0)
        rows = []
        for entry in (1, 2):
            for _ in range(rng.randint(2, 10)):
                rows.append(("r", entry, f"{entry}@{run}", run, seq, __import__("datetime").datetime(2024, 1, 1 + day % 28 if day < 28 else 28, 0, 0), rng.choice(["call", "return"]), rng.choice("ab"), "f", None, float(seq)))
                seq += 1
        batches.append(rows)
    return batches


def test_running_frequencies_equal_the_batch_result(spark):
    for gap in (None, 5):
        batches = runs(gap)
        grouped = [sum(batches[i:i + 3], []) for i in range(0, 12, 3)]
        state, out = Snapshots(spark, run_folder(spark, "state")), ChangeLog(spark, run_folder(spark, "out"))
        cs.run(cs.start(files(spark, grouped, EVENTS), mn.frequency_handler(state, out)))
        schema = "trace_id string, seq bigint, fn string, frequency_ratio double, avg_ms double, runs bigint, total_runs bigint"
        got = sorted((r.seq, r.runs, r.total_runs, round(r.avg_ms, 6)) for r in out.read(schema).collect())
        whole = spark.createDataFrame(sum(batches, []), EVENTS)
        starts = whole.groupBy("repo", "entry_id", "trace_id", "run_no").agg(F.min("ts").alias("started"))
        epochs = traces.expiry_epochs(starts, ["repo", "entry_id"], "run_no", "started").select("trace_id", "epoch")
        pairs = traces.paired_calls(whole.join(epochs, "trace_id"), ["repo", "entry_id", "trace_id", "run_no", "epoch"])
        want = traces.cross_run_frequencies(pairs, ["repo", "entry_id", "epoch"], "run_no")
        assert got == sorted((r.seq, r.runs, r.total_runs, round(r.avg_ms, 6)) for r in want.collect())


def test_lags_carry_over_batches(spark):
    rng = random.Random(6)
    rows = [("r", rng.choice("kl"), i, i, rng.choice(["trace", "path"])) for i in range(60)]
    schema = "repo string, entity string, position bigint, at bigint, kind string"
    parts = [rows[i:i + 15] for i in range(0, 60, 15)]
    stream = files(spark, parts, schema).withColumn("ts", F.timestamp_seconds("at"))
    state, out = Snapshots(spark, run_folder(spark, "state")), ChangeLog(spark, run_folder(spark, "out"))
    cs.run(cs.start(stream, mn.lag_handler(state, out)))
    got = sorted((r.position, r.lag_s) for r in out.read("position bigint, lag_s double").collect())
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    want = metrics.processing_lags(batch, ["repo", "entity"], "position", "ts")
    assert got == sorted((r.position, r.lag_s) for r in want.collect())


def test_replayed_batches_change_nothing(spark):
    log = ChangeLog(spark, run_folder(spark, "log"))
    df = spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")
    for number in (0, 1, 1, 0):
        mn.log_handler(log)(df, number)
    assert log.read("source string, target string").count() == 4
    table = Snapshots(spark, run_folder(spark, "table"))
    for number in (0, 1, 1):
        before = table.read("n bigint", before=number)
        table.write(before.unionAll(spark.createDataFrame([(number,)], "n bigint")), number)
    assert sorted(r.n for r in table.read("n bigint").collect()) == [0, 1]


def test_graph_log_orders_deletions(spark):
    log = mn.GraphLog(spark, run_folder(spark, "graph"))
    node = lambda *ids: spark.createDataFrame([(i, i, "f", "p", "r", "h") for i in ids], mn.GraphLog.NODES)
    edge = lambda *pairs: spark.createDataFrame(list(pairs), mn.GraphLog.EDGES)
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], mn.GraphLog.GONE)
    each = log.handler(lambda b: b)
    each((node("a", "b", "c"), edge(("a", "b"), ("b", "c"), ("a", "x")), gone()), 0)
    each((node(), edge(), gone("b")), 1)
    each((node("b"), edge(("b", "c")), gone("c")), 2)
    nodes = spark.createDataFrame([], mn.GraphLog.NODES + ", active boolean, updated_at timestamp, deleted_at timestamp")
    edges = spark.createDataFrame([("a", "c", "CALLS", "static", None)], "source string, target string, type string, provenance string, updated_at timestamp")
    got_nodes, got_edges = log.current(nodes, edges, F.current_timestamp())
    assert {r.stable_id: r.active for r in got_nodes.collect()} == {"a": True, "b": True, "c": False}
    assert got_edges.count() == 0


def test_work_is_readmitted_as_one_key_after_another_would_be(spark):
    """A key with most rows, keys of one row and a null key, in batches cut anywhere, against a loop over sorted times."""
    import random

    from pyspark.sql import functions as F

    from strandline.streaming import windows as wn

    rng, hour = random.Random(6), 3600
    rows = [("hot", rng.randrange(0, 60 * 24 * hour)) for _ in range(1500)] + [(rng.choice(["a", "b", None]), rng.randrange(0, 20 * 24 * hour)) for _ in range(60)]
    rows += [("edge", at) for at in (0, 24 * hour - 1, 24 * hour, 48 * hour, 48 * hour, 100 * hour)] + [("late", None)]
    want = {}
    for key, at in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if key not in want or at >= want[key][-1] + 24 * hour:
            want.setdefault(key, []).append(at)
    schema = "key string, ts timestamp"
    for cuts in ([0, 10**9], [0, 9 * 24 * hour + 5, 30 * 24 * hour, 10**9]):
        log, got = ChangeLog(spark, run_folder(spark, "admitted")), {}
        handler, kinds = wn.readmit_batches(spark.createDataFrame([], schema), ["key"], "ts", log)
        for number, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = [r for r in rows if (r[1] is None and number == 0) or (r[1] is not None and low <= r[1] < high)]
            handler(spark.createDataFrame(part, "key string, s bigint").select("key", F.timestamp_seconds("s").alias("ts")), number)
        for r in log.read(kinds).collect():
            got.setdefault(r.key, []).append(r.us // 1_000_000)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_a_year_of_slices_takes_a_few_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandline.streaming import windows as wn

    tables, real = [], wn.written
    monkeypatch.setattr(wn, "written", lambda df, label: tables.append(label) or real(df, label))
    rows = spark.range(365 * 4).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 21_600).alias("ts"))
    last = spark.createDataFrame([], "key string, us bigint")
    assert wn.next_admitted(rows, last, ["key"], "ts").count() == 365
    assert tables.count("taken") == 9 and len(tables) <= 20
    empty = wn.next_admitted(rows.limit(0), last, ["key"], "ts")
    assert empty.columns == ["key", "us"] and empty.count() == 0


def test_work_is_readmitted_without_gathering_a_key(spark):
    from pyspark.sql import functions as F

    from strandline.streaming import windows as wn

    cuts = [[0, 0, 1, 23], [24, 30, 47, 48, 49], [2, 100, 123, 124]]
    log, none = ChangeLog(spark, run_folder(spark, "admitted")), spark.createDataFrame([], "key string, ts timestamp")
    handler, schema = wn.readmit_batches(none, ["key"], "ts", log)
    for number in (0, 1, 2, 1):
        rows = spark.createDataFrame([(k, h * 3600) for k in ("k", None) for h in cuts[number]], "key string, s bigint").select("key", F.timestamp_seconds("s").alias("ts"))
        plan = wn.next_admitted(rows, log.read(schema).select("key", "us"), ["key"], "ts")._jdf.queryExecution().toString()
        assert "Pandas" not in plan
        handler(rows, number)
    got = sorted((str(r.key), r.us // 3_600_000_000) for r in log.read(schema).collect())
    assert got == [(k, h) for k in ("None", "k") for h in (0, 24, 48, 100, 124)]
