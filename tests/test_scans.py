"""Window rewrites against plain loops on random input, with chunks small enough to matter."""

import random

from pyspark.sql import functions as F

from strandline.functions import ranks, scan
from strandline.operators import bottlenecks, expand, metrics, traces

EVENT = "trace string, seq bigint, type string, fn string, file string, task_id bigint, timestamp_ms double, args string, return_val string"


def random_events(seed, n_traces=25, hot=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n_traces):
        # The first trace holds more than half of all rows.
        for seq in range(hot if i == 0 else rng.randint(1, 20)):
            kind = rng.choices(["call", "return", "exception", "async_call"], [5, 4, 2, 1])[0]
            task = rng.choice([None, 0, 1]) if i % 3 == 0 else None
            rows.append((f"t{i}", seq, kind, rng.choice("abc"), "f.py", task, float(seq * 3 + rng.randint(0, 2)), None, None))
    return rows


def loop_pairs(rows):
    """(trace, task, seq, call_seq, fn, hop, ms) with one stack per trace and task."""
    stacks, out = {}, []
    for trace, seq, kind, fn, _, task, ts, *_ in rows:
        stack = stacks.setdefault((trace, task or 0), [])
        if kind == "call":
            stack.append((seq, fn, ts))
        elif kind in ("return", "exception") and stack:
            opened, name, start = stack.pop()
            out.append((trace, task or 0, seq, opened, name, len(stack), max(0.0, ts - start)))
    return sorted(out)


def test_stack_pairing_equals_a_stack(spark):
    for seed in (1, 2):
        rows = random_events(seed)
        df = spark.createDataFrame(rows, EVENT)
        want = loop_pairs(rows)
        got = traces.paired_calls(df, ["trace"]).select("trace", "task", "seq", "call_seq", "fn", "hop", "avg_ms")
        assert sorted(map(tuple, got.collect())) == want


def test_name_matching_equals_a_search_from_the_top(spark):
    rows = random_events(3)
    want, open_calls = [], {}
    for trace, seq, kind, fn, file, _, ts, *_ in rows:
        stack = open_calls.setdefault(trace, [])
        if kind == "call":
            stack.append((fn, ts))
        elif kind == "return":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == fn:
                    want.append((trace, seq, f"{file}:{fn}", ts - stack.pop(i)[1]))
                    break
    got = traces.name_matched_calls(spark.createDataFrame(rows, EVENT), ["trace"])
    assert sorted(map(tuple, got.select("trace", "seq", "entity_id", "duration_ms").collect())) == sorted(want)


def test_side_effect_depth(spark):
    rows = [("t", 0, "return"), ("t", 1, "call"), ("t", 2, "call"), ("t", 3, "exception"), ("t", 4, "call"), ("t", 5, "call")]
    names = {1: "run", 2: "db.execute", 4: "fetchall", 5: "db.execute"}
    df = spark.createDataFrame([(t, s, k, names.get(s, "x"), "f", None, 1.0, None, None) for t, s, k in rows], EVENT)
    got = traces.side_effects(df, ["trace"]).select("type", "detail", "hop_depth")
    assert sorted(map(tuple, got.collect())) == [("db_read", "fn:fetchall", 1), ("db_write", "fn:db.execute", 1)]


def test_cross_run_frequency_equals_a_dictionary(spark):
    rng = random.Random(5)
    rows = [("e", run, i, rng.choice("abcd"), float(rng.randint(0, 9))) for run in range(40) for i in range(rng.randint(1, 4))]
    want, seen = [], {}
    for run in range(40):
        mine = [r for r in rows if r[1] == run]
        total = max((v[0] for v in seen.values()), default=0) + 1
        for _, _, _, fn, ms in mine:
            n, t = seen.get(fn, (0, 0.0))
            seen[fn] = (n + 1, t + ms)
        for _, _, i, fn, ms in mine:
            n, t = seen[fn]
            want.append((run, i, min(1.0, n / total) if total >= 5 else 1.0, t / n if total >= 5 else ms))
    df = spark.createDataFrame(rows, "entry string, run bigint, i int, fn string, avg_ms double")
    got = traces.cross_run_frequencies(df, ["entry"], "run").select("run", "i", "frequency_ratio", "avg_ms")
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and abs(a[3] - b[3]) < 1e-9


def test_expiry_epochs(spark):
    days = [0, 3, 11, 12, 30]
    df = spark.createDataFrame([("e", i, f"2024-01-{1 + d:02d}") for i, d in enumerate(days)], "entry string, run bigint, day string")
    df = df.withColumn("ts", F.col("day").cast("timestamp"))
    got = traces.expiry_epochs(df, ["entry"], "run", "ts").orderBy("run")
    assert [r.epoch for r in got.collect()] == [0, 0, 1, 1, 2]


def test_lag_matches_a_consume_once_map(spark):
    rng = random.Random(7)
    rows = [(rng.choice("kl"), i, rng.choice(["trace", "path"]), float(i)) for i in range(200)]
    want, latest = [], {}
    for key, i, kind, ts in rows:
        if kind == "trace":
            latest[key] = ts
        elif key in latest:
            want.append((key, i, ts - latest.pop(key)))
    df = spark.createDataFrame(rows, "key string, i bigint, kind string, at double").withColumn("ts", F.timestamp_seconds("at"))
    got = metrics.processing_lags(df, ["key"], "i", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_percentiles_are_exact(spark):
    rng = random.Random(11)
    groups = {"hundred": [float(v) for v in range(1, 101)], "one": [42.0], "ties": [1.0] * 500 + [2.0, 3.0], "wide": [rng.random() ** 4 for _ in range(5000)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: (r.p50, r.p99) for r in ranks.median_and_p99(df, ["k"], "v").collect()}
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert got[k] == ((s[(n - 1) // 2] + s[n // 2]) / 2, s[min(int(n * 0.99), n - 1)])
    assert got["hundred"] == (50.5, 100.0) and got["one"] == (42.0, 42.0)


def test_range_chunks_number_a_hot_group(spark):
    rows = [("hot", i % 5, i) for i in range(900)] + [(f"k{i}", 0, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    placed = scan.range_chunks(df, ["k"], ["a", "b"])
    assert placed.filter("k = 'hot'").select(scan.CHUNK).distinct().count() > 1
    got = scan.numbered(placed, ["k"], ["a", "b"], "n").filter("k = 'hot'").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted((a, b) for k, a, b in rows if k == "hot")
    assert [r.n for r in got] == list(range(1, 901))


def test_trend_slope(spark):
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate([100.0, 110.0, 120.0])] + [("one", 0, 5.0)], "e string, at int, value double")
    got = {r.e: (round(r.slope, 9), r.direction) for r in metrics.trend_slopes(df, ["e"], ["at"]).collect()}
    assert got == {"e": (10.0, "increasing"), "one": (0.0, "stable")}


def greedy(nodes, budget):
    kept, used = [], 0
    for node, score, hop, spec in sorted(nodes, key=lambda n: (-n[1], n[2], n[0])):
        cost = (60 if spec else 120) if hop == 0 else 20
        if hop == 0 or used + cost <= budget:
            kept.append(node)
            used += cost
    return sorted(kept)


def test_budget_prune_equals_the_greedy_loop(spark):
    rng = random.Random(13)
    rows, budgets, want = [], [], {}
    for q in range(40):
        nodes = [(f"n{i}", 1.0 if i < 2 else round(rng.random(), 2), 0 if i < 2 else rng.randint(1, 2), rng.random() < 0.5) for i in range(rng.randint(2, 30))]
        budget = rng.choice([1, 150, 200, 260, 400])
        want[f"q{q}"] = greedy(nodes, budget)
        budgets.append((f"q{q}", budget))
        rows += [(f"q{q}", n, s, h, "spec" if sp and h == 0 else None) for n, s, h, sp in nodes]
    df = spark.createDataFrame(rows, "query_id string, stable_id string, score double, hop int, spec_text string")
    out = expand.prune(df, spark.createDataFrame(budgets, "query_id string, max_tokens int"))
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append(r.stable_id)
    assert {q: sorted(v) for q, v in got.items()} == want


def test_bottleneck_rules(spark):
    depths = spark.createDataFrame([("s:x", 0, 10), ("s:x", 1, 25), ("s:y", 1, 90), ("s:z", 0, 3), ("s:z", 1, 4)], "entity_id string, tick bigint, depth bigint")
    assert sorted((r.entity_name, r.severity, r.value) for r in bottlenecks.queue_buildup(depths).collect()) == [("x stream", "warning", 15.0), ("y stream", "critical", 90.0)]
    lags = spark.createDataFrame([(15.0,), (12.0,), (11.0,)], "lag_s double")
    assert [r.severity for r in bottlenecks.processing_lag(lags).collect()] == ["warning"]
    rates = spark.createDataFrame([("s:x", 0, 10.0), ("s:x", 1, 2.0)], "entity_id string, tick bigint, value double")
    assert [(r.value, r.severity) for r in bottlenecks.throughput_drop(rates).collect()] == [(80.0, "critical")]


def test_sliding_sums_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [("hot", rng.randrange(0, 900), rng.randint(-5, 9)) for _ in range(1200)] + [(k, rng.randrange(0, 40), rng.choice([None, 3])) for k in "abc" for _ in range(8)]
    rows += [("gap", 0, 1), ("gap", 500, 2), ("none", None, 4)]
    df = spark.createDataFrame(rows, "key string, tick bigint, v bigint")
    for low, high in ((-7, -1), (-3, 0), (2, 5)):
        got = scan.sliding_sums(df, ["key"], "tick", low, high, {"total": F.col("v")}).collect()
        want = []
        for key, tick, v in rows:
            near = [] if tick is None else [x for k, t, x in rows if k == key and t is not None and tick + low <= t <= tick + high]
            want.append((key, tick, v, sum(x or 0 for x in near) if near else None))
        order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_as_of_finds_the_last_row_at_or_before(spark):
    rows = spark.createDataFrame([("a", 3, 30), ("a", 7, 70), ("b", 5, 50)], "key string, at bigint, v bigint")
    probes = spark.createDataFrame([("a", 2, "p"), ("a", 3, "q"), ("a", 9, "r"), ("a", 9, "r"), ("c", 1, "s")], "key string, at bigint, label string")
    got = scan.as_of(rows, probes, ["key"], "at", ["v"], "hit").collect()
    assert sorted((r.label, r.hit and r.hit.v) for r in got) == [("p", None), ("q", 30), ("r", 70), ("r", 70), ("s", None)]


def test_a_long_stream_is_compared_with_its_hour_in_ranges(spark):
    """One stream with all rows: against the window a plain plan would use, and no task holds more than a part of it."""
    from pyspark.sql import Window

    rates = spark.range(20_000).select(F.lit("s:x").alias("entity_id"), F.col("id").alias("tick"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("value"))
    hour = Window.partitionBy("entity_id").orderBy("tick").rangeBetween(-60, -1)
    plain = rates.withColumn("base", F.avg("value").over(hour)).where("base > 0 and (base - value) / base * 100 >= 50")
    want = {r.tick: round((r.base - r.value) / r.base * 100, 9) for r in plain.collect()}
    got = {r.tick: round(r.value, 9) for r in bottlenecks.throughput_drop(rates, baseline="rolling_1h", tick_s=60).collect()}
    assert got == want and len(got) > 1000
    assert scan.range_chunks(rates, ["entity_id"], ["tick"]).groupBy(scan.CHUNK).count().agg(F.max("count")).first()[0] < 12_000


def test_no_task_holds_a_hot_trace(spark):
    """Sparse orders and one trace with nearly all rows: its chunks are a fraction of it each."""
    rows = [("hot", i * 10_000_000 + i % 7, "call" if i % 2 == 0 else "return", "f", "f.py", None, float(i), None, None) for i in range(4000)]
    df = spark.createDataFrame(rows + [("cold", 5, "call", "f", "f.py", None, 1.0, None, None)], EVENT)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = scan.range_chunks(df, ["trace"], ["seq"])
        sizes = [r["count"] for r in placed.filter("trace = 'hot'").groupBy(scan.CHUNK).count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 800
        assert traces.paired_calls(df, ["trace"]).count() == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_goroutines_are_roots_of_their_own(spark):
    rows = [(1, "call", 7), (2, "call", 8), (3, "return", 7), (4, "return", 8)]
    schema = EVENT + ", goroutine_id bigint"
    df = spark.createDataFrame([("t", s, k, f"f{g}", "f.py", None, float(s), None, None, g) for s, k, g in rows], schema)
    pairs = traces.paired_calls(df, ["trace"], by_goroutine=True)
    linked = traces.linked_calls(df, pairs, ["trace"], by_goroutine=True)
    assert sorted((r.task, r.fn, r.link_pos) for r in linked.collect()) == [(7, "f7", -1), (8, "f8", -1)]
