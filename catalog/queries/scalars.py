"""Scalar function families and pluggable parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.queries.graph import EXPANDED
from catalog.queries.search import BM25, questions
from catalog.queries.streams import over, stream
from catalog.registry import query
from strandline.functions import text, values
from strandline.operators import expand as ex
from strandline.operators import search as sr
from strandline.plans.intents import request_defaults
from strandline.session import run_folder
from strandline.sources.tables import ChangeLog
from strandline.streaming import consume as cs


@query("sc3_number_formats", "select l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_discount) ratio, printf('~%.1fms', l_quantity + 0.04) ms, cast(round_even(l_tax * 100, 0) as integer)||'%' pct from lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", values.ratio_text(F.col("l_discount")).alias("ratio"),
        values.about_ms(F.col("l_quantity") + 0.04).alias("ms"), values.percent_text(F.col("l_tax")).alias("pct"),
    )


@query(
    "sc5_text_functions",
    "select doc_id, lower(source) low, regexp_replace(text, '^\\s+|\\s+$', '', 'g') = text stripped, split_part('a/'||source||'/'||lang, '/', -1) last_part, starts_with(text, 'The') starts, suffix(text, '.') ends, contains(text, 'the') has from documents",
)
def _(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", F.lower("source").alias("low"), (text.strip(c) == c).alias("stripped"),
        text.last_segment(F.concat(F.lit("a/"), "source", F.lit("/"), "lang"), "/").alias("last_part"),
        c.startswith("The").alias("starts"), c.endswith(".").alias("ends"), c.contains("the").alias("has"),
    )


@query("sc6_prefixed_hash", "select page_id, 'sha256:'||sha256(url||html) digest from pages")
def _(t):
    return t.pages.select("page_id", values.digest(F.col("url"), F.col("html")).alias("digest"))


@query("sc7_json_round_trip", "select event_id, cast(json_extract(props, '$.k') as integer) k, '{\"k\":'||cast(json_extract(props, '$.k') as integer)||'}' packed from events")
def _(t):
    parsed = F.from_json("props", "k int")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("packed"))


@query("sc8_bounds", "select l_orderkey, l_linenumber, l_partkey, greatest(0.0e0, least(1.0e0, l_discount * 20)) clamped, abs(l_quantity - 25) distance, cast(floor(l_extendedprice / 1000) as bigint) thousands from lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", values.clamped(F.col("l_discount") * 20).alias("clamped"),
        F.abs(F.col("l_quantity") - 25).alias("distance"), F.floor(F.col("l_extendedprice") / 1000).alias("thousands"),
    )


@query("sc9_array_functions", "select item_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0))), 1, 5), ' ') first_five, list_contains(regexp_extract_all(lower(text), '[a-z0-9]+', 0), 'the') has_the from benchmark")
def _(t):
    words = text.tokens(F.col("text"))
    return t.benchmark.select("item_id", F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 5), " ").alias("first_five"), F.array_contains(words, "the").alias("has_the"))


@query("sc10_time_functions", "select event_id, cast(split_part(epoch_us(ts)||'-'||event_id, '-', 1) as bigint) stream_us, epoch_us(ts - interval 7 hour) shifted_us, epoch_us(timestamp '2024-02-01') - epoch_us(ts) > 86400000000 older from events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    stream_id = F.concat_ws("-", F.unix_micros(ts), F.col("event_id"))
    return t.events.select(
        "event_id", values.stream_time(stream_id).alias("stream_us"), F.unix_micros(ts - F.expr("interval 7 hours")).alias("shifted_us"),
        values.older_than(F.lit("2024-02-01").cast("timestamp"), ts, 86_400).alias("older"),
    )


@query("sc11_globs", "select path, regexp_matches(path, '^src/.*/[rs].._.*$') nested, regexp_matches(path, '^src/[^/]*/[^b][^/]*$') flat, regexp_matches(path, '^src/[^/]*$') shallow from {paths}")
def _(t):
    match = lambda glob, keep=False: F.col("path").rlike(text.glob_regex(glob, keep))
    return t.paths.select("path", match("src/*/[rs]??_*").alias("nested"), match("src/*/[!b]*", True).alias("flat"), match("src/*", True).alias("shallow"))


@query("sc12_null_defaults", "select o_orderkey, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderstatus end, ''), 'none') status, coalesce(case when o_orderkey % 4 > 0 then o_totalprice end, 0) price from orders")
def _(t):
    status = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", values.filled(status, "none").alias("status"), F.coalesce(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")), F.lit(0.0)).alias("price"))


@query("prj31_request_defaults", "select o_orderkey, case when o_orderkey % 3 = 0 then 2000 else cast(o_orderkey % 100 as integer) + 1 end max_tokens, case when o_orderkey % 2 = 0 then 8 else 5 end max_seeds, 2 hop_depth, cast(0.7 as double) decay from orders")
def _(t):
    asked = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 100 + 1).cast("int").alias("max_tokens"),
        F.when(F.col("o_orderkey") % 2 > 0, 5).otherwise(0).alias("max_seeds"),
    )
    return request_defaults(asked)


@query("ud2_event_hooks", "select 'rows' part, count(*) n from orders where o_orderkey % 10 not in (7, 8, 9) union all select 'batches', count(distinct o_orderkey % 4) from orders")
def _(t):
    handled, hooks = (ChangeLog(t.spark, run_folder(t.spark, label)) for label in ("handled", "hooks"))
    messages = over(t, "messages", "orders", stream(t, "orders"))
    cs.run(cs.consume(messages, "raw_trace", lambda good, n: handled.append(good.select("commit_sha"), n), run_folder(t.spark, "dead"), post_batch=lambda n: hooks.append(t.spark.range(1).select(F.lit(n).cast("bigint").alias("batch")), n)))
    rows = handled.read("commit_sha string").agg(F.lit("rows").alias("part"), F.count("*").alias("n"))
    return rows.unionAll(hooks.read("batch bigint").agg(F.lit("batches").alias("part"), F.countDistinct("batch").alias("n")))


@query(
    "ud3_custom_searcher",
    f"""with {BM25}, longest as (select * from (select q.query_id, d.doc_id id, row_number() over (partition by q.query_id order by length(d.text) desc, d.doc_id) rank from {{q_base}} q join {{docs}} d on d.repo = q.repo) where rank <= 4),
    lists as (select query_id, id, rank, 'graph' source from ft union all select query_id, id, rank, 'length' from longest)
    select query_id, id, round(sum(1.0 / cast(60 + rank as double)), 9) score from lists group by query_id, id""",
)
def _(t):
    # Any (query_id, id, rank) frame is a searcher: here the longest documents of the repository.
    top = sr.top_rows(t.docs.withColumn("n", F.length("text")).select("repo", F.col("doc_id").alias("id"), "n"), ["repo"], [F.desc("n"), F.col("id")], 4)
    longest = t.q_base.join(top, "repo").select("query_id", "id", "rank")
    fused = sr.fuse(sr.ranked_lists((sr.fulltext_topk(t.docs, questions(t), 16), "graph"), (longest, "length")), None)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"))


@query(
    "ud4_custom_weights",
    "with " + EXPANDED[: EXPANDED.index("f2 as")].rstrip().rstrip(",").replace("0.7e0 * case m.edge_type when 'CALLS' then 1.0e0", "0.5e0 * case m.edge_type when 'CALLS' then 0.3e0")
    .replace("when 'INHERITS' then 0.7e0 else", "when 'INHERITS' then 0.9e0 else")
    + " select query_id, stable_id, round(score, 9) score, hop from v1",
)
def _(t):
    weights = {"CALLS": 0.3, "IMPORTS": 0.8, "INHERITS": 0.9}
    out = ex.expand(t.g_queries, t.g_seeds, t.g_nodes, t.g_edges, hops=1, decay=0.5, edge_weights=weights)
    return out.select("query_id", "stable_id", F.round("score", 9).alias("score"), "hop")
