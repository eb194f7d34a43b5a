"""Views that give the given tables the shapes of the operators' inputs.

One text serves Spark and DuckDB. ``{name}`` is a table or another view; ``@ms(x)``,
``@sha(x)`` and ``@days(x)`` differ by dialect and are substituted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# Graph nodes and edges.
VIEWS["g_nodes"] = """
select 'r:'||cast(r_regionkey as string) stable_id, r_name name, 'class' type, true active, 'repo0' repo, 0 runs, 0.0e0 coverage from {region}
union all select 'n:'||cast(n_nationkey as string), n_name, 'class', true, 'repo0', 0, 0.0e0 from {nation}
union all select 's:'||cast(s_suppkey as string), s_name, 'file', s_acctbal >= 0, 'repo0', 0, 0.0e0 from {supplier}
union all select 'p:'||cast(p_partkey as string), p_name, 'function', p_size <> 13, 'repo0', p_size % 20, (p_size % 5) * 0.25e0 from {part}
union all select 'c:'||cast(c_custkey as string), c_name, 'method', true, 'repo0', c_nationkey, (c_nationkey % 11) * 0.1e0 from {customer}
union all select 'o:'||cast(o_orderkey as string), o_orderpriority, 'function', true, 'repo0', 0, 0.0e0 from {orders}
"""
VIEWS["g_edges"] = """
select 'c:'||cast(o_custkey as string) source, 'o:'||cast(o_orderkey as string) target, 'CALLS' type,
  case o_orderstatus when 'F' then 'confirmed' when 'O' then 'static' else 'dynamic' end provenance from {orders}
union all select 'o:'||cast(l_orderkey as string), 'p:'||cast(l_partkey as string), 'CALLS',
  case min(l_returnflag) when 'A' then 'confirmed' when 'N' then 'static' else 'conflict' end
  from {lineitem} group by l_orderkey, l_partkey
union all select distinct 'p:'||cast(l_partkey as string), 's:'||cast(l_suppkey as string), 'IMPORTS', 'static' from {lineitem}
union all select 's:'||cast(s_suppkey as string), 'n:'||cast(s_nationkey as string), 'INHERITS', 'static' from {supplier}
union all select 'n:'||cast(n_nationkey as string), 'r:'||cast(n_regionkey as string), 'INHERITS', 'static' from {nation}
"""
# Every customer asks a flow question, every part an impact question, every supplier a lookup.
VIEWS["g_queries"] = """
select 'c:'||cast(c_custkey as string) query_id, 'flow' query_type, 400 + 20 * c_nationkey max_tokens from {customer}
union all select 'p:'||cast(p_partkey as string), 'impact', 300 from {part}
union all select 's:'||cast(s_suppkey as string), 'lookup', 200 from {supplier}
"""
VIEWS["g_seeds"] = """
select query_id, query_id stable_id from {g_queries}
union all select 'c:'||cast(o_custkey as string), 'o:'||cast(o_orderkey as string) from {orders} where o_orderpriority = '1-URGENT'
"""
VIEWS["g_specs"] = """
select 'o:'||cast(o_orderkey as string) node_stable_id, 'repo0' repo, o_orderstatus commit_sha, o_orderkey generated_at,
  'PATH '||o_orderpriority||'\n  1.  step' spec_text from {orders} where o_orderstatus <> 'P'
union all select 'c:'||cast(o_custkey as string), 'repo0', cast(o_orderkey as string), o_orderkey,
  'SPEC '||cast(o_orderkey as string) from {orders} where o_orderpriority = '2-HIGH'
"""
# Calls with a way back from every order to its customer, so the call graph has cycles.
VIEWS["g_calls"] = """
select source, target from {g_edges} where type = 'CALLS'
union all select 'o:'||cast(o_orderkey as string), 'c:'||cast(o_custkey as string) from {orders} where o_orderstatus = 'O'
"""
# Trace events.
VIEWS["t_events"] = """
select 'repo'||cast(user_id % 3 as string) repo, user_id entry_id,
  cast(user_id as string)||'@'||cast(cast(floor((day(ts)-1)/7) as int) as string) trace_id,
  cast(floor((day(ts)-1)/7) as bigint) run_no, event_id seq, ts,
  case event_type when 'purchase' then 'return' when 'error' then 'exception'
    when 'signup' then case when user_id % 4 = 0 and k % 3 = 1 then 'async_call' when user_id % 4 = 0 and k % 7 = 2 then 'async_return' else 'call' end
    else 'call' end type,
  case k % 12 when 0 then 'execute' when 1 then 'fetchall' when 2 then 'redis_set' when 3 then 'hset'
    when 4 then '_send_request' when 5 then 'httpx_request' when 6 then 'write_file' when 7 then 'Open'
    when 8 then 'authenticate' when 9 then 'cache_get_item' when 10 then 'test_login' else 'user_view' end fn,
  case when k % 10 = 9 then '/usr/lib/python3/m' else 'src/m' end||cast(k % 3 as string)||'.py' file, k line,
  case when user_id % 4 = 0 and k % 8 <> 0 then cast(k % 3 as bigint) end task_id, @ms(ts) timestamp_ms,
  'a'||cast(event_id as string) args, 'v'||cast(event_id as string) return_val
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) k from {events}) e
"""
VIEWS["t_traces"] = """
select repo, entry_id, trace_id, run_no, min(ts) started, min(seq) first_seq, max(timestamp_ms) - min(timestamp_ms) duration_ms
from {t_events} group by repo, entry_id, trace_id, run_no
"""
# Snapshots of node hashes, five documents to a file.
VIEWS["snap_prev"] = """
select 'd'||cast(doc_id as string) stable_id, 'f'||cast(cast(floor(doc_id / 5) as int) as string)||'.py' file_path, lang repo,
  @sha(text) node_hash from {documents} where doc_id % 10 <> 0
"""
VIEWS["snap_curr"] = """
select 'd'||cast(doc_id as string) stable_id, 'f'||cast(cast(floor(doc_id / 5) as int) as string)||'.py' file_path, lang repo,
  @sha(case when doc_id % 10 = 2 then text||'x' else text end) node_hash from {documents} where doc_id % 10 <> 1
"""
VIEWS["metrics"] = """
select 'user_code' metric_type, 'fn_duration' metric_name, 'm:'||cast(l_partkey % 200 as string) entity_id,
  'repo'||cast(l_suppkey % 3 as string) repo, l_extendedprice / 100.0e0 value, 'ms' unit,
  cast(year(l_shipdate) as string) commit_sha, l_shipdate recorded_at,
  l_orderkey * 1000 + l_linenumber * 10 order_key, l_partkey, l_suppkey, l_quantity, l_discount from {lineitem}
"""
VIEWS["vec"] = """
select vec_id, 'repo'||cast(label % 3 as string) repo, embedding from {embeddings}
"""


def _substitute(text: str, dialect: str) -> str:
    inner = r"((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)"
    if dialect == "spark":
        text = re.sub(r"@ms\(" + inner + r"\)", r"((unix_micros(cast(\1 as timestamp)) - 1704067200000000) / cast(1000 as double))", text)
        text = re.sub(r"@sha\(" + inner + r"\)", r"sha2(\1, 256)", text)
    else:
        text = re.sub(r"@ms\(" + inner + r"\)", r"((epoch_us(\1) - 1704067200000000) / cast(1000 as double))", text)
        text = re.sub(r"@sha\(" + inner + r"\)", r"sha256(\1)", text)
        text = text.replace("\\n", "\n")
    return text


class Tables:
    """Lazy tables and views of one data folder: ``tables.orders``, ``tables.g_edges``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            elif name in TABLES:
                self._made[name] = self._read(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """The text as a frame; ``frames`` stand in for tables of their name (micro-batches)."""
        used = {n: frames[n] if n in frames else getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
        spark = next(iter(frames.values())).sparkSession if frames else self.spark
        # Braces that are part of a literal are doubled for the formatter.
        pieces = re.split(r"(\{\w+\})", _substitute(text, "spark"))
        escaped = [p if re.fullmatch(r"\{\w+\}", p) else p.replace("{", "{{").replace("}", "}}") for p in pieces]
        return spark.sql("".join(escaped), **used)


def duckdb_sql(text: str) -> str:
    """The text for DuckDB: views it uses (directly or not) become common table expressions."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\{(\w+)\}", body):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(text)
    def plain(body: str) -> str:
        # A named part that several others read is evaluated once.
        body = re.sub(r"\{(\w+)\}", r"\1", _substitute(body, "duckdb"))
        return body if "recursive" in body.lower() else re.sub(r"(\w) as \((?=\s*select)", r"\1 as materialized (", body)

    head = ",\n".join(f"{n} as materialized ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not head:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + head + ",\n" + body[len("with recursive"):]
    if body.lower().startswith("with"):
        return "with " + head + ",\n" + body[len("with"):]
    return "with " + head + "\n" + body
