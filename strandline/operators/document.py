"""Context documents: every layer is a set of line rows; one ordered aggregate joins them.

A line row is (query_id, layer, p1, s1, s2, p2, text): the middle columns order the lines of a
layer and ``text`` ends with its newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import labels

# Display-id prefix per node type, in the order types are numbered.
ID_PREFIXES = {"function": "fn", "method": "fn", "class": "cls", "file": "file"}
ORDER = ["layer", "p1", "s1", "s2", "p2"]


def display_ids(nodes: DataFrame) -> DataFrame:
    """Adds ``display_id`` (empty for other types) to surviving nodes of each question."""
    prefix, rank = F, F
    for i, (kind, short) in enumerate(ID_PREFIXES.items()):
        prefix, rank = prefix.when(F.col("type") == kind, short), rank.when(F.col("type") == kind, i)
    rows = nodes.withColumn("__p", prefix.otherwise("")).withColumn("__t", rank.otherwise(len(ID_PREFIXES)))
    order = Window.partitionBy("query_id", "__p").orderBy("__t", "hop", F.desc("score"), "stable_id")
    number = F.row_number().over(order)
    return rows.withColumn(
        "display_id", F.when(F.col("__p") != "", F.concat_ws(":", "__p", number)).otherwise("")
    ).drop("__p", "__t")


def _line(df: DataFrame, layer: int, text: Column, p1: Column | int = 0, s1: Column | str = "", s2: Column | str = "", p2: Column | int = 0) -> DataFrame:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "query_id", F.lit(layer).alias("layer"), col(p1).cast("int").alias("p1"), col(s1).alias("s1"), col(s2).alias("s2"),
        col(p2).cast("int").alias("p2"), F.concat(text, F.lit("\n")).alias("text"),
    )


def _split_lines(df: DataFrame, text: Column) -> DataFrame:
    return df.select("*", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def _ids(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select("query_id", F.col("stable_id").alias(name), F.col("display_id").alias(f"{name}_id"))


def _with_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Display ids of both ends; an end outside the document has an empty one."""
    joined = rows.join(_ids(nodes, "source"), ["query_id", "source"], "left").join(_ids(nodes, "target"), ["query_id", "target"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_id", "target_id")})


def header_layer(queries: DataFrame, nodes: DataFrame, warnings: DataFrame) -> DataFrame:
    """Question, seeds in document order, confidence of the first seed, repository."""
    seeds = nodes.filter(F.col("hop") == 0).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "display_id"))).alias("seeds"),
        F.min_by(F.struct(F.col("observed_calls").alias("r"), F.col("branch_coverage").alias("c")), F.col("pos")).alias("first"),
    )
    warned = warnings.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_warn"))
    rows = queries.join(seeds, "query_id", "left").join(warned, "query_id", "left")
    rows = rows.withColumns(
        {
            "n_warn": F.coalesce("n_warn", F.lit(0)),
            "runs": F.coalesce("first.r", F.lit(0)),
            "cov": F.coalesce("first.c", F.lit(0.0)),
            "line": F.array_join(F.transform(F.coalesce("seeds", F.array()), lambda s: F.concat(s["display_id"], F.lit(" *"))), "  "),
        }
    )
    confidence = labels.answer_confidence(F.col("runs"), F.col("cov"), F.col("n_warn"))
    parts = [
        F.concat(F.lit("QUERY:       "), F.col("raw_query")),
        F.concat(F.lit("SEEDS:       "), F.col("line")),
        F.format_string(
            "CONFIDENCE:  %s  (%d observed runs · %s%% coverage · %d warnings)",
            confidence, F.col("runs"), F.bround(F.col("cov") * 100, 0).cast("int"), F.col("n_warn"),
        ),
        F.concat(F.lit("REPO:        "), F.col("repo")),
        F.lit(""),
    ]
    lines = rows.select("query_id", F.posexplode(F.array(*parts)).alias("n", "t"))
    return _line(lines, 1, F.col("t"), p2=F.col("n"))


def warnings_layer(warnings: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = _with_ids(warnings, nodes)
    head = (
        F.when(F.col("type") == "STALE", F.format_string("STALE     %s", F.col("source_id")))
        .otherwise(F.format_string("%-8s  %s -> %s", F.col("type"), F.col("source_id"), F.col("target_id")))
    )
    text = F.concat(head, F.lit("\n          "), F.col("detail"))
    known = rows.filter(F.col("type").isin("CONFLICT", "DEAD", "STALE"))
    body = _line(known, 2, text, s1=F.concat_ws("\x01", "source", "target"), s2=F.col("type"))
    return body.unionByName(_line(warnings.select("query_id").distinct(), 2, F.lit(""), p1=1))


def registry_layer(nodes: DataFrame) -> DataFrame:
    shown = F.when(F.col("hop") == 0, F.concat("display_id", F.lit(" *"))).otherwise(F.col("display_id"))
    signature = F.coalesce(F.nullif("signature", F.lit("")), F.col("name"), F.lit(""))
    pill = labels.provenance_pill(F.col("provenance"), F.col("observed_calls"), F.col("branch_coverage"))
    return _line(nodes, 3, F.format_string("%-12s  %-50s  %s", shown, signature, pill), p1=F.col("pos"))


def edges_layer(edges: DataFrame, warnings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges grouped by type; the type of the first edge comes first."""
    tagged = warnings.filter(F.col("type").isin("CONFLICT", "DEAD")).groupBy("query_id", "source", "target").agg(
        F.max(F.col("type")).alias("warned")
    )
    rows = _with_ids(edges, nodes).join(tagged, ["query_id", "source", "target"], "left")
    rows = rows.withColumn("key", F.concat_ws("\x01", F.col("extra").cast("string"), "source", "target", "type", "provenance"))
    groups = rows.groupBy("query_id", "type").agg(F.min("key").alias("first_key"))
    rows = rows.join(groups, ["query_id", "type"])
    tag = (
        F.when(F.col("provenance") == "runtime-only", "  [runtime-only]")
        .when(F.col("warned").isNotNull(), F.concat(F.lit("  ["), "warned", F.lit("]        see warnings")))
        .otherwise("")
    )
    heads = _line(groups, 4, F.concat("type", F.lit(":")), s1=F.col("first_key"))
    body = _line(rows, 4, F.concat(F.lit("  "), "source_id", F.lit(" -> "), "target_id", tag), s1=F.col("first_key"), s2=F.col("key"))
    return heads.unionByName(body)


def behaviour_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds, then nodes a seed calls, each once (``tier`` 0 or 1)."""
    seeds = nodes.filter(F.col("hop") == 0).withColumn("tier", F.lit(0))
    seed_ids = seeds.select("query_id", F.col("stable_id").alias("source"))
    called = edges.filter(F.col("type") == "CALLS").join(seed_ids, ["query_id", "source"], "left_semi")
    called = called.select("query_id", F.col("target").alias("stable_id")).distinct()
    callees = nodes.filter(F.col("hop") > 0).join(called, ["query_id", "stable_id"], "left_semi").withColumn("tier", F.lit(1))
    return seeds.unionByName(callees)


def behaviour_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = behaviour_nodes(nodes, edges)
    has_spec = F.coalesce(F.col("spec_text") != "", F.lit(False))
    runs = F.coalesce("observed_calls", F.lit(0))
    mark = F.when(F.col("hop") > 0, "").when(
        has_spec, F.format_string(" (* seed · %d runs observed)", runs)
    ).otherwise(" (* static · no spec)")
    head = F.concat(F.when(has_spec, "PATH ").otherwise("BODY "), "display_id", mark)
    at = dict(p1=F.col("tier") * 1_000_000 + F.col("pos"))
    body = _split_lines(rows, F.when(has_spec, F.col("spec_text")).otherwise(F.col("body")))
    return (
        _line(rows, 5, head, p2=-1, **at)
        .unionByName(_line(body, 5, F.concat(F.lit("  "), "line"), p2=F.col("line_no"), **at))
        .unionByName(_line(rows, 5, F.lit(""), p2=2_000_000_000, **at))
    )


def side_effects_layer(nodes: DataFrame, effects: DataFrame) -> DataFrame:
    """``effects``: (stable_id, pos, effect) rows of observed side effects, printed under their node."""
    rows = nodes.select("query_id", "stable_id", "display_id", F.col("pos").alias("at")).join(effects, "stable_id")
    owners = rows.select("query_id", "at", "display_id").distinct()
    at = dict(p1=F.col("at"))
    return (
        _line(owners, 6, F.concat(F.lit("SIDE_EFFECTS "), "display_id", F.lit(":")), p2=-1, **at)
        .unionByName(_line(rows, 6, F.concat(F.lit("  "), "effect"), p2=F.col("pos"), **at))
        .unionByName(_line(owners, 6, F.lit(""), p2=2_000_000_000, **at))
    )


def document_lines(queries: DataFrame, nodes: DataFrame, edges: DataFrame, warnings: DataFrame, effects: DataFrame | None = None) -> DataFrame:
    """All lines of all questions. Warnings and side effects appear only where there are any."""
    blank = lambda layer: _line(queries, layer, F.lit(""), p1=2_000_000_000, s1="\U0010FFFF")
    lines = (
        header_layer(queries, nodes, warnings)
        .unionByName(warnings_layer(warnings, nodes))
        .unionByName(registry_layer(nodes)).unionByName(blank(3))
        .unionByName(edges_layer(edges, warnings, nodes)).unionByName(blank(4))
        .unionByName(behaviour_layer(nodes, edges))
    )
    return lines if effects is None else lines.unionByName(side_effects_layer(nodes, effects))


def assemble(lines: DataFrame) -> DataFrame:
    """One text per question with its token estimate. The token budget bounds its lines."""
    packed = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "text"))).alias("l"))
    text = F.array_join(F.col("l.text"), "")
    return packed.select("query_id", text.alias("document")).withColumn("tokens", labels.document_tokens(F.col("document")))
