"""Mixing sources to target weights by hash-random order and exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, WORD, stored, text_key
from strandline.llm.prefix import running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, target) from rows (source, size).

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. They share ``share`` times all
    sizes; a target stops at ``repeats`` times its source's size and what is above goes to the others by weight. Each
    round is one aggregate over the sources; rounds end when no further source is full.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumns({"_all": F.lit(0), "_one": F.lit(1), "_null": F.col("source").isNull()})
    numbered = running_total(totals, "_all", [F.col("_null"), F.col("source")], "_one", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = stored(numbered.select("source", "source_no", "source_size", weight.alias("_weight")), "sources")
    ceiling = repeats * F.col("source_size")
    wanted = share * (numbered.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at_ceiling = F.col("_weight") * F.lit(level) > ceiling
        row = numbered.agg(
            F.sum(at_ceiling.cast("long")),
            F.sum(F.when(at_ceiling, ceiling)),
            F.sum(F.when(~at_ceiling, F.col("_weight"))),
        ).first()
        if (row[0] or 0) == full or not row[2]:
            break
        full, level = row[0] or 0, (wanted - (row[1] or 0)) / row[2]
    target = F.least(ceiling.cast("double"), F.col("_weight") * F.lit(level))
    return numbered.select("source", "source_no", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, carry: tuple = ()) -> DataFrame:
    """(doc_id, *carry, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    Within each source rows are sorted by a hash of ``seed`` and doc_id; whole epochs are taken while the rounded
    target allows, then rows up to the exact word at which the budget ends, so at most one row is cut per source.

    Null texts have size 0 and take nothing; a null source is a source of its own; rows of one doc_id are separate
    documents, and those that are equal throughout may change places. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select("doc_id", F.col("source").alias("_source"), *carry, size.alias("size")), "sizes")
    targets = source_targets(sizes.select(F.col("_source").alias("source"), "size"), weights, share, repeats)
    rows = sizes.join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("source", "_source")
    rows = rows.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    ranged = running_total(rows, "source_no", [F.col("_key"), F.col("doc_id"), F.col("size")], "size", "_before")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0))
    rest = quota - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return ranged.select("doc_id", *carry, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix repeats them: once per whole epoch, and the last one cut at its budget.

    Rows of which nothing is taken go, among them all without a word. Columns are those of ``docs``.
    """
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_row_key": F.xxhash64(text_key(F.col("text")), F.col("source"), F.col("source").isNull())})
    taken = mix(keyed.select("doc_id", "text", "source", "_row_key"), carry=("_row_key",), **options)
    # Rows equal in id, text and source are one text that is taken as often as they are together.
    sums = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_doc"), F.col("_row_key").alias("_text")).agg(
        F.sum("taken").alias("_taken"), F.min("size").alias("_size")
    )
    same = (F.col("_row_key") == F.col("_text")) & F.col("_id").eqNullSafe(F.col("_doc"))
    alike = Window.partitionBy("_row_key", "_id").orderBy("_id")
    once = keyed.join(sums, same).withColumn("_n", F.row_number().over(alike)).where("_n = 1")
    copies = once.withColumn("_words", F.explode(F.expr(
        "concat(array_repeat(_size, int(_taken div _size)), if(_taken % _size > 0, array(_taken % _size), cast(array() as array<bigint>)))"
    )))
    # Each piece is a word with the white space after it; white space before the first word is a piece of its own.
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.rtrim(F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int") + leading), ""), F.lit(SPACES))
    columns = {"text": F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        whole = F.col("_words") == F.col("_size")
        n_chars = F.when(whole, F.col("n_chars")).otherwise(F.char_length(cut))
        columns["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return copies.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
