"""Documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, line_dedup, mixing, packing, simhash
from strandline.llm.common import stored
from strandline.llm.queries import vocabulary
from strandline.session import tune

# Tokenizers and learnt dictionaries are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _whole(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else the table holds."""
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject; lang stays as given, the prediction fills it where it is null."""
    rows = _whole(docs).withColumn("_row", F.struct(*COLUMNS))
    found = langid.predict(rows.select("doc_id", "lang", "text", "_row"), carry=("_row",)).where(~F.col("rejected"))
    columns = {c: F.col(f"_row.{c}") for c in COLUMNS}
    columns["lang"] = F.coalesce("_row.lang", "lang_pred")
    return found.select(*[columns[c].alias(c) for c in COLUMNS])


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share are dropped everywhere; documents stay, n_chars follows."""
    kept = line_dedup.drop_repeated_lines(_whole(docs), min_docs=10, min_chars=1, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each_group(_whole(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the last one cut at the budget."""
    return mixing.mixed_documents(_whole(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack_documents(_whole(docs), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_dedup", dedupe_documents),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
