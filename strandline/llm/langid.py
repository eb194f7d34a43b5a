"""Language ID by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The fitted sample: of each language this many documents, in hash order, and this many characters of each; of the
# languages the most frequent. It bounds the model: LANGUAGES * SAMPLE * EXCERPT characters.
SAMPLE, EXCERPT, LANGUAGES = 96, 1024, 512
DICTIONARY = 65_536
LEVEL = 12
# Texts are compressed in pieces of so many bytes, each against the dictionary alone, so that long texts count throughout.
PIECE = 1024
# Bytes by which the best language has to beat the second, or the text is rejected.
MARGIN = 1
UNKNOWN = "und"

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id):
    """True for the fifth of documents that is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def normalised(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode()


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """[(lang, raw-content dictionary)], most frequent language first, from documents not held out with a lang.

    Only as many documents as the sample holds are gathered; which ones is decided on ids, before texts are read.
    """
    named = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    frequent = named.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    picked = named.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    rows = (
        named.join(F.broadcast(picked.where(F.col("lang").isin([r.lang for r in frequent])).select("doc_id", "lang").distinct()), ["doc_id", "lang"])
        .select("lang", F.col("doc_id"), F.substring("text", 1, EXCERPT).alias("text"))
        .groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(F.struct("doc_id", "text"))), 1, SAMPLE).alias("docs")).collect()
    )
    texts = {r.lang: b"\n".join(normalised(d.text or "") for d in r.docs)[:DICTIONARY] for r in rows}
    return [(r.lang, texts[r.lang]) for r in frequent if texts.get(r.lang, b"").strip()]


@lru_cache(maxsize=2)
def _compressors(model: tuple):
    out = []
    for lang, content in model:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False)))
    return out


def classify(text: str | None, model: tuple) -> tuple[str, float, int]:
    """(lang, score, margin in bytes) of a whole text; the more frequent language wins a tie."""
    if text is None or not model or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0
    data = normalised(text)
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in _compressors(model)]
    best, *others = sorted(sizes)
    margin = others[0] - best if others else len(data)
    return model[sizes.index(best)][0], 1.0 - math.exp(-margin / 10.0), margin


def _predict(position: int, model: tuple):
    def run(batches):
        for batch in batches:
            found = [classify(t, model) for t in batch.column(position).to_pylist()]
            added = [pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:position], *added], names=[*batch.schema.names[:position], "lang_pred", "score", "margin"]
            )

    return run


def predict(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """(doc_id, *carry, held_out, lang_pred, score, margin, rejected) for every row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is a learnt language, or ``und`` for a null text, one without a letter, or when nothing could be learnt.
    ``rejected`` are these and texts whose margin is narrower than ``MARGIN``. Equal texts get equal predictions.
    Other columns than ``carry`` (none named like the result's) are ignored.
    """
    model = tuple(learn(docs))
    rows = docs.select("doc_id", *carry, held_out(F.col("doc_id")).alias("held_out"), "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_predict(len(rows.columns) - 1, model), f"{types}, lang_pred string, score double, margin long")
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < MARGIN))
