"""Importance resampling towards a target corpus: bucketed n-gram gains, weights per document, Gumbel top draw.

Texts become features in Arrow: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` give
each distinct word of a batch a number; runs of consecutive words are shifted word numbers, and the CRC-32 of a run
comes from the CRCs of its distinct words, since a CRC of two joined strings is a linear function of theirs.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices, stored, text_key
from strandline.llm.prefix import running_total

# Fixed values of the feature rule.
WORDS, BUCKETS = 2, 10_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Characters of texts taken up at once, a longer text by itself; bounds memory, not results.
TAKEN = 4_000_000

_POLYNOMIAL = 0xEDB88320


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map whose images of the 32 digits are ``matrix``."""
    out = np.zeros_like(values)
    for k in range(32):
        out ^= np.where(values >> np.uint32(k) & np.uint32(1), matrix[k], np.uint32(0))
    return out


@cache
def _shift(n: int) -> np.ndarray:
    """What ``n`` further zero bytes make of a CRC: tables for its four bytes."""
    step = np.array([_POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    for _ in range(3):
        step = _apply(step, step)
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while n:
        if n & 1:
            power = _apply(step, power)
        step, n = _apply(step, step), n >> 1
    return np.stack([_apply(power, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one behind the other, from theirs and the bytes of the second."""
    out = second.copy()
    for n in np.unique(length).tolist():
        rows, tables = np.flatnonzero(length == n), _shift(n)
        for b in range(4):
            out[rows] ^= tables[b][first[rows] >> np.uint32(8 * b) & np.uint32(255)]
    return out


def _words(texts: pa.Array):
    """(dictionary of words, their numbers in text order, bounds of the texts among these)."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern_regex(lowered, NO_WORD)
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(split)
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(there)).dictionary_encode()
    kept = np.r_[0, np.cumsum(there)]
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept[np.r_[0, np.cumsum(counts)]]


def features(texts: pa.Array, words: int = WORDS, buckets: int = BUCKETS):
    """(bucket, text number) of every feature of the texts."""
    dictionary, numbers, bounds = _words(texts)
    raw = [w.encode() for w in dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in raw), np.uint32, len(raw))
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts, runs, run_crc = np.arange(len(numbers)), numbers, crc
    found, owners = [crc[numbers] % np.uint32(buckets)], [owner]
    for n in range(2, words + 1):
        # A run of n words is a run of n - 1 and the word behind it, within its text.
        inside = starts + n - 1 < bounds[1:][owner[starts]]
        starts, runs = starts[inside], runs[inside]
        pairs = pa.array(runs * len(raw) + numbers[starts + n - 1]).dictionary_encode()
        left, right = np.divmod(pairs.dictionary.to_numpy(), max(1, len(raw)))
        run_crc = joined_crc(run_crc[left], spaced[right], sizes[right])
        runs = pairs.indices.to_numpy().astype(np.int64)
        found.append((run_crc % np.uint32(buckets)).take(runs))
        owners.append(owner[starts])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def _parts(batch, column: str):
    return slices(batch, pc.binary_length(batch.column(column)), TAKEN)


def bucket_counts(texts: DataFrame, column: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without features are left out.

    A task counts all its texts before it hands on at most ``buckets`` rows. Null and empty texts have no features.
    """

    def count(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _parts(batch, column):
                seen += np.bincount(features(part.column(column), words, buckets)[0], minlength=buckets)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["bucket", "n"])

    return texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's smoothed shares in the target and in the raw corpus."""
    all_raw, all_target = float(sum(raw.values())), float(sum(target.values()))
    ratio = lambda b: ((target.get(b, 0) + 1) * (all_raw + buckets)) / ((raw.get(b, 0) + 1) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _weights(gain: np.ndarray, words: int):
    def run(batches):
        for batch in batches:
            for part in _parts(batch, "text"):
                found, owners = features(part.column("text"), words, len(gain))
                n = np.bincount(owners, minlength=part.num_rows)
                # Sums of whole numbers below 2 ** 53 are exact in doubles.
                summed = np.bincount(owners, weights=gain.take(found), minlength=part.num_rows).astype(np.int64)
                weight = summed // np.maximum(n, 1)
                columns = [*(part.column(c) for c in part.schema.names if c != "text"), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in part.schema.names if c != "text"), "n_features", "weight"])

    return run


def gumbel(doc_id, seed: int):
    """Floored thousandths of a Gumbel draw that depends on the seed and the document only."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has texts.

    Of the documents with ``min_words`` words the ``percent`` of highest scores are drawn, ranked from 1; rank is null for
    others. Only counts of ``buckets`` buckets and two numbers reach the driver. Ranks are prefix sums over ranges of
    scores. A null text has no words, a null doc_id draws as an empty one and comes last among ties, rows of one
    doc_id and score are ordered by their texts, and equal rows in any order. Empty tables give empty results; an
    empty target has no features. Other columns are ignored.
    """
    counted = [{r.bucket: r.n for r in bucket_counts(df, "text", words, buckets).collect()} for df in (docs, target)]
    gain = gains(*counted, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    weighed = rows.mapInArrow(_weights(gain, words), "doc_id long, _key long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    # n words have n runs of one word, n - 1 of two, and so on.
    least = sum(max(0, min_words - k) for k in range(words))
    eligible = scored.where(F.col("n_features") >= least).withColumns({"_all": F.lit(0).cast("long"), "_one": F.lit(1).cast("long")})
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_key")]
    ranked = running_total(eligible, "_all", order, "_one", "_before")
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1)
    out = ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    rest = scored.where(F.col("n_features") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)
