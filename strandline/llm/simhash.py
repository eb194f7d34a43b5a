"""SimHash near-dedup: fingerprints, pigeonhole buckets, bit-sliced comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_partitions, stored, text_key
from strandline.llm.components import components

WORDS = 3
RADIUS = 2
BITS = 64
# Rows of a bucket that meet in one tile; larger buckets are cut into pairs of chunks.
TILE = 512
# Planes between two looks for blocks to abandon.
STRIDE = 8

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    starts, ends, at = [], [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
        ends.append(at - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :])], dtype=np.uint64)  # noqa: B905
    slots = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    counts = np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_key", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, print) of every row; ``print`` holds the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(_fingerprints(words), "doc_id long, text_key long, print long")


def links_within(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of fingerprints that differ in at most ``radius`` bits.

    Fingerprints are laid out as bit planes, 64 of them to a machine word. For each fingerprint and word of others a
    carry-save counter, one word for each of its binary digits, takes up one plane's differences after the other; a word
    is abandoned once all its 64 distances exceed the radius.
    """
    n, words = len(prints), (len(prints) + 63) // 64
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    masks = np.where(bits.T == 1, ~np.uint64(0), np.uint64(0))
    query, word = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(words), indexing="ij"))
    above = word >= query // 64  # only later fingerprints
    query, word = query[above], word[above]
    digits = [np.zeros(len(query), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(query), np.uint64)
    for p in range(BITS):
        carry = planes[p][word] ^ masks[p][query]
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        over |= carry
        if p % STRIDE == STRIDE - 1:
            # Counts above the radius: some leading digit is 1 where the radius has 0, all before it being equal.
            greater, equal = over.copy(), ~np.uint64(0)
            for k in reversed(range(len(digits))):
                if radius >> k & 1:
                    equal = equal & digits[k]
                else:
                    greater |= equal & digits[k]
                    equal = equal & ~digits[k]
            live = greater != ~np.uint64(0)
            over = greater[live]
            query, word, digits = query[live], word[live], [d[live] for d in digits]
            if not len(query):
                break
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(near)
    i, j = query[row], word[row] * 64 + lane
    keep = (j > i) & (j < n)
    return i[keep], j[keep]


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches by links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(radius: int):
    """Rows (tile, print) sorted by tile -> edges (a, b) that connect what is linked within blocks of whole tiles."""

    def edges(prints):
        i, j = links_within(prints, radius)
        label = smallest_linked(len(prints), i, j)
        moved = np.flatnonzero(label != np.arange(len(prints)))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])

    def run(batches):
        tiles, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            tiles = np.concatenate([tiles, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            while len(tiles) > 4 * TILE:
                cut = np.flatnonzero(tiles[1:] != tiles[:-1]) + 1
                cut = cut[cut <= max(TILE, cut[0])] if len(cut) else cut
                if not len(cut):
                    break  # one tile fills all: read on to its end
                yield edges(prints[: cut[-1]])
                tiles, prints = tiles[cut[-1] :], prints[cut[-1] :]
        while len(tiles):
            cut = np.append(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(tiles))
            cut = cut[cut <= max(TILE, cut[0])][-1]
            yield edges(prints[:cut])
            tiles, prints = tiles[cut:], prints[cut:]

    return run


def print_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column print) exactly as links of at most ``radius`` bits do.

    With radius + 2 bands of bits, two fingerprints that near agree in two bands at least: each goes to one bucket per
    pair of bands. A bucket above ``TILE`` rows is cut into chunks, each pair of chunks being a tile of its own.
    """
    count = radius + 2
    bounds = [BITS * k // count for k in range(count + 1)]
    band = [F.expr(f"shiftrightunsigned(print, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(bounds, bounds[1:], strict=False)]
    keys = [F.struct(F.lit(k).alias("kind"), band[x].alias("x"), band[y].alias("y")) for k, (x, y) in enumerate(combinations(range(count), 2))]
    keyed = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(full, "key").withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "print"), F.col("chunks")).cast("int"))
    tiles = members.select("key", "chunk", "print", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tile = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = tiles.select(tile.alias("tile"), "print").repartition(shuffle_partitions(prints.sparkSession), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, print, component_id, root) of every row of ``docs`` (doc_id, text).

    ``root`` is the group's smallest fingerprint. Equal fingerprints are one node, however many documents share it. component_id is the smallest doc_id reached (null
    only where all reached are null). Texts without a word have fingerprint 0 and are linked like any other; equal
    rows all stay. Other columns are ignored.
    """
    rows = stored(fingerprints(docs, words), "prints")
    nodes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("smallest")), "nodes")
    roots = components(print_links(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    groups = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = rooted.select("print", "root").join(groups, "root").select("print", "root", "component_id")
    return rows.join(named, "print").select("doc_id", "text_key", "print", "component_id", "root")


def one_of_each_group(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` reduced to one document of each group: the one of smallest doc_id.

    Among rows of that doc_id the one of smallest text key stays, once. Columns are those of ``docs``.
    """
    groups = near_groups(docs, words, radius)
    pick = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    chosen = groups.groupBy("root").agg(F.min(pick).alias("pick")).select(
        F.col("pick.doc_id").alias("_doc"), F.col("pick.text_key").alias("_key")
    )
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text": text_key(F.col("text"))})
    same = (F.col("_text") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_doc"))
    kept = rows.join(chosen, same, "left_semi")
    alike = Window.partitionBy("_text", "_id").orderBy("_id")
    return kept.withColumn("_n", F.row_number().over(alike)).where("_n = 1").select(*docs.columns)
