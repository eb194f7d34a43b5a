"""Line dedup: sorted ranges of line hashes are streamed once; documents get back compressed keep bitmaps."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, ascii_lower, shuffle_partitions, stored, text_key

# Kinds of streamed rows.
DROP, FIRST, OPEN, EDGE = 1, 2, 3, 4

_ROWS = "h1 long, h2 long, doc_id long, text_key long, pos int, kind int, part int"


def line_key(line):
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _ordered_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of every line whose key is long enough, in range partitions by hash.

    Two hashes of 64 bits stand for a key. A key in many documents may fill several partitions.
    """
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "text_key", "pos")
    order = ["h1", "h2", "doc_id", "text_key", "pos"]
    return hashed.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)


def _starts(*columns) -> np.ndarray:
    """True where a row differs from the row before in any of ``columns``."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _stream(min_docs: int):
    """Rows of one partition in order -> its repeated lines, and what only neighbouring partitions can settle.

    A run holds the rows of one key. It is decided here when ``min_docs`` of its documents were seen; other inner runs
    are kept whole and leave nothing. The first and the last run may go on in another partition: their rows leave as OPEN
    unless decided, with an EDGE row. Only an undecided run is held back between batches: fewer than ``min_docs``
    documents' rows.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        held, inside, at_first, edge, seen_any = None, False, True, None, False

        def out(rows, kind):
            count = len(rows[0])
            return pa.RecordBatch.from_arrays(
                [*(pa.array(r[0], mask=r[1]) if isinstance(r, tuple) else pa.array(r) for r in (rows[0], rows[1], (rows[2], rows[5]), rows[3], rows[4]))]
                + [pa.array(kind.astype(np.int32)), pa.array(np.full(count, part, np.int32))],
                names=["h1", "h2", "doc_id", "text_key", "pos", "kind", "part"],
            )

        def edge_row(h1, h2):
            one = np.zeros(1, np.int64)
            return out([one + h1, one + h2, one, one, one.astype(np.int32), one == 0], np.array([EDGE]))

        for batch in batches:
            if not batch.num_rows:
                continue
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            rows = [
                batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy(),
                batch.column(3).to_numpy(), batch.column(4).to_numpy(), null,
            ]
            seen_any = True
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = None
            new_key = _starts(rows[0], rows[1])
            if inside and (rows[0][0], rows[1][0]) == edge:
                # The last batch ended in a run that is dropped already; it goes on here.
                end = int(np.argmax(new_key[1:])) + 1 if new_key[1:].any() else len(new_key)
                yield out([r[:end] for r in rows], np.full(end, DROP))
                rows = [r[end:] for r in rows]
                if not len(rows[0]):
                    continue
                new_key = _starts(rows[0], rows[1])
                at_first = False
            inside = False
            starts = np.flatnonzero(new_key)
            sizes = np.diff(np.r_[starts, len(new_key)])
            new_doc = _starts(rows[0], rows[1], rows[2], rows[3], rows[5])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            decided = docs >= min_docs
            kind = np.repeat(np.where(decided, DROP, 0), sizes)
            kind[starts[decided]] = FIRST
            if at_first:
                if len(starts) > 1 or decided[0]:
                    yield edge_row(rows[0][0], rows[1][0])
                    if not decided[0]:
                        kind[: sizes[0]] = OPEN
                    at_first = False
            edge = (rows[0][-1], rows[1][-1])
            last = starts[-1]
            if decided[-1]:
                inside, keep = True, len(kind)
            else:
                held, keep = [r[last:] for r in rows], last
            chosen = np.flatnonzero(kind[:keep])
            if len(chosen):
                yield out([r[chosen] for r in rows], kind[chosen])
        if held is not None:
            yield out(held, np.full(len(held[0]), OPEN))
        if seen_any:
            yield edge_row(*edge)

    return run


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_key, pos) of the lines whose key at least ``min_docs`` documents have.

    With ``keep_first`` the first line of each key in the order (doc_id, text_key, pos) is left out. Rows of equal doc_id
    and text count as one document.
    """
    streamed = stored(_ordered_lines(docs, min_chars).mapInArrow(_stream(min_docs), _ROWS), "lines")
    key = ["h1", "h2"]
    first_parts = streamed.where(F.col("kind") == EDGE).groupBy(*key).agg(F.min("part").alias("first_part"))
    # Keys with undecided rows: two for each partition at most.
    undecided = streamed.where(F.col("kind") == OPEN)
    counts = undecided.groupBy(*key).agg(F.count_distinct(F.struct("doc_id", "text_key")).alias("n"))
    elsewhere = streamed.where(F.col("kind").isin(DROP, FIRST)).join(F.broadcast(counts.select(*key)), key, "left_semi").select(*key).distinct()
    frequent = counts.where(F.col("n") >= min_docs).select(*key).union(elsewhere).distinct()
    late = undecided.join(F.broadcast(frequent), key, "left_semi")
    found = streamed.where(F.col("kind").isin(DROP, FIRST)).unionByName(late)
    if keep_first:
        # A partition's first row of a key is the first of all unless an earlier partition holds the key too.
        earliest = late.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("earliest"))
        found = found.join(F.broadcast(first_parts), key, "left").join(F.broadcast(earliest), key, "left")
        here = F.struct("doc_id", "text_key", "pos")
        at_start = F.coalesce(F.col("first_part") == F.col("part"), F.lit(True))
        first = F.when(F.col("earliest").isNull(), (F.col("kind") == FIRST) & at_start).otherwise(
            ((F.col("kind") == OPEN) & (here == F.col("earliest")) & at_start)
            | ((F.col("kind") == FIRST) & at_start & (here < F.col("earliest")))
        )
        found = found.where(~first)
    return found.select("doc_id", "text_key", "pos")


def _pack(batches):
    for batch in batches:
        maps = []
        for positions in batch.column("positions").to_pylist():
            bits = np.zeros(max(positions) + 1, np.uint8)
            bits[positions] = 1
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "drop_map"])


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_key, drop_map) of the documents that lose lines.

    Bit n of the zlib-compressed map is 1 when line n goes; lines after its end stay, so the complement is the keep
    bitmap. A document's positions, never more than its lines, meet in one task.
    """
    repeated = repeated_lines(docs, min_docs, min_chars, keep_first)
    grouped = repeated.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("positions"))
    return grouped.mapInArrow(_pack, "doc_id long, text_key long, drop_map binary")


def _apply(position: int):
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, packed in zip(batch.column(position).to_pylist(), batch.column("drop_map").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if packed is None:
                    dropped.append(0)
                    texts.append(text)
                    continue
                drop = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
                kept = [p for i, p in enumerate(parts) if i >= len(drop) or not drop[i]]
                dropped.append(len(parts) - len(kept))
                texts.append("\n".join(kept))
            columns = [c for i, c in enumerate(batch.columns) if i not in (position, batch.num_columns - 1)]
            names = [c for i, c in enumerate(batch.schema.names) if i not in (position, batch.num_columns - 1)]
            extra = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "text", "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, carry: tuple = ()) -> DataFrame:
    """(doc_id, *carry, text, n_lines, n_dropped) for every row of ``docs`` (doc_id, text), repeated lines gone.

    Lines end at \\n; a null or empty text is one empty line and stays as it is. Other columns are ignored, ``carry`` names
    those that are passed on (none called drop_map, n_lines or n_dropped). Equal rows lose the same lines.
    """
    maps = line_bitmaps(docs, min_docs, min_chars, keep_first).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = docs.select("doc_id", *carry, "text")
    joined = rows.join(maps, rows.doc_id.eqNullSafe(maps._doc) & (text_key(rows.text) == maps._key), "left").select(*rows.columns, "drop_map")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *carry)) + ", text string, n_lines long, n_dropped long"
    return joined.mapInArrow(_apply(len(rows.columns) - 1), schema)
