"""Token id files: an adaptive context-mixing range coder over independent, checksummed blocks.

A segment holds whole documents. Its ids are cut into blocks of ``BLOCK`` ids that start from nothing, each with its own
model, code words and CRC-32. All blocks of a segment are coded in step: numpy works on one id of every block at a time.

The model of a block has three predictions for the next id: the id that last followed the two ids before (order 2), the
id that last followed the one before (order 1), and how often each id is among the last ids (order 0). They are mixed by
weights that the block learns per context, the context being which predictions exist and whether they agree: order 2
and 1 get an interval for their id, order 0 one that it shares out by frequency, and what no prediction covers is an
escape followed by the plain id. Predictions and weights take up what was coded after each ``STEP`` ids, at the beginning sooner.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_partitions, slices, stored, text_key
from strandline.llm.tokens import encoder

END = 0
BLOCK, STEP = 4096, 512
# Ids of a segment; a longer document makes a longer segment.
SEGMENT = 4_000_000
# Bytes of texts that a worker takes apart at once.
TAKEN = 4 << 20
MAGIC = b"CMR3"

# Binary digits of the weights, of the order-0 frequencies, and of the hashes of one and two ids.
WEIGHT, FREQUENCY, HASH1, HASH2 = 12, 11, 11, 12
TOTAL = WEIGHT + FREQUENCY
ORDER2, ORDER1, ORDER0, ESCAPE = range(4)
_CONTEXTS = 5
_U = np.uint64
_WORD, _LOW, _REST = _U(32), _U(1) << _U(32), (_U(1) << _U(32)) - _U(1)


class Model:
    """What the blocks of a segment have learnt, the blocks being rows."""

    def __init__(self, blocks: int):
        self.rows = np.arange(blocks)
        # The last id behind each hash, plus one; block after block.
        self.one = np.zeros(blocks << HASH1, np.uint32)
        self.two = np.zeros(blocks << HASH2, np.uint32)
        self.counts = np.ones((blocks, _CONTEXTS, 4), np.int64)
        self.slots = 0
        self._weigh()

    def _weigh(self):
        """Weights and where their intervals begin, in units of the total, at (block * contexts + context) * 4 + outcome."""
        room = (1 << WEIGHT) - 4
        weights = self.counts * room // self.counts.sum(axis=2, keepdims=True) + 1
        weights[:, :, ESCAPE] += (1 << WEIGHT) - weights.sum(axis=2)
        begins = (np.cumsum(weights, axis=2) - weights).reshape(-1, 4) << FREQUENCY
        self.weights = weights.ravel().astype(_U)
        self.begins = begins.ravel().astype(_U)
        self.limits = [np.ascontiguousarray(begins[:, k]).astype(_U) for k in (ORDER1, ORDER0, ESCAPE)]

    @staticmethod
    def spots(rows, last2, last1):
        """Where the tables hold what followed one id and two ids."""
        h1 = (last1 * np.uint32(2654435761)) >> np.uint32(32 - HASH1)
        h2 = (last1 * np.uint32(2246822519) + last2 * np.uint32(3266489917)) >> np.uint32(32 - HASH2)
        return (rows << HASH1) + h1, (rows << HASH2) + h2

    @staticmethod
    def context(p2, p1):
        """By predictions that exist (above 0) and agree: 0 none, 1 order 1, 2 order 2, 3 both, 4 both alike."""
        both = (p2 > 0).view(np.uint8) * np.uint8(2) + (p1 > 0).view(np.uint8)
        return both + ((p2 == p1) & (both == 3)).view(np.uint8)

    def learn(self, ids, upto, contexts, outcomes, width):
        """Takes up columns upto - width .. upto of ``ids``; all but the last block hold them in full."""
        blocks = len(self.rows)
        part = ids[:, upto - width : upto]
        last1, last2 = _shifted(ids, upto - width, upto, 1), _shifted(ids, upto - width, upto, 2)
        rows = self.rows[:, None]
        for table, spots in zip((self.one, self.two), self.spots(rows, last2, last1), strict=True):
            table[spots.ravel()] = (part + np.uint32(1)).ravel()
        seen = np.bincount(((rows * _CONTEXTS + contexts) * 4 + outcomes).ravel(), minlength=blocks * _CONTEXTS * 4)
        self.counts += 2 * seen.reshape(self.counts.shape)
        self._weigh()
        self.slots = min(FREQUENCY, upto.bit_length() - 1)
        self.recent = np.sort(ids[:, upto - (1 << self.slots) : upto], axis=1)
        size = 1 << self.slots
        # Runs of equal ids: for each place the run's first place in its block, and its length.
        change = np.ones((blocks, size), bool)
        np.not_equal(self.recent[:, 1:], self.recent[:, :-1], out=change[:, 1:])
        starts = np.flatnonzero(change)
        lengths = np.diff(np.r_[starts, blocks * size])
        self.first = np.repeat((starts & (size - 1)).astype(np.uint32), lengths)
        self.many = np.repeat(lengths.astype(np.uint32), lengths)
        self.recent = self.recent.ravel()


def _shifted(ids, a, b, by):
    """Columns a .. b of the ids ``by`` places before, 0 in front of the first."""
    if a >= by:
        return ids[:, a - by : b - by]
    return np.concatenate([np.zeros((len(ids), by - a), ids.dtype), ids[:, : b - by]], axis=1)


def _steps(width: int):
    """Ranges of columns between which the model learns: doubling from 32 up to ``STEP``, then of that width."""
    a, b = 0, min(32, width)
    while a < width:
        yield a, b
        a, b = b, min(b + min(b, STEP), width)


def _settle(low, wide):
    """(low, range) after the upper 32 digits are written: a range across their next step keeps its part below it."""
    return low << _WORD, np.minimum(wide, _LOW - (low & _REST)) << _WORD


class _Writer:
    """Range encoders without carry, one for each block; a word of 32 digits is written when the range falls below that."""

    def __init__(self, blocks: int, words: int):
        self.low = np.zeros(blocks, _U)
        self.range = np.full(blocks, ~_U(0))
        self.out = np.zeros(blocks * words, np.uint32)
        self.at = np.arange(blocks) * words
        self.begin = self.at.copy()

    def code(self, rows, start, size, digits):
        """``rows`` is a slice from 0 or an index array; the interval is start .. start + size out of 2 ** digits."""
        unit = self.range[rows] >> _U(digits)
        low, wide = self.low[rows] + start * unit, unit * size
        self.low[rows], self.range[rows] = low, wide
        move = np.flatnonzero(wide < _LOW)
        if len(move):
            low, wide = low[move], wide[move]
            index = move if isinstance(rows, slice) else rows[move]
            self.out[self.at[index]] = (low >> _WORD).astype(np.uint32)
            self.at[index] += 1
            self.low[index], self.range[index] = _settle(low, wide)

    def finish(self):
        for shift in (32, 0):
            self.out[self.at] = (self.low >> _U(shift)).astype(np.uint32)
            self.at += 1
        return [self.out[a:b].astype("<u4").tobytes() for a, b in zip(self.begin, self.at, strict=True)]


class _Reader:
    """The decoders that belong to ``_Writer``."""

    def __init__(self, words: list[np.ndarray]):
        blocks = len(words)
        self.low, self.range, self.seen = np.zeros(blocks, _U), np.full(blocks, ~_U(0)), np.zeros(blocks, _U)
        self.words = np.concatenate([*words, np.zeros(4, np.uint32)]).astype(np.uint64)
        self.at = np.cumsum([0, *map(len, words[:-1])])
        for _ in range(2):
            self.seen = self.seen << _WORD | self.words[self.at]
            self.at += 1

    def peek(self, rows, digits):
        unit = self.range[rows] >> _U(digits)
        return np.minimum((self.seen[rows] - self.low[rows]) // unit, _U((1 << digits) - 1))

    def skip(self, rows, start, size, digits):
        unit = self.range[rows] >> _U(digits)
        low, wide = self.low[rows] + start * unit, unit * size
        self.low[rows], self.range[rows] = low, wide
        move = np.flatnonzero(wide < _LOW)
        if len(move):
            low, wide = low[move], wide[move]
            index = move if isinstance(rows, slice) else rows[move]
            self.low[index], self.range[index] = _settle(low, wide)
            self.seen[index] = self.seen[index] << _WORD | self.words[self.at[index]]
            self.at[index] += 1


def encode(ids: np.ndarray) -> bytes:
    """The blocks of a segment: header, a table of (ids, words, crc32 of the ids, crc32 of the words) for each block, the
    crc32 of all that, and the blocks' code words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    digits = max(1, int(ids.max()).bit_length()) if n else 1
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    table = padded.reshape(blocks, BLOCK)
    last = n - (blocks - 1) * BLOCK
    model, writer = Model(blocks), _Writer(blocks, 2 * BLOCK + 4)
    width = BLOCK if blocks > 1 else last
    for a, b in _steps(width):
        part = table[:, a:b]
        one, two = model.spots(model.rows[:, None], _shifted(table, a, b, 2), _shifted(table, a, b, 1))
        p1, p2, x = model.one[one], model.two[two], part + np.uint32(1)
        contexts = model.context(p2, p1)
        outcomes = np.where(p2 == x, ORDER2, np.where(p1 == x, ORDER1, ESCAPE))
        first, many = np.zeros(part.shape, np.uint64), np.ones(part.shape, np.uint64)
        if model.slots:
            r, c = np.nonzero(outcomes == ESCAPE)
            keys = np.repeat(np.arange(blocks, dtype=np.uint64) << _U(32), 1 << model.slots) | model.recent
            wanted = r.astype(np.uint64) << _U(32) | part[r, c]
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[spot] == wanted
            r, c, spot = r[there], c[there], spot[there]
            outcomes[r, c], first[r, c], many[r, c] = ORDER0, model.first[spot], model.many[spot]
        place = (model.rows[:, None] * _CONTEXTS + contexts) * 4 + outcomes
        weight, start = model.weights[place], model.begins[place]
        shared = outcomes == ORDER0
        unit = weight << _U(FREQUENCY - model.slots)
        size = np.where(shared, many * unit, weight << _U(FREQUENCY))
        start += np.where(shared, first * unit, _U(0))
        start, size, plain, escape = (np.ascontiguousarray(z.T) for z in (start, size, part.astype(np.uint64), outcomes == ESCAPE))
        for t in range(b - a):
            lanes = slice(0, blocks if a + t < last else blocks - 1)
            writer.code(lanes, start[t, lanes], size[t, lanes], TOTAL)
            out = np.flatnonzero(escape[t, lanes])
            if len(out):
                writer.code(out, plain[t, out], _U(1), digits)
        if b < width:
            model.learn(table, b, contexts, outcomes, b - a)
    words = writer.finish() if blocks else []
    head = [MAGIC, struct.pack("<BIQI", digits, BLOCK, n, blocks)]
    for k, w in enumerate(words):
        size = BLOCK if k < blocks - 1 else last
        head.append(struct.pack("<IIII", size, len(w) // 4, zlib.crc32(table[k, :size].astype("<u4").tobytes()), zlib.crc32(w)))
    front = b"".join(head)
    return b"".join([front, struct.pack("<I", zlib.crc32(front)), *words])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ``ValueError`` when the data is not one or a block's checksum fails."""
    fixed = 4 + struct.calcsize("<BIQI")
    if data[:4] != MAGIC or len(data) < fixed:
        raise ValueError("not a segment of token ids")
    digits, length, n, blocks = struct.unpack_from("<BIQI", data, 4)
    at = fixed + 16 * blocks
    if len(data) < at + 4 or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("checksum of the block table fails")
    table = np.frombuffer(data, "<u4", 4 * blocks, fixed).reshape(blocks, 4)
    if not blocks:
        return np.zeros(0, np.uint32)
    bounds = np.cumsum(np.r_[0, table[:, 1].astype(np.int64)])
    if len(data) != at + 4 + 4 * int(bounds[-1]):
        raise ValueError("code words are missing")
    stream = np.frombuffer(data, "<u4", int(bounds[-1]), at + 4)
    for k, crc in enumerate(table[:, 3]):
        if zlib.crc32(stream[bounds[k] : bounds[k + 1]].tobytes()) != crc:
            raise ValueError(f"checksum of the words of block {k} fails")
    reader, model = _Reader([stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]), Model(blocks)
    last = int(table[-1, 0])
    ids = np.zeros((blocks, length), np.uint32)
    width = length if blocks > 1 else last
    last1, last2 = np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint32)
    for a, b in _steps(width):
        contexts, outcomes = np.zeros((b - a, blocks), np.uint8), np.full((b - a, blocks), ESCAPE, np.uint8)
        row = np.zeros((b - a, blocks), np.uint32)
        for t in range(b - a):
            lanes = slice(0, blocks if a + t < last else blocks - 1)
            rows = model.rows[lanes]
            one, two = model.spots(rows, last2[lanes], last1[lanes])
            p1, p2 = model.one[one], model.two[two]
            context = model.context(p2, p1)
            place = rows * _CONTEXTS + context
            value = reader.peek(lanes, TOTAL)
            outcome = sum((value >= limit[place]).view(np.uint8) for limit in model.limits)
            place *= 4
            place += outcome
            weight, start = model.weights[place], model.begins[place]
            size = weight << _U(FREQUENCY)
            x = np.where(outcome == ORDER2, p2, p1) - np.uint32(1)
            shared = np.flatnonzero(outcome == ORDER0)
            if len(shared):
                unit = weight[shared] << _U(FREQUENCY - model.slots)
                spot = (shared << model.slots) + ((value[shared] - start[shared]) // unit).view(np.int64)
                x[shared] = model.recent[spot]
                size[shared] = model.many[spot] * unit
                start[shared] += model.first[spot] * unit
            reader.skip(lanes, start, size, TOTAL)
            out = np.flatnonzero(outcome == ESCAPE)
            if len(out):
                plain = reader.peek(out, digits)
                reader.skip(out, plain, _U(1), digits)
                x[out] = plain
            row[t, lanes], contexts[t, lanes], outcomes[t, lanes] = x, context, outcome
            last2, last1 = last1, row[t]
        ids[:, a:b] = row.T
        if b < width:
            if blocks > 1 and last < b:
                # The last block has ended; what it holds here has no use, in neither direction.
                contexts[max(0, last - a) :, -1], outcomes[max(0, last - a) :, -1] = 0, ESCAPE
            model.learn(ids, b, contexts.T, outcomes.T, b - a)
    out = ids.ravel()[:n]
    for k, (size, _, crc, _) in enumerate(table):
        if zlib.crc32(out[k * length : k * length + int(size)].astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of block {k} fails")
    return out


_SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<bigint>, sizes array<bigint>, payload binary"


def _to_segments(vocabulary: str):
    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held, words = 0, encoder(vocabulary)

        def row():
            values = [[part], [segment], [held], [doc_ids], [sizes], [encode(np.concatenate(parts))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "segment", "n_tokens", "doc_ids", "sizes", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        # Words of a few texts at a time; between them a worker drops what it remembers if that is much.
        for some in (s for batch in batches for s in slices(batch, pc.binary_length(batch.column(1)), TAKEN)):
            names = iter(some.column(0).to_pylist())
            for ids, offsets in words.encode(some.column(1)):
                # The end id goes behind each document.
                parts.append(np.insert(ids, offsets[1:], np.uint32(END)))
                lengths = (np.diff(offsets) + 1).tolist()
                doc_ids.extend(next(names) for _ in lengths)
                sizes.extend(lengths)
                held += len(parts[-1])
                if held >= SEGMENT:
                    yield row()
                    segment, held, doc_ids, sizes, parts = segment + 1, 0, [], [], []
            words.shrink()
        if sizes:
            yield row()

    return run


def _from_segments(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
            ids, sizes = decode(get("payload")), np.array(get("sizes"), np.int64)
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            same = [pa.array(np.full(len(sizes), get(c), np.int32)) for c in ("part", "segment")]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(get("doc_ids"), pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                names=["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def token_segments(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Segment rows of ``docs`` (doc_id, text), ready to be written as files, in ascending doc_id order.

    Each range partition of doc_id gives segments of whole documents, numbered by (part, segment). A null text is
    empty, a null doc_id comes first, rows of one doc_id follow each other. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id"), text_key(F.col("text"))]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_to_segments(vocabulary), _SEGMENTS)


def read_token_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from segment rows.

    ``start`` counts the ids of all documents before. Only token counts of segments are summed up across parts.
    """
    counts = segments.select("part", "segment", "n_tokens")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    # One row for each part of the range partitioning.
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select(F.col("part").alias("_part"), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    starts = counts.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    starts = starts.select("part", "segment", (F.col("_inside") + F.col("_before")).alias("_start"))
    decoded = segments.select("part", "segment", "doc_ids", "sizes", "payload").mapInArrow(
        _from_segments, "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["part", "segment"]).select("doc_id", (F.col("local_start") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the segments of ``docs`` as files in the shared folder and reads the documents back from them."""
    return read_token_segments(stored(token_segments(docs, vocabulary), "tokens"))
