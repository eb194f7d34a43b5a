"""Chat formatting at token level: segments encoded one by one, reserved ids spliced in, loss masks from prefix sums.

A turn becomes ``TURN HEAD role BODY text END``. The four marks are ids behind the vocabulary's, so no encoded text can
hold one. In the formatted text they show as control strings; where a role or text contains one of these, or a special
token of the vocabulary, a backslash behind its first character keeps the two apart, one more for each already there.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_partitions, slices, stored
from strandline.llm.tokens import encoder

# The control strings of the marks, in the order of their ids.
CONTROLS = ["<s>", "[INST]", "[/INST]", "</s>"]
TURN, HEAD, BODY, END = range(4)
LEARNT = "assistant"
# Bytes of texts, or ids, worked on at once, a longer turn or piece by itself; bytes of a row on the way to a digest that
# spans pieces. Both bound memory, not results.
TAKEN, CARRIED = 4_000_000, 16_384

_PIECES = "conv_id long, part int, piece int, edge boolean, input_ids array<int>, loss_mask array<byte>"
_DIGESTS = "conv_id long, part int, piece int, edge boolean, n_turns long, loss_chars long, formatted_chars long, turns binary, loss binary"


def _guarded(strings: list[str]) -> tuple[str, str]:
    """First characters and what follows them, as regular expressions; a string must not hold another's first character."""
    firsts = sorted({s[0] for s in strings})
    if any(c in firsts or c == "\\" for s in strings for c in s[1:]):
        raise ValueError("control strings overlap")
    return "([" + "".join(map(re.escape, firsts)) + "])", "(" + "|".join(sorted({re.escape(s[1:]) for s in strings})) + ")"


def escape_pattern(strings: list[str]) -> str:
    first, rest = _guarded(strings)
    return first + r"(\\*)" + rest


def escaped(texts: pa.Array, strings: list[str]) -> pa.Array:
    return pc.replace_substring_regex(texts, escape_pattern(strings), r"\1\\\2\3")


def unescaped(texts: pa.Array, strings: list[str]) -> pa.Array:
    first, rest = _guarded(strings)
    return pc.replace_substring_regex(texts, first + r"\\(\\*)" + rest, r"\1\2\3")


class Codec:
    """Encodes segments and decodes ids of a byte-level vocabulary extended by the marks."""

    def __init__(self, file: str):
        self.encoder = encoder(file)
        tokenizer = self.encoder.tokenizer
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [*CONTROLS, *self.encoder.specials]
        # Byte-level vocabularies write printable bytes as themselves and the others, in turn, from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        raw = [special[i].encode() if i in special else bytes(map(byte_of.__getitem__, tokenizer.id_to_token(i) or "")) for i in range(self.size)]
        raw += [c.encode() for c in CONTROLS]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Code points that a token begins: bytes that do not continue one.
        begun = np.r_[0, np.cumsum((self.bytes & 0xC0) != 0x80)]
        self.chars = begun[self.starts + self.sizes] - begun[self.starts]

    def encode(self, texts: pa.Array):
        """(ids, bounds) of all texts, each encoded by itself after escaping."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, offsets in self.encoder.encode(escaped(texts, self.strings)):
            ids.append(part)
            sizes.append(np.diff(offsets))
        return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts whose ids are ``ids[bounds[k]:bounds[k + 1]]``."""
        sizes = self.sizes[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        spots = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends[bounds].astype(np.int64)), pa.py_buffer(self.bytes[spots]))


_CODECS: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """The worker's own codec of a vocabulary file."""
    if file not in _CODECS:
        _CODECS[file] = Codec(file)
    return _CODECS[file]


def _spread(out: np.ndarray, at: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
    """Puts the ids of each segment behind each other from its place on."""
    out[np.repeat(at - bounds[:-1], np.diff(bounds)) + np.arange(len(ids))] = ids


def assemble(roles: pa.Array, texts: pa.Array, coder: Codec):
    """(ids, loss mask, bounds of the turns) of turns; the mask holds the texts of ``LEARNT`` turns."""
    roles, texts = (pc.fill_null(x.cast(pa.large_string()), "") for x in (roles, texts))
    named = roles.dictionary_encode()
    name_ids, name_bounds = coder.encode(named.dictionary)
    which = named.indices.to_numpy()
    role_sizes = np.diff(name_bounds)[which]
    role_bounds = np.r_[0, np.cumsum(role_sizes)]
    role_ids = name_ids[np.repeat(name_bounds[which] - role_bounds[:-1], role_sizes) + np.arange(int(role_bounds[-1]))]
    text_ids, text_bounds = coder.encode(texts)
    text_sizes = np.diff(text_bounds)
    bounds = np.r_[0, np.cumsum(4 + role_sizes + text_sizes)]
    start, body = bounds[:-1], bounds[:-1] + 2 + role_sizes
    ids = np.zeros(int(bounds[-1]), np.int32)
    for mark, at in ((TURN, start), (HEAD, start + 1), (BODY, body), (END, bounds[1:] - 1)):
        ids[at] = coder.size + mark
    _spread(ids, start + 2, role_ids, role_bounds)
    _spread(ids, body + 1, text_ids, text_bounds)
    learnt = pc.equal(roles, LEARNT).to_numpy(zero_copy_only=False)
    change = np.zeros(len(ids) + 1, np.int8)
    change[body[learnt] + 1] += 1
    change[body[learnt] + 1 + text_sizes[learnt]] -= 1
    return ids, np.cumsum(change[:-1], dtype=np.int8), bounds


def _runs(column: pa.Array) -> np.ndarray:
    """Bounds of runs of equal values, nulls being equal."""
    values, gone = pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    change = (values[1:] != values[:-1]) | (gone[1:] != gone[:-1])
    return np.r_[0, np.flatnonzero(change) + 1, len(values)]


def _format(file: str):
    def run(batches):
        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, pc.binary_length(batch.column("text")), TAKEN):
                ids, mask, bounds = assemble(rows.column("role"), rows.column("text"), codec(file))
                runs = _runs(rows.column("conv_id"))
                n, offsets = len(runs) - 1, pa.array(bounds[runs], pa.int32())
                edge = np.zeros(n, bool)
                edge[[0, -1]] = True
                columns = [
                    rows.column("conv_id").take(pa.array(runs[:-1])), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(piece, piece + n, dtype=np.int32)),
                    pa.array(edge), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask)),
                ]
                piece += n
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "piece", "edge", "input_ids", "loss_mask"])

    return run


def format_conversations(conversations: DataFrame, file: str) -> DataFrame:
    """Token rows of ``conversations`` (conv_id, turn, role, text): (conv_id, part, piece, edge, input_ids, loss_mask).

    A conversation's pieces follow each other by (part, piece); nearly all have one. Rows are dealt to ranges of
    (conv_id, turn), so a conversation of any length is spread over tasks, and ``edge`` marks the pieces at the ends of
    what a task holds at once, which alone can have others beside them. Turns come in ascending order, a null turn
    first, turns of one number by a hash of role and text. A null role or text is empty, rows without conv_id are one
    conversation, repeated rows are turns of their own. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("_key", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    order = ["conv_id", F.asc_nulls_first("turn"), "_key"]
    dealt = rows.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(file), _PIECES)


def _flat(column: pa.Array):
    """(values, bounds) of a list column."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def render(formatted: DataFrame, file: str) -> DataFrame:
    """(conv_id, part, piece, formatted): the text of token rows, marks as control strings."""

    def run(batches):
        for batch in batches:
            text = codec(file).decode(*_flat(batch.column("input_ids")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], text.cast(pa.string())], names=["conv_id", "part", "piece", "formatted"])

    return formatted.select("conv_id", "part", "piece", "input_ids").mapInArrow(run, "conv_id long, part int, piece int, formatted string")


def parsed(ids: np.ndarray, coder: Codec):
    """(roles, texts, places of the turns' first ids) of formatted ids; raises ``ValueError`` where marks are out of order."""
    marks = np.flatnonzero(ids >= coder.size)
    if len(marks) % 4 or (len(ids) > 0) != (len(marks) > 0) or not (ids[marks].reshape(-1, 4) == coder.size + np.arange(4)).all():
        raise ValueError("marks of turns are out of order")
    turn, head, body, end = marks.reshape(-1, 4).T
    if (head != turn + 1).any() or (len(turn) and (turn[0] != 0 or end[-1] != len(ids) - 1)) or (turn[1:] != end[:-1] + 1).any():
        raise ValueError("ids outside of roles and texts")

    def between(first, last):
        sizes = last - first - 1
        bounds = np.r_[0, np.cumsum(sizes)]
        inner = ids[np.repeat(first + 1 - bounds[:-1], sizes) + np.arange(int(bounds[-1]))]
        return unescaped(coder.decode(inner, bounds), coder.strings)

    return between(head, body), between(body, end), turn


def _masked(ids: np.ndarray, mask: np.ndarray, coder: Codec):
    """(unescaped text, first place) of each run of ids under the mask."""
    change = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
    first, last = change[::2], change[1::2]
    return unescaped(coder.decode(ids[mask > 0], np.r_[0, np.cumsum(last - first)]), coder.strings), first


def _joined(texts: pa.Array, bounds: np.ndarray):
    """Views of the bytes of ``texts[bounds[k]:bounds[k + 1]]``, one behind the other."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    return [data[offsets[a] : offsets[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digests(rows, coder: Codec):
    (ids, bounds), (mask, _) = _flat(rows.column("input_ids")), _flat(rows.column("loss_mask"))
    roles, texts, turns = parsed(ids, coder)
    loss, places = _masked(ids, mask, coder)
    end, feed = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    lines = pc.binary_join_element_wise(roles, texts, end, feed)
    turn_bounds, loss_bounds = np.searchsorted(turns, bounds), np.searchsorted(places, bounds)
    begun, loss_chars = (np.r_[0, np.cumsum(x)] for x in (coder.chars[ids], pc.utf8_length(loss).to_numpy(zero_copy_only=False)))
    edge = rows.column("edge").to_pylist()
    # Only a piece that may have others beside it hands on its text.
    sums = [
        [bytes(view) if kept else hashlib.sha256(view).digest() for view, kept in zip(_joined(x, at), edge, strict=True)]
        for x, at in ((lines, turn_bounds), (loss, loss_bounds))
    ]
    counts = [np.diff(turn_bounds), np.diff(loss_chars[loss_bounds]), np.diff(begun[bounds])]
    columns = [*rows.columns[:4], *(pa.array(c, pa.int64()) for c in counts), *(pa.array(d, pa.binary()) for d in sums)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DIGESTS.split(", ")])


def _read(file: str):
    def run(batches):
        for batch in batches:
            for rows in slices(batch, batch.column("input_ids").value_lengths(), TAKEN):
                yield _digests(rows, codec(file))

    return run


def _continued(batches):
    """Digests of conversations whose pieces come one behind the other."""
    names = ["conv_id", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"]
    state = None

    def row():
        values = [[state[0]], [state[1]], [state[2]], [state[3]], [state[4].digest()], [state[5].digest()]]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            conv_id, *numbers, turns, loss = (batch.column(c)[k].as_py() for c in names)
            if state is None or state[0] != conv_id:
                if state is not None:
                    yield row()
                state = [conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            state[1:4] = [a + b for a, b in zip(state[1:4], numbers, strict=True)]
            state[4].update(turns)
            state[5].update(loss)
    if state is not None:
        yield row()


def read_conversations(formatted: DataFrame, file: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from written token rows.

    Digests are over role, line feed, text, line feed of each turn, and over the text under the mask. A conversation in
    one piece is done where it lies; the pieces of longer ones stream through one task in order, as a digest asks for.
    """
    pieces = stored(formatted.mapInArrow(_read(file), _DIGESTS), "chat-digests")
    columns = ["conv_id", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"]
    at = F.col("_at")
    once = [F.when(at == 0, F.col(c)).otherwise(0).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")]
    cut = [F.substring(F.col(c), at * CARRIED + 1, F.lit(CARRIED)).alias(c) for c in ("turns", "loss")]
    # The text under the mask is a part of that of the turns.
    carried = pieces.where("edge").withColumn("_at", F.explode(F.sequence(F.lit(0), F.ceil(F.length("turns") / CARRIED).cast("int"))))
    edges = carried.select("conv_id", "part", "piece", "_at", *once, *cut).repartition(shuffle_partitions(formatted.sparkSession), "conv_id")
    edges = edges.sortWithinPartitions("conv_id", "part", "piece", "_at")
    longer = edges.select(*columns).mapInArrow(_continued, "conv_id long, n_turns long, loss_chars long, formatted_chars long, turns binary, loss binary")
    whole = pieces.where("not edge").select(*columns).unionByName(longer)
    return whole.select(
        "conv_id", "n_turns", F.lower(F.hex("turns")).alias("turns_sha256"), "loss_chars", F.lower(F.hex("loss")).alias("loss_sha256"), "formatted_chars"
    )


def format_and_read(conversations: DataFrame, file: str) -> DataFrame:
    """Writes the token rows of ``conversations`` into the shared folder and reads them back."""
    return read_conversations(stored(format_conversations(conversations, file), "chat"), file)
