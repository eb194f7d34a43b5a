"""Best-fit packing by bin completion over the histogram of lengths."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored
from strandline.llm.prefix import running_total
from strandline.llm.tokens import encoder

CAPACITY = 2048
END = 0
# Steps of a search in all: fillings taken up, branches without one, and ways back; fillings tried around
# one longest piece by the search for an incumbent.
NODES, BRANCHES = 20_000, 4


# ---- packing a histogram ----


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that are needed at least: for every k, pieces longer than capacity - k stand alone, pieces above half
    the capacity do not meet, and what pieces of k and more do not find room beside these needs sequences of its own."""
    sizes = np.arange(len(counts))
    total = np.r_[0, np.cumsum(counts)]
    mass = np.r_[0, np.cumsum(counts * sizes)]
    half = capacity // 2
    best = -(-int(mass[-1]) // capacity)
    for k in range(1, half + 1):
        alone = total[-1] - total[capacity - k + 1]
        large, large_mass = total[capacity - k + 1] - total[half + 1], mass[capacity - k + 1] - mass[half + 1]
        small_mass = mass[half + 1] - mass[k]
        best = max(best, int(alone + large + max(0, -(-(small_mass - (large * capacity - large_mass)) // capacity))))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit on all pieces of a length at once: [(lengths in a sequence, how many such sequences)]."""
    opened: dict[int, dict[tuple, int]] = {}

    def place(room: int, size: int, many: int) -> None:
        filled = opened[room]
        for pattern in list(filled):
            take = min(many, filled[pattern])
            filled[pattern] -= take
            if not filled[pattern]:
                del filled[pattern]
            into = opened.setdefault(room - size, {})
            into[pattern + (size,)] = into.get(pattern + (size,), 0) + take
            many -= take
            if not many:
                break
        if not filled:
            del opened[room]

    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            rooms = [r for r in opened if r >= size]
            if rooms:
                room = min(rooms)
                many = min(left, sum(opened[room].values()))
                place(room, size, many)
                left -= many
            else:
                per = capacity // size
                whole, rest = divmod(left, per)
                for pattern, many in (((size,) * per, whole), ((size,) * rest, 1)):
                    if pattern and many:
                        into = opened.setdefault(capacity - size * len(pattern), {})
                        into[pattern] = into.get(pattern, 0) + many
                left = 0
    return [(p, n) for patterns in opened.values() for p, n in patterns.items()]


def _near(free: int, slack: int) -> int:
    """Bit v is set where ``free`` has a bit from v to v + slack."""
    done = 0
    while done < slack:
        step = min(done + 1, slack - done)
        free |= free >> step
        done += step
    return free


def fillings(counts: np.ndarray, room: int, spare: int):
    """All undominated fillings of ``room`` that leave ``spare`` or less of it empty, least waste first, made one by one.

    A filling is dominated where some of its pieces (or none) can give way to one longer piece that is left and still
    fits: whatever they are needed for, that piece's place elsewhere takes them. Such a piece is longer than any that
    follow, so a beginning that is dominated ends its whole branch. None stands for a branch without a filling.
    """
    sizes = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x]
    reach = [1]  # bit t of reach[k]: some pieces of the k smallest lengths are t long together
    for size in sizes:
        sums, left, step = reach[-1], min(int(counts[size]), room // size), 1
        while left:
            step = min(step, left)
            sums |= sums << size * step
            left -= step
            step *= 2
        reach.append(sums & (1 << room + 1) - 1)
    everything = sum(1 << x for x in sizes)
    for total in range(room, room - min(spare, room) - 1, -1):
        if not reach[-1] >> total & 1:
            continue
        slack = room - total
        chosen: list[int] = []
        # Index to go on from, length to fill, sums of some chosen pieces, lengths left over, sums that one of these replaces, copies of the last, went on.
        levels = [[len(sizes) - 1, total, 1, everything, _near(everything, slack), 0, False]]
        while levels:
            at, rest, sums, free, near, copies, went_on = levels[-1]
            k = min(at, bisect_right(sizes, rest) - 1)
            while rest and k >= 0:
                size = sizes[k]
                again = copies + 1 if chosen and chosen[-1] == size else 1
                if again <= counts[size] and reach[k + 1] >> rest - size & 1:
                    alone = free >> size + 1 & (1 << slack) - 1
                    if not alone and not ((sums << size) ^ (1 << size)) & near:
                        break
                k -= 1
            if rest and k >= 0:
                levels[-1][0], levels[-1][-1] = k - 1, True
                chosen.append(size)
                if again == counts[size]:
                    free &= ~(1 << size)
                    near = _near(free, slack)
                levels.append([k, rest - size, sums | sums << size, free, near, again, False])
                continue
            if not rest and not free & (1 << slack + 1) - 1:
                yield tuple(chosen)
            elif not went_on:
                yield None
            levels.pop()
            if chosen:
                chosen.pop()


def likely_fillings(counts: np.ndarray, room: int) -> list[tuple]:
    """Some fillings of ``room`` with few pieces, least waste first, ``BRANCHES`` of them: for the incumbent of the complete search.

    A piece dominates any pieces that fit into its place, so one piece is tried first (the longest that fits), then
    pairs and triples of more than that; only where the longest left is much shorter than the room do copies of it come
    before. The last piece of each is the longest that fits.
    """
    available = counts.copy()
    base: tuple = ()
    while True:
        sizes = np.flatnonzero(available[: room + 1])
        sizes = sizes[sizes > 0]
        if not len(sizes):
            return [base] if base or not room else [()]
        longest = int(sizes[-1])
        copies = min(int(available[longest]), room // longest - 2)
        if copies <= 0:
            break
        base += (longest,) * copies
        available[longest] -= copies
        room -= longest * copies
    fits = np.zeros(room + 1, np.int64)  # the longest available piece up to each room
    fits[sizes] = sizes
    fits = np.maximum.accumulate(fits)
    found = [(longest, base + (longest,))]
    for first in sizes[::-1][:64] if len(sizes) > 64 else sizes[::-1]:
        first = int(first)
        rest = room - first
        second = int(min(fits[rest], first)) if rest else 0
        if second == first and available[first] < 2:
            second = int(fits[first - 1]) if first > 1 else 0
        if not second:
            continue
        found.append((first + second, base + (first, second)))
        rest -= second
        third = int(min(fits[rest], second)) if rest else 0
        while third and available[third] < 1 + (third == second) + (third == first):
            third = int(fits[third - 1])
        if third:
            found.append((first + second + third, base + (first, second, third)))
    found.sort(key=lambda x: (-x[0], len(x[1])))
    seen, out = set(), []
    for total, filling in found:
        if (len(filling) == len(base) + 1 or total > longest) and filling not in seen:
            seen.add(filling)
            out.append(filling)
            if len(out) == BRANCHES:
                break
    return out


def _likely(left: np.ndarray, capacity: int, spare: int):
    """As ``_branches``, but only likely sequences, each as often as it fits."""
    longest = int(np.flatnonzero(left)[-1])
    others = left.copy()
    others[longest] -= 1
    for filling in likely_fillings(others, capacity - longest):
        pattern = (longest, *filling)
        lengths, need = np.unique(pattern, return_counts=True)
        yield pattern, int((left[lengths] // need).min())


def _branches(left: np.ndarray, capacity: int, spare: int):
    """(sequence around the longest piece left, how many of it): fullest first, as many as fit at once and then fewer."""
    longest = int(np.flatnonzero(left)[-1])
    others = left.copy()
    others[longest] -= 1
    for filling in fillings(others, capacity - longest, spare):
        if filling is None:
            yield None
            continue
        pattern = (longest, *filling)
        lengths, need = np.unique(pattern, return_counts=True)
        waste = capacity - sum(pattern)
        most = int((left[lengths] // need).min())
        for times in range(min(most, spare // waste) if waste else most, 0, -1):
            yield pattern, times


def _search(counts: np.ndarray, capacity: int, best: list, bound: int, branches_of) -> list[tuple[tuple, int]]:
    """Depth-first over ``branches_of`` what is left; returns a packing in fewer sequences than ``best`` or ``best``."""
    used = sum(n for _, n in best)
    mass = int((counts * np.arange(len(counts))).sum())
    seen: dict[bytes, int] = {}

    def spare(waste: int) -> int:
        return (used - 1) * capacity - mass - waste

    levels = [(counts, 0, 0, None, branches_of(counts, capacity, spare(0)))] if used > bound else []
    for _ in range(NODES):
        if not levels:
            break
        left, bins, waste, chain, branches = levels[-1]
        branch = next(branches, ())
        if branch is None:
            continue
        if not branch:
            levels.pop()
            continue
        pattern, times = branch
        lengths, need = np.unique(pattern, return_counts=True)
        after = left.copy()
        after[lengths] -= times * need
        bins, waste, chain = bins + times, waste + times * (capacity - sum(pattern)), ((pattern, times), chain)
        if after.any():
            state = hashlib.blake2b(after.tobytes(), digest_size=16).digest()
            if spare(waste) >= 0 and bins < seen.get(state, bins + 1):
                seen[state] = bins
                levels.append((after, bins, waste, chain, branches_of(after, capacity, spare(waste))))
        elif bins < used:
            used, best, node = bins, [], chain
            while node:
                best.append(node[0])
                node = node[1]
            if used == bound:
                break
    return best


def bin_completion(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Packs the histogram: depth-first over the undominated fillings around the longest piece left, each as often as it
    fits at once and then fewer times.

    The first incumbent is the best-fit packing, bettered by a search of ``NODES`` steps over likely fillings. With an
    incumbent of u sequences, u - 1 of them can waste no more than (u - 1) * capacity - (all pieces); a branch that wastes
    more is cut, and one that leaves the pieces that an earlier one left after as few sequences. The search ends at the
    lower bound, when all is explored (the packing is then a best one), or after ``NODES`` steps, keeping the incumbent.
    """
    counts = counts.astype(np.int64)
    best, bound = best_fit_decreasing(counts, capacity), lower_bound(counts, capacity)
    for branches_of in (_likely, _branches):
        best = _search(counts, capacity, best, bound, branches_of)
    return best


def _places(patterns: list[tuple[tuple, int]]):
    """Sorted arrays of runs: key = length << 40 | first rank of that length; sequence of that rank; offset there."""
    next_rank: dict[int, int] = {}
    runs, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rank = next_rank.get(length, 0)
            runs.append((length << 40 | rank, base, offset))
            next_rank[length] = rank + times
            offset += length
        base += times
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3


def _assign(places, columns):
    keys, bases, offsets = places

    def run(batches):
        for batch in batches:
            wanted = batch.column("length").to_numpy().astype(np.int64) << 40 | batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, wanted, side="right") - 1
            added = [pa.array(bases[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], names=[*columns, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, order: list, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length > 0 and up to ``capacity``, other columns) with sequence_id and offset in few sequences.

    Only how many pieces there are of each length, ``capacity`` numbers, is packed in one place; pieces of one length are
    interchangeable and find their place by their rank in ``order``, a distributed prefix count. No row is cut or left.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    ranked = running_total(pieces.withColumn("_one", F.lit(1)), "length", order, "_one", "_rank").drop("_one")
    types = [(f.name, f.dataType.simpleString()) for f in pieces.schema.fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in types) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_places(bin_completion(counts, capacity)), [n for n, _ in types]), schema)


# ---- pieces of documents ----


def _pieces(file: str, capacity: int):
    def run(batches):
        for batch in batches:
            documents = iter(batch.column(0).to_pylist())
            for ids, offsets in encoder(file).encode(batch.column(1)):
                rows: list[tuple] = []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    doc_id = next(documents)
                    whole = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        # The worker lives on beside other stages' tasks.
        encoder(file).shrink()

    return run


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the token ids of every row of ``docs`` (doc_id, text), id 0 at the end.

    Only documents of more than ``capacity`` ids are cut. A null text is empty: one piece with the end id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with sequence_id and offset.

    Rows of one doc_id, repeated or not, are packed as separate documents; other columns are ignored; an empty table
    gives an empty result. Sequences are numbered from 0, each without a gap from offset 0.
    """
    pieces = stored(document_pieces(docs, vocabulary, capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
