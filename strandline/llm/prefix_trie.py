"""Prefix trie of conversations: balanced parentheses per shard, range min-max blocks, shared spines merged.

A conversation is the path of its prefixes. A prefix is named by two 64-bit values that its turns make as a product of
affine maps, so names come from a distributed prefix scan, however long a conversation is. Paths are cut into blocks of
``BLOCK`` turns, sorted, and dealt to ranges; a task turns its range into parentheses in preorder. There ``find_close``
delimits each subtree, ranks count its leaves, and differences of cumulative sums give its savings.

Only nodes whose subtree may reach out of a shard are *shared*: those on the first and last path of a shard, roots of
blocks, and paths that fill a block. All their ancestors are shared too. Their parts are merged by name, and their
subtrees are summed up by doubling the distance to ancestors; all other nodes are final where they were made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_partitions, stored

# Turns of a block, path elements of a shard, bits of a range min-max block, ids of a written piece of a list.
BLOCK, SHARD, RANGE, LISTED = 128, 1_000_000, 256, 2048
# Fixed values of the rebuilding rule.
FAMILY, HEADS = 100, 6

_U = np.uint64
_ROOT, _HEAD, _OWN = range(3)


# -- names of prefixes ---------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of odd values modulo 2 ** 64; each step doubles the right digits."""
    x = (a * _U(3)) ^ _U(2)
    for _ in range(4):
        x *= _U(2) - a * x
    return x


def _composed(a: np.ndarray, b: np.ndarray, firsts: np.ndarray, run: np.ndarray):
    """Running composition of ``x -> a x + b`` within runs of rows; ``run`` has each row's run."""
    product = np.cumprod(a, dtype=np.uint64)
    inverse = _inverse(product)
    summed = np.cumsum(b * inverse, dtype=np.uint64)
    before = lambda x, start: np.where(firsts > 0, x[firsts - 1], _U(start))[run]
    return product * before(inverse, 1), product * (summed - before(summed, 0))


_SCANNED = "n long, a1 long, b1 long, a2 long, b2 long, first boolean, part int"


def _scan(batches):
    """Adds to rows that come by conversation in order: their number and composition within their task's share of it."""
    part, last, state, leading = TaskContext.get().partitionId(), None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        firsts = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1]
        run = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(conv)]))
        n = np.arange(1, len(conv) + 1) - firsts[run]
        digest = np.frombuffer(b"".join(batch.column("h").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        u, v = digest[:, 0].copy(), digest[:, 1].copy()
        lanes = []
        root = batch.column("seg").to_numpy() == _ROOT
        for a, b in ((u, v), (_mixed(v), _mixed(u ^ _U(0x9E3779B97F4A7C15)))):
            lanes.append(_composed(np.where(root, _U(1), a | _U(1)), np.where(root, _U(0), b), firsts, run))
        continued = (run == 0) & (last == conv[0])
        if continued.any():
            n[continued] += state[0]
            for (a, b), (a0, b0) in zip(lanes, state[1], strict=True):
                b[continued] += a[continued] * b0
                a[continued] *= a0
        # Only what belongs to the first conversation of a task may have begun before it.
        leads = (run == 0) & (leading and (last is None or last == conv[0]))
        leading = bool(leads[-1])
        last, state = conv[-1], (int(n[-1]), [(a[-1], b[-1]) for a, b in lanes])
        made = [pa.array(n), *(pa.array(x.view(np.int64)) for lane in lanes for x in lane), pa.array(leads), pa.array(np.full(len(n), part, np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(c.split()[0] for c in _SCANNED.split(", "))])


def _carries(scanned: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each task that goes on with a conversation begun before: (rows, names) until there. One row a task is read."""
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "n", "a1", "b1", "a2", "b2", "first")).alias("high"))
    found, conv, n, names, mask = {}, None, 0, (0, 0), (1 << 64) - 1
    for row in sorted(ends.collect(), key=lambda r: r.part):
        high = row.high
        if conv is not None and conv == row.low:
            found[row.part] = (n, *names)
        else:
            n, names = 0, (0, 0)
        if high.first:
            n, names = n + high.n, tuple((a * x + b) & mask for a, b, x in ((high.a1, high.b1, names[0]), (high.a2, high.b2, names[1])))
        else:
            n, names = high.n, (high.b1 & mask, high.b2 & mask)
        conv = high.conv_id
    return found


def _finished(carries: dict[int, tuple[int, int, int]], keep: list[str]):
    """Positions from 0 and names of scanned rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, names = batch.column("n").to_numpy().copy(), []
            part, first = batch.column("part").to_numpy(), batch.column("first").to_numpy(zero_copy_only=False)
            values = [batch.column(c).to_numpy().view(np.uint64).copy() for c in ("a1", "b1", "a2", "b2")]
            for p in np.unique(part[first]).tolist():
                if p in carries:
                    rows = np.flatnonzero(first & (part == p))
                    n[rows] += carries[p][0]
                    for a, b, x in ((values[0], values[1], carries[p][1]), (values[2], values[3], carries[p][2])):
                        b[rows] += a[rows] * _U(x)
            names = np.stack([values[1], values[3]], axis=1).astype(">u8")
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n - 1), key], names=[*keep, "pos", "key"])

    return run


def _scanned(rows: DataFrame, order: list, keep: list[str], label: str) -> DataFrame:
    """``keep`` columns of ``rows`` (conv_id, seg, h, ...) with pos and key by ``order`` within a conversation."""
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    scanned = stored(dealt.mapInArrow(_scan, f"{fields}, {_SCANNED}"), label)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return scanned.mapInArrow(_finished(_carries(scanned), keep), f"{kept}, pos long, key binary")


# -- parentheses ---------------------------------------------------------------------------------------------------


class RangeMin:
    """Excess of parentheses with the lowest excess of blocks, and of pairs of blocks, and so on."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        padded = np.full(-(-len(bits) // RANGE) * RANGE, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        lows = padded.reshape(-1, RANGE).min(axis=1)
        size = 1 << max(0, (len(lows) - 1).bit_length())
        self.levels = [np.r_[lows, np.full(size - len(lows), np.iinfo(np.int32).max, np.int32)]]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))
        self.flat = np.concatenate(self.levels)
        self.at = np.cumsum([0, *map(len, self.levels[:-1])])

    def _within(self, found, rows, start, goal):
        """Looks through what is left of the blocks at ``start``; returns the rows without a find."""
        end = np.minimum((start // RANGE + 1) * RANGE, len(self.excess))
        left = np.zeros(0, np.int64)
        while len(rows):
            over = start >= end
            if over.any():
                left = np.r_[left, rows[over]]
                rows, start, end, goal = rows[~over], start[~over], end[~over], goal[~over]
            hit = self.excess[start] <= goal
            found[rows[hit]] = start[hit]
            rows, start, end, goal = rows[~hit], start[~hit] + 1, end[~hit], goal[~hit]
        return left

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Places of the closing parentheses that belong to the opening ones at ``opens``."""
        goal, found = self.excess[opens] - 1, np.full(len(opens), -1, np.int64)
        rows = np.sort(self._within(found, np.arange(len(opens)), opens + 1, goal))
        block, level = opens[rows] // RANGE + 1, np.zeros(len(rows), np.int64)
        # Up and to the right to the next range whose lowest excess reaches the goal ...
        active = np.arange(len(rows))
        while len(active):
            miss = self.flat[self.at[level[active]] + block[active]] > goal[rows[active]]
            active = active[miss]
            block[active] += 1
            up = (block[active] & 1) == 0
            block[active[up]] >>= 1
            level[active[up]] += 1
        # ... and down to its first block.
        active = np.flatnonzero(level > 0)
        while len(active):
            level[active] -= 1
            block[active] <<= 1
            block[active] += self.flat[self.at[level[active]] + block[active]] > goal[rows[active]]
            active = active[level[active] > 0]
        self._within(found, rows, block * RANGE, goal[rows])
        return found


_NODES = (
    "shared boolean, k1 long, k2 long, p1 long, p2 long, depth long, size long, conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, parent_conv_id long, ends_sha256 string, ends array<string>, part int, shard int"
)


def _shared_prefix(k1, k2, begin, length):
    """How many elements each path has in common with the one before it."""
    common = np.zeros(len(begin), np.int64)
    rows, t = np.arange(1, len(begin)), 0
    shortest = np.minimum(length[1:], length[:-1])
    while True:
        rows = rows[shortest[rows - 1] > t]
        same = (k1[begin[rows] + t] == k1[begin[rows - 1] + t]) & (k2[begin[rows] + t] == k2[begin[rows - 1] + t])
        rows = rows[same]
        if not len(rows):
            return common
        t += 1
        common[rows] = t


def _listed(conv: np.ndarray, node: np.ndarray, shared: np.ndarray, nodes: int):
    """Digests of the ids that end at a node, or their joined pieces where it is shared."""
    digests: list = [hashlib.sha256(b"").hexdigest()] * nodes
    pieces: list = [None] * nodes
    cuts = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)] if len(node) else np.zeros(1, np.int64)
    names = [str(c) for c in conv.tolist()]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        k = int(node[a])
        if shared[k]:
            pieces[k] = [",".join(names[i : min(b, i + LISTED)]) for i in range(a, b, LISTED)]
        else:
            digests[k] = hashlib.sha256(",".join(names[a:b]).encode()).hexdigest()
    return digests, pieces


def shard_nodes(conv: np.ndarray, block: np.ndarray, begin: np.ndarray, k1: np.ndarray, k2: np.ndarray, sizes: np.ndarray, length: np.ndarray):
    """Columns of the nodes of sorted paths. Path i has the elements begin[i] .. begin[i] + length[i], its block's root first."""
    common = _shared_prefix(k1, k2, begin, length)
    opened = length - common
    counts = np.zeros(2 * len(conv) + 1, np.int64)
    counts[1::2], counts[2:-1:2], counts[-1] = opened, length[:-1] - common[1:], length[-1]
    bits = np.repeat(np.arange(len(counts)) & 1, counts).astype(np.int8)
    reached = np.cumsum(counts)[1::2] - 1  # the bit behind which a path ends
    opens = np.flatnonzero(bits)
    closes = RangeMin(bits).find_close(opens)
    path = np.repeat(np.arange(len(conv)), opened)  # the path that opened a node, which is the first through it
    level = common[path] + np.arange(len(opens)) - (np.cumsum(opened) - opened)[path]
    element = begin[path] + level
    last = np.searchsorted(reached, closes) - 1
    subtree = (closes - opens + 1) // 2
    parent = np.full(len(opens), -1, np.int64)
    by_level = [np.flatnonzero(level == d) for d in range(int(length.max()))]
    for above, here in zip(by_level, by_level[1:], strict=False):
        parent[here] = above[np.searchsorted(above, here) - 1]
    full = np.r_[0, np.cumsum(length - 1 == BLOCK)]
    shared = (level == 0) | (path == 0) | (last == len(conv) - 1) | (full[last + 1] > full[path])
    end_node = np.cumsum(opened) - 1
    smallest = np.full(len(opens), np.iinfo(np.int64).max)
    np.minimum.at(smallest, end_node, conv)
    for here in reversed(by_level[1:]):
        np.minimum.at(smallest, parent[here], smallest[here])
    n_convs = last - path + 1
    below = parent >= 0
    n_children = np.bincount(parent[below & ~shared], minlength=len(opens))
    # A leaf is a pair "()"; ranks and sums run over nodes that are not shared.
    leaf = (bits[np.minimum(opens + 1, len(bits) - 1)] == 0) & ~shared
    saved = np.where(shared, 0, (n_convs - 1) * sizes[element])
    ranks, sums = np.r_[0, np.cumsum(leaf)], np.r_[0, np.cumsum(saved)]
    ids = np.arange(len(opens))
    n_leaves, saved_tokens = (x[ids + subtree] - x[ids] for x in (ranks, sums))
    # A shared node keeps what hangs below it outside of its shared children.
    hanging = below & shared
    np.subtract.at(n_leaves, parent[hanging], n_leaves[hanging].copy())
    np.subtract.at(saved_tokens, parent[hanging], saved_tokens[hanging].copy())
    ends = length - 1 < BLOCK
    digests, pieces = _listed(conv[ends], end_node[ends], shared, len(opens))
    deeper = (level == 0) & (block[path] > 0)  # the root of a further block counts its members in the block above
    inner = below & ~shared[parent]
    nullable = lambda values, there, kind=pa.int64(): pa.array(values, kind, mask=~there)
    return [
        pa.array(shared), pa.array(k1[element].view(np.int64)), pa.array(k2[element].view(np.int64)),
        nullable(k1[element[parent]].view(np.int64), below & ~inner), nullable(k2[element[parent]].view(np.int64), below & ~inner),
        pa.array(block[path] * BLOCK + level), nullable(sizes[element], ~deeper), pa.array(smallest), pa.array(np.where(deeper, 0, n_convs)),
        pa.array(n_children), pa.array(n_leaves), pa.array(saved_tokens), nullable(smallest[parent], inner),
        pa.array(digests, pa.string(), mask=shared), pa.array(pieces, pa.list_(pa.string())),
    ]


def _build(batches):
    """Nodes of the paths of a task, in shards of ``SHARD`` elements."""
    part, shard, held, elements = TaskContext.get().partitionId(), 0, [], 0

    def made():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        path = rows.column("path")
        begin = path.offsets.to_numpy().astype(np.int64)
        flat = path.values.slice(begin[0], begin[-1] - begin[0])
        names = np.frombuffer(b"".join(flat.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        size_list = rows.column("sizes")
        starts = size_list.offsets.to_numpy()
        sizes = size_list.values.to_numpy()[starts[0] : starts[-1]].astype(np.int64)
        begin = begin - begin[0]
        columns = shard_nodes(
            rows.column("conv_id").to_numpy(), rows.column("block").to_numpy().astype(np.int64), begin[:-1], names[:, 0].copy(), names[:, 1].copy(), sizes, np.diff(begin)
        )
        n = len(columns[0])
        columns += [pa.array(np.full(n, x, np.int32)) for x in (part, shard)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODES.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        elements += batch.column("path").values.slice(batch.column("path").offsets[0].as_py()).__len__()
        if elements >= SHARD:
            yield made()
            shard, held, elements = shard + 1, [], 0
    if held:
        yield made()


# -- conversations to paths ----------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seg, p, h, size) of rebuilt conversations: a root element, head turns of the family, then own turns.

    The family of c is c - c % FAMILY, the sign of c % FAMILY being that of c. Turns come by number, a null one first,
    those of one number by the digest of role and text. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(_OWN).alias("seg"),
        digest.alias("h"), F.char_length(text).cast("long").alias("size"),
    )
    own = _scanned(rows, [F.asc_nulls_first("turn"), F.col("h")], ["conv_id", "seg", "h", "size"], "own-turns").withColumnRenamed("pos", "p").drop("key")
    cut = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < HEADS)).groupBy(F.col("conv_id").alias("family")).agg(
        F.sort_array(F.collect_list(F.struct("p", "h", "size"))).alias("heads")
    )
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.select("conv_id").distinct().withColumn("family", family).join(heads, "family", "left")
    first = F.array(F.struct(F.lit(_ROOT).alias("seg"), F.lit(-1).cast("long").alias("p"), F.unhex(F.lit("00" * 16)).alias("h"), F.lit(0).cast("long").alias("size")))
    taken = F.transform(F.slice("heads", F.lit(1), cut), lambda x: F.struct(F.lit(_HEAD).alias("seg"), x.p.alias("p"), x.h.alias("h"), x["size"].alias("size")))
    begins = convs.select("conv_id", F.explode(F.concat(first, F.coalesce(taken, F.array().cast("array<struct<seg:int,p:bigint,h:binary,size:bigint>>")))).alias("e"))
    return begins.select("conv_id", "e.seg", "e.p", "e.h", "e.size").unionByName(own.where(F.col("p") >= cut))


def _paths(elements: DataFrame) -> DataFrame:
    """(conv_id, block, path, sizes): the elements of each block of a conversation behind the block's root."""
    depth = F.col("pos")
    own = F.greatest(F.lit(0), F.expr(f"(pos - 1) div {BLOCK}")).cast("int")
    # The last element of a block is the root of the next one.
    blocks = F.when((depth > 0) & (depth % BLOCK == 0), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = elements.select("conv_id", F.explode(blocks).alias("block"), depth.alias("depth"), "key", "size")
    lists = dealt.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "size"))).alias("e"))
    return lists.select("conv_id", "block", F.col("e.key").alias("path"), F.col("e.size").alias("sizes"))


# -- shared nodes --------------------------------------------------------------------------------------------------


def _streamed(batches):
    """Digests of lists whose pieces come in order, joined by commas."""
    key, running = None, None

    def row():
        columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([running.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "piece")), strict=True):
            if key == (k1, k2):
                running.update(b",")
            else:
                if key is not None:
                    yield row()
                key, running = (k1, k2), hashlib.sha256()
            running.update(piece.encode())
    if key is not None:
        yield row()


def _summed_up(nodes: DataFrame) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) summed over subtrees of nodes (k1, k2, p1, p2, n_leaves, saved_tokens).

    After r rounds a node holds the sum over descendants less than 2 ** r below it and knows its ancestor 2 ** r above.
    """
    while not nodes.where("p1 is not null").isEmpty():
        handed = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        above = nodes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
        stepped = nodes.join(handed, ["k1", "k2"], "left").join(above, (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2")), "left")
        nodes = stored(
            stepped.select(
                "k1", "k2", F.col("_p1").alias("p1"), F.col("_p2").alias("p2"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
            ),
            "subtrees",
        )
    return nodes.select("k1", "k2", "n_leaves", "saved_tokens")


def _merged(parts: DataFrame) -> DataFrame:
    """Whole shared nodes from their parts in shards and blocks."""
    n = shuffle_partitions(parts.sparkSession)
    whole = parts.groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "size")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    whole = stored(whole, "shared")
    children = whole.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("_more"))
    counted = whole.join(children, ["k1", "k2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    leaves = F.col("n_leaves") + (F.col("n_children") == 0).cast("long")
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")
    sums = _summed_up(stored(counted.select("k1", "k2", "p1", "p2", leaves.alias("n_leaves"), saved.alias("saved_tokens")), "subtrees"))
    lists = parts.where("ends is not null").select("k1", "k2", "part", "shard", F.posexplode("ends").alias("at", "piece"))
    dealt = lists.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "part", "shard", "at")
    digests = dealt.select("k1", "k2", "piece").mapInArrow(_streamed, "k1 long, k2 long, ends_sha256 string")
    joined = counted.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(digests, ["k1", "k2"], "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of rebuilt ``conversations`` (conv_id, turn, role, text), the textless root included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): see ``rebuilt`` for
    order, nulls and ties; a null role or text is empty, repeated rows are turns of their own, no conversation gives no
    row. Other columns are ignored.
    """
    elements = _scanned(rebuilt(conversations), ["seg", "p"], ["conv_id", "size"], "elements")
    paths = _paths(elements)
    order = ["path", "conv_id"]
    dealt = paths.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    nodes = stored(dealt.mapInArrow(_build, _NODES), "trie-nodes")
    shared = stored(_merged(nodes.where("shared")), "shared-nodes")
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "p1", "p2"]
    final = nodes.where("not shared").select(*columns, "parent_conv_id").unionByName(shared.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
    above = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_above"))
    joined = final.join(above, ["p1", "p2"], "left")
    return joined.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
