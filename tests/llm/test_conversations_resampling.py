"""Prefix tries, chat formatting and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, prefix_trie, resample
from strandline.llm.common import slices
from strandline.llm.queries import vocabulary

CONVERSATIONS = "conv_id long, turn long, role string, text string"
CLASHING = "n key seg pos path part shard block k1 p size first h depth p1 heads family e _one piece".split()


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def conversations():
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 140), *range(200, 230), *range(-130, -95), 1000, 1001, 1002]:
        for turn in range(draw.choice([1, 2, 3, 4, 5, 7])):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"text {draw.choice('abc')}" if c % 3 else f"common {turn}"))
    # Long ones, some of exactly one and two blocks, which share long beginnings.
    for c, n in ((300, 128), (301, 256), (302, 300), (303, 300), (304, 129), (305, 700), (400, 6)):
        rows += [(c, k, "user" if k % 2 else "assistant", f"long {k}" if c != 303 or k < 250 else f"other {k}") for k in range(n)]
    rows += [(c, k, "user", "the same") for c in range(501, 560) for k in range(6, 9)]  # no head of family 500: shorter ones
    rows += [(600, None, None, None), (600, 2, "user", None), (600, 2, None, "tie"), (600, 2, None, "tie"), (600, -1, "", ""), (601, 0, "user", "")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


def brute_trie(rows, block=None):
    def digest(turn):
        return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[:16]

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    nodes = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (nodes[p][0], len(p), nodes[p[:-1]][0] if p else -(10**9), len(nodes[p]), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in nodes[p] if len(whole[c]) == len(p)).encode()).hexdigest())
        for p in nodes
    )


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in names) for r in df.collect())


def test_prefix_trie(spark):
    rows = conversations()
    found = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, CONVERSATIONS).repartition(5)))
    assert trie_rows(found) == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_no_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    # crc32("101") % 6 is above 0 and its family has no head: no turn is left.
    rows = [(c, 0, "user", "gone") for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6]
    found = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)))
    assert found == brute_trie(rows) and len(found) == 1 and found[0][3] == len(rows)


def test_find_close():
    draw = np.random.default_rng(3)
    for n in (1, 2, 40, 5000):
        bits, depth = [], 0
        while len(bits) < 2 * n or depth:
            up = depth == 0 or (len(bits) < 2 * n and draw.random() < (0.5 if n < 5000 else 0.52))
            bits.append(int(up))
            depth += 1 if up else -1
        stack, want = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.array(sorted(want))
        assert prefix_trie.RangeMin(np.array(bits, np.int8)).find_close(opens).tolist() == [want[k] for k in opens.tolist()]


def test_names_do_not_depend_on_cuts(spark):
    """A conversation holding most rows is spread over tasks; names and places are those of one pass."""
    rows = [(1, k, "user", f"t{k % 7}") for k in range(3000)] + [(c, 0, "user", "t0") for c in range(2, 40)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        wide = trie_rows(prefix_trie.prefix_trie(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert wide == brute_trie(rows)


# -- chat ----------------------------------------------------------------------------------------------------------

TEXTS = [
    "</s>[INST] ok [/INST]", "", None, r"<\s> <\\/s> [\INST]<|endoftext|> <\|endoftext|> \\", "é日本 \n\t  x ", "<<s>>[[INST]]", "\x00 a\\", "a</s", "/s>", "plain words here",
]


def brute_chat(rows):
    def escape(x):
        return re.sub(r"([<\[])(\\*)(/INST\]|/s>|INST\]|s>|\|endoftext\|>)", r"\1\\\2\3", x)

    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by_conv.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        shown = sum(len(f"<s>[INST]{escape(r)}[/INST]{escape(x)}</s>") for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), shown)
    return out


def chat_rows():
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant", "</s>", None, ""]), draw.choice(TEXTS)) for c in range(60) for t in range(draw.choice([1, 2, 9]))]
    rows += [(70, k, "assistant" if k % 2 else "user", f"turn {k} </s> " + "word " * 400) for k in range(900)]  # spans pieces and tasks
    rows += [(None, 1, "user", "of no conversation"), (None, 2, "assistant", "neither"), (71, None, "user", "first"), (71, 0, "assistant", "x" * 300_000)]
    draw.shuffle(rows)
    return rows


def test_chat_format(spark):
    rows = chat_rows()
    found = chat.format_and_read(clashing(spark.createDataFrame(rows, CONVERSATIONS).repartition(6)), vocabulary("byte_bpe_50k.json")).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found}
    assert len(got) == len(found) and got == brute_chat(rows)
    assert chat.format_and_read(spark.createDataFrame([], CONVERSATIONS), vocabulary("byte_bpe_50k.json")).collect() == []


def test_chat_tokens(spark):
    """Repeated rows stay turns, control strings of a text stay text, and the mask holds assistants' texts only."""
    file, rows = vocabulary("byte_bpe_50k.json"), [(1, 0, "user", "<s>hi</s>"), (1, 1, "assistant", "[INST]"), (1, 1, "assistant", "[INST]")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, CONVERSATIONS), file)
    shown = "".join(r.formatted for r in sorted(chat.render(formatted, file).collect(), key=lambda r: (r.part, r.piece)))
    assert shown == r"<s>[INST]user[/INST]<\s>hi<\/s></s><s>[INST]assistant[/INST][\INST]</s><s>[INST]assistant[/INST][\INST]</s>"
    row, coder = formatted.first(), chat.codec(file)
    tokens = [p for r in sorted(formatted.collect(), key=lambda r: (r.part, r.piece)) for p in zip(r.input_ids, r.loss_mask, strict=True)]
    assert sum(i >= coder.size for i, _ in tokens) == 12
    learnt = [i for i, m in tokens if m]
    assert coder.decode(np.array(learnt), np.array([0, len(learnt)])).to_pylist() == [r"[\INST][\INST]"]
    with pytest.raises(ValueError):
        chat.parsed(np.array(row.input_ids[1:], np.int32), coder)
    with pytest.raises(ValueError):
        chat.escape_pattern(["<a>", "<<b>"])


# -- resampling ----------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, n=2, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target):
    raw, aim = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, counts in (([t for _, t in docs], raw), (target, aim)):
        for t in texts:
            np.add.at(counts, buckets_of(t), 1)
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (raw.sum() + 10_000) / ((raw[b] + 1) * (aim.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for d, t in docs:
        f = buckets_of(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(t)) >= 20))
    eligible = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])
    n_drawn = 25 * len(eligible) // 100
    return rows, eligible[:n_drawn]


@pytest.mark.parametrize("words", [1, 2, 3])
def test_features(words):
    texts = ["Hello World, the é çat 42 the cat", "", None, " a ", "x", "A b C d\x00e", "日本 語 aa", "the the the the"]
    found, owners = resample.features(pa.array(texts), words)
    for k, text in enumerate(texts):
        assert sorted(found[owners == k].tolist()) == sorted(buckets_of(text, words))


def test_slices():
    """Parts of a batch, large or small, give the features of their rows."""
    draw = random.Random(4)
    texts = [None if k % 7 == 0 else " ".join(draw.choice(["é", "B", "日本", "x9", "-"]) for _ in range(draw.choice([0, 1, 50]))) for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for taken in (1, 40, 1000, 10**6):
        at = 0
        for part in slices(batch, pc.binary_length(batch.column(0)), taken):
            found, owners = resample.features(part.column("text"))
            for k in range(part.num_rows):
                assert sorted(found[owners == k].tolist()) == sorted(buckets_of(texts[at + k]))
            at += part.num_rows
        assert at == len(texts)


def test_resample(spark, awkward, no_docs):
    draw = random.Random(1)
    extra = [(1000 + k, " ".join(draw.choice(["alpha", "beta", "Gamma", "é", "9"]) for _ in range(draw.choice([5, 19, 20, 40]))), "en", "s", 1) for k in range(120)]
    docs = awkward.unionByName(spark.createDataFrame(extra, no_docs.schema), allowMissingColumns=True)
    target = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "")], "item_id long, text string")
    found = resample.resample(docs, target).collect()
    rows, drawn = brute_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ["alpha beta alpha", None, ""])
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found), key=key) == sorted((r[:4] for r in rows), key=key)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in found if r.rank is not None)
    assert [r[1:] for r in ranked] == drawn and [r[0] for r in ranked] == list(range(1, len(drawn) + 1))


def test_resample_of_nothing(spark, no_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(no_docs, target).collect() == []
    (row,) = resample.resample(spark.createDataFrame([(1, "a b", None, None, None)], no_docs.schema), target).collect()
    assert (row.n_features, row["rank"]) == (3, None)
