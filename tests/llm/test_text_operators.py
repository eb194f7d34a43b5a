"""Operators on documents against brute-force versions, on rows with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from strandline.llm import langid, licences, line_dedup, mixing, packing, quality, simhash, token_files, tokens
from strandline.llm.tokens import WordEncoder
from tests.llm.conftest import text_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_rows(got, want):
    key = lambda rows: collections.Counter(tuple(r) for r in rows)
    assert key(got) == key(want)


# ---- 2 packing ----


def packed_well(rows, docs, file, capacity):
    """Checks pieces against the tokenizer and sequences for gaps; returns how many sequences there are."""
    tokenizer = Tokenizer.from_file(file)
    want = collections.Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, awkward, no_docs):
    file = public_tokenizers.path("word_bpe_49k.json")
    docs = [(r[0], r[1]) for r in text_rows()]
    for capacity in (2048, 16):
        rows = packing.pack_documents(awkward, file, capacity).collect()
        used = packed_well(rows, docs, file, capacity)
        assert used <= 1.001 * sum(r.length for r in rows) / capacity + 2
    assert packing.pack_documents(no_docs, file).collect() == []


@pytest.mark.parametrize("sizes", [
    [5], [1024] * 7 + [3], list(range(1, 100)), [700] * 30 + [2048] * 5 + [600] * 40, [1] * 5000, random.Random(1).choices(range(600, 760), k=500),
])
def test_bin_completion_packs_everything(sizes):
    capacity = 2048
    counts = np.bincount(sizes, minlength=capacity + 1)
    left = counts.copy()
    used = 0
    for pattern, times in packing.bin_completion(counts, capacity):
        assert sum(pattern) <= capacity
        used += times
        for size in pattern:
            left[size] -= times
    assert not left.any()
    fit = sum(n for _, n in packing.best_fit_decreasing(counts, capacity))
    assert packing.lower_bound(counts, capacity) <= used <= fit


def test_bin_completion_is_optimal_on_small_cases():
    draw = random.Random(3)

    def optimum(sizes, capacity):
        best = len(sizes)

        def go(rest, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if not rest:
                best = len(bins)
                return
            tried = set()
            for k, b in enumerate(bins):
                if b + rest[0] <= capacity and b not in tried:
                    tried.add(b)
                    go(rest[1:], bins[:k] + [b + rest[0]] + bins[k + 1 :])
            go(rest[1:], bins + [rest[0]])

        go(sorted(sizes, reverse=True), [])
        return best

    for _ in range(40):
        sizes = [draw.randint(10, 70) for _ in range(9)]
        used = sum(n for _, n in packing.bin_completion(np.bincount(sizes, minlength=101), 100))
        assert used == optimum(sizes, 100)


@pytest.mark.parametrize("sizes, capacity, optimum", [
    # The best filling around the longest piece has four pieces more, all of one length.
    ([1048] + [300] * 6 + [250] * 4 + [248], 2048, 2),
    # With each sequence as often as it fits nine are needed.
    ([22] * 6 + [15] * 7 + [9] * 8, 41, 8),
])
def test_bin_completion_tries_every_filling_and_repeat(sizes, capacity, optimum):
    assert sum(n for _, n in packing.bin_completion(np.bincount(sizes, minlength=capacity + 1), capacity)) == optimum


def test_fillings_are_the_undominated_ones():
    draw = random.Random(5)
    for _ in range(150):
        room, spare = draw.randint(1, 40), draw.randint(0, 12)
        counts = np.bincount(draw.choices(range(1, 16), k=draw.randint(1, 9)), minlength=room + 16)
        every = {()}
        for size in range(len(counts) - 1, 0, -1):
            every = {f + (size,) * n for f in every for n in range(counts[size] + 1) if sum(f) + size * n <= room}

        def parts_fit(pieces, places):
            """Whether pieces find room in places, each piece in one of them."""
            return not pieces or any(
                pieces[0] <= p and parts_fit(pieces[1:], places[:k] + (p - pieces[0],) + places[k + 1 :]) for k, p in enumerate(places)
            )

        want = {f for f in every if not any(f != g and parts_fit(f, g) for g in every)}
        got = [f for f in packing.fillings(counts, room, spare) if f is not None]
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        assert sorted(got) == sorted(f for f in want if room - sum(f) <= spare)


# ---- tokens and 10 token files ----


def test_word_encoder_equals_whole_texts():
    draw = random.Random(2)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "Ab", "é", "́", "Σ", "'s", "1", "<|endoftext|>", "<|", "<|startoftext|>", " ", "\x1c", "\x85", "!", "中", "İ", "ſ"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 20))) for _ in range(3000)] + [r[1] for r in text_rows()]
    import pyarrow as pa

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        file = public_tokenizers.path(name)
        got = []
        for ids, offsets in WordEncoder(file).encode(pa.array(texts, pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
        want = [e.ids for e in Tokenizer.from_file(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert got == want


@pytest.mark.parametrize("ids", [
    [], [7], [0] * 9000, list(range(40)), list(np.random.default_rng(0).integers(0, 99, 4097)), list(np.random.default_rng(1).integers(0, 2**24 - 1, 4500)),
    list(np.minimum(np.random.default_rng(2).zipf(1.3, 20_000), 60_000)),
])
def test_token_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data = token_files.encode(ids)
    assert np.array_equal(token_files.decode(data), ids)
    for at in {5, len(data) // 2, len(data) - 1}:
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.decode(bytes(broken))
    with pytest.raises(ValueError):
        token_files.decode(b"none" + data)


def test_coder_gains_from_its_predictions():
    text = np.tile(np.random.default_rng(0).integers(0, 50_000, 300), 40).astype(np.uint32)
    assert 8 * len(token_files.encode(text)) / len(text) < 3


def test_token_files(spark, awkward, no_docs, monkeypatch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    rows = token_files.write_and_read(awkward, file).collect()
    want = collections.Counter()
    for doc_id, text, *_ in text_rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named) and rows and min(rows, key=lambda r: r.start).doc_id is None
    assert token_files.write_and_read(no_docs, file).collect() == []


# ---- 3 mixing ----


def test_tokens_of_a_batch_go_by_parts_and_words_are_dropped_between(monkeypatch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, ""] + [f"word{i} and{i % 7}  tail{i}\n" * 3 for i in range(60)]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(token_files.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda self: 0})()))
    ids = lambda: np.concatenate([token_files.decode(r.column("payload")[0].as_py()) for r in token_files._to_segments(file)([batch(), batch()])])
    want, known, dropped = ids(), token_files.encoder(file), []
    assert np.array_equal(want, np.concatenate([[*known.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts * 2]))
    forget = known.forget
    monkeypatch.setattr(known, "forget", lambda: (dropped.append(known.n), forget()))
    monkeypatch.setattr(tokens, "KEPT", 40)
    monkeypatch.setattr(token_files, "TAKEN", 300)
    # A segment that ends within a part does not take the words away that the rest of the part needs.
    for size in (token_files.SEGMENT, 100):
        monkeypatch.setattr(token_files, "SEGMENT", size)
        dropped.clear()
        assert np.array_equal(ids(), want)
        assert len(dropped) > 2 and max(dropped[1:]) < 100


def test_mixing(spark, awkward, no_docs):
    rows = mixing.mix(awkward).collect()
    docs = text_rows()
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in docs]
    by_source = collections.Counter()
    for (_, _, _, source, _), size in zip(docs, sizes, strict=True):
        by_source[source] += size
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes)
    while True:
        level = (total - sum(2 * by_source[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 2 * by_source[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * by_source[s] if s in full else weight[s] * level for s in order}
    same_rows(
        [(r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in rows],
        [(d[0], n, by_source[d[3]], round(target[d[3]], 6)) for d, n in zip(docs, sizes, strict=True)],
    )
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
    for s in order:
        alike = [x for x in order if by_source[x] == by_source[s]]
        assert abs(taken[by_source[s]] - sum(target[x] for x in alike)) <= len(alike)
    same_rows(rows, mixing.mix(awkward).collect())
    assert mixing.mix(no_docs).collect() == []


def test_mixed_documents_hold_the_taken_words(spark, awkward, no_docs):
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    words = collections.Counter()
    for r in mixed.collect():
        assert WORD.search(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    want = collections.Counter()
    for r in mixing.mix(awkward).collect():
        want[r.doc_id] += r.taken
    assert words == +want
    assert mixing.mixed_documents(no_docs).collect() == []


# ---- 4 language ID ----


def test_language_id(spark, awkward, no_docs):
    rows = langid.predict(awkward).collect()
    assert len(rows) == len(text_rows())
    learnt = {r[2] for r in text_rows() if r[2]}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    empty = {2, 3, 6, 7}
    assert all((r.lang_pred == "und") == (r.doc_id in empty) and (r.lang_pred in learnt or r.doc_id in empty) for r in rows)
    assert all(r.rejected for r in rows if r.doc_id in empty)
    assert langid.predict(no_docs).collect() == []


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert sum(r.rejected for r in found) <= 0.02 * len(found)


# ---- 5 SimHash ----


def brute_print(text, words=3):
    parts = WORD.findall((text or "").translate(LOWER))
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints, radius):
    n = len(ids)
    reach = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if (prints[i] ^ prints[j]).bit_count() <= radius and reach[j] < reach[i]:
                    reach[i] = reach[j]
                    changed = True
    smallest = {}
    for i in range(n):
        if ids[i] is not None:
            smallest[reach[i]] = min(smallest.get(reach[i], ids[i]), ids[i])
    return [smallest.get(r) for r in reach]


def test_simhash(spark, awkward, no_docs):
    ids, prints = [r[0] for r in text_rows()], [brute_print(r[1]) for r in text_rows()]
    rows = simhash.near_groups(awkward).collect()
    want = zip(ids, prints, brute_groups(ids, prints, 2), strict=True)
    same_rows([(r.doc_id, r.print % 2**64, r.component_id) for r in rows], want)
    kept = simhash.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({(p, c) for p, c in zip([r.root for r in rows], [0] * len(rows), strict=True)})
    assert simhash.near_groups(no_docs).collect() == [] and simhash.one_of_each_group(no_docs).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_links(radius):
    draw = random.Random(radius)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))}) for c in centres for _ in range(40)})
    i, j = simhash.links_within(np.array(prints, np.uint64), radius)
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_large_buckets_are_tiled_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(5)
    prints = list({(draw.getrandbits(12) << 52) | draw.getrandbits(3) for _ in range(300)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.print_links(spark.createDataFrame([(p,) for p in signed], "print long"))
    from strandline.llm.components import components

    root = {r.node: r.root for r in components(edges).collect()}
    got = collections.defaultdict(set)
    for p in signed:
        got[root.get(p, p)].add(p)
    want = collections.defaultdict(set)
    for p, c in zip(signed, brute_groups(list(range(len(prints))), prints, 2), strict=True):
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- 6 licences ----

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licence_rules():
    names = lambda text: [(m[0], m[1]) for m in licences.matches(text)]
    assert names(MIT) == [("MIT", "mit-text")]
    assert names(MIT.split("\n\n")[0] + "\n" + MIT.split("\n\n")[1]) == [("MIT", "mit-short-text")]
    # Order matters, and a sentence alone is no licence where the rule wants more.
    assert names("\n\n".join(MIT.split("\n\n")[::-1])) == []
    assert names("Prose before\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0") == [("MIT", "mit-line"), ("CC-BY-NC-4.0", "cc-by-nc-4-line")]
    assert names('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.') == [
        ("Apache-2.0", "apache-2-notice-short")
    ]
    assert names("It was not released under the MIT License yesterday.") == []
    for nothing in (None, "", "\n\n", ". . .", "mit"):
        assert names(nothing) == []


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program{0} if not, see <https://www.gnu.org/licenses/>."""


@pytest.mark.parametrize("text, want", [
    (GPL.format(":", ",", 3), [("GPL-3.0-or-later", "gpl-3-notice")]), (GPL.format(";", ";", 2), [("GPL-2.0-or-later", "gpl-2-notice")]),
    (GPL.format(";", ";", 2).split("\n\n")[0], [("GPL-2.0-or-later", "gpl-2-free")]), (GPL.format(":", ",", 3).split("\n\n")[0], [("GPL-3.0-or-later", "gpl-3-free")]),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", [("MPL-2.0", "mpl-2-line")]),
    ("// SPDX-License-Identifier: MIT", [("MIT", "spdx-line")]), ("# SPDX-License-Identifier: GPL-2.0+", [("GPL-2.0-or-later", "spdx-line")]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", [("MIT", "spdx-line"), ("Apache-2.0", "spdx-line")]), ("SPDX-License-Identifier: GPL-2.0-or-later", [("GPL-2.0-or-later", "spdx-line")]),
    ("Strandline is licensed under the BSD 3-Clause License.", [("BSD-3-Clause", "named-line")]), ("This project is licensed under the\nMIT License - see the LICENSE file for details.", [("MIT", "named-line")]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", [("LGPL-2.1-or-later", "lgpl-2.1-library-or-later")]),
    ("This project is not licensed under the MIT License.", []), ("This program is free software. You can leave.", []), ("SPDX-License-Identifier: Unheard-Of", []),
])
def test_licence_rules_match_real_notices(text, want):
    assert [(m[0], m[1]) for m in licences.matches(text)] == want


def test_every_licence_rule_can_match():
    spelt = {i: s.replace(" |", ";") for s, i in licences._KNOWN.items()} | {f"spdx:{i}": f"SPDX-License-Identifier: {i}" for i in licences.NAMES}
    for licence, rule, wanted in licences.RULES:
        assert (licence, rule) in [(m[0], m[1]) for m in licences.matches(".\n".join(spelt[i] for i in wanted))], rule


def test_licence_scan_finds_the_planted_lines(spark, awkward, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    want = {r.doc_id: sorted({v for k, v in lines.items() if k in r.text.split("\n")}) for r in docs.collect()}
    assert {r.doc_id: r.licences for r in licences.scan(docs).collect()} == want and any(want.values())
    assert licences.scan(awkward).count() == len(text_rows()) and licences.scan(no_docs).collect() == []


# ---- 8 quality ----


def brute_statistics(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (4, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(awkward, labels).collect()
    want = []
    for doc_id, text, *_ in text_rows():
        found = brute_statistics(text)
        failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
        want.append((doc_id, *found, failed, not failed))
    same_rows([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows], want)
    assert quality.judge(no_docs, labels).collect() == [] and quality.judge(awkward, labels.limit(0)).count() == len(want)


def test_binomial_tail(spark):
    from math import comb

    frame = spark.createDataFrame([(n, k) for n in (1, 10, 400) for k in (0, 1, 4) if k <= n], "n long, k long")
    for r in frame.withColumn("p", quality.binomial_tail("n", "k", 0.01)).collect():
        assert r.p == pytest.approx(sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1)), rel=1e-9)
    assert spark.sql("select 200000L n, 1500L k").select(quality.binomial_tail("n", "k", 0.01)).first()[0] < 1e-20


def test_cutoffs_keep_false_rejection_low(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(24_000):
        good = k % 4 != 0
        symbols = 0 if good and draw.random() > 0.004 else draw.randint(40, 90) if not good else 30
        rows.append((k, "en" if k % 10 else "rare", 100, 500, symbols, 0, 5, 0))
        labels.append((k, int(good), 0))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long")
    found = {r.lang: r.cutoffs for r in quality.cutoffs(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    cut = found["en"][0]
    assert cut is not None and cut < 0.9 and all(c is None for c in found["en"][1:])
    false = sum(r[4] / 100 > cut for r in rows if r[0] % 4 and r[1] == "en") / sum(1 for r in rows if r[0] % 4 and r[1] == "en")
    assert false <= quality.RISK / len(quality.RULES)
    # Every good text with symbols at the same level as bad ones: nothing can be certified.
    none = stats.selectExpr("doc_id", "lang", "n_words", "word_chars", "90L n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    assert quality.cutoffs(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


# ---- 9 line dedup ----


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows, min_docs, keep_first=False):
    holders, first = collections.defaultdict(set), {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add((doc_id, text))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not line_key(x) or len(holders[line_key(x)]) < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(spark, awkward, no_docs, min_docs):
    rows = line_dedup.drop_repeated_lines(awkward, min_docs).collect()
    same_rows(
        [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows], brute_lines(text_rows(), min_docs)
    )
    assert line_dedup.drop_repeated_lines(no_docs).collect() == []


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_line_dedup_across_partitions(spark, partitions):
    """One line in most documents fills several partitions; whatever the bounds, results are the same."""
    draw = random.Random(9)
    rows = [(k, "\n".join(draw.choice(["hot", "hot", "warm", f"own {k}", f"few {k % 60}"]) for _ in range(6))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = line_dedup.drop_repeated_lines(docs, 7).collect()
        firsts = line_dedup.drop_repeated_lines(docs, 7, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    same_rows([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got], brute_lines(rows, 7))
    # Keeping the first of each key leaves exactly one more line for each key that is dropped.
    dropped = {line_key(x) for (_, t), r in zip(sorted(rows), sorted(got, key=lambda r: r.doc_id), strict=True) for x in t.split("\n") if x not in (r.text or "").split("\n")}
    assert sum(r.n_dropped for r in got) - sum(r.n_dropped for r in firsts) == len(dropped)
    seen, kept = set(), {r.doc_id: (r.text or "").split("\n") for r in firsts}
    for doc_id, text in sorted(rows):
        for line in text.split("\n"):
            if line in dropped and line not in seen:
                seen.add(line)
                assert line in kept[doc_id]


def test_words_without_their_marks_are_encoded_once():
    import pyarrow as pa

    alphabet = ["Word", "word", "é", "É", "ǰ", "J̌", "é", "'s", "'", ".", ",", "!?", "...", ":;", "\n", "\n\n", " ", "  ", "1", "-", "ß", "Ж.", "́", "<|endoftext|>"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        words = WordEncoder(public_tokenizers.path(name))
        got = [ids[a:b].tolist() for ids, at in words.encode(pa.array(texts)) for a, b in zip(at, at[1:], strict=False)]
        assert got == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    list(words.encode(pa.array(["word, word. word! word:\nword\nword é. é; end"])))
    assert len(words.entry) == 8  # word é end , . ! : ;
    words.shrink()
    assert len(words.entry) == 8
