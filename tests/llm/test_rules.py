import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwise.llm import chat, common, decontaminate, licenses, topk

from .helpers import frame, prose


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, rng.randint(20, 60), 3000)) for k in range(12)] + [(90, None), (91, ""), (92, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = dict(items)
    near = text[3].split()
    near = " ".join(["changed"] + near[1:])
    broken = " ".join(w if i % 4 else f"q{i}" for i, w in enumerate(text[4].split()))
    rows = [(1, f"{prose(rng, 50, 3000)} {text[0].upper()} {prose(rng, 5000, 3000)}"), (2, f"{near}. The end"), (3, broken), (4, text[5]),
            (4, text[5]), (5, None), (6, ""), (7, prose(rng, 400, 3000)), (8, f"x, tiny; item y"), (9, " ".join(text[6].split()[:10])),
            (10, f"{text[7]} {text[8]}")]
    got = decontaminate.leaks(frame(spark, rows, "item w start"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 3), (4, 5), (8, 92), (10, 7), (10, 8)]
    assert {r.doc_id: r.start_word for r in got}[1] == 50
    kept = sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect())
    assert kept == [3, 5, 6, 7, 9]
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    """All item-sized windows, compared directly."""
    rng = random.Random(8)
    items = [(k, prose(rng, 30 + k, 60)) for k in range(6)]
    rows = []
    for i in range(40):
        w = items[i % 6][1].split()
        for _ in range(rng.randint(0, 2)):
            at = rng.choice([0, 1, len(w) - 1])
            w[at:at + rng.randint(0, 1)] = [f"z{rng.randrange(99)}"] * rng.randint(0, 2)
        rows.append((i, " ".join([prose(rng, rng.randint(0, 30), 60), *w, prose(rng, rng.randint(0, 30), 60)])))

    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    def weighted(a, b):
        keys = set(a) | set(b)
        return sum(min(a.count(k), b.count(k)) for k in keys) / sum(max(a.count(k), b.count(k)) for k in keys)

    expect = {}
    for i, t in rows:
        w = t.split()
        for k, it in items:
            b = it.split()
            best = max(weighted(grams(w[s:s + len(b)]), grams(b)) for s in range(max(1, len(w) - len(b) + 1)))
            if best >= 0.8:
                expect[i, k] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expect and expect


def test_decontamination_of_short_and_long_items(spark):
    """Items of 1 to 16 words and one of 3,000."""
    rng = random.Random(12)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(1, 17)] + [(50, prose(rng, 3000, 9000))]
    rows = []
    for i in range(90):
        w = items[i % 16][1].split() if i % 31 else items[16][1].split()
        if i % 3:
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
            w[at] = f"z{i}"
        rows.append((i, " ".join([prose(rng, rng.randint(0, 9), 60), *w, prose(rng, rng.randint(0, 9), 60)])))

    def grams(w, n):
        return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]

    expect = set()
    for i, t in rows:
        w = t.split()
        for k, it in items:
            b = it.split()
            n = min(5, len(b))
            own = set(grams(b, n))
            if not own & set(grams(w, n)):
                continue
            for s in range(max(1, len(w) - len(b) + 1)):  # shingles of an item do not repeat here
                there = set(grams(w[s:s + len(b)], n))
                if 10 * len(own & there) >= 8 * len(own | there):
                    expect.add((i, k))
    got = decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expect and {k for _, k in expect} >= {1, 4, 5, 9, 50}
    assert len(got) == len(expect)


def test_broadcast_bound_counts_what_rows_hold(spark, monkeypatch):
    rows = spark.createDataFrame([("a" * 100, [1] * 1000), (None, None), ("", [])], "t string, xs array<long>")
    assert rows.agg(F.sum(common.bytes_of("t", fixed=10, xs=8))).first()[0] == 30 + 100 + 8000
    for limit, hinted in ((9000, True), (8000, False)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        plan = common.small_side(rows, common.bytes_of("t", fixed=10, xs=8))._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in plan) is hinted
    assert "ResolvedHint" in common.small_side(rows.where("false"), common.bytes_of("t"))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("shard, block", [(2048, 128), (7, 3)])
def test_top_k_matches_brute_force(spark, shard, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist()) for i in range(150)]
    rows += [(150, rows[7][1]), (151, rows[7][1]), (152, None), (153, [float("nan")] * 16), (154, [None] + [0.1] * 15), (155, [float("inf")] * 16),
             (None, [0.1] * 16), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df).cache()
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5, shard, block).collect())
    own = {r.id: np.array(r.v) for r in v.collect()}
    assert len(own) == 152
    expect = []
    for q in (i for i in own if i % 50 == 0):
        best = sorted((-int(own[q] @ own[c]), c) for c in own if c != q)[:5]
        expect += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expect)
    few = v.where("id < 3")
    assert topk.top_k(few, few.where("id = 0")).count() == 2
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_of_huge_and_unequal_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 3) * 10.0 ** rng.integers(0, 12, 3)]) for i in range(60)]
    rows += [(100, [3e10, 1.0, 0.0]), (101, [3e10, 2.0, 0.0]), (102, [1e17, 1e17, 0.0]), (103, [-1e17, -1e17, 0.0]), (104, [1e17]), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantised(df).cache()
    own = {r.id: r.v for r in v.collect()}
    got = sorted(tuple(r) for r in topk.top_k(v, v, 5, 16, 16).collect())
    expect = []
    for q in own:
        score = {c: min(max(sum(a * b for a, b in zip(own[q], own[c])), topk.LONG[0]), topk.LONG[1]) for c in own if c != q}
        expect += [(q, n + 1, c, score[c]) for n, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:5])]
    assert got == sorted(expect)


def test_license_rules(spark):
    licenses.check_tables()
    s = licenses.SENTENCES
    apache = "\n".join([s["apache-the-license"].title() + ".", s["apache-comply"] + ".", s["apache-obtain"], s["apache-url"]])
    rows = [(1, f"Prose here. Licensed under the Apache License, Version 2.0.\nmore"), (2, apache), (3, f"{apache} {s['as-is']}."),
            (4, "Released### under&&& the*** MIT%%% License.\nReleased under the MIT License. Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "we license things")]
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(frame(spark, rows, "ids hit0 seq0")).collect()}
    assert got[1] == (1, "apache-line", "Apache-2.0", 1, 0)
    assert got[2] == (4, "apache-the-license apache-comply apache-obtain apache-url", "Apache-2.0", 1, 0)
    assert got[3][2:] == ("Apache-2.0", 1, 1)
    assert got[4] == (3, "mit-line mit-line cc-by-nc", "MIT,CC-BY-NC-4.0", 3, 0)
    assert got[5] == got[6] == got[7] == (0, "", "", 0, 0)
    assert licenses.scan(frame(spark, [])).count() == 0


MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Copyright (c) 2001, The Regents. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_wrapped_license_notices(spark):
    expect = {
        MIT: (3, "mit-title mit-notice as-is", "MIT", 1, 0),
        BSD: (1, "bsd-redistribution", "BSD", 1, 0),
        GPL: (3, "gpl-redistribute gpl-no-warranty gpl-details", "GPL-3.0-or-later", 1, 0),
        MPL: (1, "mpl-line", "MPL-2.0", 1, 0),
        "Released under\nthe MIT License": (1, "mit-line", "MIT", 1, 0),
        "Licensed under the Apache License, Version 2.0\n(the License);": (1, "apache-the-license", "Apache-2.0", 1, 0),
        "Licensed under the Apache License, Version 2.0.\nThe License\nwas": (1, "apache-line", "Apache-2.0", 1, 0),
        "Released under\n\nthe BSD License": (0, "", "", 0, 0),  # a blank line ends a sentence
        "Released under the\nBSD License and others": (0, "", "", 0, 0),
        "We released under the\nBSD License": (0, "", "", 0, 0),
        "Released under the MIT License\nReleased under the\nBSD License. Released under\nthe ISC License.": (3, "mit-line bsd-line isc-line", "MIT,BSD,ISC", 3, 0),
    }
    texts = {}
    for text, want in expect.items():
        lines = text.split("\n")
        marked = ["\n".join(mark + line for line in lines) for mark in ("# ", " * ", "// ", ";; ", ".. ", "\t")]
        for t in [text, text.replace("\n", "\r\n"), "/*\n" + marked[1] + "\n */\nint main() {}", *marked]:
            texts[len(texts)] = (t, want)
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(frame(spark, [(i, t) for i, (t, _) in texts.items()])).collect()}
    for i, (t, want) in texts.items():
        assert got[i] == want, t


def brute_cost(roles):
    """Least cost over all choices of role, merge and insertions."""
    best = chat.INF
    for way in product([(t, m) for t in (1, 2, 3) for m in (False, True)], repeat=len(roles)):
        state, cost = chat.START, 0
        for r, (t, merge) in zip(roles, way):
            cost += 0 if t == r else chat.RELABEL if r else chat.GUESS
            if merge:
                cost += chat.MERGE if t == state else chat.INF
            elif (state, t) in chat.BETWEEN:
                cost += chat.INSERT * len(chat.BETWEEN[state, t])
            else:
                cost += chat.INF
            state = t
        best = min(best, cost + chat.INSERT * len(chat.CLOSING[state]))
    return best


def test_chat_repair_is_cheapest():
    rng = random.Random(4)
    for roles in [list(r) for n in (1, 2, 3) for r in product(range(4), repeat=n)] + [[rng.randrange(4) for _ in range(5)] for _ in range(15)]:
        m = chat.transfer(roles)[0]
        leave = int((m + [chat.INSERT * len(chat.CLOSING[a]) for a in range(4)]).argmin())
        *_, cost = chat.render_block(roles, ["x"] * len(roles), 0, leave, True)
        assert cost == brute_cost(roles), roles


def test_chat_rendering_and_blocks(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "gpt ", None),
            (3, 0, None, None), (4, 5, "assistant", "only"), (None, 0, "user", "n"), (5, None, "assistant", "late"), (5, 0, "Human", "first"),
            (6, 0, "user", "x"), (6, 0, "user", "x"), (6, 1, "assistant", "y")]
    rows += [(7, t, rng.choice(["user", "assistant", "system", "odd"]), f"t{t}") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS conv")

    def whole(block):
        out = {}
        for r in sorted(chat.format_chats(df, block=block).collect(), key=lambda r: (r.conv_id or -1, r.block)):
            a = out.setdefault(r.conv_id, ["", 0, 0])
            a[0] += r.rendered
            a[1] += r.cost
            a[2] += r.n_turns
        return out

    got = whole(1024)
    assert got[1][:2] == ["<|system|>\nS<|end|>\n<|user|>\nU<|end|>\n<|assistant|>\nA<|end|>\n", 0]
    assert got[2][:2] == ["<|user|>\na\n\nb<|end|>\n<|assistant|>\n<|end|>\n", chat.MERGE]
    assert got[4][0] == "<|user|>\n<|end|>\n<|assistant|>\nonly<|end|>\n"
    assert got[5][0] == "<|user|>\nfirst<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert got[6][0] == "<|user|>\nx\n\nx<|end|>\n<|assistant|>\ny<|end|>\n"
    small = whole(3)
    assert {k: v[1:] for k, v in small.items()} == {k: v[1:] for k, v in got.items()}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_blocks_hold_rows_not_turn_numbers(spark):
    """Null and repeated turn numbers, null conversations and equal rows fill blocks like
    other rows, over partitions that cut a conversation."""
    rng = random.Random(8)
    rows = [(9, None, rng.choice(["user", "assistant", None]), f"n{i % 50}") for i in range(700)]
    rows += [(None, rng.choice([0, 1, None]), "user", "same" * 30) for _ in range(400)] + [(None, 3, "odd", "") for _ in range(200)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(20, 80) for t in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(df, block=64).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    codes = {None: 0, "odd": 0, "user": chat.USER, "assistant": chat.ASSISTANT}
    far = 1 << 62
    for conv in {r[0] for r in rows}:
        turns = sorted(((far if t is None else t, role or "", codes[role], text) for c, t, role, text in rows if c == conv))
        blocks = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.block)
        assert [r.block for r in blocks] == list(range(-(-len(turns) // 64)))
        assert [r.n_turns for r in blocks] == [min(64, len(turns) - 64 * i) for i in range(len(blocks))]
        assert [r.is_last for r in blocks] == [False] * (len(blocks) - 1) + [True]
        way = [t[2] for t in turns]
        m = chat.transfer(way)[0]
        leave = int((m + [chat.INSERT * len(chat.CLOSING[a]) for a in range(4)]).argmin())
        text, *_, cost = chat.render_block(way, [t[3] for t in turns], 0, leave, True)
        assert sum(r.cost for r in blocks) == cost
        if len(blocks) == 1:  # several blocks may take another way of the same cost
            assert blocks[0].rendered == text


def test_chat_of_empty_and_very_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", ""), (1, 1, "assistant", "x" * 3_000_000), (1, 2, "user", None)],
                               "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chats(df).collect()
    assert row.n_turns == 3 and row.rendered.count("x") == 3_000_000 and row.rendered.startswith("<|user|>\n<|end|>")


def test_vectors_are_dealt_once_to_thousands_of_queries(spark):
    """Shuffled rows follow the vectors, not vectors times hundreds of queries."""
    v = topk.quantised(spark.createDataFrame([(i, [float(i)]) for i in range(1900)], "vec_id long, embedding array<double>")).cache()
    left, right = topk.dealt(v, v)
    assert left.count() == right.count() == 1900


def test_impact_index_stops_early_and_is_exact():
    rng = np.random.default_rng(6)
    x = rng.integers(-200, 200, (3000, 40))
    x[:, 16:] //= 100  # most dimensions can add little
    index, q, skip = topk.ImpactIndex(x), x[17], np.arange(3000) == 17
    row, score = index.search(q, 5, skip)
    exact = np.where(skip, topk.LONG[0], x @ q)
    assert 5 <= len(row) < 3000 // 8 and (score == exact[row]).all()
    assert sorted(score)[-5:] == sorted(exact)[-5:]
