"""Nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables, for every operator and stage."""

import hashlib
import math
import os
import random
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from brute import jaccard_classes, repeated_words
from pyspark.sql import functions as F

import corpus_pipeline
from skylag.llm import (boosting, chat_format, components, decontaminate, exact_dedup, jaccard, language_id, licenses, pii,
                        sentencepiece_bpe, substring_dedup, tables, warc, words)

SF_DIR = "/root/testdata/sf0.001"


# Words and components ------------------------------------------------------------------

def test_batches_are_bounded_by_bytes(spark):
    """Few rows of long texts, and groups, do not go to Python as one batch."""
    docs = spark.range(40).coalesce(1).selectExpr("id AS doc_id", "id % 1 AS g", "repeat('abcdefgh', 65536) AS text")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) >= 4 and max(r["n"] for r in sizes) <= 6 << 20
    chunks = docs.groupBy("g").applyInArrow(lambda t: pa.table({"n": [t.column("text").num_chunks]}), "n long").collect()
    assert chunks[0]["n"] >= 4


def test_words_do_not_depend_on_slices(monkeypatch):
    text = ("alpha Beta\tgamma x\n" * 500 + "y" * 3000 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    whole = words.text_words(data)
    monkeypatch.setattr(words, "SLICE", 700)
    assert (words.text_words(data) == whole).all() and len(whole) == len(text.split())
    assert (words.text_words(data, lower=True) == words.text_words(np.frombuffer(text.lower(), np.uint8))).all()


def test_batches_give_the_same_words_as_single_texts():
    texts = pa.array(["a b c", None, "", " c  d", "x" * 10])
    got = [h for _, places, hashes in words.batch_words(texts) for a, b in zip(places, places[1:]) for h in [hashes[a:b].tolist()]]
    assert got == [words.text_words(np.frombuffer((t or "").encode(), np.uint8)).tolist() for t in texts.to_pylist()]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(200, 199), (3, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 3 for k in [3, *range(5, 60)]}, 199: 199, 200: 199}


# 1 SentencePiece -----------------------------------------------------------------------

def test_chunked_encoding_equals_the_library():
    import sentencepiece

    v, model = sentencepiece_bpe.load(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.PATH)
    draw = random.Random(3)
    alphabet = ["a", "th", "e", "in", "tion", "漢", "0", "-", "=", " ", "  ", "\n", "\U0001F600", "é", "xx"]
    for turn in range(300):
        text = "".join(draw.choice(alphabet[:9] if turn % 2 else alphabet) for _ in range(draw.randint(1, 90)))
        parts = list(sentencepiece_bpe.split_text(text, v.longest, draw.choice([5, 17, 40])))
        steps = [(0, k, *sentencepiece_bpe._as_array(sentencepiece_bpe.transfer(v, *p))) for k, p in enumerate(parts)]
        ids = b"".join(sentencepiece_bpe.chunk_ids(v, *p, s[2], s[3]) for p, s in zip(parts, sentencepiece_bpe._settle(steps)))
        assert np.frombuffer(ids, np.int32).tolist() == model.encode(text)


def test_products_are_associative():
    draw = np.random.default_rng(1)
    a, b, c = (np.where(draw.random((4, 4)) < 0.5, 0, -np.inf) for _ in range(3))
    assert np.array_equal(sentencepiece_bpe.combine(sentencepiece_bpe.combine(a, b), c),
                          sentencepiece_bpe.combine(a, sentencepiece_bpe.combine(b, c)))


def test_encoding_odd_rows_and_giant_texts(odd, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.PATH)
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd, chunk=5000, block=4))
    rows = got.collect()
    assert len(rows) == odd.count() and set(got.columns) == {*odd.columns, "decoded"}
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else model.encode(r["text"])) and r["decoded"] == r["text"]
    assert sentencepiece_bpe.encode(nothing).count() == 0


# 2 Licences ----------------------------------------------------------------------------

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'''


def test_licences(spark, odd, nothing):
    rows = [(1, MIT), (2, "text.\nReleased under the MIT License.\nmore"), (3, None), (4, ""), (5, "no licence here."),
            (6, "All rights reserved. x. y. z. Licensed under CC BY-NC 4.0."), (2, "text.\nReleased under the MIT License.\nmore")]
    got = sorted((r["doc_id"], r["rules"], r["sequence"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, ["mit_text"], "hij"), (2, ["mit_short"], "g"), (2, ["mit_short"], "g"), (6, ["all_rights", "cc_by_nc_short"], "r/o")]
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0


def _gnu_notice(name, grant, what="program"):
    return f"""This {what} is free software{grant}

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{name} for more details."""


def test_licences_are_told_apart_by_the_piece_with_name_and_version(spark):
    gpl, lgpl, agpl = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
    may = "you can redistribute it and/or modify\nit under the terms of the"
    gpl_2 = _gnu_notice(gpl, f"; {may} {gpl} as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.")
    gpl_3 = _gnu_notice(gpl, f": {may} {gpl} as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    agpl_3 = _gnu_notice(agpl, f": {may} {agpl} as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    lgpl_21 = _gnu_notice(lgpl, f"; {may} GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\n"
                                "version 2.1 of the License, or (at your option) any later version.", "library")
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
           "file, You can obtain one at http://mozilla.org/MPL/2.0/.")
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
              "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
              "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
              "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\n"
              "limitations under the License.")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
           "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
           "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
           "   and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\n"
           "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.")
    third = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
             "   this software without specific prior written permission.\n\n")
    expected = [(gpl_2, "gpl_2_notice", "GPL-2.0-or-later"), (gpl_3, "gpl_notice", "GPL-3.0-or-later"), (agpl_3, "agpl_notice", "AGPL-3.0-or-later"),
                (lgpl_21, "lgpl_2_1_notice", "LGPL-2.1-or-later"), (mpl, "mpl_notice", "MPL-2.0"), (apache, "apache_header", "Apache-2.0"),
                (bsd.format(""), "bsd_2", "BSD-2-Clause"), (bsd.format(third), "bsd_3", "BSD-3-Clause"), (MIT, "mit_text", "MIT"),
                ("Licensed under the MIT License.", "mit_short", "MIT"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "spdx", "AGPL-3.0-or-later"),
                ("SPDX-License-Identifier: GPL-2.0-only", "spdx", "GPL-2.0-only"), ("Licensed under the ISC License.", "isc_short", "ISC")]
    texts = [form for text, _, _ in expected for form in (
        text, text.replace("\n", "\r\n"), "\n".join(f" * {line}".rstrip() for line in text.split("\n")), "\n".join(f"# {line}" for line in text.split("\n")),
        "/*\n" + "\n".join(f"// {line}" for line in text.split("\n")) + "\n*/")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["rules"], r["licences"]) for r in licenses.scan(frame).collect()}
    assert got == {k: ([expected[k // 5][1]], [expected[k // 5][2]]) for k in range(len(texts))}
    vague = "This program is free software: you can do what you like."
    assert licenses.scan(spark.createDataFrame([(1, vague)], "doc_id bigint, text string")).count() == 0


def test_licence_scan_has_no_python_and_no_shuffle(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# 3 Decontamination ---------------------------------------------------------------------

def test_decontamination(spark, odd, nothing):
    item = " ".join(f"q{k}" for k in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, "one two three"), (5, " ".join(f"z{k}" for k in range(600))), (1, item)],
                                  "item_id bigint, text string")
    filler = " ".join(f"f{k}" for k in range(3000))
    docs = [(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, " ".join(f"q{k}" for k in range(10)) + " " + filler),
            (4, "see One, two; three!"), (5, "three two one"), (6, None), (7, " ".join(f"z{k}" for k in range(300, 600)) + filler), (None, item)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, score string")
    for shard_words in (10 ** 6, 30):
        shards = decontaminate.indexes(items, shard_words)
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame, shards).collect()}
        assert got == {(1, 1), (4, 4), (7, 5), (None, 1)}
        left = decontaminate.remove(frame, shards)
        assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 6] and left.columns == frame.columns
    assert decontaminate.find(odd, shards).count() == 0
    assert decontaminate.find(nothing, shards).count() == 0
    assert decontaminate.find(frame, decontaminate.indexes(items.filter("item_id > 99"))).count() == 0


def test_findings_depend_neither_on_other_items_nor_on_shards(spark):
    def found(items, docs, shard_words=10 ** 6):
        frame = spark.createDataFrame(items, "item_id bigint, text string")
        texts = spark.createDataFrame(docs, "doc_id bigint, text string")
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["answer_overlap"])
                      for r in decontaminate.find(texts, decontaminate.indexes(frame, shard_words)).collect())

    short = [(1, "a b c d e f g h")]
    long = [(2, " ".join(f"z{k}" for k in range(256)))]
    gap = " ".join(f"f{k}" for k in range(100))
    # Half of the triples of each half, far apart: no passage of the item's own length holds them.
    scattered = [(1, f"a b c d {gap} e f g h {gap}")]
    assert found(short, scattered) == [] and found(short + long, scattered) == []
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((8, 20, 300, 700, 6, 3))]
    docs = [(k, f"{gap} {items[k % 6][1]} {gap} {items[(k + 1) % 6][1]}") for k in range(6)]
    docs += [docs[2], docs[2], (2, f"{items[2][1]} other")]
    whole = found(items, docs)
    assert len(whole) == 17 and found(items, docs, 100) == whole


def test_bounds_never_lose_an_item():
    draw = random.Random(5)
    vocabulary = [f"v{k}" for k in range(80)]
    units = [(k, [draw.choice(vocabulary) for _ in range(draw.randint(8, 30))]) for k in range(40)]
    code = lambda w: words.text_words(np.frombuffer(" ".join(w).encode(), np.uint8), lower=True, loose=True)
    coded = [(k, code(w)) for k, w in units]
    df: dict = {}
    for _, w in coded:
        for t in set(w.view(np.int64).tolist()):
            df[t] = df.get(t, 0) + 1
    index = decontaminate.build_index(coded, df, len(units), sum(len(w) for _, w in units) / len(units))
    for k, w in units:
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 200))]
        at = draw.randint(0, len(text))
        doc = code(text[:at] + w + text[at:])
        spans = np.append(np.arange(-(-len(doc) // index.span)) * index.span, len(doc))
        assert k in {index.items[u] for _, u, *_ in index.find(doc, spans)}


def _plain_findings(docs, items):
    """Findings by BM25 of every passage against every item, one after the other."""
    units = [(i, text.split()) for i, text in items]
    n, mean = len(units), sum(len(w) for _, w in units) / len(units)
    df = Counter(t for _, w in units for t in set(w))
    found = {}
    for doc, text in docs:
        own = text.split()
        for item, w in units:
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean))
                      for t, c in Counter(w).items()}
            span = 1
            while span < len(w):
                span *= 2
            size, half = (3, len(w) // 2) if len(w) >= 6 else (len(w), 0)
            triples = lambda v: {tuple(v[k:k + size]) for k in range(len(v) - size + 1)}  # noqa: B023,E731
            question, answer = (triples(w[:half]), triples(w[half:])) if half else (triples(w), triples(w))
            for start in range(0, max(1, len(own) - span), span):
                passage = own[start:start + 2 * span]
                score = sum(v for t, v in impact.items() if t in set(passage)) / sum(impact.values())
                there = triples(passage)
                q, a = len(question & there) / len(question), len(answer & there) / len(answer)
                if score >= 0.5 and min(q, a) >= (0.5 if half else 1):
                    found[doc, item] = max(found.get((doc, item), (0.0,)), (round(min(1.0, score), 9), q, a))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_findings_equal_those_of_plain_bm25(spark, seed):
    draw = random.Random(seed)
    words_of = lambda n: [f"v{int(120 * draw.random() ** 3)}" for _ in range(n)]
    items = [(k, " ".join(words_of(draw.choice((1, 3, 5, 6, 7, 8, 9, 15, 16, 17, 33, 70))))) for k in range(60)]
    docs = []
    for doc in range(80):
        text = words_of(draw.randint(0, 90))
        for _ in range(draw.randint(0, 2)):  # items of which some words are changed, moved or left out
            noisy = [w if draw.random() > 0.12 else f"v{draw.randint(0, 119)}" for w in draw.choice(items)[1].split()]
            at = draw.randint(0, len(text))
            text[at:at] = noisy[draw.randint(0, 2):]
        docs.append((doc, " ".join(text)))
    want = _plain_findings(docs, items)
    frame, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for shard_words in (10 ** 6, 300):
        rows = decontaminate.find(frame, decontaminate.indexes(tests, shard_words)).collect()
        got = {(r["doc_id"], r["item_id"]): (round(min(1.0, r["score"]), 9), r["question_overlap"], r["answer_overlap"]) for r in rows}
        assert got == want and len(rows) == len(want) > 20


# 4 Jaccard -----------------------------------------------------------------------------

def _variants(seed, groups=6, size=25):
    draw, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(40)]
    for g in range(groups):
        base = [f"g{g}w{draw.randint(0, 400)}" for _ in range(draw.randint(20, 140))]
        for _ in range(size):
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = f"e{draw.randint(0, 99)}"
            if draw.random() < 0.5:
                w += passage
            rows.append((len(rows), " ".join(w)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("small_group, heavy_count", [(4, 16), (1, 10 ** 9), (2, 3)])
def test_jaccard_on_large_groups(spark, monkeypatch, small_group, heavy_count):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small_group)
    monkeypatch.setattr(jaccard, "HEAVY_COUNT", heavy_count)
    rows = _variants(small_group)
    found, sizes = jaccard_classes(rows)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in
           jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: (found[d], sizes[d]) for d, _ in rows}


def test_jaccard_of_edited_copies_near_the_threshold(spark, monkeypatch):
    """Copies with different edits of a text that is not there: most pairs lie just below the threshold, some above."""
    monkeypatch.setattr(jaccard, "TILE", 4000)
    monkeypatch.setattr(jaccard, "ROW_WEIGHT", 30)
    monkeypatch.setattr(jaccard, "PAIRS", 500)
    monkeypatch.setattr(jaccard, "MEETINGS", 700)
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", 5000)
    draw, rows = random.Random(5), []
    base = [f"w{draw.randint(0, 3000)}" for _ in range(140)]
    for k in range(400):
        w = list(base)
        for _ in range(draw.randint(2, 4)):
            w[draw.randrange(len(w))] = f"e{draw.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    found, sizes = jaccard_classes(rows)
    assert 1 < len(set(found.values())) < 400
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in
           jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: (found[d], sizes[d]) for d, _ in rows}


def test_jaccard_fetches_no_sets_for_a_shared_passage(spark):
    """Of a group that has a passage in common only the members go on that may be linked."""
    draw = random.Random(11)
    words = lambda k: [f"w{draw.randint(0, 10 ** 9)}" for _ in range(k)]
    passage = words(120)
    rows = [(k, " ".join(words(100) + passage)) for k in range(40)]
    rows.append((40, f"{rows[7][1]} and three more"))
    members = tables.written(spark.createDataFrame([(0, x, x) for x, _ in rows], "g bigint, x bigint, component bigint"), "members")
    left = jaccard._possible(spark.createDataFrame(rows, "doc_id bigint, text string"), members)
    assert sorted(tuple(r) for r in left.collect()) == [(0, 7, 7), (0, 40, 40)]


def test_jaccard_sketches_keep_every_link():
    """Texts of 1 to 900 words that begin alike or begin later: what is linked passes, in one block and between two, however long."""
    draw = random.Random(12)
    words = [f"w{draw.randint(0, 10 ** 9)}" for _ in range(1200)]
    sizes = [1, 3, 5, 6, 7, 20, 63, 67, 68, 69, 84, 88, 120, 132, 133, 170, 260, 261, 340, 516, 517, 680, 900]
    texts = [" ".join(words[a:a + k]) for k in sizes for a in {0, 1, k // 8, k // 7, k // 5}]
    sets = [s for _, some in jaccard._sets([pa.record_batch({"doc_id": range(len(texts)), "text": texts})]) for s in some]
    made = pa.Table.from_batches(jaccard._sketches([pa.record_batch({"doc_id": range(len(texts)), "text": texts})]))
    assert all(len(d) == 1 or n <= 64 * len(d) < 2 * n for n, d in zip(*(made.column(c).to_pylist() for c in ("n", "tokens"))))
    linked = passed = 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            link = 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared)
            if not link and (i + j) % 5:
                continue
            for right in ([False, True], [True, False], [False, False]):
                two = made.take([i, j])
                tile = pa.table({"g": [7, 7], "x": two["doc"], "component": two["doc"], "n": two["n"], "d": two["tokens"], "right": np.array(right)})
                left = jaccard._tile_members(tile).column("x").to_pylist()
                assert left in ([], [j, i]) and (left or not link)
                linked, passed = linked + link, passed + bool(left)
    assert 0 < linked <= passed


def test_jaccard_groups_join_every_link():
    """Longer sketches of all texts in one tile, or dealt to both sides of it: linked texts come into one group, not all into the same."""
    draw = random.Random(14)
    words = [f"w{draw.randint(0, 10 ** 9)}" for _ in range(1500)]
    texts = [" ".join(words[a:a + k]) for k in (1, 4, 6, 12, 30, 70, 140, 300, 700)
             for b in range(0, 600, k) for a in (b, b + k // 8)]
    draw.shuffle(texts)
    batch = pa.record_batch({"doc_id": range(len(texts)), "text": texts})
    sets = [s for _, some in jaccard._sets([batch]) for s in some]
    made = pa.Table.from_batches(jaccard._longer([batch]))
    assert all(len(d) == jaccard.LONGER or n <= 64 * len(d) // jaccard.LONGER < 2 * n
               for n, d in zip(*(made.column(c).to_pylist() for c in ("n", "tokens"))))
    links = [(i, j) for i in range(len(texts)) for j in range(i)
             if (k := len(np.intersect1d(sets[i], sets[j]))) and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    for right in (np.zeros(len(texts), bool), np.arange(len(texts)) % 2 == 1):
        tile = pa.table({"g": np.zeros(len(texts), np.int64), "x": made["doc"], "component": made["doc"], "n": made["n"],
                         "d": made["tokens"], "right": right})
        stars = jaccard._tile_stars(tile).to_pydict()
        group = dict(zip(stars["a"], stars["b"]))
        assert len(group) == len(stars["a"]) and not set(group) & set(group.values()) and len(set(group.values())) > 20
        crossing = [(i, j) for i, j in links if not right.any() or right[i] != right[j]]
        assert len(crossing) > 20 and all(group.get(i, i) == group.get(j, j) for i, j in crossing)


def test_jaccard_compares_whole_sets_in_one_group(spark):
    """Texts that meet many others on many tokens come once into the work on whole sets, with those they may be linked to."""
    draw = random.Random(13)
    words = lambda k: " ".join(f"w{draw.randint(0, 10 ** 9)}" for _ in range(k))
    rows = []
    for k in range(0, 24, 2):
        text = words(60)
        rows += [(k, f"{text} {words(2)}"), (k + 1, f"{words(3)} {text}")]
    rows.append((24, words(60)))
    met = spark.createDataFrame([(t, x, x) for t in range(10) for x in range(t, 25)], "token bigint, x bigint, component bigint")
    found, best = jaccard._differences(spark.createDataFrame(rows, "doc_id bigint, text string"), met)
    assert sorted(tuple(r) for r in found.select("g", "x").collect()) == [(x - x % 2, x) for x in range(24)]
    assert {r["size"] for r in best.collect()} == {2}
    assert sorted(sorted(r) for r in jaccard._star(found.join(best, "g")).collect()) == [[k, k + 1] for k in range(0, 24, 2)]


def test_forgotten_tables_are_deleted(spark):
    kept, gone = tables.written(spark.range(3), "kept"), tables.written(spark.range(3), "gone")
    folder = os.path.dirname(urlparse(gone.inputFiles()[0]).path)
    assert os.path.isdir(folder)
    tables.forget(gone.filter("id > 0"))
    assert not os.path.exists(folder) and kept.count() == 3


def test_jaccard_odd_rows(odd, nothing):
    got = jaccard.classes(odd)
    rows = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert got.count() == odd.count()
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (10, 10), (None, None)} == rows
    kept = jaccard.keep_first(odd)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10] and kept.columns == odd.columns
    assert jaccard.classes(nothing).count() == 0 and jaccard.keep_first(nothing).count() == 0


# 5 Substrings --------------------------------------------------------------------------

def test_substrings_on_repetitive_texts(spark):
    draw = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(k, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 120)))) for k in range(30)]
    rows += [(30 + k, f"s{k} " * draw.randint(0, 9) + passage + "\n" + passage[:draw.randint(1, 300)]) for k in range(30)]
    rows += [(100, "same " * 500), (101, None), (102, ""), (103, "x" * 100_000)]
    draw.shuffle(rows)
    got = substring_dedup.summary(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == repeated_words(rows)


def test_windows_of_a_hot_anchor_are_dealt_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 20)
    draw = random.Random(4)
    # Of many phrases the one with the smallest hash, so that it is the anchor of all windows that hold it.
    phrase = min((" ".join(f"p{n}q{k}" for k in range(8)) for n in range(5000)),
                 key=lambda p: words.grams(words.text_words(np.frombuffer(p.encode(), np.uint8)), 8)[0])
    around = [" ".join(f"c{draw.randint(0, 10 ** 6)}" for _ in range(30)) for _ in range(60)]
    rows = [(k, f"{around[draw.randrange(60)]} {phrase} {around[draw.randrange(60)]}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, substring_dedup.summary(frame).collect())) == repeated_words(rows)
    # Dealt by their anchor the runs are in one shard, by their windows in many.
    runs = [{"at": 3 * substring_dedup.RUN + 12, "anchor": 5, "hot": hot} for hot in (True, False)]
    texts = [" ".join(f"d{k}w{j}" for j in range(40)) for k in range(300)]
    for run, least in zip(runs, (40, 1)):
        kind = pa.list_(pa.struct([("at", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_())]))
        batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array([[run]] * 300, kind)], names=["doc_id", "text", "runs"])
        sent = [r for out in substring_dedup._segments(64)(iter([batch])) for r in out.to_pylist()]
        sizes = [len(r["docs"]) // 8 for r in sent]
        assert len({r["shard"] for r in sent}) >= least and sum(sizes) == (300 * 13 if run["hot"] else 300)
        assert max(sizes) <= (150 if run["hot"] else 300)


def test_a_shard_may_have_more_words_than_characters(monkeypatch):
    draw = random.Random(6)
    runs = [(" ".join(draw.choice("abcdefgh") if k % 2 else f"x{k % 5}w{j}" for j in range(30)).encode(), k, 3) for k in range(200)]
    expected = {(d, s + j) for d, s, n in substring_dedup.repeated_windows(runs) for j in range(n)}
    monkeypatch.setattr(substring_dedup, "LETTERS", 60)
    assert expected and {(d, s + j) for d, s, n in substring_dedup.repeated_windows(runs) for j in range(n)} == expected


def test_substrings_odd_rows(odd, nothing):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.summary(odd).collect()}
    # A repeated row is the same document, so it does not repeat itself; a row without doc_id keeps its words.
    assert {(1, 60, 0), (2, 60, 60), (3, 61, 60), (4, 0, 0), (5, 0, 0), (6, 0, 0), (None, 60, 0)} <= got
    cut = substring_dedup.deduplicate(odd)
    assert cut.columns == odd.columns and {r["text"] for r in cut.filter("doc_id = 3").collect()} == {"more"}
    assert substring_dedup.summary(nothing).count() == 0


# 6 Personal data -----------------------------------------------------------------------

def test_pii_odd_rows(spark, documents, odd, nothing):
    detector = pii.fit(documents)
    assert pii.find(odd, detector).filter("spans <> ''").count() == 0
    assert pii.find(nothing, detector).count() == 0 and pii.fit(nothing).trees is None
    assert pii.redact(odd, detector).columns == odd.columns
    text = "mail a.b@c.example.com now"
    row = pii.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), detector).first()
    assert row["text"] == "mail [EMAIL] now"


@pytest.mark.parametrize("text", ["write to jane [at] example [dot] org", "jane(at)example(dot)org", "Jane AT example DOT com", "jane\nat example dot org"])
def test_spelt_out_addresses_reach_the_trees_without_a_digit(text, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "features", lambda text, span: seen.append(span) or [0.0])

    class Sure:
        def probabilities(self, x):
            return np.ones(len(x))

    expected = sorted(c for c in pii.candidates(text) if c[0] == "email")
    base, spans = pii.Detector(Sure(), {"email": 0.5}).spans(text)
    assert base == [] and seen == expected and len(spans) == min(1, len(expected))
    assert bool(expected) == ("\n" not in text)


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "+1" + "(" * 50_000, "1.1." * 20_000, "@" * 20_000, "1 " * 30_000,
                                  "1.2.3.4.5.6.7.8 999.1.1.1", "a@b.c@d.e", "+1 (234) 555-0000 1.2.3.4", "4111-1111-1111-1111 4"])
def test_base_spans_equal_the_patterns(text):
    from brute import base_spans

    if len(text) < 100 or text[0] in "1+":
        expected = base_spans(text) if len(text) < 100 else None
        assert expected is None or pii.base_spans(text) == expected
    pii.base_spans(text)


def test_words_joined_in_blocks_equal_the_queue_of_joins(monkeypatch):
    """Words of all lengths with unknown characters, in blocks of few words, against ``split``; chunks' words are learned together."""
    v = sentencepiece_bpe.load()
    draw = np.random.default_rng(7)
    signs = list("aaeeinrst\u2581\n.,0129-zq\u00e9\u6f22\u0416\U0001F600\u0378")
    words = sorted({"".join(draw.choice(signs, n)) for n in range(1, 40) for _ in range(25)})
    monkeypatch.setattr(sentencepiece_bpe, "TOGETHER", 7)
    assert v.encode_words(words) == [v.ids_of(v.split(w)) for w in words] and v.encode_words([]) == []
    calls = []
    monkeypatch.setattr(v, "encode_words", lambda w, own=v.encode_words: calls.append(len(w)) or own(w))
    parts = [p for k in range(5) for p in sentencepiece_bpe.split_text(f"some words of text {k} " * 200, v.longest, 512)]
    sentencepiece_bpe.learn_chunks(v, parts)
    for before, core, after in parts[1:4]:
        weights = sentencepiece_bpe.transfer(v, before, core, after)
        entry, leave = map(int, np.argwhere(weights == 0)[0])
        assert sentencepiece_bpe.chunk_ids(v, before, core, after, entry, leave)
    assert sum(n > 0 for n in calls) == 1


def test_detector_is_trained_on_every_candidate(spark):
    """Trees, calibration and thresholds equal those of all candidates on one machine, also beyond 20,000 of them."""
    draw = np.random.default_rng(5)
    texts = []
    for k in range(1500):
        a, b, c, d = (int(v) for v in draw.integers(1000, 9999, 4))
        texts.append(f"call +1 (212) 555-{a} or 4111 1111 {b} {c} {d}, order +49 30 {a}{b} then mail u{k % 7}.x@host{k % 5}.example.com " * 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    every = docs.mapInArrow(pii._labelled, "label int, held boolean, x array<double>").collect()
    assert len(every) > 20_000
    x, y, held = np.array([r["x"] for r in every]), np.array([r["label"] for r in every]), np.array([r["held"] for r in every])
    trees = boosting.fit(x, y, held)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of scores
    try:
        detector = pii.fit(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("features", "splits", "values", "at", "share"):
        assert np.allclose(getattr(detector.trees, name), getattr(trees, name), rtol=1e-9, atol=1e-9)
    p, expected = trees.probabilities(x), {}
    for k, kind in enumerate(pii.KINDS):
        mine = held & (x[:, 0] == k)
        if len(set(y[mine])) == 2:
            good = [t for t in sorted(set(p[mine & (p >= 0.5)])) if y[mine & (p >= t)].mean() >= pii.PRECISION]
            expected.update({kind: good[0]} if good else {})
    assert expected and detector.thresholds == pytest.approx(expected, rel=1e-9)


def test_thresholds_and_calibration_over_many_ranges_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    score = np.round(draw.normal(0, 2, 4000), 2)
    kind, label = draw.integers(0, 3, 4000), (score + draw.normal(0, 0.7, 4000) > 0).astype(int)
    label[kind == 1] = 1  # no negatives, so no threshold
    blocks = boosting.pooled((float(s), int(label[score == s].sum()), int((score == s).sum())) for s in np.unique(score))
    trees = boosting.Trees(0.0, 1, *[np.zeros(1)] * 5)
    boosting.calibrate(trees, blocks)
    scores = spark.createDataFrame([(int(a), float(b), int(c), 1) for a, b, c in zip(kind, score, label)], "kind int, score double, positive bigint, n bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert boosting.blocks_of(scores) == blocks and len(blocks) > 3
        got = pii._thresholds(scores, trees, 0.9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    p = np.interp(score, trees.at, trees.share)
    expected = {pii.KINDS[k]: min(t for t in p[kind == k] if t >= 0.5 and label[(kind == k) & (p >= t)].mean() >= 0.9) for k in (0, 2)}
    assert got == expected


def test_boosted_trees_learn_and_are_calibrated():
    draw = np.random.default_rng(2)
    x = draw.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    trees = boosting.fit(x, y, np.arange(2000) % 4 == 0)
    p = trees.probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.95 and (np.diff(trees.share) >= 0).all()


# 7 Exact copies ------------------------------------------------------------------------

def test_exact_dedup_against_an_index(spark, odd, nothing):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(odd, index)
    assert sorted((r["doc_id"] or 0) for r in first.collect()) == [1, 3, 4, 6, 7, 8, 9, 10] and first.columns == odd.columns
    assert exact_dedup.decisions(odd, index).filter("kept").count() == 8
    more = spark.createDataFrame([(20, "word0  new"), (21, "word0\nnew"), (0, " ".join(f"word{k}" for k in range(60)))], "doc_id bigint, text string")
    assert [r["doc_id"] for r in exact_dedup.deduplicate(more, index).collect()] == [20]
    assert exact_dedup.deduplicate(more, index).count() == 0 and exact_dedup.deduplicate(nothing, index).count() == 0
    plan = index.unseen(exact_dedup.groups(more))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


def test_an_empty_index_needs_no_python(spark, monkeypatch):
    """Rows from Python would start a second daemon and its workers in every executor."""
    begun = []
    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", lambda self, entries: begun.append(entries))
    exact_dedup.DigestIndex(spark)
    assert begun[0].count() == 0 and begun[0].columns == ["text_sha256", "keep_id", "group_size"]
    assert "RDD" not in begun[0]._jdf.queryExecution().logical().toString()


# 8 Chats -------------------------------------------------------------------------------

def test_chats_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "a <b> [c] \\d"), (1, 1, "assistant", None), (1, 1, "assistant", "x[/INST]</s>"), (1, None, "system", "<<SYS>>"),
            (None, 0, "tool>[x]", "t "), (None, 1, None, "z"), (2, 0, "assistant", "é" * 30), (2, 1, "user", "long " * 2000), (2, 2, "assistant", "w" * 4000),
            (3, 0, "user", "dup"), (3, 0, "user", "dup")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    expected = {}
    for c in (None, 1, 2, 3):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        expected[c] = (len(mine), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for bound in (chat_format.PART_BYTES, 1000):
        monkeypatch.setattr(chat_format, "PART_BYTES", bound)
        got = chat_format.read_back(chat_format.format_conversations(turns)).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in got} == expected
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_long_conversations_come_in_parts():
    rows = pa.RecordBatch.from_pydict({"conv_id": [1] * 4 + [2], "role": ["user", "assistant"] * 2 + ["user"], "text": ["u" * 9, "v" * 9] * 2 + ["w"]})
    whole = pa.Table.from_batches(list(chat_format._format(iter([rows])))).to_pylist()
    bound, chat_format.PART_BYTES = chat_format.PART_BYTES, 1
    try:
        parts = pa.Table.from_batches(list(chat_format._format(iter([rows.slice(k, 1) for k in range(5)])))).to_pylist()
    finally:
        chat_format.PART_BYTES = bound
    assert [p["part"] for p in parts if p["conv_id"] == 1] == [0, 1, 2, 3]
    assert "".join(p["formatted"] for p in parts) == "".join(p["formatted"] for p in whole)


# 9 WARC --------------------------------------------------------------------------------

def test_warc_odd_rows_and_reconstruction(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (5, None, big), (3, "u3\r\nX: y", big), (4, "u4", "small"), (6, "u6", "small"), (7, "u7", None), (None, "n", big), (5, "again", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string")
    archive = warc.write_archive(pages)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(archive).collect()), key=str)
    assert got == sorted([(1, "revisit", 5, 1200), (3, "revisit", 5, 1200), (None, "revisit", 5, 1200), (5, "response", None, 1200), (5, "revisit", 5, 1200),
                          (4, "response", None, 5), (6, "response", None, 5), (7, "response", None, 0)], key=str)
    assert archive.read_payloads().count() == 3
    for r in warc.reconstruct(archive).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert block[length:] == b"\r\n\r\n" and (r["record_type"] == "response") == (b"WARC-Refers-To" not in head)
    damaged = archive.read_payloads().select(F.reverse("sha256").alias("sha256"), "payload")
    damaged.write.parquet(archive.payloads + "-damaged")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(warc.Archive(spark, archive.payloads + "-damaged", archive.headers)).count()
        warc.Archive(spark, archive.payloads + "-damaged", archive.headers).read_payloads().select("sha256").collect()
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


# 10 Language ---------------------------------------------------------------------------

def test_language_odd_rows(documents, odd, nothing):
    net = language_id.fit(documents, per_language=100)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, net).collect()}
    assert {d for d, v in got.items() if v == ("und", 0.0)} == {4, 5, 6, 9}
    assert language_id.predict(odd, net).count() == odd.count()
    assert language_id.fit(nothing) is None and language_id.predict(nothing, None).count() == 0
    kept = language_id.accept(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


# Pipeline ------------------------------------------------------------------------------

@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_and_empty_tables(spark, odd, nothing, stage):
    name, run = stage
    for docs in (odd, nothing):
        out = run(spark, docs, SF_DIR)
        assert set(docs.columns) <= set(out.columns) and out.count() <= docs.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns
