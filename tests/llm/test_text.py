import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import chat, decontaminate, html_text, importance, langid, licenses, packing, secrets

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, value string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, src, len(t or ""), 1, "k", "v") for k, t, lang, src in rows], DOC)


def some(spark, *texts):
    return docs(spark, [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)])


# --- importance resampling -----------------------------------------------------------------------
def test_importance_prefers_text_like_the_target(spark):
    good, bad = "the quick brown fox jumps over the lazy dog", "BUY!! NOW!! $$$ cheap ### pills"
    rows = some(spark, *[f"{good} {k}" for k in range(30)], *[f"{bad} {k}" for k in range(10)], None, "", "!!")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)] + [(30, 0, 1), (31, 1, 1), (None, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(rows, labels, keep=0.7).collect()}
    assert len(got) == 43 and sum(r.selected for r in got.values()) == math.ceil(0.7 * 43)
    assert min(got[k].log_weight for k in range(30)) > max(got[k].log_weight for k in range(30, 40))
    assert got[40].log_weight == got[41].log_weight == 0.0
    assert min(r.gumbel_key for r in got.values() if r.selected) >= max(r.gumbel_key for r in got.values() if not r.selected)
    again = {r.doc_id: r.selected for r in importance.resample(rows.repartition(5), labels, keep=0.7).collect()}
    assert again == {k: r.selected for k, r in got.items()}


def test_importance_against_brute_force(spark):
    """Weights, noise and the selected rows by a plain count over the same hashed n-grams; null and repeated ids draw by their texts."""
    import xxhash

    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: 20 if k % 3 else 60]) for _ in range(rng.randrange(1, 40))) for k in range(120)]
    ids = [None if k % 10 == 0 else k // 2 for k in range(120)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id or 0), r.n_grams, round(r.log_weight, 9), round(r.gumbel_key, 9), r.selected) for r in importance.resample(docs(spark, [(k, t, "en", "s") for k, t in zip(ids, texts, strict=True)]), labels, keep=0.3).collect())

    def buckets(t):
        h = [np.array([xxhash.xxh64_intdigest(w.encode(), 0)], np.uint64) for w in t.split()]
        runs = [np.concatenate(h[k : k + n]) for n in (1, 2) for k in range(len(h) - n + 1)]
        return [int(importance.rolling(r, len(r))[0] % np.uint64(importance.BUCKETS)) for r in runs]

    target, raw = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for k, t in zip(ids, texts, strict=True):
        for b in buckets(t):
            raw[b] += 1
            target[b] += k is not None and k % 3 == 0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    def noise(k, t):
        """Gumbel noise from the hash of the id's digits, the text's hash and the seed, each hashed with the one before as its seed."""
        h = xxhash.xxh64_intdigest(b"" if k is None else str(k).encode(), 42)
        h = xxhash.xxh64_intdigest((xxhash.xxh64_intdigest(t.encode(), 0) >> 1).to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest(importance.SEED.to_bytes(4, "little"), h)
        return -np.log(-np.log((h % (1 << 52) + 0.5) / (1 << 52)))

    want = []
    for k, t in zip(ids, texts, strict=True):
        w = float(sum(ratio[b] for b in buckets(t)))
        want.append(((k or 0), len(buckets(t)), w, w + noise(k, t)))
    got.sort(key=lambda g: (g[0], g[1], g[3]))
    want.sort(key=lambda g: (g[0], g[1], g[3]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:4] for g in got], [w[2:4] for w in want], rtol=0, atol=1e-6)
    assert {k for k, g in enumerate(got) if g[4]} == set(sorted(range(120), key=lambda k: -want[k][3])[:36])
    keys = sorted((g[3] for g in got), reverse=True)
    assert sum(g[4] for g in got) == 36 and min(g[3] for g in got if g[4]) >= keys[35] - 1e-6


def test_importance_ties_and_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = docs(spark, [(7, "same text", "en", "s")] * 9)
    assert sum(r.selected for r in importance.resample(same, labels, keep=0.5).collect()) == 5
    assert importance.resample(some(spark).limit(0), labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100])
def test_threshold(spark, k):
    values = [(v * 7919) % 1000 << 40 | v % 3 for v in range(100)]
    t, left = importance.threshold(spark.createDataFrame([(v,) for v in values], "key long"), k)
    order = sorted(values, reverse=True)
    assert t == order[k - 1] and left == k - sum(v > t for v in values)


# --- decontamination -----------------------------------------------------------------------------
def brute_leaks(text, items):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    out, w = {}, words(text)
    for item, t in items:
        own = words(t)
        if not own or not w:
            continue
        n, s = min(len(own), len(w)), min(5, len(own))
        bag = lambda x: {g: [tuple(x[k : k + s]) for k in range(len(x) - s + 1)].count(g) for g in {tuple(x[k : k + s]) for k in range(len(x) - s + 1)}}  # noqa: E731, B023
        b = bag(own)
        for at in range(len(w) - n + 1):
            a = bag(w[at : at + n])
            both = sum(min(c, b.get(g, 0)) for g, c in a.items())
            total = sum(a.values()) + sum(b.values()) - both
            if total and both / total >= 0.8:
                out[item] = max(out.get(item, 0), both / total)
    return out


def test_leaks_against_brute_force(spark):
    item = " ".join(f"word{k}" for k in range(30))
    other = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(1, item), (2, other), (3, "tiny item"), (4, None), (5, ""), (1, item), (6, "the the the the the the the the")]
    edit = item.replace("word29", "changed")
    texts = [f"before {item} after", f"x {item.upper().replace(' ', ', ')} y", f"a b {edit} c", item.replace("word15", "changed"), "a TINY, item b", " ".join(f"word{k}" for k in range(20)), other, "clean text of no item at all", None, "", f"{item} mid {item}", "the " * 30, "word1 word2"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.leaks(some(spark, *texts), bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.similarity
    want = {k: brute_leaks(t, items) for k, t in enumerate(texts)}
    assert {k: {i: round(s, 9) for i, s in v.items()} for k, v in got.items()} == {k: {i: round(s, 9) for i, s in v.items()} for k, v in want.items() if v}
    assert {0, 1, 2, 4, 6, 10} <= set(got)
    kept = decontaminate.clean(some(spark, *texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if k not in got] and len(kept.columns) == 8
    none = bench.limit(0)
    assert decontaminate.leaks(some(spark, *texts), none).count() == 0 and decontaminate.clean(some(spark, *texts), none).count() == len(texts)
    assert decontaminate.leaks(some(spark, "x").limit(0), bench).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    index = decontaminate.Index([(k, " ".join(rng.choice(500, 20).astype(str))) for k in range(50)])
    own = index.print_of[20]
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in (1, 10, 19, 25)], np.uint64)
    prints = (own[:, None] ^ flips[None]).ravel()
    w, k, d = index.within(prints, 20)
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(own) if int(p ^ q).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w, k, strict=True)) == want


# --- chat ----------------------------------------------------------------------------------------
def test_rotation(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, None, "who"), (3, 0, "system", "alone"), (None, 1, "cat", "é")]
    got = chat.rotated(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, part int")).collect()
    text = {}
    for r in sorted(got, key=lambda r: r.position):
        side = text.setdefault((r.conv_id, r.perspective), "")
        assert r.start == len(side) and r.length == len(r.segment)
        text[r.conv_id, r.perspective] = side + r.segment
    assert set(text) == {(1, "ann"), (1, "bob"), (None, "cat")}
    assert text[1, "ann"] == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo <im_end><|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    learnt = {(r.perspective, text[r.conv_id, r.perspective][r.mask_start : r.mask_start + r.mask_length]) for r in got if r.mask_length}
    assert learnt == {("ann", "hi<|im_end|>"), ("ann", "<|im_end|>"), ("bob", "yo <im_end><|im_end|>"), ("cat", "é<|im_end|>")}
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- licences ------------------------------------------------------------------------------------
def test_licence_model_knows_its_templates():
    model = licenses.train()
    for family, group in licenses.TEMPLATES.items():
        for t in group:
            assert any(w in t.lower() for w in licenses.WORDING)
            p = licenses.probabilities(model.logits(licenses.grams_of(t)), model.temperature)
            assert max(p, key=p.get) == family and p[family] >= licenses.PROBABILITY
    for t in licenses.OTHER:
        p = licenses.probabilities(model.logits(licenses.grams_of(t)), model.temperature)
        assert max(p, key=p.get) == licenses.UNKNOWN


def test_no_licence_without_its_wording():
    """The words that pick paragraphs lose none that could be confirmed."""
    for _, grams in licenses.train().templates:
        assert sum(not any(w in g for w in licenses.WORDING) for g in grams) / len(grams) < licenses.CONFIRMED


def test_licences_of_unseen_wordings():
    """Paragraphs that no template has as they stand: families and, for as many others, the unknown class."""
    seen = {
        "mit": ("This package is distributed under the terms of the MIT License, see LICENSE.", "The code in this folder is MIT licensed.", "Copyright (c) 2021 A. Person. Released under the MIT licence."),
        "apache-2.0": ("Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0.", "The samples are available under the Apache License 2.0.", "You may obtain a copy of the Apache License, Version 2.0 and must use this file in compliance with it."),
        "gpl": ("This script is free software under the GNU General Public License version 2.", "The tool is released under the GPL v3 or later.", "You should have received a copy of the GNU General Public License with this package."),
        "lgpl": ("The bindings may be used under the GNU Lesser General Public License 2.1.", "This library is under the LGPL."),
        "bsd": ("The utilities are governed by a BSD-style license found in the LICENSE file.", "Redistribution and use in source and binary forms are permitted provided that these conditions are met.", "Distributed under the 3-Clause BSD License."),
        "cc-by-sa": ("Text of this site is available under CC BY-SA 4.0.", "Content is licensed under a Creative Commons Attribution-ShareAlike 4.0 licence."),
        "cc0": ("The data set is dedicated to the public domain under CC0 1.0.",),
        "mpl-2.0": ("Files here are subject to the terms of the Mozilla Public License, v. 2.0.",),
        "proprietary": ("Copyright 2019 Example Ltd. All rights reserved. Do not copy.",),
        licenses.UNKNOWN: ("Her driving license was renewed under the new rules.", "The museum granted permission to take photographs.", "A copyright dispute between two publishers ended today.", "The warranty of the washing machine has expired.", "Public domain films were shown at the general meeting.", "The foundation will redistribute the donated food.", "The council may license street traders for one year.", "In this version of the story the fox gets away.", "Their work on the library took several years.", "No permission is needed to enter the park."),
    }
    model, right, sure, n = licenses.train(), 0, 0.0, 0
    for family, texts in seen.items():
        for t in texts:
            p = licenses.probabilities(model.logits(licenses.grams_of(t)), model.temperature)
            best = max(p, key=p.get)
            right, sure, n = right + (best == family), sure + p[best], n + 1
    assert right / n >= 0.85 and abs(sure / n - right / n) <= 0.15, (right, sure, n)


def test_licences_against_python(spark):
    texts = ["Prose.\nReleased under the MIT License.\nMore.", "x LICENSED UNDER CC BY-NC 4.0. y\r\n\r\nLicensed under CC BY 4.0.", "A fishing license costs money.", None, "", "\n \n", "SPDX-License-Identifier: Apache-2.0\n" * 3, "mit und der licence", "word " * 5000 + "Licensed under the Apache License, Version 2.0. " + "word " * 5000]
    model = licenses.train()
    for r in licenses.scan(some(spark, *texts)).collect():
        text = texts[r.doc_id] or ""
        parts = [p for p in re.split("\r?\n", text) if p.strip(" ")]
        worded = [p for p in parts if any(w in p.lower() for w in licenses.WORDING)]
        found, unknown = set(), 0
        for p in worded:
            grams = set(licenses.grams_of(p))
            prob = licenses.probabilities(model.logits(grams), model.temperature)
            best = min(prob, key=lambda f: (-prob[f], f))
            match = max((len(grams & t) / len(t) for f, t in model.templates if f == best), default=0)
            if best != licenses.UNKNOWN and prob[best] >= licenses.PROBABILITY and match >= licenses.CONFIRMED - 1e-9:
                found.add(best)
            else:
                unknown += 1
        assert (r.n_paragraphs, r.n_worded, r.n_unknown, r.licences) == (len(parts), len(worded), unknown, ",".join(sorted(found)))
    assert licenses.scan(some(spark).limit(0)).count() == 0


def test_wrapped_licences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    prose = "Some words that have nothing to do with it\nand go on for a second line"
    texts = [mit, bsd, f"{prose}\n{bsd}\n{prose}", f"{mit.replace(chr(10), chr(13) + chr(10))}\r\n\r\n{bsd}", "All rights\nreserved.", "Copyright law differs\nfrom country to country.", f"{prose}\n\nmore"]
    got = {r.doc_id: r for r in licenses.scan(some(spark, *texts)).collect()}
    assert [got[k].licences for k in range(len(texts))] == ["mit", "bsd", "bsd", "bsd,mit", "proprietary", "", ""]
    assert got[1].n_unknown == 0 and (got[0].n_worded, got[0].n_unknown) == (2, 1) and got[5].n_unknown == 1


def test_notice_without_licence_words(spark):
    """A part of a notice that is confirmed by pairs of its words alone has its family; prose with such a pair isn't counted."""
    part = "Unless required by applicable law or agreed to in writing, software distributed under the terms is distributed on an AS IS BASIS."
    texts = [part, part.replace(" ", "  ").replace("software", "/* software"), part.replace("writing, ", "writing,\n * "), "The applicable law, agreed to in writing, has changed."]
    assert not any(w in t.lower() for w in licenses.LICENCE_WORDS for t in texts)
    got = {r.doc_id: (r.licences, r.n_worded, r.n_unknown) for r in licenses.scan(some(spark, *texts)).collect()}
    assert got == {0: ("apache-2.0", 0, 0), 1: ("apache-2.0", 0, 0), 2: ("apache-2.0", 0, 0), 3: ("", 0, 0)}


# --- packing -------------------------------------------------------------------------------------
def test_packing_round_trip(spark):
    t = Tokenizer.from_file(TOKENIZER)
    texts = ["Hello, World. it's 2024...", None, "", "É ǅ İx ſs ﬁ é 日本   a b", "x y. " * 9000, "tok, " * 300, "tok, " * 300, "<|endoftext|> z"]
    rows = docs(spark, [(k, s, "en", "s") for k, s in enumerate(texts)] + [(0, texts[0], "en", "s"), (None, "n", "en", "s")])
    got = packing.pack(rows, TOKENIZER).collect()
    ids = {k: np.array([*t.encode(s or "", add_special_tokens=False).ids, 2], "<u4") for k, s in [*enumerate(texts), (None, "n")]}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096
    assert sum(r.length for r in got) == sum(len(v) for v in ids.values()) + len(ids[0])
    assert packing.pack(rows.limit(0), TOKENIZER).count() == 0


def test_word_ids_are_the_plain_tokenizers():
    """Texts of every plane of trouble: letters that normalise to a letter and a mark, marks after stops, special strings, odd white space."""
    rng, t, w = random.Random(1), Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    pool = ["İ.", "σς,", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", "\n", "\t", "'s", "'RE", "don't.", "1.5", "a.b,c", "é.", "e\u0301.", "\u0958.", "\ufb2a,", "\u1100\u1161\u11a8.", ".\u0301", "\u212b,", "\ufb01.", "٣.", "\x00", "\x1c", "\xa0", "👍🏽", "\u200d", '"', "AB"]
    texts = ["İ.", "a <|endoftext|> b", ""]
    for _ in range(4000):
        letter = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x900, 0x3000), rng.randrange(0xF900, 0xFB50)]))
        texts.append("".join(rng.choice(pool) if rng.random() < 0.8 else letter() for _ in range(rng.randrange(12))))
    for k in range(0, len(texts), 512):
        offsets, ids = w(pa.array(texts[k : k + 512]))
        for j, s in enumerate(texts[k : k + 512]):
            assert t.encode(s, add_special_tokens=False).ids == ids[offsets[j] : offsets[j + 1]].tolist(), repr(s)


def test_linear_program_is_proven():
    rng = np.random.default_rng(3)
    for top in (9, 60, 512):
        size = np.unique(rng.integers(1, top + 1, 200))
        demand = rng.integers(1, 500, len(size))
        used, bound = packing.cutting_stock(size, demand, 512)
        made = sum(x * c for x, c in used)
        assert np.allclose(made, demand, rtol=1e-4, atol=1e-2) and all(c @ size <= 512 for _, c in used)
        total = sum(x for x, _ in used)
        assert bound - 1e-3 <= total <= bound * (1 + packing.GAP) + 1e-3 and bound >= (size @ demand) / 512 * (1 - packing.GAP) - 1e-3


def test_plan_wastes_little():
    rng = np.random.default_rng(6)
    size = np.arange(1, 257)
    demand = rng.integers(0, 40, 256)
    keep = demand > 0
    placed = packing.plan(size[keep], demand[keep], 512)
    fill, ranks = {}, {}
    for s, first, n, each, seq, _ in placed.tolist():
        ranks.setdefault(s, []).append((first, n))
        for k in range(n):
            fill[seq + k // each] = fill.get(seq + k // each, 0) + s
    assert max(fill.values()) <= 512 and len(fill) * 512 <= 1.02 * (size * demand).sum() + 512
    for s, parts in ranks.items():
        ends = 0
        for first, n in sorted(parts):
            assert first == ends
            ends = first + n
        assert ends == demand[s - 1]


# --- pages ---------------------------------------------------------------------------------------
def page(article, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Ad</div>{extra}<article>{article}</article><footer>&copy; me</footer>'


def test_main_text(spark):
    html = [
        ("http://h/a/1", page("<h1>A &amp; B</h1><p>one\n two<br>three<p><b>x<div class='comments'><p>c</p></div><aside>s</aside><form>f</form>"), "A & B\none two three\nx"),
        ("http://h/a/2", "<div>Site name</div><p>first story</p><p>is long enough to count</p><div>Imprint</div>", "first story\nis long enough to count"),
        ("http://h/a/3", "<div>Site name</div><p>second story here</p><p>has other words in it</p><div>Imprint</div>", "second story here\nhas other words in it"),
        ("http://g/x", "<p>copy of a page</p>", "copy of a page"),
        ("http://g/y", "<p>copy of a page</p>", "copy of a page"),
        (None, None, ""),
        ("", "", ""),
        ("http://h/z", "plain <i>te</i>xt <!-- no --> &lt;b&gt; <p hidden>h</p><main><p>m</p><div id='sidebar'>s</div></main>", "m"),
    ]
    rows = spark.createDataFrame([(k, u, h, "x") for k, (u, h, _) in enumerate(html)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text.main_text(rows).collect()}
    assert {k: r.text for k, r in got.items()} == {k: t for k, (_, _, t) in enumerate(html)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(rows.limit(0)).count() == 0


def test_lines_of_a_template_go_copies_stay(spark):
    """A menu of most of the page, runs of copies and of near copies on pages without marked parts."""
    menu, foot = "".join(f"<div>menu entry number {k}</div>" for k in range(3)), "<p>imprint of the publisher</p>"
    bodies = {f"http://h/n/{k}": f"<p>short story {k} of its own</p>" for k in range(4)}
    bodies |= {f"http://h/n/2{c}": bodies["http://h/n/2"] for c in "abc"}
    story = [f"<p>sentence {k} of the long story that two pages tell alike</p>" for k in range(60)]
    near = {"http://g/s/1": "".join(story), "http://g/s/2": "".join([*story, "<p>one more</p>"]), "http://g/s/3": "".join([*story[:30], "<p>other</p>", *story[31:]])}
    rows = spark.createDataFrame([(k, u, menu + b + foot) for k, (u, b) in enumerate(bodies.items())] + [(100 + k, u, b) for k, (u, b) in enumerate(near.items())], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    plain = lambda h: "\n".join(re.findall("<p>(.*?)</p>", h))
    assert [got[k] for k in range(len(bodies))] == [plain(b) for b in bodies.values()]
    assert [got[100 + k] for k in range(3)] == [plain(b) for b in near.values()]


def test_differencing_decides_inside_a_marked_article(spark):
    """By brute force: of a marked article go the lines that both unlike neighbours and most pages of the host have; what few have stays, and copies do."""
    rng = random.Random(5)
    own = lambda k: [f"own sentence {k} {j} of this page" for j in range(6)]
    stories = []
    for k in range(30):
        lines = own(k)
        if k % 10 < 6:
            lines.insert(rng.randrange(6), "read more from our desk")
        if k in (6, 7, 8, 24):
            lines.insert(0, "a line that one page quotes")
        stories.append(["by the newsroom", *lines, "all rights are ours"])
    stories[21] = [*stories[20][:5], "edited", *stories[20][6:]]  # a near copy
    html = lambda lines: "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    rows = spark.createDataFrame([(k, f"http://h/n/{k:02}", html(x)) for k, x in enumerate(stories)], "page_id long, url string, html string")

    def expected(k):
        if k in (0, 29):  # one neighbour
            return stories[k]
        sides = [stories[k - 1], stories[k + 1]]
        size = lambda x: sum(map(len, x))
        both = [x for x in stories[k] if all(x in s for s in sides)]
        if any(size([x for x in stories[k] if x in s]) >= html_text.COPY * max(size(stories[k]), size(s)) for s in sides):
            return stories[k]
        return [x for x in stories[k] if x not in both or 2 * sum(x in s for s in stories) <= len(stories)]

    got = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    assert got == {k: "\n".join(expected(k)) for k in range(30)}
    assert "by the newsroom" not in got[3] and "by the newsroom" in got[20] and "a line that one page quotes" in got[7]


@pytest.mark.parametrize(("a", "b"), [("abcde", "axcye"), ("", "a"), ("aaaa", "aa"), ("xaby", "zabw"), ("abcabba", "cbabac")])
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    at = html_text.shared_lines([ord(c) for c in a], [ord(c) for c in b])
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert len(at) == table[-1][-1] and at == sorted(set(at))
    rest = iter(b)
    assert all(a[k] in rest for k in at)


# --- languages -----------------------------------------------------------------------------------
def test_languages(spark):
    words = {"en": "the and of that with from this have", "de": "der und nicht mit einer auch wird sich", "fr": "les des est dans pour une qui avec"}
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 30)), lang, "s") for k in range(240) for lang in [list(words)[k % 3]]]
    odd = [(1000, None, "en", "s"), (1001, "123 !!", "de", "s"), (1002, rows[0][1], None, "s"), (None, rows[1][1], None, "s"), (1003, rows[2][1] * 2000, "en", "s")]
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows + odd)).collect()}
    assert len(got) == 245
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang, _ in rows)
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1000].score) == ("und", "und", 0.0)
    assert (got[1002].lang_pred, got[None].lang_pred, got[1003].lang_pred) == ("en", "de", "fr")
    assert {r.lang_pred for r in langid.identify(docs(spark, odd).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs(spark, []).limit(0)).count() == 0
    kept = langid.select_clear(docs(spark, rows + odd), 0.4)
    assert {r.doc_id for r in kept.collect()} >= {k for k, *_ in rows} and kept.columns == docs(spark, rows).columns
    assert kept.where("doc_id IN (1000, 1001)").count() == 0


def test_held_out_accuracy(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    both = langid.identify(d).where("held_out AND lang_pred <> 'und'").join(d.select("doc_id", "lang"), "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


# --- secrets -------------------------------------------------------------------------------------
def slow_base(text):
    out = []
    rules = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
    for place, (kind, pattern, group, least) in enumerate(rules):
        out += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2 + "aa"
    texts = [f"é password = '{hexes}' end", "token: abc then secret: token : abcdefgh1", "AKIA" + "A1B2C3D4E5F6 AKIAX xAKIAAKIABBBBCCCC1", None, "", "ApI_KeY:\"abcd1234efgh", "ghp_" + "aB3dE5fG7h" * 4, "secret=EXAMPLEkey42", "secret=EXAMPLEkey42", "secret=EXAMPLEkey42", "secret=EXAMPLEkey42 " + "w " * 60000, "toKen=ſecret passwordd=xxxxxxxxx", "a" * 40 + "g" + "b" * 31]
    rows = docs(spark, [(k, t, "en", f"s{k}") for k, t in enumerate(texts)] + [(0, texts[0], "en", None)])
    got = secrets.secret_spans(rows).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == base
    by = {r.doc_id: r for r in got}
    assert by[6].spans.startswith("prefixed:0:") and by[6].n_live == 1
    assert (by[7].n_live, by[7].n_copied) == (0, 1) and by[0].n_live == 2
    clean = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert clean[0].text == "é [secret]' end" and clean[0].n_chars == len(clean[0].text) and clean[7].text == texts[7] and clean[3].text is None
    assert secrets.redact(rows).columns == rows.columns and secrets.secret_spans(rows.limit(0)).count() == 0


def test_redact_by_row(spark):
    key = ["password = hunter2secret9X", "token: q8Zr41LmNv77pQ", "secret=Jk82nVbX90aa1"]
    rows = docs(spark, [(None, f"a {key[0]} b", "en", "s0"), (None, f"other text {key[1]} c", "en", "s1"), (5, f"{key[2]} at the start", "en", "s2"), (5, f"a much longer text of the same id, then {key[0][:-1]}Q end", "en", "s3"), (5, "no secret in this one, only words", "en", "s4")])
    got = sorted(r.text for r in secrets.redact(rows).collect())
    assert got == sorted(["a [secret] b", "other text [secret] c", "[secret] at the start", "a much longer text of the same id, then [secret] end", "no secret in this one, only words"])
