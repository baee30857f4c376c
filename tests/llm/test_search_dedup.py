import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import lexical_search as L
from tracewright.llm import substring_dedup as D
from tracewright.llm.suffix_automaton import NOBODY, SuffixAutomaton

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_search(docs, items, top=10):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m)) for w in terms(text) if w in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("size", [10, 200, 1 << 20])
def test_search_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(L, "SHARD_BYTES", size)
    monkeypatch.setattr(L, "SEEDS", 3)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["É", "naïve", "x1", "Straße"]
    text = lambda n: rng.choice([" ", "-", "_\x7f", "\n"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, text(rng.randrange(40))) for k in range(150)]
    docs += [(7, None), (8, ""), (9, "..."), (None, text(30)), (500, docs[3][1]), (501, docs[3][1].upper()), (3, docs[3][1]), (502, "w1 " * 3000)]
    items = [(k, text(rng.randrange(1, 15))) for k in range(20)] + [(90, None), (91, ""), (92, "nowhere"), (5, "w3 w3 w3 naïve"), (None, "w29 x1")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score long, rank long").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, ids string")
    got = [tuple(r) for r in L.search(L.build_index(df), asked).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3] * -1, r[1])
    assert sorted(got, key=key) == sorted(slow_search(docs, items), key=key)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(L.build_index(docs), items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.search(L.build_index(some), items.limit(0)).collect() == []


def test_lists_that_are_idle_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lists = []
        for _ in range(rng.integers(1, 7)):
            docs = np.flatnonzero(rng.random(300) < rng.choice([0.02, 0.3, 0.9]))
            gain = rng.integers(1, rng.choice([5, 1000]), len(docs))
            if len(docs):
                lists.append((int(gain.max()), docs, gain))
        sums = Counter()
        for _, docs, gain in lists:
            sums.update(dict(zip(docs.tolist(), gain.tolist(), strict=True)))
        best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:10]
        got = sorted(L.merged(lists, 10, 0), key=lambda x: (-x[1], x[0])) if lists else []
        assert got[:10] == best
        if len(best) == 10:  # the tenth score is a floor that changes nothing
            assert sorted(L.merged(lists, 10, best[-1][1]), key=lambda x: (-x[1], x[0]))[:10] == best


def test_numbers_of_seven_bits():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40, 5], np.int64)
    data, ends = L.packed(values)
    assert L.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert L.unpacked(L.packed(values[:0])[0]).tolist() == []


def slow_rows(docs):
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in rows:
        gone = {x for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def some_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "naïve.", "x\x1fy"]
    passage = [rng.choices(vocabulary, k=rng.randrange(10, 40)) for _ in range(8)]
    docs = []
    for k in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choices(vocabulary, k=rng.randrange(20))
            words += rng.choice(passage)[rng.randrange(4) :]
        docs.append((rng.randrange(10_000), rng.choice([" ", "\n", "\x0b ", "  "]).join(words)))
    docs += [(1, None), (2, ""), (3, " \t"), (None, docs[0][1]), (4, "one"), (docs[5][0], docs[6][1]), docs[7], docs[7]]
    docs += [(20_000 + k, "a " * (30 + k)) for k in range(3)] + [(30_000, "a b c " * 20), (30_001, "c a b " * 20), (10, docs[9][1] + " x"), (40_000, "x" * 3000 + " " + " ".join(passage[0]))]
    return docs


@pytest.mark.parametrize("shard", [1024, 1])
def test_repeats_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD", shard)  # 1: every shard of several stretches is dealt by single windows
    docs = some_docs(shard)
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in docs], "doc_id long, text string, key long, content string, doc long").repartition(4)
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in D.without_repeats(df).collect()), key=lambda r: (r[0] is None, str(r)))
    assert got == sorted(slow_rows(docs), key=lambda r: (r[0] is None, str(r)))
    assert sum(r[2] for r in got) > 1000 and key


def test_repeats_without_rows(spark):
    assert D.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r)[:3] for r in D.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0)]


def test_word_hashes(monkeypatch):
    texts = ["a b", None, "", " a\tbb ", "ab", "cd e", "e", "x" * 50, "bb"]
    for piece in (1 << 20, 16):
        monkeypatch.setattr(D, "PIECE", piece)
        D._powers.cache_clear()
        offsets, hashes = D.word_hashes(pa.array(texts))
        words = [WORD.findall(t or "") for t in texts]
        assert np.diff(offsets).tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    D._powers.cache_clear()


def test_stretches_hold_each_window_once():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    words[100:160] = 1
    offsets = np.array([0, 12, 25, 25, 300, 500])
    text, at, n, key, content = D.stretches(offsets, words)
    own = [(t, a + k) for t, a, c in zip(text.tolist(), at.tolist(), n.tolist(), strict=True) for k in range(c)]
    assert sorted(own) == [(t, k) for t in range(5) for k in range(max(0, offsets[t + 1] - offsets[t] - 12))]
    assert n.max() <= D.STRETCH
    by_words = {}
    for t, a, c, k in zip(text.tolist(), at.tolist(), n.tolist(), key.tolist(), strict=True):
        for j in range(c):
            window = words[offsets[t] + a + j :][:13].tobytes()
            assert by_words.setdefault(window, k) == k  # equal windows meet in one shard


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(40):
        references = [([rng.randrange(3) for _ in range(rng.randrange(1, 25))], rng.randrange(9)) for _ in range(rng.randrange(1, 5))]
        a = SuffixAutomaton()
        for words, owner in references:
            a.add(words, owner)
        a.settle()
        query = [rng.randrange(4) for _ in range(40)]
        for most in (4, 50):
            for k, (length, least) in enumerate(a.statistics(query, most)):
                own = lambda n: [o for w, o in references if any(w[i : i + n] == query[k + 1 - n : k + 1] for i in range(len(w) - n + 1))]  # noqa: B023, E731
                want = max((n for n in range(1, min(most, k + 1) + 1) if own(n)), default=0)
                assert (length, least) == (want, min(own(want)) if want else NOBODY)


def test_a_text_of_a_million_words(spark):
    words = " ".join(f"w{k % 5003}" if k % 7 else f"u{k}" for k in range(1_000_000))
    row = L.shard_of(pa.array([1, 2], pa.int64()), pa.array([words, "w1 w2"]))
    assert row["n_terms"] == 1_000_002 and row["n_docs"] == 2 and int(row["df"].sum()) == len(set(words.split())) + 2
    offsets, hashes = D.word_hashes(pa.array([words]))
    _, _, n, key, _ = D.stretches(offsets, hashes)
    assert len(hashes) == 1_000_000 and int(n.sum()) == 1_000_000 - 12 and len(np.unique(key)) > 100_000
    docs = spark.createDataFrame([(1, "x " + words), (2, words + " y"), (3, "short")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in D.without_repeats(docs).collect()) == [(1, 1_000_001, 0), (2, 1_000_001, 1_000_000), (3, 1, 0)]
