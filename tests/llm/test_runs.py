import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """All runs by trying every period and start."""
    found = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q) and (i, j + q) not in found:
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                    found[i, j + q] = q
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def runs_of(words):
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
    return P.find_runs(codes, P.lag_matches(codes, np.array([0, len(codes)]))[0])


@pytest.mark.parametrize("cost", [10, 10**9])
def test_runs_against_brute_force(cost, monkeypatch):
    monkeypatch.setattr(P, "PAIR_STEPS", cost)  # 10**9: all words that stand twice are counted by the transform
    rng = random.Random(3)
    for _ in range(250):
        vocabulary = rng.choice([1, 2, 3, 20])
        words = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            piece = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(1, 14))]
            words += (piece * rng.randrange(2, 12))[: rng.randrange(1, 90)]
            words += [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(6))]
        assert runs_of(words) == slow_runs(words)


def test_edges_of_length_and_period():
    assert runs_of(["a"] * 23) == [] and runs_of(["a"] * 24) == [(0, 24, 1)]
    nine = [str(k) for k in range(9)]
    assert runs_of(nine * 3) == [(0, 27, 9)] and runs_of((nine * 3)[:26]) == []
    assert runs_of(["x", *nine * 3, *nine[:4], "y"]) == [(1, 31, 9)]


def test_lags_counted_both_ways_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    codes, offsets = rng.integers(0, 5, 900), np.array([0, 0, 400, 401, 900])
    slow = [[int((own[: len(own) - q] == own[q:]).sum()) for q in range(len(own) // 3 + 1)] for own in np.split(codes, offsets[1:-1])]
    for cost in (0, 10**9):
        monkeypatch.setattr(P, "PAIR_STEPS", cost)
        assert [c[1:].tolist() for c in P.lag_matches(codes, offsets)] == [s[1:] for s in slow]


def test_a_million_words_end_soon():
    assert runs_of(["a"] * 1_000_000) == [(0, 1_000_000, 1)]
    half = [str(k) for k in range(1000)] * 500
    assert runs_of(half + [f"z{k}" for k in range(500_000)]) == [(0, 500_000, 1000)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a b " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "É é " * 25)]
    for k in range(10, 160):
        words = [rng.choice("a b c dd e f".split(" ")) for _ in range(rng.randrange(120))]
        if k % 3 == 0:
            words = [*words[:7] * 6, "x", *words, "y", *words[:9] * 4]
        rows.append((k, rng.choice([" ", "\n", "\x0b ", " \x1f "]).join(words)))
    schema = "doc_id long, text string, start long, runs string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((slow_row(*r) for r in rows), key=key)
    assert any(r[1] for r in got) and any(r[1] > 1 for r in got)
    assert P.op12_periodic_runs(spark, str(tmp_path)).schema.simpleString() == "struct<doc_id:bigint,n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,runs_sha256:string,collapsed_sha256:string>"


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
