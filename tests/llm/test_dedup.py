import random
import re

import numpy as np
import pytest
import xxhash

from tracewright.llm import embedding_dedup as E
from tracewright.llm import simhash_dedup as S
from tracewright.llm.components import connected

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, root long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, 2, 3) for k, t in rows], DOC)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "  \t\n", "one", "Two Words", "A b\x0bC\x0cd e", "É é x y z", "a b c " * 40, "x\x1fy z w"])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) & (1 << 64) - 1 == slow_fingerprint(text)


def brute_components(values, near):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(values))]


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64) & np.uint64(0xFFFFF))
    q, x = S.Tree(values).within(values, 2)
    got = set(zip(q.tolist(), x.tolist(), strict=True))
    assert got == {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= 2}


@pytest.mark.parametrize("tree", [4, 256])
def test_links_join_what_brute_force_joins(spark, tree):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(6)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected(S.links(nodes, tree=tree), "t").collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for v, w in zip(signed, want, strict=True):
        least[w] = min(least.get(w, v), v)
    assert got == [least[w] for w in want]


def test_connected_follows_long_chains(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 100), (None, 5), (200, 201), (200, 201)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, long), (3, long.upper()), (9, long + " more"), (1, "other text here"), (2, None), (4, ""), (7, "one"), (7, "one"), (None, long)]
    got = S.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 2, 7: 7}
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    kept = S.deduplicate(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7] and kept.columns == docs(spark, rows).columns
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    seeds = rng.normal(size=(40, 16))
    x = np.concatenate([seeds + rng.normal(scale=s, size=seeds.shape) for s in (0.0, 0.2, 0.35, 0.5)] + [np.repeat(seeds[:1], 30, axis=0)])
    rows = [(k, v.tolist(), 1, 2.0) for k, v in enumerate(x.astype(np.float32))]
    got = sorted(E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, x double")).collect())
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = near.sum(axis=1) - 1
    # every link that is missed is missed at both ends
    assert sum(r.n_links for r in got) >= 0.99 * want.sum() and all(r.n_links <= w for r, w in zip(got, want, strict=True)) and sum(r.n_links for r in got) % 2 == 0
    roots = brute_components(range(len(x)), lambda i, j: near[i, j])
    least = {w: min(k for k in range(len(x)) if roots[k] == w) for w in roots}
    assert np.mean([r.component_id == least[w] for r, w in zip(got, roots, strict=True)]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 9, 10)]
    assert got == sorted([(0, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (8, 3, 1, False), (8, 3, 1, False), *alone])
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Null ids aren't one document, and an id stays in each component in which it is smallest."""
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue black white"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (None, texts[2]), (4, "quite another text of the same id"), (9, texts[2])]
    got = sorted((r.doc_id or 0, r.text) for r in S.deduplicate(docs(spark, rows)).collect())
    assert got == sorted([(0, texts[0]), (0, texts[1]), (4, texts[2]), (4, "quite another text of the same id")])
