"""Nulls, repeats, ties and clashing names in the operators that the pipeline and the searches are made of."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tracewright.llm import embedding_dedup as E
from tracewright.llm import importance as I
from tracewright.llm import langid, packing, secrets

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _cut string, _row string, _id string, row string, value string, c0 string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "cut", "row", "id", "r", "v", "c") for i, t, s in rows], CLASH)


def test_redact_keeps_columns_of_any_name(spark):
    live = "password = 'q8Zx7Lm2Vb91'"
    rows = [(1, f"a {live} b", "s1"), (1, f"a {live} b", "s1"), (None, live, None), (2, None, "s2"), (3, "", "s3"), (4, "clean", "s4")]
    rows += [(10 + k, "token: EXAMPLEKEY12345", f"x{k}") for k in range(5)]  # widely copied
    df = clashing(spark, rows)
    out = secrets.redact(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = sorted((tuple(r) for r in out.collect()), key=str)
    hidden = "a [secret]' b"
    want = [(1, hidden, "s1"), (1, hidden, "s1"), (None, "[secret]'", None), *rows[3:]]
    assert got == sorted(((i, t, "en", s, len(t or ""), "cut", "row", "id", "r", "v", "c") for i, t, s in want), key=str)
    assert secrets.redact(df.limit(0)).collect() == []
    assert secrets.redact(df.withColumnRenamed("source", "repo"), repository="repo", owner="lang").count() == len(rows)


def test_language_stage_keeps_columns_of_any_name(spark):
    rows = [(k, "the and of with this that " * 5, "s") for k in range(12)] + [(90, None, "s"), (91, "", None), (92, "123 456", "s"), (None, "the and of this", "s")]
    df = clashing(spark, rows)
    out = langid.select_clear(df, 0.0)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {r.doc_id for r in out.collect()} == {*range(12), None}
    assert langid.select_clear(df.limit(0), 0.4).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e9])
def test_keys_are_as_exact_as_doubles(spark, scale):
    rng = np.random.default_rng(3)
    values = [*(rng.normal(size=60) * scale).tolist(), 0.0, -0.0, float("inf"), -float("inf"), 5e-324, -5e-324, -2.0**40, -(2.0**40) - 2.0**-12]
    rows = I.by_bits(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    assert sorted(values) == [r.x for r in sorted(rows, key=lambda r: r.key)]
    assert len({r.key for r in rows}) == len(set(values))
    keys = spark.createDataFrame([(r.key,) for r in rows], "key long")
    ordered = sorted((r.key for r in rows), reverse=True)
    for k in (1, 7, 40, len(rows)):
        t, left = I.threshold(keys, k)
        assert t == ordered[k - 1] and left == k - sum(x > t for x in ordered)


def test_repeated_rows_are_packed_apart(spark):
    """Rows without an id and of one text are dealt over the buckets by their numbers, and each gets a place of its own."""
    docs = spark.createDataFrame([(None, "one two three", "x")] * 300 + [(7, None, "x"), (8, "", "x")], "doc_id long, text string, number string").repartition(3)
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64, 1).collect()
    assert len(out) == 302
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    end = zlib.crc32(np.array([packing.END], "<u4").tobytes())
    assert [(r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id in (7, 8)] == [(1, end, 1)] * 2
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_an_unproven_plan_is_told():
    with pytest.warns(UserWarning, match="proven within"):
        old, packing.ROUNDS = packing.ROUNDS, 0
        try:
            packing.cutting_stock(np.array([3, 5, 7]), np.array([10, 11, 12]), 16)
        finally:
            packing.ROUNDS = old


def test_both_sides_of_a_pair_see_one_distance():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = E.fit(x, len(x), 8)
    residuals = x[:200] - index.centres[0]
    codes = index.encode(x[200:700] - index.centres[0])
    table = index.distances(residuals, codes)
    q, m = rng.integers(0, 200, 3000), rng.integers(0, 500, 3000)
    assert (index.distances_of_pairs(residuals[q], codes[m]) == table[q, m]).all()
    assert (index.encode(x[200:201] - index.centres[0])[0] == codes[0]).all() and (index.distances(residuals[:3], codes[:5]) == table[:3, :5]).all()


def test_every_link_of_near_vectors_counts_once(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for k in range(400):
        b = base[k % 12]
        rows.append((k, [v + rng.gauss(0, rng.choice([0.05, 0.2, 0.33])) for v in b]))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in range(400)] == near.sum(axis=1).tolist()
    assert near.sum() > 2000


def test_ownership_against_brute_force(spark):
    rng = random.Random(12)
    values = [f"token={k}Xy7Qp{k * 7919}" for k in range(8)] + ["password: aaaaaaaaaaaa", "AKIA" + "Z9" * 8]
    rows = []
    for k in range(90):
        held = rng.sample(values, rng.randrange(3))
        rows.append((k, rng.choice(["a b ", "x\n"]) + " ; ".join(held), rng.choice(["r1", "r2", "r3", "r4", "r5", "r6", None]), rng.choice(["o1", "o2", None])))
    rows += [rows[3], (200, values[0], "only", "me"), (None, values[1], None, None), (201, None, "r1", "o1"), (202, "", "r1", "o1")]
    repositories, owners = {}, {}
    for _, text, repo, owner in rows:
        for *_, value in secrets.scan(text or ""):
            repositories.setdefault(value, set()).update([repo] if repo else [])
            owners.setdefault(value, set()).update([owner] if owner else [])
    want = []
    for i, text, *_ in rows:
        spans = secrets.scan(text or "")
        copied = [len(repositories[s[4]]) >= 4 or len(owners[s[4]]) >= 2 for s in spans]
        live = [not c and secrets.entropy(s[4]) >= secrets.LIVE_ENTROPY for c, s in zip(copied, spans, strict=True)]
        some = lambda keep: secrets.joined((s[0], s[2], s[3]) for s, k in zip(spans, keep, strict=True) if k)  # noqa: B023, E731
        want.append((i, sum(live), sum(copied), some(live), some(copied), some([True] * len(spans))))
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, team string").repartition(3)
    out = secrets.secret_spans(df, "repo", "team", 4, 2)
    got = [(r.doc_id, r.n_live, r.n_copied, r.spans_live, r.spans_copied, r.spans) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x for _, n, c, *_ in got for x in (n > 0, c > 0)} == {True, False}
