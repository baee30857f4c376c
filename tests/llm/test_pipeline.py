import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import queries
from tracewright.llm.decontaminate import leaks
from tracewright.llm.langid import identify
from tracewright.llm.secrets import secret_spans


def test_queries_are_there():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline"} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_pipeline_step_by_step(spark, tiny):
    """Every stage keeps the columns and does to its own input what its operator says; the last packs every id of what is left."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{tiny}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    clear = stages["language_id"](spark, docs, tiny)
    assert ids(clear) == sorted(r.doc_id for r in identify(docs).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE)
    one = stages["near_dedup"](spark, clear, tiny)
    assert ids(one) == brute_kept([(r.doc_id, r.text) for r in clear.collect()])
    pure = stages["decontamination"](spark, one, tiny)
    assert ids(pure) == sorted(set(ids(one)) - {r.doc_id for r in leaks(one, bench).collect()})
    safe = stages["secret_scan"](spark, pure, tiny)
    live = {r.doc_id: r.n_live for r in secret_spans(pure).collect()}
    before = {r.doc_id: r.text for r in pure.collect()}
    assert all((r.text != before[r.doc_id]) == (live[r.doc_id] > 0) and r.n_chars == len(r.text) for r in safe.collect())
    assert clear.columns == one.columns == pure.columns == safe.columns == columns
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in safe.collect()}
    got = corpus_pipeline.run(spark, tiny).collect()
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    assert all(zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)


def brute_kept(rows):
    """Of each group that chains of pairs with five-word Jaccard similarity of 0.8 or more join, the smallest id."""

    def shingles(text):
        words = (text or "").lower().split()
        size = min(5, len(words))
        return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()

    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if b < a and (5 * len(x & y) >= 4 * len(x | y)) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(k) for k in sets})


def test_near_dedup_against_brute_force_jaccard(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(200)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, tiny)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    # a large group around one text, at similarities on both sides of 0.8, chains, a common line and texts without words
    rng = random.Random(5)
    base, line = [f"w{k}" for k in range(120)], [f"c{k}" for k in range(25)]
    rows = [(0, ""), (1, None), (2, " ".join(base)), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for k in range(10, 70):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 6)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(base[: 118 - k + 100] + [f"y{k}"])) for k in range(100, 130)]
    rows += [(k, " ".join([*line, *(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 40)))])) for k in range(200, 240)]
    rng.shuffle(rows)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), tiny)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    same = [(None, "a b c d e f"), (None, "g h i j k l"), (7, "a b c d e f"), (7, "m n o p q r"), (7, "m n o p q r")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(same, "doc_id long, text string"), tiny)
    assert sorted(r.text for r in kept.collect()) == ["a b c d e f", "g h i j k l", "m n o p q r"]

