"""Substring dedup: passages that an earlier document holds are removed, found by suffix automata of reference shards.

Texts are cut into stretches of consecutive windows, and a stretch belongs to the shard of the least hash among the
five-word runs of its windows. Equal windows have the same shard, so an automaton of each shard's stretches finds all that
documents share, and no document meets a shard that it has no run of words of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bits_of, bounded_batches, in_bits, mix, plain, read, rolling, stash
from tracewright.llm.suffix_automaton import SuffixAutomaton

#: Words of a window, which is the shortest passage to be removed, and of the runs that choose its shard.
WINDOW, RUN = 13, 5
#: Windows of a stretch at most: so many can have the same least run, if it doesn't repeat.
STRETCH = WINDOW - RUN + 1
#: Stretches of one automaton at most; those of a larger shard go to shards of single windows.
SHARD = 1024
#: Bytes that are hashed at once.
PIECE = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache
def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the words of each text: runs without ASCII white space, as 64-bit hashes. A null text has none."""
    texts = plain(texts)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    cut = ends[:-1][ends[:-1] < len(data)]
    begins[cut] = inside[1:-1][cut]  # no word goes on from one text to the next
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    between = cut[(cut > 0)]
    between = between[inside[between] & inside[between + 1]]
    if len(between):
        stop = np.union1d(stop, between)
    out = np.empty(len(start), np.uint64)
    powers, back = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))
    k = 0
    while k < len(start):
        n = max(1, int(np.searchsorted(stop[k:], start[k] + PIECE, side="right")))
        a, b = int(start[k]), int(stop[k + n - 1])
        if b - a > PIECE:  # one word of more bytes than a piece
            out[k] = int.from_bytes(hashlib.sha256(data[a:b].tobytes()).digest()[:8], "little")
        else:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a:b]] * powers[: b - a], dtype=np.uint64)))
            s, e = start[k : k + n] - a, stop[k : k + n] - a
            out[k : k + n] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        k += n
    return np.searchsorted(start, ends), out


def stretches(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, at, n, key, content) of all stretches: n windows from word `at` of a text, their shard and a hash of their words."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = rolling(words, RUN)
    wide = 1
    while wide < STRETCH:  # minima of twice as many runs, then of just enough
        step = min(wide, STRETCH - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    whole = text[:n] == text[WINDOW - 1 :]
    start = whole.copy()
    start[1:] &= (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
    # where a run repeats, more windows may follow each other in the shard
    place = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    at = np.flatnonzero(whole & (place % STRETCH == 0))
    end = np.append(at[1:], n)
    before = np.concatenate(([0], np.cumsum(whole)))
    size = before[end] - before[at]
    windows = rolling(words, WINDOW)
    content = mix(windows[at] * np.uint64(_ODD) + windows[at + size - 1] + size.astype(np.uint64))
    return text[at], at - offsets[text[at]], size, least[at], content


def _stretch_rows(docs: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """Stretches of docs(doc, print, text) with the row they are of; with bits, those whose shard may be in them."""
    names = ["key", "content", "n", "doc", "print", "at"]

    def run(batches):
        for b in batches:
            text, at, n, key, content = stretches(*word_hashes(b.column(2)))
            if bits is None:  # a document's share of a shard counts once
                _, some = np.unique(key ^ mix(text.astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), b.column(0).take(pa.array(text[some]))], ["key", "doc"])
                continue
            some = in_bits(bits, key.view(np.int64))
            of = pa.array(text[some])
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(content[some].view(np.int64)), pa.array(n[some]), b.column(0).take(of), b.column(1).take(of), pa.array(at[some])], names)

    return docs.mapInArrow(run, "key long, doc long" if bits is None else ", ".join(f"{c} long" for c in names))


def _reference_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, content, doc, words, size) of wanted(key, content, n, doc, print, at, size) stretches, their words taken from the texts."""
    bits = bits_of(wanted, "print")
    asked = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("key", "content", "at", "n", "size")).alias("asked"))

    def near(batches):
        for b in batches:
            yield b.filter(pa.array(in_bits(bits, b.column(1).to_numpy())))

    def run(batches):
        for b in batches:
            offsets, words = word_hashes(b.column(1))
            own = b.column(2)
            flat, of = own.flatten(), np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            key, content, at, n, of_shard = flat.flatten()
            first, size = at.to_numpy() + offsets[of], n.to_numpy() + WINDOW - 1
            ends = np.concatenate(([0], np.cumsum(size)))
            place = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays([key, content, b.column(0).take(pa.array(of)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[place].view(np.int64))), of_shard], ["key", "content", "doc", "words", "size"])

    # rows that repeat hold the same words
    one = docs.mapInArrow(near, docs.schema).join(asked, ["doc", "print"]).dropDuplicates(["doc", "print"]).select("doc", "text", "asked")
    return one.mapInArrow(run, "key long, content long, doc long, words array<bigint>, size long")


#: What a stretch says of its windows: so many from one on are first held by the document of this id.
OWNED = "key long, content long, owned array<struct<from:long,n:long,least:long>>"


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, doc, words) in order of key: an automaton of each shard, through which its stretches are streamed."""
    held: list[tuple] = []

    def shard() -> list[dict]:
        automaton = SuffixAutomaton()
        for _, _, doc, words in held:
            automaton.add(words, doc)
        automaton.settle()
        out = []
        for key, content, _, words in held:
            owned: list[dict] = []
            for k, (length, least) in enumerate(automaton.statistics(words, WINDOW)):
                if length < WINDOW:
                    continue
                if owned and owned[-1]["least"] == least:
                    owned[-1]["n"] += 1
                else:
                    owned.append({"from": k - WINDOW + 1, "n": 1, "least": least})
            out.append({"key": key, "content": content, "owned": owned})
        return out

    kind = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("owned", pa.list_(pa.struct([("from", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])))])
    out: list[dict] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                out += shard()
                held = []
            held.append(row)
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema=kind)
            out = []
    if held:
        out += shard()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def owned_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(OWNED) of every stretch of found, which holds all stretches of the shards that several documents share."""
    first = F.min(F.struct("doc", "print", "at", "n"))
    distinct = stash(found.groupBy("key", "content").agg(first.alias("f")).select("key", "content", "f.*"), "substring-stretches")
    sizes = distinct.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = distinct.join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    words = stash(_reference_words(docs, sized.where("size > 1")), "substring-references")
    # an automaton of a single stretch is a chain: its windows all begin in the document that holds it first
    alone = sized.where("size = 1").select("key", "content", F.array(F.struct(F.lit(0).cast("long").alias("from"), "n", F.col("doc").alias("least"))).alias("owned"))
    shards = words.where(F.col("size") <= SHARD).drop("size")
    several = shards.repartition("key").sortWithinPartitions("key").mapInArrow(_owners, OWNED)
    # of a larger shard each window is a shard of its own
    window = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda k: F.struct(F.xxhash64(F.slice("words", k, F.lit(WINDOW))).alias("window"), (k - 1).cast("long").alias("from")))
    single = words.where(F.col("size") > SHARD).select("key", "content", "doc", F.explode(window).alias("w")).select("key", "content", "doc", "w.*")
    least = single.groupBy("window").agg(F.min("doc").alias("least"))
    large = single.join(least, "window").groupBy("key", "content").agg(F.collect_list(F.struct("from", F.lit(1).cast("long").alias("n"), "least")).alias("owned"))
    return alone.unionByName(several).unionByName(large)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, print, spans) of rows of docs(doc, print, text) that hold a window which starts in a document of a smaller id.

    spans are stretches of words (from, to exclusive) that such windows cover; they may overlap.
    """
    known = docs.where("doc IS NOT NULL")
    shared = _stretch_rows(known, None).groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
    shared = stash(shared, "substring-shards")
    found = stash(_stretch_rows(known, bits_of(shared, "key")).join(shared, "key"), "substring-found")
    owned = stash(owned_windows(known, found), "substring-owned")
    hits = found.join(owned, ["key", "content"]).select("doc", "print", "at", F.filter("owned", lambda o: o["least"] < F.col("doc")).alias("owned")).where(F.size("owned") > 0)
    spans = F.transform("owned", lambda o: F.struct((F.col("at") + o["from"]).alias("from"), (F.col("at") + o["from"] + o["n"] + (WINDOW - 1)).alias("to")))
    return hits.groupBy("doc", "print").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs(doc_id, text).

    Words are runs of characters without ASCII white space; a window is 13 of one document in a row. A word is removed if a
    window covers it whose words also stand in a document with a smaller doc_id, judged on the texts as they come; kept has
    the other words, joined by one space. Null and empty texts have no words. Rows of the same doc_id, repeated ones among
    them, remove nothing from each other; rows without a doc_id are left as they are and remove nothing. No rows give no
    rows. Words and windows are compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))
    spans = stash(repeated_spans(lean), "substring-spans")
    bits = bits_of(spans, "print")

    def part(some: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bits(bits, b.column(1).to_numpy()) == some))

        return lean.mapInArrow(run, lean.schema)

    def cut(batches):
        for b in batches:
            rows = []
            for doc, raw, own in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows, strict=True):
                words = (raw or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in own or ():
                    gone[s["from"]] += 1
                    gone[s["to"]] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([words[k] for k in np.flatnonzero(stays)] if own else words)
                rows.append((doc, len(words), len(words) - int(stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    clean = part(False).select("doc", "text").mapInArrow(cut, schema)
    return clean.unionByName(part(True).join(spans, ["doc", "print"], "left").select("doc", "text", "spans").mapInArrow(cut, schema))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of every document; nulls, repeats and empty tables as in without_repeats()."""
    return without_repeats(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (g) WHERE least < doc_id),
k AS (SELECT r, count(*)::BIGINT AS gone FROM c GROUP BY r),
w AS (SELECT r, i, word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d)),
s AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN c ON c.r = w.r AND c.i = w.i WHERE c.i IS NULL GROUP BY w.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN s USING (r)
"""
