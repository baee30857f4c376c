"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, hashed_words, read, rolling

SHINGLE = 5
SIMILARITY = 0.8
#: Two windows of similarity 0.8 differ in about 10 of 64 bits, and in more than 19 once in some thousands.
RADIUS = 19
#: Widths of the blocks of a fingerprint. Within RADIUS < 2 * len(BLOCKS) bits, some block differs in one bit at most.
BLOCKS = (6, 6, 6, 6, 6, 6, 7, 7, 7, 7)
#: Items and characters of the benchmark that one pass over the documents holds.
ITEMS, CHARACTERS = 20_000, 8 << 20

LEAK = "item_id long, start_word long, n_words long, hamming long, similarity double, n_windows long"


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """A block of benchmark items: their shingles, and for every length their fingerprints by block."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        offsets, hashes = hashed_words(pa.array([t for _, t in items], pa.string()))
        self.ids, self.words, self.shingles, self.prints = [], [], [], []
        for k, (item, _) in enumerate(items):
            words = hashes[offsets[k] : offsets[k + 1]]
            if len(words):
                shingles = rolling(words, min(SHINGLE, len(words)))
                self.ids.append(item)
                self.words.append(len(words))
                self.shingles.append(shingles)
                self.prints.append(pack(signs(shingles).sum(axis=0, keepdims=True))[0])
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        words, prints = np.array(self.words, np.int64), np.array(self.prints, np.uint64)
        self.of_length = {int(n): np.flatnonzero(words == n) for n in np.unique(words)}
        # near[n][b][v]: which items of n words have a block b within one bit of v
        self.near = {n: [_near(prints[own], b) for b in range(len(BLOCKS))] for n, own in self.of_length.items()}
        self.print_of = {n: prints[own] for n, own in self.of_length.items()}
        # keys[s]: sorted shingles of s words and the lengths of the items that hold them
        self.keys: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for s in {min(SHINGLE, n) for n in self.words}:
            lengths: dict[int, set[int]] = {}
            for n, shingles in zip(self.words, self.shingles, strict=True):
                if min(SHINGLE, n) == s:
                    for h in shingles.tolist():
                        lengths.setdefault(h, set()).add(n)
            keys = sorted(lengths)
            self.keys[s] = np.array(keys, np.uint64), [np.array(sorted(lengths[h])) for h in keys]

    def windows(self, hashes: np.ndarray, start: int, end: int, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
        """By item length, the starts of all windows of one document that hold a shingle of an item of that length."""
        found: dict[int, list[np.ndarray]] = {}
        for s, (at, key) in hits.items():
            lengths = self.keys[s][1]
            for p, k in zip(at.tolist(), key.tolist(), strict=True):
                for n in lengths[k].tolist():
                    size = min(n, end - start)
                    found.setdefault(n, []).append(np.arange(max(start, p - (size - s)), min(p, end - size) + 1))
        return {n: np.unique(np.concatenate(w)) for n, w in found.items()}

    def leaks(self, hashes: np.ndarray, start: int, end: int, hits) -> list[tuple]:
        """(item_id, start_word, n_words, hamming, similarity, n_windows) of each item that leaks into one document."""
        best: dict[int, tuple] = {}
        number: Counter = Counter()
        for n, starts in self.windows(hashes, start, end, hits).items():
            s, size = min(SHINGLE, n), min(n, end - start)
            if size < s or not len(starts):
                continue
            low, high = int(starts[0]), int(starts[-1]) + size
            shingles = rolling(hashes[low:high], s)
            m = size - s + 1
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(shingles), axis=0, dtype=np.int32)))
            prints = pack(sums[starts - low + m] - sums[starts - low])
            for w, k, d in zip(*self.within(prints, n), strict=True):
                item = int(self.of_length[n][k])
                at = int(starts[w])
                own = self.counts[item]
                seen = Counter(shingles[at - low : at - low + m].tolist())
                both = sum(min(c, own[h]) for h, c in seen.items() if h in own)
                similarity = both / (m + len(self.shingles[item]) - both)
                if similarity >= SIMILARITY:
                    number[self.ids[item]] += 1
                    got = (-similarity, int(d), at - start, size)
                    best[self.ids[item]] = min(best.get(self.ids[item], got), got)
        return [(item, at, size, d, -sim, number[item]) for item, (sim, d, at, size) in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]

    def within(self, prints: np.ndarray, n: int) -> tuple[list[int], list[int], list[int]]:
        """All (window, item of n words, distance) at most RADIUS bits apart: candidates by block, then the exact distance."""
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for at in range(0, len(prints), 4096):
            part, shift, cand = prints[at : at + 4096], 0, None
            for b, width in enumerate(BLOCKS):
                v = (part >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                cand = self.near[n][b][v] if cand is None else cand | self.near[n][b][v]
                shift += width
            w, k = np.nonzero(cand)
            d = np.bitwise_count(part[w] ^ self.print_of[n][k]).astype(np.int64)
            for o, x in zip(out, (w + at, k, d), strict=True):
                o += x[d <= RADIUS].tolist()
        return out

    def batch(self, texts: pa.Array) -> list[list[tuple]]:
        """The leaks into each text of a batch."""
        offsets, hashes = hashed_words(texts)
        hits: dict[int, dict[int, tuple]] = {}
        for s, (keys, _) in self.keys.items():
            r = rolling(hashes, s)
            if not len(r):
                continue
            k = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
            at = np.flatnonzero(keys[k] == r)
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + s <= offsets[doc + 1]
            at, doc = at[inside], doc[inside]
            for d in np.unique(doc).tolist():
                mine = at[doc == d] if len(at) < 4096 else at[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
                hits.setdefault(d, {})[s] = (mine, k[mine])
        return [self.leaks(hashes, int(offsets[d]), int(offsets[d + 1]), hits[d]) if d in hits else [] for d in range(len(texts))]


def _near(prints: np.ndarray, block: int) -> np.ndarray:
    width = BLOCKS[block]
    v = (prints >> np.uint64(sum(BLOCKS[:block]))).astype(np.int64) & ((1 << width) - 1)
    table = np.zeros((1 << width, len(prints)), bool)
    for flip in [0, *(1 << i for i in range(width))]:
        table[v ^ flip, np.arange(len(prints))] = True
    return table


def blocks(benchmark: DataFrame) -> list[Index]:
    """The benchmark in parts of about ITEMS items and CHARACTERS characters, each small enough for every task to hold.

    Items without words match nothing; repeated rows are one item.
    """
    lean = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    n, chars = lean.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-chars // CHARACTERS))
    for k in range(parts):
        part = lean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else lean
        rows = sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r))
        yield Index(rows)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity, n_windows) of every benchmark item found in a document.

    A document holds an item if some window of as many words has a fingerprint within RADIUS of the
    item's and a weighted (by multiplicity) Jaccard similarity of five-word shingles of SIMILARITY or
    more; the row gives the most similar window, ties going to the nearest fingerprint, then to the
    first. Words are lower-cased runs of letters and digits. Windows without a shingle of an item of
    their length have similarity zero, so only the others are fingerprinted. A document shorter than the
    item is one window; an item of fewer than five words is one shingle. Null and empty texts hold
    nothing; repeated documents are each reported. Each part of the benchmark is one more pass.
    """
    bounded_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(index: Index) -> DataFrame:
        def run(batches):
            for b in batches:
                at, rows = [], []
                for k, found in enumerate(index.batch(b.column(1))):
                    at += [k] * len(found)
                    rows += found
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(x.split()[0] for x in LEAK.split(", "))])

        return lean.mapInArrow(run, "doc_id long, " + LEAK)

    return reduce(DataFrame.unionByName, [one(i) for i in blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks; filtered in the scan, without a shuffle.

    What leaks is told by leaks(): null and empty texts hold nothing and stay, as do all rows if the benchmark is empty.
    Repeated rows stay or go together; columns may have any names; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    text = docs.columns.index("text")
    for index in blocks(benchmark):

        def run(batches, index=index):
            for b in batches:
                yield b.filter(pa.array([not found for found in index.batch(b.column(text).cast(pa.string()))]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of the whole documents and benchmark tables; nulls, empty texts, repeated rows and an empty table as there."""
    return leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
