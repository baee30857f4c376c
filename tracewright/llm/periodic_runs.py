"""Periodic runs of words: lags are counted first, and only those with enough matches are scanned for runs."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, plain, read

#: A run has at least so many words and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Steps of a transform of n log2 n that cost as much as counting one pair; shares out words between the two ways of counting.
PAIR_STEPS = 10
#: Places of a stretch that are looked at before all of it is compared.
PROBES = 16

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"


def needed(lag: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of this period has at least."""
    return np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words) of each text; words are runs without ASCII white space, and a null text has none."""
    lists = pc.ascii_split_whitespace(plain(texts))
    offsets, words = np.asarray(lists.offsets, np.int64), lists.flatten()
    some = pc.not_equal(words, "")
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return before[offsets - offsets[0]], words.filter(some)


def lag_matches(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, the number of places whose word stands again q words later, for q from 0 to a third of its words.

    Frequent words are counted by an FFT autocorrelation of their places, all others by the differences of their
    pairs of places, a step for all texts at once. Both counts are exact.
    """
    n = np.diff(offsets)
    most = n // LEAST_PERIODS
    counts = [np.zeros(m + 1, np.int64) for m in most]
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((codes, text))
    text, code = text[order], codes[order]
    place = order - offsets[text]
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])))) if len(code) else order
    size = np.diff(np.append(first, len(code)))
    width = 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64)
    points = width[text[first]] if len(code) else size
    frequent = size * (size - 1) // 2 * PAIR_STEPS > points * np.log2(np.maximum(points, 2))
    power: dict[int, np.ndarray] = {}
    for g in np.flatnonzero(frequent).tolist():
        t = int(text[first[g]])
        there = np.zeros(int(width[t]))
        there[place[first[g] : first[g] + size[g]]] = 1
        power[t] = power.get(t, 0) + np.abs(np.fft.rfft(there)) ** 2
    for t, p in power.items():
        counts[t] += np.rint(np.fft.irfft(p, int(width[t]))[: most[t] + 1]).astype(np.int64)
    rare = ~np.repeat(frequent, size)
    text, place, group = text[rare], place[rare], np.repeat(np.arange(len(size)), size)[rare]
    base = np.concatenate(([0], np.cumsum(most + 1)))
    flat = np.zeros(int(base[-1]), np.int64)
    at, step = np.arange(len(place)), 1
    while len(at):
        at = at[at + step < len(place)]
        at = at[group[at] == group[at + step]]
        lag = place[at + step] - place[at]
        near = lag <= most[text[at]]  # places ascend, so what is too far stays too far
        at, lag = at[near], lag[near]
        flat += np.bincount(base[text[at]] + lag, minlength=len(flat))
        step += 1
    for t, c in enumerate(counts):
        c += flat[base[t] : base[t + 1]]
    return counts


def islands(codes: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """(first, after the last) place of every maximal row of needed(lag) or more matches at a lag.

    Such a row holds two neighbouring multiples of half its least length and all between them, so only stretches between two
    matching multiples are looked at: at some of their places, and those that pass as a whole.
    """
    n, least = len(codes) - lag, int(needed(np.int64(lag)))
    step = max(1, least // 2)
    if n < least:
        return []
    mark = np.arange(0, n - step, step)
    mark = mark[(codes[mark] == codes[mark + lag]) & (codes[mark + step] == codes[mark + step + lag])]
    for k in range(1, PROBES):
        inner = mark + step * k // PROBES
        mark = mark[codes[inner] == codes[inner + lag]]
    out: list[tuple[int, int]] = []
    for at in mark.tolist():
        if out and at < out[-1][1]:
            continue
        if not (codes[at : at + step] == codes[at + lag : at + step + lag]).all():
            continue
        lo, hi = _reach(codes, at, lag, -1), _reach(codes, at + step, lag, 1)
        if hi - lo >= least:
            out.append((lo, hi))
    return out


def _reach(codes: np.ndarray, at: int, lag: int, way: int) -> int:
    """How far matches go on from a place to the left or right; looks at pieces that double."""
    piece, n = 64, len(codes) - lag
    while 0 < at if way < 0 else at < n:
        a, b = (max(0, at - piece), at) if way < 0 else (at, min(n, at + piece))
        odd = np.flatnonzero(codes[a:b] != codes[a + lag : b + lag])
        if len(odd):
            return int(a + odd[-1] + 1 if way < 0 else a + odd[0])
        at, piece = (a if way < 0 else b), 2 * piece
    return at


def find_runs(codes: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text by start, then period. matches: as lag_matches() counts them; they are changed.

    Lags ascend. What a run matches at the multiples of its period is taken from their counts: two runs share less than
    a period of either, so none of these matches can belong to a run of the multiple, and a text of one word is scanned at one lag.
    """
    found: dict[tuple[int, int], int] = {}
    enough = np.flatnonzero(matches[1:] >= needed(np.arange(1, len(matches)))) + 1
    for lag in enough.tolist():
        if matches[lag] < needed(np.int64(lag)):
            continue
        for a, b in islands(codes, lag):
            stretch = (a, b + lag)
            if stretch not in found:  # else a smaller period has it
                found[stretch] = lag
                longer = np.arange(2 * lag, min(len(matches), b + lag - a), lag)
                matches[longer] -= b + lag - a - longer
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated_suffix(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on repeat with period p in the text that op12 takes; None if it takes the text as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, repeat_suffixes: bool = False) -> DataFrame:
    """(RUNS): for each row of docs(doc_id, text) its runs and the digest of its words without what runs repeat.

    Words are runs of characters without ASCII white space. A run is a stretch of words with smallest period q, of at least
    max(24, 3q) words, that no neighbouring word extends; of its words, those after the first q are left out of the collapsed text.
    Texts are worked in the batches of the scan, without a shuffle. With repeat_suffixes, a tenth of the texts (by a
    checksum of doc_id) repeat a piece of theirs first; a null doc_id is never among them. Null and empty texts have no words and no
    runs; rows that repeat are each reported; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            offsets, words = split(b.column(1))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            if repeat_suffixes:
                for doc_id, at, end in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if again := repeated_suffix(doc_id, end - at):
                        a, p = again
                        codes[at + a : end] = codes[at + a + np.arange(end - at - a) % p]
            names, rows, digests = coded.dictionary.to_pylist(), [], []
            for k, matches in enumerate(lag_matches(codes, offsets)):
                own = codes[offsets[k] : offsets[k + 1]]
                runs = find_runs(own, matches)
                kept = np.ones(len(own), bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                digests.append(hashlib.sha256(" ".join([names[c] for c in own[kept].tolist()]).encode()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(rows, kind), pa.array(digests, pa.string())], [c.split()[0] for c in ("doc_id", "n_words", "runs", "collapsed_sha256")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of runs of each document and the one of the greatest exact exponent; rows as periodic_runs() has them."""
    found = periodic_runs(read(spark, sf_dir, "documents", "doc_id", "text"), repeat_suffixes=True)

    def better(x, y):
        # length / period of both as fractions, without rounding
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] <= y["period"]))))

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), x).otherwise(y))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n")))
    some = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256")
    return some.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
