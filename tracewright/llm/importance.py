"""Quality by importance resampling: target against raw hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm._common import bounded_batches, hashed_words, read, rolling, stash

#: Hash buckets of the two models, and the longest n-gram.
BUCKETS, ORDERS = 10_000, 2
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Share of the rows to sample.
KEEP = 0.8
SEED = 17
#: Labelled documents that the target model is fitted on at most, drawn by a hash of the id.
TARGETS = 50_000
#: Bits of the key that one step of the selection fixes.
STEP = 16


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a batch over words, as written, and runs of punctuation."""
    offsets, words = hashed_words(texts, marks=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    docs, buckets = [], []
    for n in range(1, ORDERS + 1):
        h = rolling(words, n)
        inside = doc[n - 1 :] == doc[: len(h)]
        docs.append(doc[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in rows that are a target and in all rows of docs(target, text); each task sends its sums once."""

    def run(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            doc, bucket = features(b.column(1))
            target = b.column(0).to_numpy(zero_copy_only=False).astype(bool)[doc]
            sums[0] += np.bincount(bucket[target], minlength=BUCKETS)
            sums[1] += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "target", "raw"])

    counted = docs.select("target", "text").mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.toLocalIterator():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target model's probability over the raw model's, by bucket; no target gives zeros."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs(row, doc_id, text) with a hash of the text, n_grams and log_weight in place of text."""
    import xxhash

    def run(batches):
        for b in batches:
            doc, bucket = features(b.column(2))
            prints = np.fromiter((xxhash.xxh64_intdigest(t or b"", seed=0) >> 1 for t in b.column(2).cast(pa.large_binary()).to_pylist()), np.int64, b.num_rows)
            n = np.bincount(doc, minlength=b.num_rows)
            w = np.bincount(doc, weights=ratio[bucket], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints), pa.array(n.astype(np.int64)), pa.array(w)], ["row", "doc_id", "print", "n_grams", "log_weight"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, print long, n_grams long, log_weight double")


def threshold(keys: DataFrame, k: int) -> tuple[int, int]:
    """(t, left): the k-th largest of keys(key), non-negative 63-bit integers, and how many rows equal to t belong to the k.

    Each step counts the rows under the digits fixed so far by their next STEP bits, so the driver sees
    at most 2^STEP counts at once, however many rows there are.
    """
    fixed, left = 0, k
    for shift in range(64 - STEP, -1, -STEP):
        under = keys if shift == 64 - STEP else keys.where(F.shiftright("key", shift + STEP) == F.lit(fixed))
        digit = F.shiftright("key", shift)
        digit = digit if shift == 64 - STEP else digit.bitwiseAND(F.lit((1 << STEP) - 1))  # the first digit has the sign
        for r in sorted(under.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["d"]):
            if r["n"] >= left:
                fixed = fixed << STEP | r["d"]
                break
            left -= r["n"]
    return fixed, left


def by_bits(rows: DataFrame, column: str) -> DataFrame:
    """rows with key, a whole number for each double of a column, in the same order as the doubles and as exact as they are."""
    at = rows.columns.index(column)

    def run(batches):
        for b in batches:
            bits = (b.column(at).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)  # one zero
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))], [*b.schema.names, "key"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, selected) for every row of docs(doc_id, text).

    Target text is that of documents whose label has quality 1 and isn't toxic, TARGETS of them at most;
    raw text is all text, and every document is weighed.
    log_weight is the log of the ratio of the two bag models over all of the document's hashed words and
    word pairs. gumbel_key adds noise that follows from the seed, the id and the text; the ceil(keep * rows)
    rows of the largest keys are selected, which draws that many rows without replacement in
    proportion to exp(log_weight). Null and empty texts weigh nothing and draw like any other.
    Rows that repeat id and text, null ids among them, have equal keys, and if the limit falls among equal keys the lower
    row numbers are selected. Labels are matched by id; a repeated one counts as quality 1 if any
    says so and as toxic if any does. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(F.max("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("bad"))
    good = marks.where("doc_id IS NOT NULL AND good AND NOT bad").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGETS).select("doc_id", F.lit(True).alias("target"))
    lean = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = lean.join(F.broadcast(good), "doc_id", "left").select("row", "doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    ratio = log_ratio(*bucket_counts(marked))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("print"), F.lit(0)), F.lit(seed)), F.lit(1 << 52))
    noise = -F.log(-F.log((draw + 0.5) / F.lit(float(1 << 52))))
    scored = stash(weighed(lean, ratio).select("row", "doc_id", "n_grams", "log_weight", (F.col("log_weight") + noise).alias("gumbel_key")), "importance")
    n = scored.count()
    k = int(np.ceil(keep * n))
    if not 0 < k < n:
        return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", F.lit(k > 0).alias("selected"))
    keyed = by_bits(scored, "gumbel_key")
    t, left = threshold(keyed.select("key"), k)
    ties = keyed.where(F.col("key") == t).select(F.col("row").alias("key"))
    # of equal keys the lowest rows: the left-th smallest row number is the k-th largest of the rest
    total = ties.count()
    if left < total:
        over, _ = threshold(ties, total - left)
        among = (F.col("key") == t) & (F.col("row") < F.lit(over))
    else:
        among = F.col("key") == t
    return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", ((F.col("key") > t) | among).alias("selected"))


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample() of the whole documents and labels tables; nulls, empty texts, repeated rows and an empty table as there."""
    return resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
