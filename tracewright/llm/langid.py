"""Language identification: multinomial logistic regression over TF-IDF character n-grams, trained with FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, plain, read

UNDETERMINED = "und"
#: Hash buckets of n-grams of 1 to ORDERS characters.
BUCKETS = 1 << 14
ORDERS = 3
#: Labelled rows to fit on: so many of each language, and so many in all.
PER_LANGUAGE = 500
SAMPLE = 4000
#: Share of the sample that sets the temperature.
CALIBRATION = 5
#: Follow-the-regularised-leader: rate, smoothing, elastic net, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-3, 1e-3, 3
SEED = 11


@dataclass(frozen=True)
class Model:
    """weights: buckets x languages, of IDF-weighted, unit-length counts."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def judge(self, text: str) -> tuple[str, float] | None:
        """The likeliest language of a text that letters() returned, and its probability; None without a letter."""
        if not text:
            return None
        at, counts = grams(text)
        p = softmax((vector(at, counts, self.idf) @ self.weights[at] + self.bias) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def letters(texts: pa.Array) -> list[str]:
    """Lower-cased texts with every run of characters but letters and marks as one space; null, and a text without a letter, is empty."""
    texts = plain(texts)
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " "), " ")
    return pc.if_else(pc.match_substring_regex(texts, r"\p{L}"), spaced, "").to_pylist()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the whole text between two spaces."""
    counts = np.zeros(BUCKETS, np.int64)
    if text:
        points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
        for at in range(0, len(points), 1 << 20):  # runs overlap, so that no n-gram is lost
            part = points[at : at + (1 << 20) + ORDERS - 1]
            h = np.zeros(len(part), np.uint32)
            for n in range(1, ORDERS + 1):
                h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
                new = h[: min(len(h), 1 << 20)]
                counts += np.bincount((new ^ (new >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after PASSES over (buckets, values, class) in a fixed random order; L1 leaves most weights at zero."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(SEED)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            slope = softmax(x @ w)
            slope[label] -= 1
            g = np.outer(x, slope)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes held-back labels most likely, by golden-section search on its logarithm.

    Targets are smoothed by one imagined error among the rows, so that perfectly separated rows
    don't drive every score to one.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many of docs(text) there are, and how many hold each bucket; each task sends its sums once."""

    def run(batches):
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in letters(b.column(0)):
                df[grams(t)[0]] += 1
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS, np.int64), 0
    for r in sums:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return total, df


def train(labelled: DataFrame) -> Model | None:
    """Fit on labelled(key, text, lang); None if it has no rows.

    Language counts and document frequencies come from every row. Weights come from at most
    PER_LANGUAGE rows of a language, SAMPLE in all (whole texts, reduced to counts before they reach
    the driver), chosen by a hash of the key; one row in CALIBRATION of them sets the temperature. Where many rows
    repeat a drawn key, the first 2 * SAMPLE by a hash of their counts stay.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    total, df = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + df)) + 1
    want = min(PER_LANGUAGE, max(1, SAMPLE // len(languages)))
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, want / sizes[lang]))])
    draw = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(batches):
        for b in batches:
            got = [grams(t) for t in letters(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary())], ["lang", "at", "counts"])

    chosen = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(run, "lang string, at binary, counts binary")
    place = {lang: k for k, lang in enumerate(languages)}
    rows = []
    # rows arrive in any order; the learner takes them in one of its own, so that it learns the same each time
    for r in sorted(chosen.orderBy(F.xxhash64("at", "counts"), "lang", "at", "counts").limit(2 * SAMPLE).toLocalIterator(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["counts"]))):
        at = np.frombuffer(r["at"], "<i4")
        if len(at):
            rows.append((at, vector(at, np.frombuffer(r["counts"], "<i4"), idf), place[r["lang"]]))
    fit, held = [r for k, r in enumerate(rows) if k % CALIBRATION], rows[::CALIBRATION]
    weights, bias = ftrl(fit, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, temperature(logits, np.array([k for *_, k in held], int)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(key, ...) with lang_pred and score in place of text: the likeliest language and its calibrated probability."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", lang_pred string, score double"

    def run(batches):
        for b in batches:
            found = [(model.judge(t) if model else None) or (UNDETERMINED, 0.0) for t in letters(b.column(b.num_columns - 1))]
            names, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from the learner: CRC-32 of the id's digits leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang).

    Learns from rows outside the held-out third that have a lang. A null text or one without a letter
    is und with score 0, as is every text if there is nothing to learn from. A null doc_id counts as
    the empty string. Repeated rows get equal predictions. Whole texts count, however long.
    """
    bounded_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = train(lean.where("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(lean.select("doc_id", "held_out", "text"), model)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of the whole documents table; nulls, empty texts, repeated rows and an empty table as there."""
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def select_clear(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted language has at least that score; und rows go.

    The model learns as in identify(); rows are filtered in the scan, without a shuffle. Null and empty texts and those
    without a letter are und, whatever the least score. Repeated rows stay or go together, a null doc_id counts as one
    that isn't held out, columns may have any names, and no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = train(lean.where(~held_out(F.col("key"))))
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            found = [model.judge(t) if model else None for t in letters(b.column(text).cast(pa.string()))]
            yield b.filter(pa.array([x is not None and x[1] >= least_score for x in found]))

    return docs.mapInArrow(run, docs.schema)
