"""Ranked lexical search: compressed postings in shards, a document-at-a-time heap merge per shard, one global merge."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, plain, read, stash

TOP = 10
#: A shard holds about so many bytes of text and so many documents at most; one longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCUMENTS = 16 << 20, 65_536
#: Items and characters of one block of queries, which every task holds; more queries are worked block by block.
ITEMS, CHARACTERS = 20_000, 8 << 20
#: Documents of the rarest terms that are scored first, for a lower bound of the scores that count.
SEEDS = 64
#: Bytes as they count in terms: letters A-Z small, ASCII without letters and digits a space, all others as they are.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "n_docs long, n_terms long, ids array<bigint>, lengths array<bigint>, terms array<string>, df array<bigint>, ends array<bigint>, postings binary"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, terms) of each text: terms[offsets[k]:offsets[k + 1]] are those of text k, repeats included; a null text has none."""
    texts = plain(texts)
    if not len(texts):
        return np.zeros(1, np.int64), pa.array([], pa.large_string())
    _, ends, data = texts.buffers()
    spaced = pa.LargeStringArray.from_buffers(len(texts), ends, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(_BYTES)))
    lists = pc.split_pattern(spaced, " ")
    offsets, words = np.asarray(lists.offsets, np.int64), lists.flatten()
    some = pc.not_equal(words, "")
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return before[offsets - offsets[0]], words.filter(some)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, low bits first, the last byte of each below 128; and where each ends."""
    n = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[(ends - n)[some] + k] = (values[some] >> 7 * k & 127) | np.where(n[some] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        some = first + k <= last
        out[some] |= (data[first[some] + k].astype(np.int64) & 127) << 7 * k
    return out


def shard_of(ids: pa.Array, texts: pa.Array) -> dict:
    """A row of INDEX. Documents are numbered in order of doc_id, null last; a posting is the gap to the one before and tf."""
    order = pc.sort_indices(pa.table({"id": ids}), [("id", "ascending")], null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    offsets, words = terms_of(texts)
    lengths = np.diff(offsets)
    coded = words.dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    place = np.empty(len(by_name), np.int64)
    place[by_name.to_numpy()] = np.arange(len(by_name))
    n = max(1, len(ids))
    key, tf = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = key // n, key % n
    new = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
    gap = doc - np.where(new, 0, np.concatenate(([0], doc[:-1])))
    data, ends = packed(np.stack((gap, tf), axis=1).ravel())
    at = np.append(np.flatnonzero(new), len(term))
    return {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "ids": ids, "lengths": lengths, "terms": coded.dictionary.take(by_name), "df": np.diff(at), "ends": ends[2 * at[1:] - 1] if len(term) else at[:0], "postings": data.tobytes()}


def build_index(docs: DataFrame) -> DataFrame:
    """An index (INDEX) of docs(doc_id, text) in the shared folder: one row for each shard, which is a stretch of a task's rows.

    Nothing is shuffled, and a row holds no more than SHARD_BYTES of text need. Null and empty texts have no
    terms and don't count as documents; rows that repeat, or have no doc_id, are documents of their own.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        held, size, rows = [], 0, 0
        for b in batches:
            if held and (size + b.nbytes > SHARD_BYTES or rows + b.num_rows > SHARD_DOCUMENTS):
                yield row(held)
                held, size, rows = [], 0, 0
            held.append(b)
            size, rows = size + b.nbytes, rows + b.num_rows
        if held:
            yield row(held)

    def row(held) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        s = shard_of(*(pa.concat_arrays(table.column(k).chunks) for k in range(2)))
        some = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if isinstance(x, np.ndarray) else x.cast(kind))
        columns = [pa.array([s["n_docs"]]), pa.array([s["n_terms"]]), some(s["ids"], pa.int64()), some(s["lengths"], pa.int64()), some(s["terms"], pa.string()), some(s["df"], pa.int64()), some(s["ends"], pa.int64()), pa.array([s["postings"]], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # row groups of a few shards, so that no reader holds more of them at once
    return stash(lean.mapInArrow(run, INDEX), "lexical-index", **{"parquet.block.size": str(SHARD_BYTES)})


class Lists:
    """The postings of one shard that a block of queries needs, unpacked when first asked for."""

    def __init__(self, row: dict, wanted: pa.Array, n: int, total: int) -> None:
        self.at = pc.index_in(wanted, row["terms"].values.cast(pa.large_string())).to_pylist()
        self.ids = row["ids"].values
        self.data = np.frombuffer(row["postings"].as_py(), np.uint8)
        self.ends = np.concatenate(([0], row["ends"].values.to_numpy()))
        self.m = 25 + 75 * row["lengths"].values.to_numpy() * n // max(1, total)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(documents in order, parts of the score before the term's weight)."""
        at = self.at[term]
        if at is None:
            return None
        if term not in self.known:
            pairs = unpacked(self.data[self.ends[at] : self.ends[at + 1]])
            doc, tf = np.cumsum(pairs[::2]), pairs[1::2]
            self.known[term] = doc, 1_000_000_000 * tf // (1000 * tf + 8 * self.m[doc])
        return self.known[term]


def _added(docs: np.ndarray, sums: np.ndarray, one: tuple) -> None:
    """Adds the parts that a list has for these documents."""
    _, own, gain = one
    k = np.minimum(np.searchsorted(own, docs), len(own) - 1)
    sums += np.where(own[k] == docs, gain[k], 0)


def merged(lists: list[tuple[int, np.ndarray, np.ndarray]], top: int, floor: int) -> Iterator[tuple[int, int]]:
    """(document, score) of one shard, document by document, of all whose score is at least floor, if top of them reach it.

    lists are (greatest part, documents, parts). A heap merges the lists in order of documents. Lists that together can't
    reach the floor start no document: those that the others start look into them while they can still reach it.
    """
    lists = sorted(lists, key=lambda x: (x[0], -len(x[1])))
    reach = np.cumsum([x[0] for x in lists])
    if not floor and len(lists) > 1:
        seeds = np.unique(np.concatenate([x[1][:SEEDS] for x in sorted(lists, key=lambda x: len(x[1]))[:3]]))
        sums = np.zeros(len(seeds), np.int64)
        for one in lists:
            _added(seeds, sums, one)
        if len(sums) >= top:
            floor = int(np.partition(sums, -top)[-top])
    idle = int(np.searchsorted(reach, floor))  # lists whose greatest parts sum to less
    docs: list[int] = []
    sums: list[int] = []
    for doc, gain in heapq.merge(*(zip(d.tolist(), g.tolist(), strict=True) for _, d, g in lists[idle:])):
        if docs and docs[-1] == doc:
            sums[-1] += gain
        else:
            docs.append(doc)
            sums.append(gain)
    doc, score = np.array(docs, np.int64), np.array(sums, np.int64)
    for k in range(idle - 1, -1, -1):
        may = score + reach[k] >= floor
        doc, score = doc[may], score[may]
        _added(doc, score, lists[k])
    may = score >= max(1, floor)
    yield from zip(doc[may].tolist(), score[may].tolist(), strict=True)


def query_blocks(items: DataFrame) -> Iterator[tuple[list, list[Counter]]]:
    """Items(item_id, text) in blocks of about ITEMS rows and CHARACTERS characters: their ids, and their terms with repeats."""
    lean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = lean.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-chars // CHARACTERS))
    for k in range(parts):
        part = lean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else lean
        rows = list(part.toLocalIterator())
        offsets, words = terms_of(pa.array([r["text"] for r in rows], pa.string()))
        words = words.to_pylist()
        yield [r["item_id"] for r in rows], [Counter(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of an index for each row of items(item_id, text).

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document's score sums weight * (10^9 tf div (1000 tf + 8 m))
    over the item's terms with repeats, m being 25 + 75 n N div L. Only scores above 0 count; equal ones rank by ascending doc_id,
    a null doc_id last. Items that repeat are each ranked; items without terms, or with terms that no document has, give no rows,
    nor does an empty index. A task keeps `top` documents of each item of a block; the blocks bound what tasks hold.
    """
    spark = index.sparkSession
    bounded_batches(spark, rows=4)
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def block(number: int, ids: list, queries: list[Counter]) -> DataFrame:
        names = sorted(set().union(*queries))
        wanted = pa.array(names, pa.large_string())

        def counts(batches):
            for b in batches:
                for terms, df in zip(b.column(0), b.column(1), strict=True):
                    at = pc.index_in(wanted, terms.values.cast(pa.large_string()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))), df.values.take(at.drop_null())], ["term", "df"])

        df = dict.fromkeys(range(len(names)), 0) | {r["term"]: r["df"] for r in index.select("terms", "df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[k] + 1))) for k in range(len(names))]
        code = {w: k for k, w in enumerate(names)}
        asked = [[(code[w], weight[code[w]] * times) for w, times in q.items()] for q in queries]

        def run(batches):
            best: list[list[tuple]] = [[] for _ in asked]  # heaps of (score, has an id, -doc_id), the least first
            for b in batches:
                for k in range(b.num_rows):
                    shard = Lists({c: b.column(c)[k] for c in b.schema.names}, wanted, n, total)
                    for q, heap in zip(asked, best, strict=True):
                        lists = [(int(w * p[1].max()), p[0], w * p[1]) for t, w in q if w and (p := shard.get(t))]
                        for doc, score in merged(lists, top, heap[0][0] if len(heap) == top else 0) if lists else ():
                            i = shard.ids[doc].as_py()
                            entry = (score, i is not None, -(i or 0))
                            if len(heap) < top:
                                heapq.heappush(heap, entry)
                            elif entry > heap[0]:
                                heapq.heapreplace(heap, entry)
            rows = [(q, -i if there else None, score) for q, heap in enumerate(best) for score, there, i in heap]
            if rows:
                q, doc, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array([ids[k] for k in q], pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["block", "q", "item_id", "doc_id", "score"])

        return index.select("ids", "lengths", "terms", "ends", "postings").mapInArrow(run, "block int, q int, item_id long, doc_id long, score long")

    found = reduce(DataFrame.unionByName, [block(k, *b) for k, b in enumerate(query_blocks(items))])
    order = W.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item; null and empty texts and tables as in build_index() and search()."""
    return search(build_index(read(spark, sf_dir, "documents", "doc_id", "text")), read(spark, sf_dir, "benchmark", "item_id", "text"))


_TERM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERM} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM d) GROUP BY r, w),
df AS (SELECT w, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY w),
q AS (SELECT i, item_id, w, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(t) AS w FROM (SELECT row_number() OVER () AS i, item_id, {_TERM} AS t FROM benchmark WHERE text IS NOT NULL)) GROUP BY i, item_id, w),
s AS (
  SELECT q.i, q.item_id, n.r, n.doc_id, sum(q.times * df.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * c.n_docs) // c.total))))::BIGINT AS score
  FROM q JOIN df USING (w) JOIN tf USING (w) JOIN n ON n.r = tf.r, c GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
