"""SimHash near-duplicates: shard trees with children keyed by integer Hamming distance (BK-trees)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import simhash_similar
from tracewright.llm._common import bounded_batches, hex16, numbered, read, stash
from tracewright.llm.bk_tree import Tree, least_labels
from tracewright.llm.components import connected

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Equal parts of a fingerprint; within RADIUS at least BLOCKS - RADIUS of them agree.
BLOCKS = 4
#: Largest number of fingerprints in one tree; a larger shard becomes several trees, each sent to all its queries.
TREE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer; no words give zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of docs; a null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def shard_key(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """Shards of a fingerprint: for every choice of blocks - radius blocks, the choice and their bits."""
    width = 64 // blocks
    picks = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << width) - 1) << (width * i) for i in pick) for pick in picks]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).cast("int").alias("pick"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])


def _tree_links(radius: int):
    """Streams rows sorted by (pick, bits, i, j); i is the tree, side 0 its values, side 1 queries of another part of the shard."""

    def links(fps: np.ndarray, side: np.ndarray):
        values = fps[side == 0]
        if not len(values) or len(fps) < 2:
            return
        tree = Tree(values)
        others = fps[side == 1]
        queries = others if len(others) else values
        q, x = tree.within(queries, radius)
        every = np.concatenate((values, others))
        labels = least_labels(len(every), q + (len(values) if len(others) else 0), x)
        own = np.arange(len(every))
        # the least fingerprint of each local component stands for it
        order = np.argsort(every, kind="stable")
        least = np.full(len(every), -1)
        least[labels[order[::-1]]] = order[::-1]
        root = every[least[labels]]
        keep = (root != every[own]) & (np.bincount(labels, minlength=len(every))[labels] > 1)
        yield root[keep], every[keep]

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(6)]))
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            if not len(new):
                held = [rows]
                continue
            yield from blocks(rows[:, : new[-1]])
            held = [rows[:, new[-1] :]]
        if held:
            yield from blocks(np.concatenate(held, axis=1))

    def blocks(rows: np.ndarray):
        cuts = np.concatenate(([0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1, [rows.shape[1]]))
        a, c = [], []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            part = rows[:, cuts[k] : cuts[k + 1]]
            for x, y in links(part[5], part[4]):
                a.append(x)
                c.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """Edges (a, b) that join all fingerprints of nodes(fp) that are at most radius bits apart.

    Fingerprints within the radius agree on blocks - radius blocks, so they meet in a shard. A shard
    with more than `tree` fingerprints is dealt into parts of about that size, one tree each; a tree's
    rows and those of each other part meet in a task of their own, so no task holds a whole large shard.
    Only the edges of a spanning forest of each task leave it, never all pairs.
    """
    spread = nodes.select("fp", F.explode(shard_key(F.col("fp"), blocks, radius)).alias("s")).select("fp", "s.pick", "s.bits")
    sizes = spread.groupBy("pick", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(tree)).cast("int")
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int")
    member = (
        spread.join(sizes, ["pick", "bits"])
        .select("fp", "pick", "bits", parts.alias("parts"))
        .withColumn("mine", mine)
        # unit (i, j), i <= j: the tree of part i against the queries of part j
        .select("fp", "pick", "bits", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        .select("pick", "bits", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), F.when(F.col("mine") <= F.col("o"), 0).otherwise(1).alias("side"), "fp")
    )
    unit = member.repartition(F.col("pick"), F.col("bits"), F.col("i"), F.col("j")).sortWithinPartitions("pick", "bits", "i", "j")
    return unit.mapInArrow(_tree_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    Words are runs without ASCII white space after lower-casing A-Z; a text of fewer than three words
    is one shingle, and one without words (or null) has fingerprint zero and links like any other.
    Repeated rows have the same fingerprint and so one component; component_id is the smallest doc_id
    there, a null doc_id never being smallest. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    marked = stash(fingerprints(docs), "simhash-docs")
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected(links(nodes.select("fp"), radius, blocks, tree), "simhash")
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole documents table, fingerprints as hex digits; nulls, empty texts, repeated rows and an empty table as there."""
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = simhash_similar.SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near copies: the one of the smallest doc_id, and of such rows the first.

    Near copies have a Jaccard similarity of 0.8 or more of their sets of five-word shingles (see simhash_similar); chains
    of them are one group. Words are runs without ASCII white space after lower-casing A-Z. A null doc_id is never smallest.
    Texts without words are copies of each other. Columns may have any names; no rows give no rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = numbered(named, "simhash-rows")
    ids = rows.select(F.col("_row").alias("row"), doc_id.cast("long").alias("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    groups = stash(simhash_similar.components(rows.select("_row", text.alias("text")), shingle), "simhash-groups").join(ids, "row")
    kept = groups.groupBy("root").agg(least.alias("kept"))
    gone = stash(groups.join(kept, "root").where("row <> kept").select(F.col("row").alias("_row")), "simhash-gone")
    bits = simhash_similar.bitmap(gone)

    def part(some: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(simhash_similar.marked_in(bits, b.column(at)) == some))

        return rows.mapInArrow(run, rows.schema)

    # rows without a bit stay for certain; the others meet the rows that go in a join
    at = rows.columns.index("_row")
    return part(False).unionByName(part(True).join(gone.hint("merge"), "_row", "left_anti")).select(*names).toDF(*docs.columns)
