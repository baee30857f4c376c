"""SimHash near-duplicates of a wide radius: trees in shards of rare shingles, then exact similarity of whole sets.

Within two bits, blocks of a fingerprint make shards (simhash_dedup.links). A radius that covers a similarity of 0.8
leaves no block alike, so here texts meet in the shards of their rarest shingles: sets of that similarity share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import bits_of, bounded_batches, in_bits, mix, stash
from tracewright.llm.bk_tree import Forest
from tracewright.llm.components import connected

SHINGLE = 5
#: Least similarity as a fraction, so that counts are compared as integers.
PART, WHOLE = 4, 5
#: Sets of similarity 0.8 differ in about 10 of 64 bits with a deviation of 3, and in 20 of 128 with one of 4.
RADIUS, RADIUS_BOTH = 22, 38
#: Sets of so few shingles are compared whatever their fingerprints, which a single shingle changes much.
SMALL = 8
#: Texts from which the common shingles are learnt, and how many of those are kept. They set only the order and the dealing of shingles, not the result.
SAMPLE, COMMON = 20_000, 100_000
#: Texts of one dealt part of a common shingle's shard, of one tree, and of one part of the texts that meet another text.
DEALT, TREE, MEET = 4096, 256, 512
SEED = 42
#: Bits of the map that lets rows pass without a shuffle; a map too small for the rows only lets more of them be shuffled.
BITS = 1 << 24


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of one text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n))


def simhash(own: np.ndarray) -> int:
    """The fingerprint of a set of hashes as a signed 64-bit integer; no hashes give zero. mix() of the hashes gives another one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def common_shingles(rows: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, estimated number of the n rows that have each) of those that at least one in a thousand of a sample of the texts has."""
    share = min(1.0, SAMPLE / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"", size).view(np.int64))], ["token"])

    least = max(3, min(n, SAMPLE) // 1000)
    counted = some.select(F.col("text").cast("string")).mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counted.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    token, count = np.array([r["token"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(token)
    return token[order], (count[order] / share).astype(np.int64)


def marked(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """(row, n, digest, fp, fp2, score, prefix, deal) of every text: size, digest and fingerprints of its set, how common its shingles are, and its rarest fifth and one more.

    Sets of similarity PART / WHOLE share a shingle of these prefixes in any order that all texts keep; here the common come
    last. deal is 0 for a shingle that isn't common, else one more than the part of its shard that the text is dealt to.
    """
    tokens, counts = common

    def run(batches):
        import xxhash

        for b in batches:
            out = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = shingles(t or b"", size)
                n, rank = len(own), np.zeros(len(own), np.int64)
                if n and len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    rank = np.where(tokens[at] == own, counts[at], 0)
                order = np.argsort(rank, kind="stable")[: n - -(-PART * n // WHOLE) + 1] if n else np.empty(0, np.int64)
                deal = np.where(rank[order] > 0, 1 + xxhash.xxh32_intdigest(row.to_bytes(8, "little"), SEED) % (1 + rank[order] // DEALT), 0)
                out.append((row, n, xxhash.xxh3_128_digest(own.tobytes()), simhash(own), simhash(mix(own)), int(rank.mean() * 1000 // (1 + rank.max())) if n else 0, own[order].view(np.int64), deal))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["row", "n", "digest", "fp", "fp2", "score", "prefix", "deal"]
    return rows.select("_row", F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, n int, digest binary, fp long, fp2 long, score int, prefix array<long>, deal array<int>")


def near_enough(shared, n, m):
    """Whether sets of n and m shingles that share so many, at most, can have the least similarity."""
    return shared * (PART + WHOLE) >= (n + m) * PART


def near_prints() -> Column:
    """Whether the fingerprints of a text and of the first of its part are near enough to compare their sets."""
    one, two = (F.bit_count(F.col(c).bitwiseXOR(F.col(f"c_{c}"))) for c in ("fp", "fp2"))
    return ((one <= RADIUS) & (one + two <= RADIUS_BOTH)) | (F.col("n") <= SMALL) | (F.col("c_n") <= SMALL)


def slots(row: np.ndarray) -> np.ndarray:
    """The bit of each row number."""
    return (row + (row >> 33) * 1_000_003) % BITS


def bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for each slot, set for those of rows(_row); BITS / 8 bytes, whatever the number of rows."""
    row = F.col("_row")
    at = (row + F.shiftright(row, 33) * 1_000_003) % BITS
    parts = rows.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    bits = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts:
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def marked_in(bits: np.ndarray, row: pa.Array) -> np.ndarray:
    at = slots(row.to_numpy())
    return (bits[at >> 3] >> (at & 7)) & 1 > 0


SHARD = "token long, deal int, node long, n int, at int, fp long, fp2 long, prev long, c_node long, c_n int, c_at int, c_fp long, c_fp2 long"


def shards(nodes: DataFrame) -> DataFrame:
    """(SHARD) of every text in every part of a shard that holds another, with the part's first: its text of the most common shingles.

    A part is streamed, whatever its size. The first text of a part has a row of its own if another follows, or if
    the shingle is common, as other parts of the shard may then hold others.
    """
    shared = nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    entries = _entries(nodes, bits_of(shared, "token"))
    dealt = entries.repartition("token", "deal").sortWithinPartitions("token", "deal", F.desc("score"), "node").drop("score")

    def run(batches):
        held: list[np.ndarray] = []  # the first text of the last part, and whether its own row is out
        out = False
        for b in batches:
            x = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            if not x.shape[1]:
                continue
            if held:
                x = np.concatenate((held[0][:, None], x), axis=1)
            first = np.concatenate(([True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)))
            lead = np.maximum.accumulate(np.where(first, np.arange(x.shape[1]), 0))
            many = np.zeros(x.shape[1], bool)
            many[lead[~first]] = True
            own = first & (many | (x[1] > 0))
            if held and out:
                own[0] = False
            out = bool(many[lead[-1]] or x[1, -1] > 0)
            keep = np.flatnonzero(~first | own)
            held = [x[:, lead[-1]].copy()]
            if len(keep):
                y = np.concatenate((x[:, keep], x[2:7, lead[keep]]))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(y, types, strict=True)], names)

    names = [c.split()[0] for c in SHARD.split(", ")]
    types = [pa.int64() if c.split()[1] == "long" else pa.int32() for c in SHARD.split(", ")]
    return dealt.select(*names[:8]).mapInArrow(run, SHARD)


def _entries(nodes: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row for each shingle of the prefixes that may stand in another's, too, by a map of the shared ones.

    prev has half the bits of each of the two shingles before it, or of the row's number where there are none.
    """
    names = ["token", "deal", "node", "n", "at", "fp", "fp2", "prev", "score"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        for b in batches:
            row, n, fp, fp2, score = (b.column(c).to_numpy() for c in ("row", "n", "fp", "fp2", "score"))
            token = b.column("prefix").flatten().to_numpy()
            deal = b.column("deal").flatten().to_numpy()
            size = np.diff(b.column("prefix").offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), size)
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            high = token.view(np.uint64) >> np.uint64(32)
            none = mix(row.view(np.uint64))[of] >> np.uint64(32)
            back = [np.where(at >= k, np.concatenate((none[:k], high[:-k])) if len(high) >= k else none, none) for k in (1, 2)]
            prev = (back[0] << np.uint64(32) | back[1]).view(np.int64)
            keep = np.flatnonzero(in_bits(bits, token))
            of, at = of[keep], at[keep]
            columns = [token[keep], deal[keep], row[of], n[of], at, fp[of], fp2[of], prev[keep], score[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types, strict=True)], names)

    schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'int'}" for c, t in zip(names, types, strict=True))
    return nodes.select("row", "n", "fp", "fp2", "score", "prefix", "deal").mapInArrow(run, schema)


def tree_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): texts of entries(token, node, n, at, fp, fp2, prev, root) in one shard that are still apart and near enough by fingerprint, size and place.

    A shard beyond TREE texts is dealt into several trees, and each tree meets each other part of the shard in a
    task of its own, so that no task holds a large shard.
    """
    sizes = entries.groupBy("token").agg(F.ceil(F.count("*") / F.lit(TREE)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    spread = entries.join(sizes, "token").withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    units = spread.select("token", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), F.when(F.col("mine") <= F.col("o"), 0).otherwise(1).alias("side"), "node", "n", "at", "fp", "fp2", "prev", "root")
    units = units.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pairs(x: np.ndarray) -> np.ndarray:
        """The pairs of whole units: rows token, i, j, side, node, n, at, fp, fp2, prev, root, sorted by the first three."""
        unit = np.concatenate(([0], np.cumsum((x[:3, 1:] != x[:3, :-1]).any(axis=0))))
        values, queries = np.flatnonzero(x[3] == 0), np.flatnonzero(x[3] == 1)
        alone = np.flatnonzero(x[1, values] == x[2, values])  # one part of a shard, which meets itself
        queries = np.concatenate((queries, values[alone]))
        first = np.minimum(np.searchsorted(unit[values], unit[queries]), max(len(values) - 1, 0))
        met = unit[values[first]] == unit[queries] if len(values) else np.zeros(len(queries), bool)
        queries, first = queries[met], first[met]
        q, v = Forest(x[7, values], unit[values]).within(x[7, queries], first, RADIUS)
        both = np.bitwise_count((x[7, queries[q]] ^ x[7, values[v]]).view(np.uint64)) + np.bitwise_count((x[8, queries[q]] ^ x[8, values[v]]).view(np.uint64)).astype(np.int64)
        q, v = q[both <= RADIUS_BOTH], v[both <= RADIUS_BOTH]
        few = np.flatnonzero(x[5, queries] <= SMALL)
        size = np.bincount(unit[values], minlength=unit[-1] + 1)
        of_few = size[unit[queries[few]]]
        more_q = np.repeat(few, of_few)
        more_v = np.repeat(first[few] - np.cumsum(of_few) + of_few, of_few) + np.arange(int(of_few.sum()))
        a, b = x[4:, queries[np.concatenate((q, more_q))]], x[4:, values[np.concatenate((v, more_v))]]
        earlier = np.zeros(a.shape[1], bool)  # both hold one of the shingles before this one, so they meet in its shard
        for x1 in (a[5] >> 32, a[5] & 0xFFFFFFFF):
            for x2 in (b[5] >> 32, b[5] & 0xFFFFFFFF):
                earlier |= x1 & 0xFFFFFFFF == x2 & 0xFFFFFFFF
        keep = ~earlier & (a[6] != b[6]) & near_enough(np.minimum(a[1] - a[2], b[1] - b[2]), a[1], b[1])
        return np.unique(np.stack((np.minimum(a[0], b[0])[keep], np.maximum(a[0], b[0])[keep])), axis=1)

    def run(batches):
        held = np.empty((11, 0), np.int64)
        for b in batches:
            held = np.concatenate((held, np.stack([c.to_numpy().astype(np.int64) for c in b.columns])), axis=1)
            cuts = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            if len(cuts) and held.shape[1] >= 4096:
                yield out(held[:, : cuts[-1]])
                held = held[:, cuts[-1] :]
        if held.shape[1]:
            yield out(held)

    def out(x: np.ndarray) -> pa.RecordBatch:
        a, b = pairs(x)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs(a, b) of rows whose sets have the least similarity, by their whole sets.

    Texts meet the first text of their pair: it comes once to each part of about MEET of them, and each part is streamed.
    """
    pairs = stash(pairs, "similar-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(MEET)).cast("int").alias("parts"))
    seconds = pairs.join(parts, "a").select(F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    firsts = parts.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tags = stash(firsts.unionByName(seconds), "similar-tags")
    bits = bitmap(tags.select(F.col("row").alias("_row")))

    def texts(batches):
        for b in batches:
            yield b.filter(pa.array(marked_in(bits, b.column(0))))

    def run(batches):
        first = whole = None
        for b in batches:
            keep = []
            for a, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = shingles((text or "").encode(), size)
                if a == row:
                    first, whole = a, own
                elif a == first and near_enough(len(np.intersect1d(whole, own, assume_unique=True)), len(whole), len(own)):
                    keep.append((a, row))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64())], ["a", "b"])

    own = rows.select("_row", F.col("text").cast("string").alias("text")).mapInArrow(texts, "_row long, text string")
    met = tags.join(own, F.col("row") == F.col("_row")).select("a", "part", "row", "text")
    return met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("row") != F.col("a")).select("a", "row", "text").mapInArrow(run, "a long, b long")


def components(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row, root) for every row of rows(_row, text): root is one row for each group that chains of near copies join.

    Texts of the same set are one node. Nodes that share a rare shingle (see marked) meet in its shard. First each meets
    its most common text, which settles a large group of copies by as many pairs as it has nodes; then trees find the pairs
    of nodes still apart. A pair goes on if its fingerprints are at most RADIUS apart, and whole sets decide.
    """
    bounded_batches(rows.sparkSession)
    every = stash(marked(rows, common_shingles(rows, rows.count(), size), size), "similar-marked")
    least = F.min(F.struct("row", "n", "fp", "fp2", "score", "prefix", "deal"))
    met = stash(shards(every.groupBy("digest").agg(least.alias("x")).select("x.*")), "similar-shards")

    pair = [F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")]
    other = F.col("node") != F.col("c_node")
    room = near_enough(F.least(F.col("n") - F.col("at"), F.col("c_n") - F.col("c_at")), F.col("n"), F.col("c_n"))
    near = other & room & near_prints()
    # the first texts of the parts of a common shingle's shard meet one of them
    leads = met.where((F.col("deal") > 0) & ~other)
    hub = leads.groupBy("token").agg(F.min(F.struct("node", "n", "at", "fp", "fp2")).alias("c")).select("token", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "n", "at", "fp", "fp2")])
    hubs = leads.select("token", "node", "n", "at", "fp", "fp2").join(hub, "token")
    first = met.where(near).select(*pair).unionByName(hubs.where(near).select(*pair)).distinct()
    edges = stash(verified(first, rows, size), "similar-links")
    roots = connected(edges, "similar")

    apart = met.select("token", "node", "n", "at", "fp", "fp2", "prev").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(2):
        # a node whose shingle stands too late even for the smallest other set of the shard has no partner there
        open_ = apart.groupBy("token").agg(F.min("n").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "least")
        apart = stash(apart.join(open_, "token").where(near_enough(F.col("n") - F.col("at"), F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * PART / WHOLE)))).drop("least"), "similar-apart")
    rest = stash(tree_pairs(apart).join(first, ["a", "b"], "left_anti"), "similar-rest")
    if not rest.isEmpty():
        edges = edges.unionByName(stash(verified(rest, rows, size), "similar-links"))
        roots = connected(edges, "similar")
    of_digest = every.groupBy("digest").agg(F.min("row").alias("node")).join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return every.select("row", "digest").join(of_digest, "digest").select("row", "root")
