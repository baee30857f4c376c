"""Embedding near-duplicates: product quantisation over coarse lists, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, read, stash
from tracewright.llm.bk_tree import least_labels
from tracewright.llm.components import connected

COSINE = 0.9
#: Vectors that the index is fitted on, drawn by a hash of the id.
SAMPLE = 16_384
#: Aimed-for vectors in a coarse list, and the most lists.
LIST, LISTS = 400, 2048
#: Lists that a vector searches, its own among them.
PROBES = 8
#: Parts of a vector, and codes of each.
SUBSPACES, CODES = 16, 64
ROUNDS = 8
#: Members and searchers of a list in one task's table; longer lists are dealt into blocks of about that many. A member is
#: sent once for each block of searchers and a searcher once for each block of members, so blocks of the many are larger.
BLOCK, SEARCHERS = 512, 1024
SEED = 5


def _squares(parts, shape) -> np.ndarray:
    """The sum of squares of arrays of one shape, added in their order: each number is the same whatever else is in the arrays."""
    out = np.zeros(shape)
    for x in parts:
        out += x * x
    return out


@dataclass(frozen=True)
class Index:
    """centres: lists x d; codes: subspaces x CODES x (d / subspaces); error: the largest residual left by its code, of nearly all sampled vectors."""

    centres: np.ndarray
    codes: np.ndarray
    error: float

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        d = (self.centres * self.centres).sum(axis=1) - 2 * (x @ self.centres.T)
        k = min(probes, len(self.centres))
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.take_along_axis(d, top, axis=1).argsort(axis=1, kind="stable"), axis=1)

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([self.table(residuals, m).argmin(axis=1) for m in range(len(self.codes))], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.codes[np.arange(len(self.codes)), codes].reshape(len(codes), -1)

    def table(self, residuals: np.ndarray, m: int) -> np.ndarray:
        """Squared distances of one part of each residual to the codes of that part; a row's numbers don't depend on the other rows."""
        part = residuals.reshape(len(residuals), len(self.codes), -1)[:, m]
        return _squares((part[:, j : j + 1] - self.codes[m][:, j] for j in range(part.shape[1])), (len(part), len(self.codes[m])))

    def distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of exact residuals of queries to coded ones: one table per query, one look-up per subspace."""
        out = np.zeros((len(queries), len(codes)))
        for m in range(len(self.codes)):
            out += self.table(queries, m)[:, codes[:, m]]
        return out

    def distances_of_pairs(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The same numbers, to the last bit, as distances() has for each query and the code of its own row."""
        out = np.zeros(len(queries))
        parts = queries.reshape(len(queries), len(self.codes), -1)
        for m, c in enumerate(self.codes):
            out += _squares((parts[:, m, j] - c[codes[:, m], j] for j in range(c.shape[1])), len(queries))
        return out


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centres * centres).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def fit(sample: np.ndarray, n: int, subspaces: int) -> Index:
    """An index for n unit vectors from a sample of them."""
    centres = k_means(sample, int(min(LISTS, max(1, n // LIST))))
    index = Index(centres, np.zeros((subspaces, 1, sample.shape[1] // subspaces)), 0.0)
    residuals = sample - centres[index.lists(sample, 1)[:, 0]]
    parts = residuals.reshape(len(sample), subspaces, -1)
    some = parts[:: max(1, len(parts) // 4096)]
    codes = np.stack([np.resize(c := k_means(some[:, m], CODES), (CODES, c.shape[1])) for m in range(subspaces)])
    index = Index(centres, codes, 0.0)
    left = np.sqrt(((residuals - index.decode(index.encode(residuals))) ** 2).sum(axis=1))
    return Index(centres, codes, float(np.quantile(left, 0.999)) if len(left) else 0.0)


def usable() -> F.Column:
    """Whether a vector can link: neither null nor zero, and every component a finite number."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable vectors; x has length one in double precision."""
    x = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    scaled = x.withColumn("most", F.array_max(F.transform("x", F.abs))).withColumn("x", F.transform("x", lambda v: v / F.col("most")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return scaled.withColumn("norm", norm).select("vec_id", F.transform("x", lambda v: v / F.col("norm")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def assigned(points: DataFrame, index: Index) -> DataFrame:
    """(node, n, x) with the lists that each point searches, its own first."""

    def run(batches):
        for b in batches:
            found = index.lists(matrix(b.column(2)), PROBES)
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["node", "n", "x", "lists"])

    return points.select("node", "n", "x").mapInArrow(run, "node long, n long, x array<double>, lists array<int>")


def _search(index: Index, cosine: float):
    """Streams rows sorted by (list, i, j): members of block i of a list (side 0) and searchers of block j (side 1)."""
    # the true distance is at most that to the code plus the error of the code
    reach = (np.sqrt(2 - 2 * cosine) + index.error) ** 2

    def unit(t: pa.Table):
        side = t.column("side").to_numpy()
        node, n, x = t.column("node").to_numpy(), t.column("n").to_numpy(), matrix(t.column("x"))
        lists = matrix(t.column("lists")).astype(np.int64)
        which = int(t.column("list")[0].as_py())
        m, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(m) or not len(q):
            return
        codes = index.encode(x[m] - index.centres[which])
        near = index.distances(x[q] - index.centres[which], codes) <= reach
        a, b = np.nonzero(near)
        exact = np.concatenate([np.einsum("ij,ij->i", x[q[a[k : k + 65536]]], x[m[b[k : k + 65536]]]) for k in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine
        a, b = a[exact], b[exact]
        other = node[q[a]] != node[m[b]]
        a, b = a[other], b[other]
        # a pair that its member finds from its own side, too, counts there for the member; the coded distance of that side tells
        home = lists[q[a], 0]
        both = (lists[m[b]] == home[:, None]).any(axis=1)
        c = np.flatnonzero(both)
        for k in range(0, len(c), 65536):
            part = c[k : k + 65536]
            centre = index.centres[home[part]]
            both[part] = index.distances_of_pairs(x[m[b[part]]] - centre, index.encode(x[q[a[part]]] - centre)) <= reach
        links = np.zeros(len(node), np.int64)
        np.add.at(links, q[a], n[m[b]])
        np.add.at(links, m[b[~both]], n[q[a[~both]]])
        every, place = np.unique(node, return_inverse=True)  # in ascending order, so the least place is the least node
        labels = least_labels(len(every), place[q[a]], place[m[b]])
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, links)
        keep = total > 0
        yield every[keep], every[labels[keep]], total[keep]

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    key = tuple(keys[:, s])
                    if held and key != last:
                        yield from out(held)
                        held = []
                    last = key
                    held.append(b.slice(s, e - s))
        if held:
            yield from out(held)

    def out(held):
        for node, root, links in unit(pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links)], ["node", "root", "links"])

    return run


def linked(points: DataFrame, sizes: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(node, root, links) from every block of every list; links of a node add up, and (node, root) join its component.

    sizes(list, n) counts the members and searchers of a list; a longer list is dealt into blocks, and each
    pair of a block of members and one of searchers is a unit of its own.
    """
    probe = points.select("node", "n", "x", "lists", F.posexplode("lists").alias("place", "list"))
    parts = sizes.select("list", F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.lit(1)).cast("int").alias("mp"), F.greatest(F.ceil(F.col("searchers") / F.lit(SEARCHERS)), F.lit(1)).cast("int").alias("qp"))
    dealt = probe.join(F.broadcast(parts), "list")  # at most LISTS rows
    hashed = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    members = dealt.where("place = 0").select("list", hashed("mp", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("qp") - 1)).alias("j"), F.lit(0).alias("side"), "node", "n", "lists", "x")
    searchers = dealt.select("list", F.explode(F.sequence(F.lit(0), F.col("mp") - 1)).alias("i"), hashed("qp", 2).alias("j"), F.lit(1).alias("side"), "node", "n", "lists", "x")
    units = members.unionByName(searchers).repartition(F.col("list"), F.col("i"), F.col("j")).sortWithinPartitions("list", "i", "j")
    return units.mapInArrow(_search(index, cosine), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Equal vectors are one point that counts as often as it occurs, so a group of copies costs a row for
    each of them and no pairs. A pair is found if one of its points searches the other's list and its
    coded distance is within reach; it links if its exact cosine is at least `cosine`. Both points count
    it. Vectors of different lengths never link. Null and zero vectors and those with a null or
    non-finite component have no links and are their own component. A row that repeats a vec_id links
    with the other; a null vec_id is its own component if alone. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=2048)
    rows = stash(unit_vectors(vectors).withColumn("key", F.xxhash64("x")), "vectors")
    groups = rows.groupBy("key", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    # a point is known by a number of its own, as unlike vectors may share a hash
    points = stash(groups.select(F.monotonically_increasing_id().alias("node"), "key", "x", "n", "least"), "vector-points")
    links, roots = None, None
    for r in sorted(r["d"] for r in points.select(F.size("x").alias("d")).distinct().collect()):
        l, e = _of_size(points.where(F.size("x") == r), r, cosine, sample)
        links, roots = (l, e) if links is None else (links.unionByName(l), roots.unionByName(e))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if links is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = points.join(links, "node", "left").join(connected(roots, "vectors"), "node", "left").select("key", "x", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("key", "x", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    found = rows.join(classes, ["key", "x"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_size(points: DataFrame, d: int, cosine: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) and edges (a, b) of the points of one length."""
    n = points.count()
    draw = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / n) * (1 << 20)))
    drawn = points.where(draw).select("x").limit(2 * sample).toArrow() if n > 1 else None
    x = matrix(drawn.column("x")) if drawn is not None and drawn.num_rows else np.eye(1, d)
    x = x[np.lexsort(x.T[::-1])]  # rows arrive in any order; the fit is the same each time
    index = fit(x, n, next(m for m in range(min(SUBSPACES, d), 0, -1) if d % m == 0))
    placed = stash(assigned(points, index), "vector-lists")
    sizes = placed.select(F.posexplode("lists").alias("place", "list")).groupBy("list").agg(F.count_if(F.col("place") == 0).alias("members"), F.count("*").alias("searchers"))
    found = stash(linked(placed, sizes, index, cosine), "vector-links")
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole embeddings table; nulls, zero vectors, repeated rows and an empty table as there."""
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
