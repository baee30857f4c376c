"""Connected components of an edge list, kept distributed from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import stash


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    chains shrink geometrically; it ends in the round that changes nothing. Null ends are ignored,
    as are repeated edges and loops. No edges give no rows. Minima are combined before the shuffle,
    and a hub costs one row for each of its edges in a join that adaptive execution can split.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stash(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{label}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = lower.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), F.col("old"))
        after = stash(moved, f"{label}-labels")
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
