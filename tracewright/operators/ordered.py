"""Total orders over whole tables: numbers, running sums and values carried down, without a task that holds them all.

A table is range-partitioned and sorted once and written; what each range adds up to is one small row, and the sums
of the ranges before it are added to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.sources.shared import written

#: Low bits of an id, which count within a range; the bits above are the range's number.
LOW = (1 << 33) - 1


class Ordered:
    """The rows of df in the order of `order`, which should be total. total is their number; one row a range reaches the driver.

    sums are added up and values carried down: with(name) columns of rows() hold the sum up to and with a row, and the latest
    value that isn't null at or before it (null before the first).
    """

    def __init__(self, df: DataFrame, *order: str | Column, sums: dict[str, Column] | None = None, values: dict[str, Column] | None = None) -> None:
        self.columns, self.sums, self.values = df.columns, list(sums or {}), list(values or {})
        own = df.withColumns({f"_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in (sums or {}).items()} | {f"_{n}": c for n, c in (values or {}).items()})
        laid = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        self.table = written(laid, "ordered").withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit(LOW))})
        ends = [F.sum(f"_{n}").alias(n) for n in self.sums] + [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("_id"))).alias(n) for n in self.values]
        ranges = self.table.groupBy("_range").agg(F.count("*").alias("_rows"), *ends).collect()
        before, rows = dict.fromkeys(["_rows", *self.sums], 0) | dict.fromkeys(self.values), []
        for r in sorted(ranges, key=lambda r: r["_range"]):
            rows.append((r["_range"], *before.values()))
            before = {n: r[n] + x if n in ("_rows", *self.sums) else x if r[n] is None else r[n] for n, x in before.items()}
        self.total: int = before["_rows"]
        kinds = ["_range long", "_rows long", *(f"{n} long" for n in self.sums), *(f"{n} {self.table.schema[f'_{n}'].dataType.simpleString()}" for n in self.values)]
        self.before = df.sparkSession.createDataFrame(rows, ", ".join(kinds))

    def rows(self, ordinal: str | None = None, first: int = 1) -> DataFrame:
        """The table with its sums and values, and the numbers of the rows from `first` on if a name for them is given."""
        both = self.table.join(F.broadcast(self.before), "_range")  # a row for each range
        own = W.partitionBy("_range").orderBy("_id")
        out = [F.col(c) for c in self.columns] + [(F.col(n) + F.sum(f"_{n}").over(own)).alias(n) for n in self.sums]
        out += [F.coalesce(F.last(f"_{n}", ignorenulls=True).over(own), F.col(n)).alias(n) for n in self.values]
        return both.select(*out, *([(F.col("_rows") + F.col("_place") + first).alias(ordinal)] if ordinal else []))
