"""Whole renderings as ordered lines, and text files that keep the order (SK2-SK4, SK10, O1-O3, O8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import render as R
from tracewright.operators.ordered import Ordered
from tracewright.sources.files import numbered_lines


class Section:
    """A view in a total order, as lines of one format; JSON is an array and isn't cut, others stop after `most` rows and say how many more there are."""

    def __init__(self, name: str, df: DataFrame, order: list[str | Column], form: str = "toon", most: int | None = None, heads: list[str] | None = None) -> None:
        keyed = df.withColumns({f"_{k}": F.expr(c) if isinstance(c, str) else c for k, c in enumerate(order)})
        keys = [f"_{k}" for k in range(len(order))]
        self.ordered = Ordered(keyed.select(*df.columns, *keys), *keys)
        total = self.ordered.total
        shown = total if most is None or form == "json" else min(most, total)
        numbered = self.ordered.rows("_ordinal", 0).where(F.col("_ordinal") < shown)
        line = R.line_of(numbered, df.columns, form)
        if form == "json":
            line = F.concat(F.lit("  "), line, F.when(F.col("_ordinal") < total - 1, ",").otherwise(""))
            self.heads, self.tails = ["["], ["]"]
        elif form == "md":
            self.heads, self.tails = ["| " + " | ".join(heads or df.columns) + " |", "|" + " --- |" * len(df.columns)], []
        else:
            self.heads, self.tails = [R.toon_header(name, heads or df.columns, shown)], []
        self.tails += [f"# +{total - shown} more"] if total > shown else []
        self.lines, self.shown = numbered.select(F.col("_ordinal").alias("ordinal"), line.alias("line")), shown


def document(spark: SparkSession, *sections: Section | str) -> DataFrame:
    """(ordinal, line): sections and single lines one after the other, numbered from 0. Only headings pass through the driver."""
    at, fixed, parts = 0, [], []
    for s in sections:
        if isinstance(s, str):
            fixed.append((at, s))
            at += 1
            continue
        fixed += [(at + k, h) for k, h in enumerate(s.heads)]
        at += len(s.heads)
        parts.append(s.lines.select((F.col("ordinal") + at).alias("ordinal"), "line"))
        at += s.shown
        fixed += [(at + k, t) for k, t in enumerate(s.tails)]
        at += len(s.tails)
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(fixed, "ordinal long, line string"))


def save_document(lines: DataFrame, path: str) -> None:
    """Lines (ordinal, line) as text files whose order by name is that of the lines."""
    lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("line").write.text(path)


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of a folder of text files, numbered from 0 over the files in the order of their names."""
    lines = numbered_lines(spark, path)
    lengths = sorted((r["file"], r["n"]) for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect())  # one row a file
    before, rows = 0, []
    for file, n in lengths:
        rows.append((file, before))
        before += n
    starts = spark.createDataFrame(rows, "file string, before long")
    return lines.join(F.broadcast(starts), "file").select((F.col("before") + F.col("line_no") - 1).alias("ordinal"), F.col("value").alias("line"))
