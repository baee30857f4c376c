"""Diff classification (SC15, N18, N19, J3, J4, A18, A19, W4, C2, C3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.classify import path_category, path_language
from tracewright.functions.scalars import count_or_zero, hunk_section, renamed_to
from tracewright.operators.ordered import Ordered


def name_status(lines: DataFrame) -> DataFrame:
    """Lines of a name-status listing as (status, path); a rename keeps its new path and the letter R."""
    parts = F.split("line", "\t")
    return lines.where(F.size(parts) >= 2).select("ord", F.left(F.get(parts, F.lit(0)), F.lit(1)).alias("status"), F.element_at(parts, -1).alias("path"))


def churn(lines: DataFrame) -> DataFrame:
    """Lines of a numstat listing as (path, adds, dels)."""
    parts = F.split("line", "\t")
    return lines.where(F.size(parts) >= 3).select(renamed_to(F.get(parts, F.lit(2))).alias("path"), count_or_zero(F.get(parts, F.lit(0))).alias("adds"), count_or_zero(F.get(parts, F.lit(1))).alias("dels"))


def hunk_symbols(lines: DataFrame) -> DataFrame:
    """Distinct hunk sections of each file in the order in which they first occur; deleted files have none.

    A diff is one ordered text: the file name is carried down it over ranges of lines.
    """
    name = F.when(F.startswith("line", F.lit("+++ ")), F.regexp_replace(F.substring("line", 5, 1 << 20), "^b/", ""))
    carried = Ordered(lines.select("ord", "line"), "ord", values={"path": name}).rows()
    sections = carried.where(F.startswith("line", F.lit("@@")) & (F.col("path") != "/dev/null")).select("path", "ord", hunk_section(F.col("line")).alias("symbol")).where("symbol <> ''")
    first = sections.groupBy("path", "symbol").agg(F.min("ord").alias("ord"))
    return first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol"))).alias("s")).select("path", F.col("s.symbol").alias("symbols"))


def untracked(porcelain: DataFrame) -> DataFrame:
    """Untracked paths of a status listing."""
    return porcelain.where(F.startswith("line", F.lit("?? "))).select(F.regexp_replace(F.substring("line", 4, 1 << 20), '^"|"$', "").alias("path"))


def changes(status: DataFrame, numstat: DataFrame, hunks: DataFrame, porcelain: DataFrame | None = None, symbols: bool = True) -> DataFrame:
    """(status, path, category, lang, adds, dels, symbols) by path; untracked files that aren't listed follow as added."""
    base = name_status(status).select("status", "path")
    if porcelain is not None:
        new = untracked(porcelain).join(base, "path", "left_anti").select(F.lit("?").alias("status"), "path")
        base = base.unionByName(new)
    out = base.withColumn("category", path_category(F.col("path"))).withColumn("lang", path_language(F.col("path"))).join(churn(numstat), "path", "left")
    none = F.array().cast("array<string>")
    if symbols:
        named = hunk_symbols(hunks)
        out = out.join(named, "path", "left").withColumn("symbols", F.when(F.col("lang") != "", F.coalesce("symbols", none)).otherwise(none))
    else:
        out = out.withColumn("symbols", none)
    zero = F.lit(0)
    return out.select("status", "path", "category", "lang", F.coalesce("adds", zero).alias("adds"), F.coalesce("dels", zero).alias("dels"), "symbols").orderBy("path")


def by_category(changes: DataFrame) -> DataFrame:
    """A18."""
    return changes.groupBy("category").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "category")


def totals(changes: DataFrame) -> DataFrame:
    """A18."""
    return changes.agg(F.count("*").alias("files"), F.coalesce(F.sum("adds"), F.lit(0)).alias("adds"), F.coalesce(F.sum("dels"), F.lit(0)).alias("dels"))
