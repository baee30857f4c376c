"""Names against tables of names: the nearest one by edit distance, and the longest known prefix; both are joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_NUMBERS = "array<int>"


def _up(first: Column, last: Column) -> Column:
    """first..last, none if last is below first."""
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast(NO_NUMBERS))


def _part(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Start and length of the i-th of edits + 1 even parts of a text."""
    start = F.floor(i * length / (edits + 1)).cast("int")
    return start, (F.floor((i + 1) * length / (edits + 1)).cast("int") - start)


def allowed_edits(length: Column) -> Column:
    """A third of a word's length, rounded up, one at least."""
    return F.greatest(F.ceil(length / F.lit(3.0)), F.lit(1)).cast("int")


def nearest_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name, distance): for each distinct word of words(word) the closest of names(name, ord) within allowed_edits(), case aside.

    Of equally close names the first by ord counts; words without a name that close have no row, nor have empty and null ones.
    Words are trimmed. A name is cut into one part more than there may be edits, so that one part at least stands
    unchanged in a word, moved by no more characters than edits before or after it can: parts and pieces of words that agree meet in a join, and
    the distance decides. For each word length that may ask for it, a name is cut anew.
    """
    trimmed = F.btrim("word")
    asked = words.select("word", F.lower(trimmed).alias("low")).where(F.col("low") != "").distinct()
    low = asked.select("low").distinct().withColumn("l", F.length("low")).withColumn("k", allowed_edits(F.col("l")))
    known = names.where("name IS NOT NULL").groupBy(F.lower("name").alias("known")).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")).withColumn("m", F.length("known"))

    # a word of length l may have ceil(l / 3) edits and l differs from m by no more
    k = F.explode(_up(F.greatest(F.lit(1), F.ceil(F.col("m") / 4)), F.floor((F.col("m") + 2) / 2)))
    cut = known.withColumn("k", k).withColumn("i", F.explode(_up(F.lit(0), F.col("k"))))
    start, size = _part(F.col("i"), F.col("m"), F.col("k"))
    parts = cut.select("known", "m", "k", "i", F.substring("known", start + 1, size).alias("piece"))

    asks = low.withColumn("m", F.explode(_up(F.greatest(F.lit(0), F.col("l") - F.col("k")), F.col("l") + F.col("k")))).withColumn("i", F.explode(_up(F.lit(0), F.col("k"))))
    start, size = _part(F.col("i"), F.col("m"), F.col("k"))
    shift, rest = F.col("l") - F.col("m"), F.col("k") - F.col("i")
    first = F.greatest(F.lit(0), start - F.col("i"), start + shift - rest)
    last = F.least(F.col("l") - size, start + F.col("i"), start + shift + rest)
    pieces = asks.withColumn("at", F.explode(_up(first, last))).select("low", "m", "k", "i", F.substring("low", F.col("at") + 1, size).alias("piece"))

    pairs = pieces.join(parts, ["m", "k", "i", "piece"]).select("low", "known", "k").distinct()
    near = pairs.withColumn("distance", F.levenshtein("low", "known")).where(F.col("distance") <= F.col("k")).join(known.select("known", "name", "ord"), "known")
    best = near.groupBy("low").agg(F.min(F.struct("distance", "ord", "name")).alias("b"))
    return asked.join(best, "low").select("word", "b.name", F.col("b.distance").cast("int").alias("distance"))


def prefixes(name: Column, separator: str) -> Column:
    """The empty text, what stands before each separator of a name, and the name itself."""
    parts = F.split(name, F.regexp_replace(F.lit(separator), r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(names: DataFrame, name: str, known: DataFrame, prefix: str, separator: str) -> DataFrame:
    """names with the columns of the row of known whose prefix is the longest that `name` equals or continues after a separator; null without one.

    Each distinct name is taken apart at its separators, and its prefixes meet the known ones by equality. Prefixes of known are distinct.
    """
    own = names.select(name).distinct().withColumn("_prefix", F.explode(prefixes(F.col(name), separator)))
    rows = known.select(F.col(prefix).alias("_prefix"), F.struct(*known.columns).alias("_known"))
    best = own.join(rows, "_prefix").groupBy(name).agg(F.max_by("_known", F.length("_prefix")).alias("_known"))
    return names.join(best, name, "left").select(*[names[c] for c in names.columns], *[F.col(f"_known.{c}").alias(c) for c in known.columns])
