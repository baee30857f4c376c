"""Text search over files (T1-T13, J5-J7, A20, A21, A24, L1, O2, O3): grep, refs and their layered forms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.classify import extension, ref_kind, scope_label
from tracewright.functions.dialect import java_regex, layer_of, layer_rank, quoted, whole_word
from tracewright.functions.scalars import cut_bytes, raw_tokens
from tracewright.sources.files import split_text

PER_PATTERN, MOST_REFS, SHOWN_BYTES = 30, 30, 200
REF_EXTENSIONS = (".go", ".php", ".ts", ".tsx", ".vue")


def lines_of(content: Column) -> Column:
    """The lines of a text without their ends; nothing follows a last line end, and an empty text has none."""
    parts = F.split(F.coalesce(content, F.lit("")), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda s: F.regexp_replace(s, r"\r\z", ""))


def lines(files: DataFrame) -> DataFrame:
    """files(path, content) as rows of (path, ext, line from 1, text)."""
    ext = F.col("ext") if "ext" in files.columns else extension(F.col("path"))
    return files.select("path", ext.alias("ext"), F.posexplode(lines_of(F.col("content"))).alias("p", "text")).select("path", "ext", (F.col("p") + 1).cast("int").alias("line"), "text")


def pattern_regex(pattern: str, word: bool = False, regex: bool = False, ignore_case: bool = False) -> str:
    """One pattern for Java. Case-blind literals are looked for in lower-cased text; regular expressions ignore word."""
    if regex:
        return java_regex(pattern, ignore_case)
    text = pattern.lower() if ignore_case else pattern
    return whole_word(text) if word else quoted(text)


def offsets(text: Column, regex: str, length: int | None = None) -> Column:
    """Byte offsets of the matches, left to right, that don't overlap: sums over what lies between them.

    length is that of every match in bytes, if they are all of one; else the matches are looked up, too.
    """
    parts = F.split(text, regex, -1)
    if length is None:
        found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        both = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda between, match: F.struct(F.octet_length(between).alias("b"), F.octet_length(match).alias("m")))
    else:
        both = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda between: F.struct(F.octet_length(between).alias("b"), F.lit(length).alias("m")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    run = F.aggregate(both, start, lambda a, x: F.struct((a["end"] + x["b"] + x["m"]).alias("end"), F.array_append(a["at"], a["end"] + x["b"]).alias("at")))["at"]
    return run if length is None else F.when(F.size(parts) == 2, F.array(F.octet_length(F.get(parts, F.lit(0))))).otherwise(run)


def holds(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds one of the literals."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in patterns])


def hits(rows: DataFrame, patterns: list[str], word: bool = False, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """(pattern, path, ext, line, col, text) of every match; col counts bytes (of the lower-cased text for case-blind literals).

    All patterns are matched in one pass over the lines; an empty one matches nothing. Literals are looked for as such
    before any expression runs.
    """
    text = F.lower("text") if ignore_case and not regex else F.col("text")
    each = [(p, pattern_regex(p, word, regex, ignore_case), None if regex else p.lower() if ignore_case else p) for p in dict.fromkeys(patterns) if p]
    if not each:
        return rows.limit(0).select(F.lit("").alias("pattern"), "path", "ext", "line", F.lit(0).alias("col"), "text")
    any_of = text.rlike("|".join(f"(?:{r})" for _, r, _ in each)) if regex else holds(text, [plain for _, _, plain in each])
    none = F.array().cast("array<int>")
    at = lambda r, plain: F.when(text.rlike(r), offsets(text, r)).otherwise(none) if plain is None else F.when(F.contains(text, F.lit(plain)), offsets(text, r, len(plain.encode()))).otherwise(none)
    found = F.array(*[F.struct(F.lit(p).alias("pattern"), at(r, plain).alias("at")) for p, r, plain in each])
    per = rows.where(any_of).select("path", "ext", "line", "text", F.explode(found).alias("f"))
    return per.select("path", "ext", "line", "text", F.col("f.pattern").alias("pattern"), F.explode("f.at").alias("col")).select("pattern", "path", "ext", "line", "col", "text")


def with_scopes(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the nearest scope that a line of rows strictly before theirs opens in the same file, '' if none.

    Only hits and the lines that open a scope are dealt by file; the other lines stay where they are.
    """
    opened = rows.select("path", "line", scope_label(F.col("text"), F.col("ext")).alias("label")).where("label IS NOT NULL")
    both = found.withColumn("label", F.lit(None).cast("string")).unionByName(opened, allowMissingColumns=True)
    before = F.last("label", ignorenulls=True).over(W.partitionBy("path").orderBy("line").rangeBetween(W.unboundedPreceding, -1))
    return both.withColumn("enclosing", F.coalesce(before, F.lit(""))).where("pattern IS NOT NULL").drop("label")


def enclosing(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """Rows with the nearest scope that a line strictly before opens in the same file, '' if none.

    Files are carried over in chunks of so many lines: inside a chunk first, then the last scope of the chunks before.
    """
    part = rows.withColumn("label", scope_label(F.col("text"), F.col("ext"))).withColumn("chunk", F.floor(F.col("line") / chunk))
    inside = F.last("label", ignorenulls=True).over(W.partitionBy("path", "chunk").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    ends = part.groupBy("path", "chunk").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("line"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(W.partitionBy("path").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("path", "chunk", before.alias("before"))
    return part.withColumn("inside", inside).join(carried, ["path", "chunk"]).withColumn("enclosing", F.coalesce("inside", "before", F.lit(""))).drop("label", "chunk", "inside", "before")


def grep(files: DataFrame, patterns: list[str], word: bool = False, regex: bool = False, ignore_case: bool = False) -> dict[str, DataFrame]:
    """Hits with their scopes, patterns with their files and hits (A20), patterns without a hit, skipped files, raw cost."""
    readable, skipped = split_text(files)
    literals = [p for p in patterns if p]
    if literals and not regex and not ignore_case:  # files without a hit are of no use
        readable = readable.where(holds(F.col("content").cast("string"), literals))
    every = lines(readable)
    named = with_scopes(hits(every, patterns, word, regex, ignore_case), every).select("pattern", F.col("path").alias("file"), "line", "col", "enclosing", "text")
    asked = files.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return {
        "hits": named.orderBy("file", "line", "col"),
        "patterns": per_pattern(named),
        "empty": asked.join(named.select("pattern").distinct(), "pattern", "left_anti"),
        "skipped": skipped.agg(F.count("*").alias("skipped")),
        "raw": raw_cost(named),
    }


def per_pattern(found: DataFrame) -> DataFrame:
    """A20."""
    return found.groupBy("pattern").agg(F.count_distinct("file").alias("files"), F.count("*").alias("hits"))


def raw_cost(found: DataFrame) -> DataFrame:
    """Tokens of the plain file:line:text lines, rounded once."""
    line = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "text", F.lit("\n"))
    return found.agg(raw_tokens(line).alias("raw_tokens"))


def capped(found: DataFrame, most: int = PER_PATTERN) -> DataFrame:
    """L1, SK10: the first hits of each pattern with trimmed text, and how many more there are; 0 is all."""
    over = W.partitionBy("pattern").orderBy("file", "line", "col")
    shown = found.withColumn("k", F.row_number().over(over))
    more = found.groupBy("pattern").agg(F.count("*").alias("n"))
    kept = (shown.where(F.col("k") <= most) if most > 0 else shown).join(more, "pattern")
    return kept.select("pattern", "file", "line", "col", "enclosing", cut_bytes(F.btrim("text"), SHOWN_BYTES).alias("text"), (F.greatest(F.col("n") - F.lit(most if most > 0 else 1 << 40), F.lit(0))).cast("long").alias("more"))


SYMBOL = re.compile(r"[^\W\d]\w*|[$][\w$]*|[^\W\d][\w$]*")


def refs(files: DataFrame, symbol: str, extensions: tuple[str, ...] = REF_EXTENSIONS, decls: DataFrame | None = None) -> DataFrame:
    """(kind, file, line, col, enclosing, text) of each whole-word occurrence; definitions first, then by place.

    In Go files the scope is the innermost of decls(path, start_line, end_line, name, label), if given.
    """
    if not re.fullmatch(r"[^\W\d][\w$]*|[$_][\w$]*", symbol):
        raise ValueError(f"not an identifier: {symbol!r}")
    every = lines(split_text(files.where(F.col("ext").isin(*extensions) & F.contains(F.col("content").cast("string"), F.lit(symbol))))[0])
    found = with_scopes(hits(every, [symbol], word=True), every)
    if decls is not None:
        found = innermost(found, decls)
    out = found.select(ref_kind(symbol, F.col("text"), F.col("ext")).alias("kind"), F.col("path").alias("file"), "line", "col", "enclosing", "text")
    return out.orderBy((F.col("kind") == "def").desc(), "file", "line", "col")


def innermost(found: DataFrame, decls: DataFrame) -> DataFrame:
    """Go hits labelled with the smallest declaration that holds their line, the first on a tie."""
    d = decls.select(F.col("path").alias("p"), "start_line", "end_line", "label")
    held = found.join(d, (F.col("path") == F.col("p")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    least = held.groupBy("path", "line", "col").agg(F.min_by("label", F.struct(F.col("end_line") - F.col("start_line"), "start_line")).alias("label"))
    return found.join(least, ["path", "line", "col"], "left").withColumn("enclosing", F.when(F.col("ext") == ".go", F.coalesce("label", F.lit(""))).otherwise(F.col("enclosing"))).drop("label")


def ref_totals(found: DataFrame) -> DataFrame:
    """Counted before any cap."""
    return found.agg(F.count_if(F.col("kind") == "def").alias("defs"), F.count_if(F.col("kind") == "use").alias("uses"))


def most_refs(asked: int) -> int | None:
    """L2: 0 is the default, a negative number all."""
    return MOST_REFS if asked == 0 else None if asked < 0 else asked


def by_layer(found: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """Hits or refs with their layer, in declared order, the unclassified last; never capped."""
    out = found.withColumn("layer", layer_of(F.col("file"), layers))
    return out.orderBy(layer_rank(F.col("layer"), layers), "file", "line")


def layer_counts(paths: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """How many files each layer has; empty layers have no row."""
    layer = layer_of(F.col("path"), layers)
    return paths.groupBy(layer.alias("layer")).agg(F.count("*").alias("files")).orderBy(layer_rank(F.col("layer"), layers))
