"""Readers of logs, transcripts, source trees and captured documents (SC1-SC24)."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.classify import extension
from tracewright.functions.scalars import json_number
from tracewright.sources.shared import written

#: Longest line of a log or a text file, and the part of a file in which a NUL marks it as binary.
LINE_BYTES, PEEK_BYTES = 4 << 20, 8000
#: Directories that scans leave out (fixed values).
IGNORED = ("vendor", "node_modules", "var", ".git", ".idea", ".vscode", ".svn", ".hg", "dist", "build", "target", "__pycache__")
#: Extensions with a structure reader, and the most files of one call.
SOURCE_EXTENSIONS, MOST_FILES = (".go", ".php", ".ts", ".tsx", ".vue", ".py"), 250


class LineTooLong(ValueError):
    pass


def log_path(env: Mapping[str, str], name: str) -> str:
    """SC3: an explicit directory, else the state directory, else the home directory, else here. `name` is the program's."""
    if env.get(f"{name.upper()}_LOG_DIR"):
        return os.path.join(env[f"{name.upper()}_LOG_DIR"], "calls.jsonl")
    base = env.get("XDG_STATE_HOME") or (os.path.join(env["HOME"], ".local", "state") if env.get("HOME") else "")
    return os.path.join(base, name, "calls.jsonl") if base else f".{name}-calls.jsonl"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSONL file or folder with their file; a path that isn't there has none."""
    try:
        text = spark.read.text(path)
        text.schema  # noqa: B018  resolves the path
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string, file string, ord long")
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


def parse_log(lines: DataFrame) -> DataFrame:
    """SC1, SC2: lines(value, ord) as call-log rows; lines that aren't JSON objects are skipped.

    Fields of the wrong JSON kind are null. Lines over LINE_BYTES are an error, as they are for a reader of bounded lines.
    """
    guarded = F.when(F.octet_length("value") > LINE_BYTES, F.raise_error(F.lit("line too long"))).otherwise(F.col("value"))
    doc = lines.select("ord", F.try_parse_json(guarded).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string").alias(f)
    number = lambda f: F.coalesce(json_number(F.col("v"), f), F.lit(0)).alias(f)
    return doc.select(
        "ord", text("ts"), text("tool"), text("source"), text("sid"), text("tag"), F.try_variant_get("v", "$.args", "array<string>").alias("args"), text("fp"),
        number("dur_ms"), number("exit"), text("err"), number("out_bytes"), number("out_tokens"), F.try_variant_get("v", "$.summary", "variant").alias("summary"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(json_lines(spark, path))


def numbered_lines(spark: SparkSession, path: str, since: Column | str | None = None) -> DataFrame:
    """Lines (file, line_no, value, mtime) of text files, of any size and in any number of splits, numbered from 1 in each file.

    Lines are counted by split, and a split's lines are numbered on from those of the splits before it, so no task holds a file.
    since, a time or an expression of one without columns, prunes files by when they were modified, before they are read.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if since is not None:
        at = F.lit(since).cast("timestamp") if isinstance(since, str) else since
        rows = rows.where(F.col("_metadata.file_modification_time") >= at)
    lines = written(rows, "lines")  # numbered as they were read, whatever splits a later reading would have
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("at") + F.col("offset")).alias("line_no"), "value", "mtime")


def transcripts(spark: SparkSession, root: str, modified_after: Column | str | None = None, files: str = "*/*.jsonl") -> DataFrame:
    """SC4, SC5, SC7: lines of the transcripts below root with path, line number in the file, stem, directory and modification time.

    modified_after prunes whole files before any of their lines is read. Lines that aren't JSON are left out, but counted.
    """
    rows = numbered_lines(spark, f"{root}/{files}", modified_after)
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[a-z]+$", "")
    return rows.select(F.col("file").alias("path"), "line_no", stem.alias("stem"), F.element_at(F.split("file", "/"), -2).alias("dir_name"), "mtime", F.try_parse_json("value").alias("v")).where("v IS NOT NULL")


def session_files(lines: DataFrame) -> DataFrame:
    """SC4: the files behind transcript lines, newest first."""
    return lines.select("path", "stem", "dir_name", "mtime").distinct().orderBy(F.desc("mtime"), "path")


def select_session(files: DataFrame, selector: str) -> DataFrame:
    """SC6: one file by explicit path, `last`, id prefix or part of the project, in this order of precedence, the newest first."""
    s = F.lit(selector.lower())
    rank = F.when(F.col("path") == selector, 0).when(F.lit(selector == "last"), 1).when(F.startswith(F.lower("stem"), s), 2).when(F.contains(F.lower("dir_name"), s), 3)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.desc("mtime"), "path").limit(1).drop("rank")


def sessions_of(files: DataFrame, project: str = "", since: Column | str | None = None) -> DataFrame:
    """SC7: files of a project (part of the directory, project or cwd, case aside) modified since a time."""
    names = [c for c in ("dir_name", "project", "cwd") if c in files.columns]
    hit = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(project.lower())) for c in names]
    out = files
    if project:
        any_of = hit[0]
        for h in hit[1:]:
            any_of = any_of | h
        out = out.where(any_of)
    if since is None:
        return out
    return out.where(F.col("mtime") >= (F.lit(since).cast("timestamp") if isinstance(since, str) else since))


def tree(spark: SparkSession, root: str, extensions: Iterable[str] = (), ignore: Iterable[str] = IGNORED, ignore_paths: Iterable[str] = ()) -> DataFrame:
    """SC8: files(path, ext, content) below root; ignore names directories anywhere, ignore_paths those relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^(?![a-z]+:)", "file:", root.rstrip("/"))
    path = F.regexp_replace(F.col("path"), "^" + re.escape(base).replace("file:", "file:/*") + "/*", "")
    return pruned(files.select(path.alias("path"), F.col("content")), extensions, ignore, ignore_paths)


def pruned(files: DataFrame, extensions: Iterable[str] = (), ignore: Iterable[str] = IGNORED, ignore_paths: Iterable[str] = ()) -> DataFrame:
    """SC8, SC10: files(path, content) with ext, without ignored directories and, if extensions are named, without others."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    out = files.withColumn("ext", extension(F.col("path"))).where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in ignore]).cast("array<string>")) | (F.size(folders) == 0))
    for p in ignore_paths:
        out = out.where(~F.startswith("path", F.lit(p.rstrip("/") + "/")))
    wanted = [e.lower() for e in extensions]
    return out.where(F.col("ext").isin(*wanted)) if wanted else out


def is_text(content: Column) -> Column:
    """SC9: no NUL near the start and no line that a bounded reader would refuse."""
    text = content.cast("string")
    longest = F.array_max(F.transform(F.split(text, "\n"), F.octet_length))
    return (F.locate("\0", F.decode(F.substring(content.cast("binary"), 1, PEEK_BYTES), "ISO-8859-1")) == 0) & (F.coalesce(longest, F.lit(0)) <= LINE_BYTES)


def split_text(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """SC9: (readable, skipped) files."""
    ok = F.coalesce(is_text(F.col(content)), F.lit(False))
    return files.where(ok), files.where(~ok)


def expanded(paths: DataFrame, inputs: list[str]) -> DataFrame:
    """SC11: known paths that the inputs name: themselves, everything below a directory, or a glob; each once, in order of the inputs, however many.

    Only extensions with a structure reader come from directories.
    """
    rank = None
    for k, i in enumerate(inputs):
        if re.search(r"[*?\[]", i):
            hit = F.col("path").rlike(fnmatch.translate(i).replace("(?s:", "(?s:").replace(".*", "[^/]*"))
        else:
            hit = (F.col("path") == i) | (F.startswith("path", F.lit(i.rstrip("/") + "/")) & extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
        rank = F.when(hit, k) if rank is None else rank.when(hit, k)
    return paths.withColumn("input", rank if rank is not None else F.lit(None)).where("input IS NOT NULL").dropDuplicates(["path"]).orderBy("input", "path").drop("input")


def expand(paths: DataFrame, inputs: list[str]) -> DataFrame:
    """SC11: expanded() for one call of a structure reader: no path, or more than MOST_FILES, is a ValueError."""
    found = expanded(paths, inputs)
    n = found.limit(MOST_FILES + 1).count()
    if n == 0 or n > MOST_FILES:
        raise ValueError("no files" if n == 0 else f"more than {MOST_FILES} files")
    return found


def split_arguments(args: list[str], known: set[str]) -> tuple[list[str], list[str]]:
    """SC12: arguments that are files (known ones, or with a path or an extension) and those that are symbols."""
    is_file = [a in known or "/" in a or a.lower().endswith(SOURCE_EXTENSIONS) or bool(re.search(r"[*?\[]", a)) for a in args]
    return [a for a, f in zip(args, is_file, strict=True) if f], [a for a, f in zip(args, is_file, strict=True) if not f]


def package_documents(docs: DataFrame) -> DataFrame:
    """SC13: packages (PACKAGE, with dir) of docs(dir, value), each value a whole document.

    A document that isn't a JSON object, or in which a field that is read has another kind, is skipped. Maps have
    whatever keys they have; null fields and null texts are absent.
    """
    v = docs.select("dir", F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    text = lambda path: (kind(path) == "STRING") | (kind(path) == "VOID")
    thing = lambda path: kind(path).startswith("OBJECT") | (kind(path) == "VOID")
    texts = lambda path: F.coalesce(~F.exists(F.map_values(F.try_variant_get("v", path, "map<string,variant>")), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"), F.lit(True))
    fits = text("$.name") & text("$.version") & text("$.type") & thing("$.scripts") & thing("$.autoload") & thing("$.autoload['psr-4']")
    for field in ("$.require", "$['require-dev']"):
        fits = fits & thing(field) & texts(field)
    get = lambda path, to: F.try_variant_get("v", path, to)
    return v.where(fits).select(
        get("$.name", "string").alias("name"), get("$.version", "string").alias("version"), get("$.type", "string").alias("type"), get("$.require", "map<string,string>").alias("require"), get("$['require-dev']", "map<string,string>").alias("require-dev"),
        get("$.scripts", "map<string,variant>").alias("scripts"), F.struct(get("$.autoload['psr-4']", "map<string,variant>").alias("psr-4")).alias("autoload"), "dir",
    )


def captured_packages(files: DataFrame, name: str = "composer.json") -> DataFrame:
    """SC13: packages of captured files(path, value), many in one stored file: those called name, outside vendor, module and version control folders, with their directory."""
    path = F.concat(F.lit("/"), F.col("path"))  # a captured path may have no folder above its own
    named = files.where((F.substring_index("path", "/", -1) == name) & ~path.rlike("/(vendor|node_modules|[.]git)/"))
    return package_documents(named.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "value"))


def packages(spark: SparkSession, root: str, name: str = "composer.json") -> DataFrame:
    """SC13: package files below root, outside vendor, module and version control folders, with their directory. name may be a glob."""
    docs = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return package_documents(docs.select(folder.alias("dir"), "value").where(~F.col("dir").rlike("/(vendor|node_modules|[.]git)(/|$)")))


def find_package(packages: DataFrame, target: str) -> DataFrame:
    """SC14: one package by directory, exact name, last part of its name or last part of its directory."""
    rank = F.when(F.col("dir") == target, 0).when(F.col("name") == target, 1).when(F.endswith("name", F.lit("/" + target)), 2).when(F.substring_index("dir", "/", -1) == target, 3)
    return packages.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name", "dir").limit(1).drop("rank")


def neon_level(first: Column, second: Column) -> Column:
    """SC19: the level of the first of two settings files that has one."""
    pattern = r"(?m)^\s*level:\s*(\w+)"
    return F.coalesce(F.nullif(F.regexp_extract(first, pattern, 1), F.lit("")), F.regexp_extract(second, pattern, 1))


def router_file(files: DataFrame) -> DataFrame:
    """SC20: router/index.ts, else the first router.ts."""
    rank = F.when(F.col("path").rlike(r"(^|/)router/index\.ts$"), 0).when(F.col("path").rlike(r"(^|/)router\.ts$"), 1)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).drop("rank")


def psr4(text: Column) -> Column:
    """SC24: prefix and directory of each entry of a generated autoload map."""
    pairs = F.regexp_extract_all(text, F.lit(r"'([^']+)'\s*=>\s*array\(\s*\$\w+\s*\.\s*'[^']*'"), 0)
    return F.transform(pairs, lambda p: F.struct(F.replace(F.regexp_extract(p, r"'([^']+)'\s*=>", 1), F.lit("\\\\"), F.lit("\\")).alias("prefix"), F.regexp_extract(p, r"\.\s*'([^']*)'$", 1).alias("dir")))
