"""Scalar functions (N1-N34, SK6-SK9, T13): Column expressions, and a few parsers that run on the driver."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def blank_null(c: Column) -> Column:
    """Empty text as null: the log leaves empty fields out."""
    return F.nullif(c, F.lit(""))


# --- text size -----------------------------------------------------------------------------------
def token_parts(text: Column) -> Column:
    """Unrounded token estimate: a quarter for each ASCII character, one for each other."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.length(text) - other) / F.lit(4.0) + other


def tokens(text: Column) -> Column:
    """Token estimate rounded half up; null counts as empty."""
    return F.floor(F.coalesce(token_parts(text), F.lit(0.0)) + F.lit(0.5)).cast("long")


def raw_tokens(text: Column) -> Column:
    """Token estimate of a group's texts put together, rounded once (an aggregate)."""
    return F.floor(F.coalesce(F.sum(token_parts(text)), F.lit(0.0)) + F.lit(0.5)).cast("long")


def cut_bytes(text: Column, n: int) -> Column:
    """At most n bytes, the last of them an ellipsis. Cut between characters, never inside one."""
    whole = F.octet_length(text) <= n
    ends = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.left(text, k))
    fits = F.filter(ends, lambda s: F.octet_length(s) <= n - 1)
    return F.when(whole, text).otherwise(F.concat(F.coalesce(F.array_max(F.transform(fits, lambda s: F.struct(F.octet_length(s).alias("n"), s.alias("s"))))["s"], F.lit("")), F.lit("…")))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


# --- distance ------------------------------------------------------------------------------------
def nearest(word: Column, candidates: list[str]) -> Column:
    """The closest candidate within a third of the word's length (at least one), case aside; the first on a tie."""
    low = F.lower(word)
    allowed = F.greatest(F.ceil(F.length(word) / F.lit(3.0)), F.lit(1)).cast("int")
    every = F.array(*[F.struct(F.levenshtein(low, F.lit(c.lower())).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(candidates)])
    return F.array_min(F.filter(every, lambda s: s["d"] <= allowed))["c"]


# --- identity ------------------------------------------------------------------------------------
def fingerprint(args: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the sorted arguments."""
    return F.left(F.sha2(F.array_join(F.array_sort(args), "\x1f"), 256), F.lit(16))


def dedup_key(tool: Column, args: Column) -> Column:
    """fingerprint() of the arguments and the tool's name."""
    return fingerprint(F.concat(F.array(F.concat(F.lit("tool="), tool)), args))


def short_id(sid: Column) -> Column:
    """What stands before the first dash, or the first eight characters."""
    return F.when(F.instr(sid, "-") > 1, F.substring_index(sid, "-", 1)).otherwise(F.left(sid, F.lit(8)))


def project_of_dir(name: Column) -> Column:
    """Last part of an encoded directory name."""
    return F.substring_index(F.regexp_replace(name, "^-", ""), "-", -1)


def relative(path: Column, base: Column) -> Column:
    """Path below base, or the path itself if it is elsewhere."""
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def safe_session(sid: Column) -> Column:
    """N29."""
    return F.regexp_replace(sid, "[^A-Za-z0-9_-]", "_")


def dotted_tool(command: Column) -> Column:
    """Command path after the program's name, dots for spaces."""
    return F.regexp_replace(F.regexp_replace(F.btrim(command), r"^\S+\s*", ""), r"\s+", ".")


def is_logged(tool: Column) -> Column:
    """Readers of the log, help and bare groups leave no row in it."""
    top = F.substring_index(tool, ".", 1)
    return ~(F.coalesce(blank_null(tool), F.lit("help")).isin("help", "history", "gripe", "cc", "completion", "version") | top.isin("help", "history", "completion"))


def repo_slug(url: Column) -> Column:
    """owner/name of a git address in any of its spellings."""
    return F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"([^/:]+/[^/:]+)$", 1)


def asset_name(template: str, **values: str) -> str:
    """Release asset name with {os}-like fields filled in."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


def checksum_of(line: Column) -> Column:
    """(sum, file) of a line of a checksum file."""
    return F.struct(F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 1).alias("sum"), F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 2).alias("file"))


# --- time ----------------------------------------------------------------------------------------
def strict_time(text: Column) -> Column:
    """An RFC 3339 time, or null; laxer spellings that a cast would take are null, too."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def days_before(now: Column, n: int) -> Column:
    """The same clock time n calendar days before now, in the session's zone."""
    return now - F.make_dt_interval(F.lit(n))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between, -1 if unknown."""
    return F.coalesce(F.expr("1") * F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / F.lit(86400)), F.lit(-1)).cast("long")


DURATION = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(h|ms|us|µs|ns|m|s)")
UNITS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def parse_since(text: str) -> timedelta:
    """Days as in 7d, or hours, minutes and seconds as in 1h30m; anything else is a ValueError."""
    if re.fullmatch(r"[+-]?\d+d", text):
        return timedelta(days=int(text[:-1]))
    body = text.lstrip("+-") if text[:1] in "+-" else text
    if text == "0" or body and re.fullmatch(f"(?:{DURATION.pattern})+", body):
        total = sum(float(n) * UNITS[u] for n, u in DURATION.findall(body))
        return timedelta(seconds=-total if text[:1] == "-" else total)
    raise ValueError(f"not a duration: {text!r}")


def parse_bucket(text: str) -> str:
    """Hour or day."""
    try:
        return {"hour": "hour", "h": "hour", "day": "day", "d": "day"}[text.lower()]
    except KeyError:
        raise ValueError(f"not a bucket: {text!r}") from None


# --- versions ------------------------------------------------------------------------------------
VERSION_PARTS = 6


def version_key(v: Column) -> Column:
    """A sortable array; one leading v goes, as does all from the first - or +; parts that aren't numbers are 0."""
    core = F.regexp_extract(F.regexp_replace(v, "^v", ""), r"^[^-+]*", 0)
    parts = F.transform(F.split(core, r"\."), lambda p: F.coalesce(F.try_cast(p, "int") if hasattr(F, "try_cast") else p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), VERSION_PARTS)), 1, VERSION_PARTS)


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(version_key(a) == version_key(b), 0).when(version_key(a) < version_key(b), -1).otherwise(1)


SEMVER_TAG = r"^v?\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"


def is_release_tag(tag: Column) -> Column:
    """N17."""
    return tag.rlike(SEMVER_TAG)


def protocol(text: Column) -> Column:
    """(major, minor, patch) of one to three numbers, else null."""
    ok = text.rlike(r"^v?\d+(\.\d+){0,2}$")
    p = F.split(F.regexp_replace(text, "^v", ""), r"\.")
    at = lambda k: F.coalesce(F.get(p, F.lit(k)).try_cast("int"), F.lit(0))
    return F.when(ok, F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch")))


def compatible(host: Column, plugin: Column) -> Column:
    """The host speaks its own major protocol and the one before; a plugin with a newer minor is too new."""
    h, p = protocol(host), protocol(plugin)
    return F.when(h.isNull() | p.isNull(), "invalid").when(p["major"] > h["major"], "too-new").when(p["major"] < h["major"] - 1, "too-old").when((p["major"] == h["major"]) & (p["minor"] > h["minor"]), "too-new").otherwise("ok")


# --- diffs, routes, packages ---------------------------------------------------------------------
def renamed_to(path: Column) -> Column:
    """The new path of a rename in numstat's spelling, with or without braces."""
    braces = F.replace(F.regexp_replace(path, r"\{.*? => (.*?)\}", "$1"), F.lit("//"), F.lit("/"))
    return F.when(path.contains("{") & path.contains(" => "), braces).otherwise(F.regexp_replace(path, r"^.* => ", ""))


def count_or_zero(text: Column) -> Column:
    """Binary files have a dash for a number."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def hunk_section(line: Column) -> Column:
    """What follows the second @@ of a hunk header."""
    return F.btrim(F.regexp_extract(line, r"@@.*?@@(.*)", 1))


def route_path(parent: Column, child: Column) -> Column:
    """An absolute child stands alone, an empty one is its parent (or /)."""
    joined = F.concat(F.rtrim(parent, F.lit("/")), F.lit("/"), child)
    return F.when(F.startswith(child, F.lit("/")), child).when(child == "", F.when(parent == "", "/").otherwise(parent)).otherwise(joined)


def component_name(spec: Column) -> Column:
    """File name of an import without its extension."""
    return F.regexp_replace(F.substring_index(spec, "/", -1), r"\.(vue|ts|tsx|js)$", "")


def script_value(value: Column) -> Column:
    """A script of a package as one line: text, a list joined by &&, or its JSON."""
    kind = F.schema_of_variant(value)
    lines = F.try_variant_get(value, "$", "array<string>")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY<STRING"), F.array_join(lines, " && ")).otherwise(F.to_json(value))


# --- JSON probes ---------------------------------------------------------------------------------
def json_number(doc: Column, field: str) -> Column:
    """A JSON number, truncated; text that looks like one is null."""
    part = F.try_variant_get(doc, f"$.{field}", "variant")
    numeric = F.schema_of_variant(part).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(doc, f"$.{field}", "double").cast("long"))


def json_flag(doc: Column, field: str) -> Column:
    """True only for a JSON true."""
    part = F.try_variant_get(doc, f"$.{field}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(part) == "BOOLEAN", F.try_variant_get(doc, f"$.{field}", "boolean")), F.lit(False))


def json_texts(doc: Column, field: str) -> Column:
    """The strings of a JSON array; other elements are left out, and anything else is an empty array."""
    every = F.try_variant_get(doc, f"$.{field}", "array<variant>")
    return F.coalesce(F.transform(F.filter(every, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def result_text(content: Column) -> Column:
    """A tool result that is text itself, or the text blocks of a list, each with a line end."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.concat(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")), F.lit("\n")))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(texts, ""), F.lit("")))


def tool_brief(name: Column, command: Column, path: Column, pattern: Column) -> Column:
    """N22."""
    return F.when(name == "Bash", cut_bytes(command, 100)).when(name.isin("Read", "Edit", "Write", "NotebookEdit"), path).when(name.isin("Grep", "Glob"), pattern).otherwise(name)


# --- money and display ---------------------------------------------------------------------------
def cost(n: Column, rate: Column) -> Column:
    """Dollars for n tokens at a rate for a million."""
    return n / F.lit(1e6) * rate


def format_k(n: Column) -> Column:
    """Thousands, rounded half up, from 1000."""
    return F.when(n >= 1000, F.concat(F.floor((n + 500) / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def format_ms(ms: Column) -> Column:
    """SK9. Half a hundredth of a second goes up."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms / F.lit(1000.0)))


def format_bytes(n: Column) -> Column:
    """SK9."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.format_string("%.1fKB", F.bround(n / F.lit(1024.0), 1))).otherwise(F.format_string("%.1fMB", F.bround(n / F.lit(1048576.0), 1)))


def format_duration(seconds: Column) -> Column:
    """SK9."""
    s = F.floor(seconds).cast("long")
    return F.when(s <= 0, "0s").when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s / 60) % 60))


def format_age(seconds: Column) -> Column:
    """SK9: minutes to the nearest, ties up."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm", F.floor((s + 30) / 60)))


def format_size_k(n: Column) -> Column:
    """SK9: whole KiB without a decimal."""
    return F.when(n % 1024 == 0, F.format_string("%dK", F.floor(n / 1024))).otherwise(F.format_string("%.1fK", F.bround(n / F.lit(1024.0), 1)))


def smaller_of(compact: Column, raw: Column) -> Column:
    """SK6: raw text only if it is estimated to be strictly smaller."""
    return F.when(raw.isNotNull() & (tokens(raw) < tokens(compact)), raw).otherwise(compact)


def footer(tok: Column, raw: Column, label: str = "#") -> Column:
    """SK7: what an answer costs, and what it saves against the raw text if it saves anything."""
    return (
        F.when((raw > 0) & (raw > tok), F.format_string(label + " ≈%d tok · raw ≈%d · saved ≈%d", tok, raw, raw - tok))
        .when(raw > 0, F.format_string(label + " ≈%d tok · raw passthrough", tok))
        .otherwise(F.format_string(label + " ≈%d tok", tok))
    )


def toon(value: Column) -> Column:
    """A TOON scalar, in quotes where it would clash with the structure."""
    text = value.cast("string")
    quoted = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    clash = text.rlike(r'[,:"\\\n\r\t\[\]{}]|^[ \t]|[ \t]\z')
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit('""')).when(clash, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(text)


def toon_list(items: Column) -> Column:
    """Items as an inline list."""
    return F.array_join(F.transform(items, toon), ",")
