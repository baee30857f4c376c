"""Source structure (X1-X14, J6, J10, J11, F9, F10): declarations of Go, PHP, Python, TypeScript and Vue files, and routes.

All languages give one flat table, a row for each declaration. Parsers work on text in which comments
and the insides of strings are blanked out, so that places stay the same.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.scalars import smaller_of, tokens
from tracewright.operators.names import longest_prefix
from tracewright.sources.shared import written

DECLS = "path string, ord int, kind string, owner string, name string, detail string, exported boolean, start_line int, end_line int"
#: Files below so many bytes are shown as they are.
RAW_FLOOR = 8192
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Decl:
    kind: str
    name: str
    detail: str = ""
    owner: str = ""
    exported: bool = True
    start: int = 0
    end: int = 0


@dataclass
class Source:
    """A text, and the same text with comments and strings blanked."""

    text: str
    bare: str = ""
    ends: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.ends = [m.start() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def close(self, at: int) -> int:
        """Place of the bracket that closes the one at `at`; the end of the text if none does."""
        depth = 0
        for k in range(at, len(self.bare)):
            c = self.bare[k]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth == 0:
                    return k
        return len(self.bare)

    def depth_zero(self, start: int, end: int, sep: str) -> list[tuple[int, int]]:
        """Parts of [start, end) between separators outside brackets."""
        out, depth, last = [], 0, start
        for k in range(start, end):
            c = self.bare[k]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif depth == 0 and c in sep:
                out.append((last, k))
                last = k + 1
        return [*out, (last, end)]


def blanked(text: str, comment: str) -> str:
    """comment is a pattern of comments; strings in single, double and back quotes lose their insides."""
    token = re.compile(rf"""(?P<c>{comment})|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`""", re.S)
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    return token.sub(lambda m: blank(m[0]) if m["c"] is not None else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


def flat(text: str) -> str:
    return " ".join(text.split())


# --- Go ------------------------------------------------------------------------------------------
def go_decls(text: str) -> list[Decl]:
    """Package, imports, types, functions, constants and variables; a file that doesn't balance has none."""
    s = Source(text, blanked(text, r"//[^\n]*|/\*.*?\*/"))
    if any(s.bare.count(a) != s.bare.count(b) for a, b in PAIRS.items()) or not re.search(r"(?m)^package\s+\w+", s.bare):
        return []
    out: list[Decl] = []

    def add(kind, name, detail, at, end, owner=""):
        out.append(Decl(kind, name, flat(detail), owner, name[:1].isupper(), s.line(at), s.line(end)))

    m = re.search(r"(?m)^package\s+(\w+)", s.bare)
    add("package", m[1], "", m.start(), m.end())
    for m in re.finditer(r"(?m)^(import|type|const|var|func)\b", s.bare):
        at, word = m.end(), m[1]
        while at < len(s.bare) and s.bare[at] in " \t":
            at += 1
        if word == "func":
            go_func(s, m.start(), at, add)
            continue
        if s.bare[at : at + 1] == "(":
            end = s.close(at)
            specs = [(a, b) for a, b in s.depth_zero(at + 1, end, "\n;") if s.bare[a:b].strip()]
        else:
            specs = [s.depth_zero(at, len(s.bare), "\n")[0]]
        for a, b in specs:
            go_spec(s, word, a, b, add)
    return out


def go_func(s: Source, start: int, at: int, add) -> None:
    owner = ""
    if s.bare[at] == "(":
        end = s.close(at)
        owner = flat(s.text[at + 1 : end]).split(" ")[-1]
        at = end + 1
    m = re.compile(r"\s*(\w+)\s*(\[[^\]]*\])?\s*").match(s.bare, at)
    if not m:
        return
    args = s.close(m.end())
    rest = re.compile(r"[^\n{]*(?:\{)?").match(s.bare, args + 1)
    body = s.bare.find("{", args + 1)
    while 0 <= body and re.search(r"\b(interface|struct)\s*$", s.bare[args + 1 : body]):
        body = s.bare.find("{", s.close(body) + 1)
    line_end = s.bare.find("\n", args)
    if body < 0 or (0 <= line_end < body and "(" not in s.bare[args + 1 : line_end] and "{" not in s.bare[args + 1 : line_end]):
        end, sig_end = (rest.end(), rest.end()) if line_end < 0 else (line_end, line_end)
    else:
        end, sig_end = s.close(body), body
    add("func", m[1], f"({flat(s.text[m.end() + 1 : args])}) {flat(s.text[args + 1 : sig_end])}".strip(), start, end, owner)


def go_spec(s: Source, word: str, a: int, b: int, add) -> None:
    body = s.bare[a:b]
    lead = a + len(body) - len(body.lstrip())
    raw = s.text[lead:b].strip()
    if word == "import":
        if m := re.match(r"""(?:([\w.]+)\s+)?["`](.+)["`]""", raw):
            add("import", m[2], m[1] or "", lead, b)
    elif word == "type":
        if m := re.match(r"(\w+)\s*(\[[^\]]*\w[^\]]*\]\s*)?(=\s*)?(struct|interface)?", s.bare[lead:b]):
            kind = m[4] or ("alias" if m[3] else "defined")
            brace = s.bare.find("{", lead, b)
            if m[4] and brace >= 0:
                end = s.close(brace)
                parts = [flat(s.text[x:y]) for x, y in s.depth_zero(brace + 1, end, "\n;") if s.bare[x:y].strip()]
                add(kind, m[1], "; ".join(strip_comment(p) for p in parts), lead, end)
            else:
                add(kind, m[1], s.text[lead + m.end(3 if m[3] else 1) : b], lead, b)
    elif m := re.match(r"([\w\s,]*?\w)\s*(?=$|=|[\[*(\w].*)", s.bare[lead:b].split("=")[0].strip() or "_"):
        left = s.bare[lead:b].split("=")[0].strip()
        names = re.match(r"\w+(?:\s*,\s*\w+)*", left)
        kind = left[names.end() :].strip() if names else ""
        for n in re.split(r"\s*,\s*", names[0]) if names else []:
            if n != "_":
                add(word, n, kind, lead, b)


def strip_comment(text: str) -> str:
    return re.sub(r"\s*//.*$", "", text)


# --- PHP -----------------------------------------------------------------------------------------
PHP_TYPE = re.compile(r"(?m)(?:^|[;{}\s])((?:(?:abstract|final|readonly)\s+)*)(class|interface|trait|enum)\s+(\w+)([^{;]*)\{")
PHP_NEW = ((r"\b(public|protected|private)\s*\(set\)\s+", ""), (r"\b(public|protected|private)(\s+)(public|protected|private)\(set\)", r"\1"), (r"\breadonly\s+(class)\b", r"\1"), (r"\bconst\s+(?:string|int|float|bool|array|self|\??\w+)\s+(\w+\s*=)", r"const \1"), (r"\)\s*\|>\s*", "), "), (r"#\[\\?Override\]\s*", ""))


def php_older(text: str) -> str:
    """Syntax of newer versions in older terms, so that one grammar reads both."""
    for pattern, plain in PHP_NEW:
        text = re.sub(pattern, plain, text)
    return text


def php_decls(text: str) -> list[Decl]:
    """Namespace, imports, types with their constants, cases, properties, constructor parameters and public methods, and functions."""
    s = Source(text, blanked(text, r"//[^\n]*|/\*.*?\*/|\#(?!\[)[^\n]*"))
    out: list[Decl] = []
    space = re.search(r"\bnamespace\s+([\w\\]+)\s*[;{]", s.bare)
    if space:
        out.append(Decl("namespace", space[1], start=s.line(space.start()), end=s.line(space.end())))
    first = PHP_TYPE.search(s.bare)
    for m in re.finditer(r"(?m)^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", s.bare[: first.start() if first else len(s.bare)]):
        out.append(Decl("use", m[1], m[2] or "", start=s.line(m.start(1)), end=s.line(m.end())))
    inside: list[tuple[int, int]] = []
    for m in PHP_TYPE.finditer(s.bare):
        brace = m.end() - 1
        end = s.close(brace)
        inside.append((brace, end))
        out.append(Decl(m[2], m[3], flat(f"{m[1]} {m[4]}"), start=s.line(m.start(2)), end=s.line(end)))
        php_members(s, m[3], brace + 1, end, out)
    for m in re.finditer(r"\bfunction\s+&?(\w+)\s*\(", s.bare):
        if not any(a < m.start() < b for a, b in inside):
            args = s.close(m.end() - 1)
            brace = s.bare.find("{", args)
            out.append(Decl("function", m[1], flat(s.text[m.end() - 1 : brace if brace > 0 else args + 1]), start=s.line(m.start()), end=s.line(s.close(brace) if brace > 0 else args)))
    return out


def php_members(s: Source, owner: str, start: int, end: int, out: list[Decl]) -> None:
    at = start
    while at < end:
        m = re.compile(r"[^;{(]*").match(s.bare, at, end)
        stop = m.end()
        head = s.bare[at:stop]
        if stop >= end:
            break
        if (f := re.search(r"\bfunction\s+&?(\w+)\s*$", head)) and s.bare[stop] == "(":
            args = s.close(stop)
            tail = re.compile(r"[^;{]*").match(s.bare, args + 1).end()
            close = s.close(tail) if s.bare[tail : tail + 1] == "{" else tail
            seen = re.search(r"\b(public|protected|private)\b", head)
            line, last = s.line(at + f.start()), s.line(close)
            if f[1] == "__construct":
                for x, y in s.depth_zero(stop + 1, args, ","):
                    if p := re.search(r"((?:\b(?:public|protected|private|readonly)\s+)*)([\w\\?|&]*)\s*(?:\.\.\.)?&?\$(\w+)", s.bare[x:y]):
                        out.append(Decl("ctor", p[3], p[2], owner, bool(p[1].strip()), s.line(x), s.line(y)))
            elif not seen or seen[1] == "public":
                out.append(Decl("method", f[1], flat(("static " if "static" in head else "") + s.text[stop : args + 1] + s.text[args + 1 : tail]), owner, True, line, last))
            at = close + 1
        elif s.bare[stop] == "(":
            at = s.close(stop) + 1  # an attribute or a value with a call
            if not s.bare[at:end].lstrip().startswith(("]", ",", ")")):
                at = re.compile(r"[^;{]*;?").match(s.bare, at, end).end()
            else:
                at += len(s.bare[at:end]) - len(s.bare[at:end].lstrip()) + 1
        elif s.bare[stop] == "{":
            if p := re.search(r"(?:\b(public|protected|private)\s+)?([\w\\?|&]*)\s*\$(\w+)[^$]*$", head):
                out.append(Decl("property", p[3], p[2], owner, p[1] == "public", s.line(stop), s.line(s.close(stop))))
            at = s.close(stop) + 1
        else:
            line = s.line(at + len(head) - len(head.lstrip()))
            if u := re.match(r"\s*use\s+([\w\\,\s]+)$", head):
                out.extend(Decl("uses", t.strip(), "", owner, True, line, line) for t in u[1].split(","))
            elif c := re.match(r"\s*case\s+(\w+)\s*(?:=\s*)?", head):
                out.append(Decl("case", c[1], flat(s.text[at + c.end() : stop]), owner, True, line, line))
            elif c := re.search(r"\bconst\s+(?:[\w\\?|]+\s+)?(\w+)\s*=", head):
                out.append(Decl("const", c[1], flat(s.text[at + c.end() : stop]), owner, "private" not in head and "protected" not in head, line, line))
            elif p := re.search(r"\b(public|protected|private|var|static|readonly)\s+(?:(?:static|readonly)\s+)*([\w\\?|&]*)\s*\$(\w+)", head):
                out.append(Decl("property", p[3], p[2], owner, "private" not in head and "protected" not in head, line, line))
            at = stop + 1


# --- Python --------------------------------------------------------------------------------------
def python_decls(text: str) -> list[Decl]:
    """Imports, classes, functions and methods (nested ones aside) and annotated or plain variables of modules and classes."""
    bare = re.sub(r"(?s)\"\"\".*?\"\"\"|'''.*?'''", lambda m: '""' + re.sub(r"[^\n]", " ", m[0][2:]), text)
    s = Source(text, blanked(bare, r"\#[^\n]*"))
    lines = s.bare.split("\n")
    out: list[Decl] = []
    scopes: list[tuple[int, str, str]] = []  # indentation, kind, name
    offset, k = 0, 0
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    while k < len(lines):
        line, first = lines[k], k
        offset = begins[k]
        k += 1
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while scopes and indent <= scopes[-1][0]:
            scopes.pop()
        # a header or a value may run on while brackets are open
        end = offset + len(line)
        while k < len(lines) and sum(s.bare[offset:end].count(c) for c in "([{") > sum(s.bare[offset:end].count(c) for c in ")]}"):
            end = begins[k] + len(lines[k])
            k += 1
        whole, raw = flat(s.bare[offset:end]), s.text[offset:end]
        kinds = [kind for _, kind, _ in scopes]
        owner = scopes[-1][2] if scopes else ""
        last = next((j for j in range(k, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent), len(lines))
        while last > k and not lines[last - 1].strip():
            last -= 1
        if m := re.match(r"class\s+(\w+)\s*(?:\((.*)\))?\s*:", whole):
            if "func" not in kinds:
                out.append(Decl("class", m[1], flat(re.search(r"\((.*)\)", flat(raw))[1]) if m[2] else "", owner, public(m[1]), first + 1, last))
            scopes.append((indent, "class", m[1]))
        elif m := re.match(r"(async\s+)?def\s+(\w+)\s*\(", whole):
            if "func" not in kinds:
                opened = s.bare.index("(", offset)
                colon = s.depth_zero(s.close(opened) + 1, end, ":")[0][1]
                sig = flat(s.text[opened:colon])
                sig = re.sub(r"\(\s+", "(", re.sub(r",?\s+\)", ")", sig))
                out.append(Decl("func", m[2], ("async " if m[1] else "") + sig, owner, public(m[2]), first + 1, last))
            scopes.append((indent, "func", m[2]))
        elif "func" in kinds or kinds.count("class") > 1:
            continue
        elif indent == 0 and (m := re.match(r"(?:from\s+([\w.]+)\s+)?import\s+(.+)", whole)):
            out.append(Decl("import", m[1] or m[2], m[2] if m[1] else "", "", True, first + 1, k))
        elif m := re.match(r"(\w+)\s*(?::\s*([^=]+?)\s*)?(=(?!=)|$)", whole):
            if (m[2] or m[3]) and not re.match(r"(return|pass|else|try|finally|raise|yield|break|continue)$", m[1]):
                out.append(Decl("var", m[1], flat(m[2] or ""), owner, public(m[1]), first + 1, k))
    return out


def public(name: str) -> bool:
    """a leading underscore hides a name, double ones on both ends don't."""
    return not name.startswith("_") or (name.startswith("__") and name.endswith("__"))


# --- TypeScript and Vue --------------------------------------------------------------------------
TS_DECL = re.compile(r"(?m)^[ \t]*(export\s+)?(default\s+)?(?:declare\s+)?(?:async\s+)?(abstract\s+)?(function|class|const|let|enum|interface|type)\s*\*?\s+([A-Za-z_$][\w$]*)")


def ts_decls(text: str) -> list[Decl]:
    """X11: imports, types with their members, other symbols, and in components props, emits, models, stores, calls and used components."""
    shift, template = 0, ""
    if m := re.search(r"<script\b[^>]*>(.*?)</script>", text, re.S):
        shift = text.count("\n", 0, m.start(1))
        template = (re.search(r"<template\b[^>]*>(.*)</template>", text, re.S) or ["", ""])[1]
        text = m[1]
    s = Source(text, blanked(text, r"//[^\n]*|/\*.*?\*/"))
    out: list[Decl] = []
    line = lambda at: s.line(at) + shift
    for m in re.finditer(r"(?m)^[ \t]*import\s+([^;]*?)['\"]", s.bare):
        spec = re.compile(r"['\"]([^'\"\n]*)['\"]").search(text, m.end() - 1)
        if spec:
            out.append(Decl("import", spec[1], flat(re.sub(r"\s*from\s*$", "", m[1])), start=line(m.start()), end=line(spec.end())))
    for m in TS_DECL.finditer(s.bare):
        depth = s.bare.count("{", 0, m.start()) - s.bare.count("}", 0, m.start())
        if depth:
            continue
        brace = s.bare.find("{", m.end())
        stop = s.bare.find("\n", m.end())
        end, members = (stop if stop >= 0 else len(s.bare)), ""
        if m[4] in ("interface", "enum", "type", "class", "function") and brace >= 0 and (brace < stop or stop < 0 or m[4] != "type"):
            end = s.close(brace)
            if m[4] in ("interface", "enum", "type"):
                parts = s.depth_zero(brace + 1, end, ";,\n")
                members = ", ".join(n[1] for a, b in parts if (n := re.match(r"\s*(?:readonly\s+)?([A-Za-z_$][\w$]*\??)", s.bare[a:b])))
        out.append(Decl(m[4], m[5], members, "", bool(m[1]), line(m.start(4)), line(end)))
    for kind, call in (("props", "defineProps"), ("emits", "defineEmits"), ("model", "defineModel")):
        for m in re.finditer(rf"\b{call}\b\s*(<)?", s.bare):
            at = m.end() - 1 if m[1] else m.end()
            stop = re.compile(r"[^({]*").match(s.bare, at).end()
            body = text[stop + 1 : s.close(stop)] if stop < len(text) else ""
            names = re.findall(r"(?m)(?:^|[,{(;])\s*['\"]?([A-Za-z_$][\w:-]*)['\"]?\??\s*[:(]", body) or re.findall(r"['\"]([\w:-]+)['\"]", body)
            out.extend(Decl(kind, n, "", "", True, line(m.start()), line(m.start())) for n in dict.fromkeys(names or ["modelValue"] * (kind == "model")))
    for kind, pattern in (("store", r"\b(use[A-Z]\w*Store)\s*\("), ("api_call", r"\b((?:api|axios|http)\.\w+)\s*[(<]")):
        out.extend(Decl(kind, n) for n in dict.fromkeys(re.findall(pattern, s.bare)))
    out.extend(Decl("component", n) for n in dict.fromkeys(re.findall(r"<([A-Z]\w+)", template)))
    return out


# --- routes --------------------------------------------------------------------------------------
def route_rows(text: str) -> list[Decl]:
    """The routes of a router file, children after their parents with whole paths."""
    s = Source(text, blanked(text, r"//[^\n]*|/\*.*?\*/"))
    m = re.search(r"\broutes\b[^=\[{]*[=:]\s*(?:\w+\s*\(\s*)?\[", s.bare) or re.search(r"\bchildren\s*:\s*\[", s.bare)
    names = {a: b for a, b in re.findall(r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", text)}
    out: list[Decl] = []

    def value(a: int, b: int, key: str) -> tuple[int, int] | None:
        for x, y in s.depth_zero(a, b, ","):
            if k := re.match(rf"\s*['\"]?{key}['\"]?\s*:\s*", s.text[x:y]):
                return x + k.end(), y
        return None

    def walk(a: int, b: int, parent: str) -> None:
        for x, y in s.depth_zero(a, b, ","):
            brace = s.bare.find("{", x, y)
            if brace < 0:
                continue
            end = s.close(brace)
            part = lambda key: s.text[slice(*v)].strip() if (v := value(brace + 1, end, key)) else ""  # noqa: E731, B023
            child = part("path").strip("'\"`")
            path = child if child.startswith("/") else (parent or "/") if not child else f"{parent.rstrip('/')}/{child}"
            spec = re.search(r"import\(\s*['\"]([^'\"]+)", part("component"))
            source = spec[1] if spec else names.get(part("component"), part("component"))
            component = re.sub(r"\.(vue|ts|tsx|js)$", "", source.rsplit("/", 1)[-1])
            out.append(Decl("route", path, flat(part("meta")), component, True, s.line(brace), s.line(end)))
            out[-1].kind = part("name").strip("'\"`") or ""
            if v := value(brace + 1, end, "children"):
                at = s.bare.find("[", *v)
                if at >= 0:
                    walk(at + 1, s.close(at), path)

    if m:
        walk(m.end(), s.close(m.end() - 1), "")
    return out


PARSERS = {".go": go_decls, ".php": lambda t: php_decls(php_older(t)), ".py": python_decls, ".ts": ts_decls, ".tsx": ts_decls, ".vue": ts_decls}


def _mapped(files: DataFrame, parse) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, ext, text in zip(part["path"], part["ext"], part["content"], strict=True):
                for k, d in enumerate(parse(ext, text or "")):
                    rows.append((path, k, d.kind, d.owner, d.name, d.detail, d.exported, d.start, d.end))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLS.split(", ")])

    return files.select("path", "ext", F.col("content").cast("string").alias("content")).mapInPandas(run, DECLS)


def declarations(files: DataFrame) -> DataFrame:
    """Declarations of files(path, ext, content); files of other kinds, and Go files that can't be read, have none."""
    return _mapped(files, lambda ext, text: PARSERS[ext](text) if ext in PARSERS else [])


def routes(files: DataFrame) -> DataFrame:
    """(path, ord, route, name, component, meta)."""
    r = _mapped(files, lambda ext, text: route_rows(text))
    return r.select("path", "ord", F.col("name").alias("route"), F.col("kind").alias("name"), F.col("owner").alias("component"), F.col("detail").alias("meta"))


def go_spans(decls: DataFrame) -> DataFrame:
    """Spans for J6."""
    kinds = {"struct": "type", "interface": "type", "alias": "type", "defined": "type", "func": "func", "const": "const", "var": "var"}
    label = F.lit(None).cast("string")
    for k, name in kinds.items():
        label = F.when(F.col("kind") == k, F.concat(F.lit(name + " "), F.when(F.col("owner") != "", F.concat(F.regexp_replace("owner", r"^\*", ""), F.lit("."))).otherwise(""), "name")).otherwise(label)
    return decls.select("path", "start_line", "end_line", "name", label.alias("label")).where("label IS NOT NULL")


def exported(decls: DataFrame) -> DataFrame:
    """F9."""
    return decls.where("exported")


def brief(decls: DataFrame) -> DataFrame:
    """without the details of fields, values and variables."""
    bare = F.col("kind").isin("struct", "const", "var", "case", "property", "interface", "enum", "type")
    return decls.withColumn("detail", F.when(bare, "").otherwise(F.col("detail")))


def counts(decls: DataFrame) -> DataFrame:
    """How many declarations of each kind each file has."""
    return decls.groupBy("path", "kind").agg(F.count("*").alias("n"))


def slices(files: DataFrame, decls: DataFrame, symbols: list[str]) -> DataFrame:
    """Source of the named declarations (Name or Owner.Name), comments and decorators above included.

    A symbol that a file lacks has no row for it: the others are still found.
    """
    owner = F.regexp_replace("owner", r"^\*", "")
    full = F.when(owner == "", F.col("name")).otherwise(F.concat(owner, F.lit("."), "name"))
    wanted = F.filter(F.array(*[F.lit(x.replace("::", ".")) for x in symbols]), lambda x: (x == full) | (x == F.col("name")))
    hit = decls.where(F.size(wanted) > 0).select("path", "ord", F.get(wanted, F.lit(0)).alias("symbol"), "start_line", "end_line").where("start_line > 0")
    lines = F.split(F.col("content").cast("string"), "\n")
    above = F.transform(F.slice(lines, F.lit(1), F.col("start_line") - 1), lambda x: F.when(x.rlike(r"^\s*(//|/\*|\*|#|@)"), 1).otherwise(0))
    lead = F.aggregate(F.reverse(above), F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda a, x: F.struct((a["n"] + a["on"] * x).alias("n"), (a["on"] * x).alias("on")))["n"]
    joined = hit.join(files.select("path", "content"), "path").withColumn("from", F.col("start_line") - lead)
    return joined.select("path", "symbol", F.col("from").alias("start_line"), "end_line", F.array_join(F.slice(lines, F.col("from"), F.col("end_line") - F.col("from") + 1), "\n").alias("text")).orderBy("path", "start_line")


def summaries(files: DataFrame, decls: DataFrame, floor: int = RAW_FLOOR, api: bool = False) -> DataFrame:
    """X13, SK6: (path, text): files below the floor as they are, others by their declarations unless raw is smaller."""
    line = F.concat_ws(" ", F.nullif("owner", F.lit("")), "kind", "name", F.nullif("detail", F.lit("")))
    compact = decls.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("s")))), lambda x: x["s"]), "\n").alias("compact"))
    both = files.join(compact, "path", "left")
    small = (F.octet_length("content") < floor) & F.lit(floor > 0 and not api)
    text = F.when(small | F.col("compact").isNull(), F.col("content")).otherwise(F.col("compact") if api else smaller_of(F.col("compact"), F.col("content")))
    return both.select("path", text.alias("text"), tokens(text).alias("tokens"))


# --- effective API -------------------------------------------------------------------------------
def effective_api(types: DataFrame, links: DataFrame, methods: DataFrame) -> DataFrame:
    """(root, method, via, place) of every method that a type answers to: its own, then its traits' (depth first), then its parents'.

    links(type, kind, target, ord) holds uses and extends; methods(type, name, ord) public ones. Each step
    follows one more link from the types reached so far, until it reaches no new one; a type reached twice counts where it comes first.
    """
    rank = F.concat(F.when(F.col("kind") == "uses", "1").otherwise("2"), F.lpad(F.col("ord").cast("string"), 5, "0"))
    step = links.select(F.col("type").alias("via"), "target", rank.alias("rank"))
    reached = types.select(F.col("type").alias("root"), F.col("type").alias("via"), F.lit("").alias("place"))
    front = reached
    while True:
        front = front.join(step, "via").select("root", F.col("target").alias("via"), F.concat("place", F.lit("/"), "rank").alias("place"))
        front = front.join(reached.select("root", "via"), ["root", "via"], "left_anti")
        front = written(front, "effective-api")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    own = reached.groupBy("root", "via").agg(F.min("place").alias("place"))
    every = own.join(methods.select(F.col("type").alias("via"), F.col("name").alias("method"), "ord"), "via")
    one = every.withColumn("k", F.row_number().over(W.partitionBy("root", "method").orderBy("place", "ord"))).where("k = 1")
    return one.select("root", "method", F.when(F.col("via") == F.col("root"), "").otherwise(F.col("via")).alias("via"), "place", "ord").orderBy("root", "place", "ord")


def unresolved(links: DataFrame, types: DataFrame) -> DataFrame:
    """Links to types that aren't there."""
    return links.join(types.select(F.col("type").alias("target")), "target", "left_anti").select("type", "target")


def psr4_path(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The file of each class by the longest prefix of its name; prefixes end with a backslash, and the empty one fits all. None has no row."""
    bare = prefixes.select(F.regexp_replace("prefix", r"\\$", "").alias("bare"), F.col("prefix"), "dir")
    hit = longest_prefix(names.select("fqcn").distinct(), "fqcn", bare, "bare", "\\")
    return hit.where("prefix IS NOT NULL").select("fqcn", F.concat(F.rtrim(F.col("dir"), F.lit("/")), F.lit("/"), F.replace(F.substring(F.col("fqcn"), F.length("prefix") + 1, F.length("fqcn")), F.lit("\\"), F.lit("/")), F.lit(".php")).alias("path"))


def resolved(name: Column, namespace: Column, imports: Column) -> Column:
    """A class name through its file's imports (map of alias to full name), else in its namespace."""
    first = F.substring_index(name, "\\", 1)
    return F.when(name.startswith("\\"), F.substring(name, 2, 1 << 20)).when(F.element_at(imports, first).isNotNull(), F.concat(F.element_at(imports, first), F.substring(name, F.length(first) + 1, F.length(name)))).otherwise(F.concat_ws("\\", F.nullif(namespace, F.lit("")), name))
