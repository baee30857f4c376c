"""Patterns: RE2 syntax on Java's engine, and path globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Syntax that Java takes and RE2 refuses.
REFUSED = re.compile(r"\(\?[=!]|\(\?<[=!]|\(\?>|\\[1-9]|\\k<|[*+?}]\+")
WORD = r"[\p{L}\p{Nd}_]"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same language for Java; a pattern that RE2 refuses is a ValueError."""
    bare = re.sub(r"\\[^1-9k]|\[(?:\\.|[^\]])*\]", "x", pattern)
    if REFUSED.search(bare):
        raise ValueError(f"not a pattern: {pattern!r}")
    if bare.count("(") != bare.count(")"):
        raise ValueError(f"not a pattern: {pattern!r}")
    body = re.sub(r"(?<!\\)\$$", r"\\z", pattern)
    return f"(?d{'iu' if ignore_case else ''}:{body})"


def quoted(text: str) -> str:
    """A literal as a pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_word(text: str) -> str:
    """T4: a literal that no letter, digit or underscore touches."""
    return f"(?<!{WORD}){quoted(text)}(?!{WORD})"


def glob_regex(glob: str) -> str:
    """A pattern for a slash-separated glob. ** stands for any number of segments, none included; * and ? stay in one."""
    out = ""
    segments = glob.split("/")
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out = (out[:-1] + "(?:/.*)?" if out.endswith("/") else out + ".*") if last else out + "(?:[^/]*/)*"
            continue
        part, i = "", 0
        while i < len(segment):
            c = segment[i]
            close = segment.find("]", i + 2) if c == "[" else -1
            if c == "*":
                part += "[^/]*"
            elif c == "?":
                part += "[^/]"
            elif close > 0:
                inner = segment[i + 1 : close]
                part += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("[", "\\[") + "]"
                i = close
            else:
                part += re.escape(c)
            i += 1
        out += part + ("" if last else "/")
    return f"^{out}$"


def layer_of(path: Column, layers: list[tuple[str, list[str]]], none: str = "(unclassified)") -> Column:
    """The first declared layer with a glob that matches the path, a leading ./ aside."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    out = F.lit(none)
    for name, globs in reversed(layers):
        hit = plain.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
        out = F.when(hit, name).otherwise(out)
    return out


def layer_rank(layer: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """Declared order, the rest last."""
    out = F.lit(len(layers))
    for k, (name, _) in reversed(list(enumerate(layers))):
        out = F.when(layer == name, k).otherwise(out)
    return out
