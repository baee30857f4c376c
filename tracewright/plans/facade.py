"""Named tools (E8), their registry with precedence and checks (E3-E6), and declarative adapters."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tracewright.operators import calllog, diffs, releases, search, sessions, structure

#: The read-only tools, each a function over tables.
TOOLS: dict[str, Callable[..., object]] = {
    "history": calllog.recent, "history_stats": calllog.tool_stats, "history_histogram": calllog.histogram, "history_adoption": calllog.adoption, "gripes": calllog.feedback,
    "cc_ls": sessions.index_view, "cc_show": sessions.fold, "cc_resume": sessions.resume, "cc_prompts": sessions.prompts, "cc_bash": sessions.bash_view, "cc_candidates": sessions.heavy_tools, "cc_value": sessions.value, "cc_quota": calllog.quota,
    "grep": search.grep, "refs": search.refs, "code": structure.summaries, "code_symbols": structure.slices, "changed": diffs.changes,
    "composer_ls": releases.package_list, "composer_show": releases.package_scripts, "packagist_status": releases.release_status, "github_ci": releases.ci_latest, "github_pr": releases.pull_requests, "github_branches": releases.branches, "vue_routes": structure.routes,
}


@dataclass(frozen=True)
class Adapter:
    """A project's layers and files, declared. layers are (name, globs) in order of precedence."""

    kind: str
    root_markers: tuple[str, ...]
    layers: tuple[tuple[str, tuple[str, ...]], ...]
    root_key: str = ""
    extensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = [n for n, _ in self.layers]
        globs = [g for _, gs in self.layers for g in gs]
        if not self.root_markers:
            raise ValueError("an adapter needs root markers")
        if len(set(names)) < len(names) or not all(names):
            raise ValueError("layer names must differ")
        for g in [*globs, *self.root_markers]:
            if not g or g.startswith("/") or ".." in g.split("/") or "\\" in g:
                raise ValueError(f"not a relative path: {g!r}")

    def root(self, flag: str, env: Mapping[str, str], start: str, exists: Callable[[str], bool] = os.path.exists) -> str | None:
        """The flag, else the environment, else the nearest directory upwards that has all markers."""
        if flag or env.get(self.root_key):
            return flag or env[self.root_key]
        at = start
        while True:
            if all(exists(os.path.join(at, m)) for m in self.root_markers):
                return at
            if at == os.path.dirname(at):
                return None
            at = os.path.dirname(at)

    def _layers(self) -> list[tuple[str, list[str]]]:
        return [(n, list(g)) for n, g in self.layers]

    def _files(self, files: DataFrame) -> DataFrame:
        return files.where(files["ext"].isin(*self.extensions)) if self.extensions else files

    def layer_counts(self, files: DataFrame) -> DataFrame:
        return search.layer_counts(self._files(files), self._layers())

    def grep(self, files: DataFrame, patterns: list[str], **how) -> DataFrame:
        return search.by_layer(search.grep(self._files(files), patterns, **how)["hits"], self._layers())

    def refs(self, files: DataFrame, symbol: str) -> DataFrame:
        return search.by_layer(search.refs(self._files(files), symbol), self._layers())


@dataclass(frozen=True)
class Manifest:
    """What an extension says of itself."""

    name: str
    protocol: str
    commands: tuple[str, ...] = ()
    schema: int = 1
    min_version: str = ""
    settings: Mapping[str, str] = field(default_factory=dict)
    capabilities: tuple[str, ...] = ()
    adapter: Adapter | None = None


def numbers(text: str) -> tuple[int, int, int] | None:
    """N16 on the driver."""
    if not re.fullmatch(r"v?\d+(\.\d+){0,2}", text):
        return None
    return tuple((*map(int, text.lstrip("v").split(".")), 0, 0)[:3])  # type: ignore[return-value]


def compatible(host: str, plugin: str) -> str:
    """Ok, invalid, too-new or too-old; the host speaks the major protocol before its own, too."""
    h, p = numbers(host), numbers(plugin)
    if not h or not p:
        return "invalid"
    if p[0] > h[0] or p[0] == h[0] and p[1] > h[1]:
        return "too-new"
    return "too-old" if p[0] < h[0] - 1 else "ok"


@dataclass
class Registry:
    """Functions by name. Managed ones hide those found by convention; nothing runs until it is called."""

    protocol: str = "1.0"
    managed: dict[str, tuple[Manifest, Callable]] = field(default_factory=dict)
    found: dict[str, tuple[Manifest, Callable]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def add(self, manifest: Manifest, run: Callable, managed: bool = True) -> None:
        (self.managed if managed else self.found)[manifest.name] = (manifest, run)

    def state(self, name: str) -> str:
        """A load error counts before an unfit protocol, and that before the user's choice."""
        if name in self.errors:
            return f"error: {self.errors[name]}"
        entry = self.managed.get(name) or self.found.get(name)
        if not entry:
            return "unknown"
        fit = compatible(self.protocol, entry[0].protocol)
        return fit if fit != "ok" else "disabled" if name in self.disabled else "enabled"

    def list(self) -> list[tuple[str, str, bool]]:
        return [(n, self.state(n), n in self.managed) for n in sorted({*self.managed, *self.found, *self.errors})]

    def call(self, name: str, *args, **params):
        if self.state(name) != "enabled":
            raise ValueError(f"{name}: {self.state(name)}")
        return (self.managed.get(name) or self.found[name])[1](*args, **params)
