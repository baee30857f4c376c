"""Ordered-rule classifiers (C1-C9, T7, T8, F-predicates) as CASE expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shell categories in the order in which they are tried.
SHELL_RULES = (
    ("test", r"\b(phpunit|pest|jest|vitest|pytest|go test|cargo test|rspec|mocha|playwright)\b"),
    ("test", r"\b(npm|yarn|pnpm|composer) (run )?test\b"),
    ("test", r"\bmake test\b|/vendor/bin/(phpunit|pest|phpstan|psalm)"),
    ("db", r"\b(mysql|psql|sqlite3|mysqldump|pg_dump|mongosh|redis-cli)\b"),
    ("db", r"\b(artisan|doctrine|migrate|sequelize|prisma|alembic|flyway)\b"),
    ("git", r"\bgit\b"),
    ("build", r"\b(go build|go install|go run|cargo build|tsc|vite build|webpack|rollup|esbuild|docker build|make\b)"),
    ("build", r"\b(npm|yarn|pnpm|composer|pip|poetry|bundle|gradle|mvn)\b"),
    ("search", r"\b(grep|rg|ag|ack|fd|find)\b"),
    ("read", r"\b(cat|head|tail|less|bat|sed|awk|jq|wc)\b"),
    ("fs", r"\b(mkdir|rm|mv|cp|touch|ln|chmod|chown|ls|tree|stat)\b"),
)
# Languages by extension, and the extensions and names of the other path categories.
LANGUAGES = {
    "go": (".go",), "php": (".php",), "ts": (".ts", ".tsx"), "js": (".js", ".mjs", ".cjs"), "vue": (".vue",), "python": (".py",),
    "rust": (".rs",), "sql": (".sql",), "css": (".css", ".scss"), "template": (".html", ".twig"),
}
DOCS = (".md", ".rst", ".adoc", ".txt")
CONFIG = (".yaml", ".yml", ".json", ".xml", ".toml", ".ini", ".env", ".neon", ".conf", ".dist")
BUILD = ("Makefile", "Dockerfile", "go.mod", "go.sum", "composer.json", "composer.lock", "package.json", "package-lock.json", "yarn.lock", "Cargo.toml", "Cargo.lock")
# What counts as the start of a scope, by extension.
SCOPES = (
    ((".php",), r"(?:public|private|protected|static|final|abstract|readonly|\s)*\s*(function|class|enum|trait|interface)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ((".ts", ".tsx", ".js", ".vue"), r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|const|enum|interface|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ((".twig", ".tpl", ".html"), r"\{%\s*(block|macro)\s+([A-Za-z_][A-Za-z0-9_]*)"),
)
INI = r"^\s*\[([^\]]+)\]"
# What declares a name (which stands for NAME), by extension, and how messages begin that no person wrote.
DECLARATIONS = (
    ((".go",), r"^\s*(func\s+(\([^)]*\)\s*)?|type\s+|const\s+|var\s+)NAME\b"),
    ((".php",), r"\b(function|class|interface|trait|enum|const)\s+NAME\b"),
    ((".ts", ".tsx", ".vue"), r"\b(export\s+)?(default\s+)?(async\s+)?(function|class|interface|type|enum|const|let)\s+NAME\b"),
)
INJECTED = ("<", "Caveat:", "[Request interrupted", "API Error", "This session is being continued")


def first_match(rules: list[tuple[Column, object]], default) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def shell_category(command: Column) -> Column:
    """The first rule that the lower-cased whole command matches."""
    low = F.lower(command)
    return first_match([(low.rlike(r), c) for c, r in SHELL_RULES], "other")


def path_language(path: Column) -> Column:
    """C2: '' if the extension is of no language."""
    ext = extension(path)
    return first_match([(ext.isin(*e), lang) for lang, e in LANGUAGES.items()], "")


def path_category(path: Column) -> Column:
    """Test, migration, docs, build, config, source, other, in this order."""
    ext, base = extension(path), base_name(path)
    return first_match(
        [
            (base.endswith("_test.go") | base.endswith("Test.php") | base.contains(".test.") | base.contains(".spec.") | path.contains("/tests/") | path.contains("/test/") | path.startswith("tests/"), "test"),
            (path.contains("migrations/") | F.lower(base).contains("migration"), "migration"),
            (ext.isin(*DOCS) | path.contains("/docs/") | path.startswith("docs/"), "docs"),
            (base.isin(*BUILD) | path.endswith(".lock") | base.startswith("Dockerfile"), "build"),
            (ext.isin(*CONFIG) | base.startswith(".env") | path.contains("/config/") | path.startswith("config/"), "config"),
            (path_language(path) != "", "source"),
        ],
        "other",
    )


def release_state(tag: Column, published: Column, order: Column) -> Column:
    """C4: order compares the published version with the tag (-1, 0, 1)."""
    return first_match([(F.coalesce(tag, F.lit("")) == "", "no-tags"), (F.coalesce(published, F.lit("")) == "", "unpublished"), (order == 0, "in-sync"), (order == -1, "needs-update")], "local-stale")


def branch_status(pr_state: Column) -> Column:
    """From the newest pull request; null is none."""
    return first_match([(pr_state == "MERGED", "merged"), (pr_state == "CLOSED", "closed"), (pr_state == "OPEN", "open")], "no-pr")


def branch_label(pr_state: Column, number: Column) -> Column:
    """C5."""
    return F.coalesce(F.concat(pr_state, F.lit("#"), number.cast("string")), F.lit("none"))


def deletable(branch: Column, status: Column, mode: str) -> Column:
    """worktree branches never; merged ones, and closed ones if the mode says so."""
    kept = branch.startswith("wt/")
    return ~kept & status.isin(*{"merged": ["merged"], "closed": ["merged", "closed"]}.get(mode, [""]))


def plugin_state(error: Column, fit: Column, disabled: Column) -> Column:
    """An error of loading counts before an unfit protocol (compatible() says which), and that before the user's choice."""
    return F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), error)).when(fit != "ok", fit).when(F.coalesce(disabled, F.lit(False)), "disabled").otherwise("enabled")


def ci_state(state: Column) -> Column:
    """C6."""
    return F.coalesce(F.nullif(state, F.lit("")), F.lit("NONE"))


def ci_glyph(state: Column) -> Column:
    """C6."""
    return first_match([(state == "SUCCESS", "✓"), (state.isin("FAILURE", "ERROR"), "✗"), (state.isin("PENDING", "EXPECTED"), "⏳")], "–")


def review_short(decision: Column) -> Column:
    """C6."""
    return first_match([(decision == "APPROVED", "approved"), (decision == "CHANGES_REQUESTED", "changes"), (decision == "REVIEW_REQUIRED", "review")], "–")


def action_rank(ci: Column, review: Column) -> Column:
    """Broken or to be changed, then pending, then the rest."""
    return first_match([(ci.isin("FAILURE", "ERROR") | (review == "CHANGES_REQUESTED"), 0), (ci.isin("PENDING", "EXPECTED") | (review == "REVIEW_REQUIRED"), 1)], 2)


def status_rank(status: Column) -> Column:
    """O5."""
    return first_match([(status == s, k) for k, s in enumerate(("merged", "closed", "no-pr", "open"))], 4)


def check_status(ok: Column, fail: Column) -> Column:
    """A check that passed with a message was skipped."""
    return first_match([(ok & (F.coalesce(fail, F.lit("")) != ""), "skip"), (ok, "ok")], "FAIL")


def build_status(head: Column, built: Column, dirty: Column) -> Column:
    """A build older than the newest commit fails, uncommitted changes warn."""
    return first_match([(head > built, "fail"), (dirty, "warn")], "ok")


def heavy_tool_hint(tool: Column, hints: dict[str, str]) -> Column:
    """The hint for a tool, '' without one."""
    return first_match([(tool == t, h) for t, h in hints.items()], "")


def is_human(text: Column) -> Column:
    """neither blank nor one of the messages that tools put in a person's place."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return (t != "") & ~reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in INJECTED])


def is_failing(status: Column, conclusion: Column) -> Column:
    """F13."""
    return (status == "completed") & (F.coalesce(conclusion, F.lit("")) != "") & (conclusion != "success")


def is_stable(version: Column) -> Column:
    """F14."""
    low = F.lower(version)
    return ~(low.startswith("dev-") | low.contains("-dev") | low.rlike("alpha|beta|rc"))


def scope_label(line: Column, ext: Column) -> Column:
    """The scope that a line opens, by the first match on it, or null."""
    rules = []
    for extensions, pattern in SCOPES:
        label = F.concat_ws(" ", F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
        rules.append((ext.isin(*extensions) & line.rlike(pattern), label))
    rules.append(((ext == ".ini") & line.rlike(INI), F.concat(F.lit("["), F.regexp_extract(line, INI, 1), F.lit("]"))))
    return first_match(rules, F.lit(None).cast("string"))


def ref_kind(symbol: str, line: Column, ext: Column) -> Column:
    """Def if the line declares the symbol in the file's language, else use."""
    rules = [(ext.isin(*extensions) & line.rlike(pattern.replace("NAME", re.escape(symbol))), "def") for extensions, pattern in DECLARATIONS]
    return first_match(rules, "use")


STRUCTURAL = (".go", ".php", ".ts", ".tsx", ".vue")
GUARD_BYTES = 8192


def bare_cat(command: Column) -> Column:
    """F16: the file of a plain `cat FILE`, else null; anything piped, flagged or globbed is left alone."""
    words = F.split(F.regexp_replace(F.btrim(command), r"\s+", " "), " ")
    path = F.btrim(F.get(words, F.lit(1)), F.lit("'\""))
    plain = ~command.rlike(r"[|&;<>$`(){}\n*?]") & (F.size(words) == 2) & (base_name(F.get(words, F.lit(0))) == "cat")
    return F.when(plain & (path != "") & ~path.startswith("-"), path)


def guard_action(tool: Column, path: Column, offset: Column, limit: Column, command: Column, size: Column, seen: Column, mode: str, least: int = GUARD_BYTES) -> Column:
    """F16: allow, suggest or deny a full read of a large source file, by mode (off, suggest, nudge, strict)."""
    target = F.when((tool == "Read") & ~((F.coalesce(offset, F.lit(0)) > 0) | (F.coalesce(limit, F.lit(0)) > 0)), path).when(tool == "Bash", bare_cat(command))
    large = F.coalesce(F.regexp_extract(target, r"(\.[^./]*)$", 1).isin(*STRUCTURAL) & (size >= least), F.lit(False))
    if mode == "off":
        return F.lit("allow")
    act = {"suggest": F.lit("suggest"), "strict": F.lit("deny")}.get(mode, F.when(seen, "allow").otherwise("deny"))
    return F.when(large, act).otherwise("allow")
