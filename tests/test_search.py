import pytest
from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import dialect as D
from tracewright.operators import search as T
from tracewright.sources import files as SC


def files(spark, *rows):
    return spark.createDataFrame([(p, "." + p.rsplit(".", 1)[-1], c) for p, c in rows], "path string, ext string, content string")


def found(df):
    return sorted((r.pattern, r.line, r.col) for r in df.collect())


def test_lines(spark):
    df = T.lines(files(spark, ("a.txt", "x\r\ny\n\nz"), ("b.txt", ""), ("c.txt", "one\n"), ("d.txt", None)))
    assert sorted((r.path, r.line, r.text) for r in df.collect()) == [("a.txt", 1, "x"), ("a.txt", 2, "y"), ("a.txt", 3, ""), ("a.txt", 4, "z"), ("c.txt", 1, "one")]


def test_matching(spark):
    rows = T.lines(files(spark, ("a.txt", "foo food foo\nпривет foo\nПРИВЕТ\naaaa\nfoo_bar a.c abc\n")))
    assert found(T.hits(rows, ["foo"])) == [("foo", 1, 0), ("foo", 1, 4), ("foo", 1, 9), ("foo", 2, 13), ("foo", 5, 0)]
    assert found(T.hits(rows, ["foo"], word=True)) == [("foo", 1, 0), ("foo", 1, 9), ("foo", 2, 13)]
    assert found(T.hits(rows, ["привет"], word=True, ignore_case=True)) == [("привет", 2, 0), ("привет", 3, 0)]
    assert found(T.hits(rows, ["aa", ""])) == [("aa", 4, 0), ("aa", 4, 2)]
    assert found(T.hits(rows, ["a.c"])) == [("a.c", 5, 8)]
    assert found(T.hits(rows, ["a.c"], regex=True)) == [("a.c", 5, 8), ("a.c", 5, 12)]
    assert found(T.hits(rows, ["(?:foo|bar)$"], regex=True)) == [("(?:foo|bar)$", 1, 9), ("(?:foo|bar)$", 2, 13)]
    assert found(T.hits(rows, ["привет"], regex=True, ignore_case=True)) == [("привет", 2, 0), ("привет", 3, 0)]
    assert T.hits(rows, [""]).count() == 0


@pytest.mark.parametrize("pattern", ["(?=x)", r"(a)\1", "a++", "(?>a)", "(a"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        D.java_regex(pattern)


def test_enclosing_excludes_the_own_line_and_crosses_chunks(spark):
    php = "class A\nx\npublic function go()\nx\n" + "x\n" * 20
    rows = T.lines(files(spark, ("a.php", php), ("b.ini", "[one]\nk=1\n[two]\nk=2"), ("c.py", "def f():\n  x")))
    got = {(r.path, r.line): r.enclosing for r in T.enclosing(rows, chunk=4).collect()}
    assert got["a.php", 1] == "" and got["a.php", 3] == "class A" and got["a.php", 4] == got["a.php", 20] == "function go"
    assert got["b.ini", 2] == "[one]" and got["b.ini", 4] == "[two]" and got["c.py", 2] == ""


def test_grep_and_cap(spark):
    f = files(spark, ("a.php", "foo\nfoo foo"), ("b.php", "foo\0bar foo"), ("c.php", "class K\nfoo"))
    out = T.grep(f, ["foo", "none"])
    assert [(r.pattern, r.files, r.hits) for r in out["patterns"].collect()] == [("foo", 2, 4)]
    assert [r.pattern for r in out["empty"].collect()] == ["none"] and out["skipped"].first().skipped == 1
    assert {(r.k, r.more) for r in T.capped(out["hits"], 3).groupBy().agg(F.count("*").alias("k"), F.max("more").alias("more")).collect()} == {(3, 1)}
    # a.php:1:foo\n is 12 characters and so on; rounded once
    assert out["raw"].first().raw_tokens == round(sum(len(s) for s in ("a.php:1:foo\n", "a.php:2:foo foo\n", "a.php:2:foo foo\n", "c.php:2:foo\n")) / 4)


def test_refs(spark):
    f = files(spark, ("a.go", "func Run() {}\nx := Run()\n"), ("b.php", "function Run() {}\nRunner Run"), ("c.py", "def Run(): pass"), ("d.ts", "const (\n export class Run {}"))
    got = [(r.kind, r.file, r.line) for r in T.refs(f, "Run").collect()]
    assert got == [("def", "a.go", 1), ("def", "b.php", 1), ("def", "d.ts", 2), ("use", "a.go", 2), ("use", "b.php", 2)]
    totals = T.ref_totals(T.refs(f, "Run")).first()
    assert (totals.defs, totals.uses) == (3, 2)
    with pytest.raises(ValueError):
        T.refs(f, "a.*")
    assert (T.most_refs(0), T.most_refs(-1), T.most_refs(7)) == (30, None, 7)


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src", True), ("src/**", "src/a/b", True), ("src/**", "srcx/a", False), ("**/*.go", "a/b/c.go", True), ("**/*.go", "c.go", True), ("*.go", "a/c.go", False), ("a/?/c", "a/b/c", True), ("a/?/c", "a//c", False), ("a/[bc]d", "a/cd", True), ("a/[!b]d", "a/bd", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a.b", "axb", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(D.glob_regex(glob)).alias("x")).first().x is hit


def test_layers(spark):
    layers = [("ui", ["web/**"]), ("core", ["**/*.go"])]
    f = files(spark, ("web/a.go", "foo"), ("./core/b.go", "foo"), ("x.txt", "foo"))
    assert [(r.layer, r.file) for r in T.by_layer(T.grep(f, ["foo"])["hits"], layers).collect()] == [("ui", "web/a.go"), ("core", "./core/b.go"), ("(unclassified)", "x.txt")]
    assert [(r.layer, r.files) for r in T.layer_counts(f, layers).collect()] == [("ui", 1), ("core", 1), ("(unclassified)", 1)]


@pytest.mark.parametrize(("command", "category"), [("git grep x", "git"), ("cat x | grep y", "search"), ("cd x && go test ./...", "test"), ("NPM test", "test"), ("npm install", "build"), ("vendor/bin/phpstan", "other"), ("./vendor/bin/phpstan", "test"), ("psql -c x", "db"), ("ls -la", "fs"), ("tail x", "read"), ("echo", "other")])
def test_shell_categories(spark, command, category):
    assert spark.range(1).select(C.shell_category(F.lit(command)).alias("c")).first().c == category


def test_readers_of_trees(spark, tmp_path):
    for name, text in {"a.go": "x", "vendor/b.go": "x", "sub/c.GO": "x", "sub/d.txt": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    assert sorted(r.path for r in SC.tree(spark, str(tmp_path), [".go"]).collect()) == ["a.go", "sub/c.GO"]
    known = spark.createDataFrame([("a.go",), ("sub/c.php",), ("sub/d.txt",)], "path string")
    assert [r.path for r in SC.expand(known, ["sub", "a.go", "*.go"]).collect()] == ["sub/c.php", "a.go"]
    with pytest.raises(ValueError):
        SC.expand(known, ["none"])
    assert SC.split_arguments(["a.go", "Name", "x/y"], set()) == (["a.go", "x/y"], ["Name"])
    assert SC.json_lines(spark, str(tmp_path / "nowhere.jsonl")).count() == 0


def test_a_call_has_a_most_of_files_a_table_has_none(spark):
    known = spark.range(2 * SC.MOST_FILES).select(F.format_string("sub/%d.go", "id").alias("path"))
    assert SC.expanded(known, ["sub", "*.php"]).count() == 2 * SC.MOST_FILES and SC.expanded(known, ["none"]).count() == 0
    with pytest.raises(ValueError):
        SC.expand(known, ["sub"])


def test_transcripts(spark, tmp_path):
    d = tmp_path / "-home-me-app"
    d.mkdir()
    (d / "abc-1.jsonl").write_text('{"type":"user","message":{"content":"hi"}}\nbroken\n{"type":"assistant"}\n')
    rows = SC.transcripts(spark, str(tmp_path))
    assert sorted((r.line_no, r.stem, r.dir_name) for r in rows.collect()) == [(1, "abc-1", "-home-me-app"), (3, "abc-1", "-home-me-app")]
    one = SC.session_files(rows)
    assert [SC.select_session(one, s).count() for s in ("last", "ABC", "home", "zzz")] == [1, 1, 1, 0]
