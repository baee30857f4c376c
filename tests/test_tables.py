import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewright.operators import diffs as D
from tracewright.operators import releases as R
from tracewright.operators import sessions as N
from tracewright.operators import structure as X
from tracewright.plans import catalog
from tracewright.plans.facade import TOOLS, Adapter, Manifest, Registry


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert len(TOOLS) >= 18


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:3] == ["tool", "calls", "errors"]


TRANSCRIPT = [
    '{"type":"user","cwd":"/w/app","timestamp":"2026-01-01T00:00:00Z","message":{"content":"fix it"}}',
    '{"type":"assistant","gitBranch":"main","durationMs":1500,"message":{"model":"m","usage":{"input_tokens":5,"output_tokens":100,"cache_read_input_tokens":200,"cache_creation_input_tokens":50},"content":[{"type":"text","text":"ok"},{"type":"tool_use","id":"1","name":"Bash","input":{"command":"grep x"}},{"type":"tool_use","id":"2","name":"Read","input":{"file_path":"a.go"}},{"type":"tool_use","id":"3","name":"Edit","input":{"file_path":"a.go"}},{"type":"tool_use","id":"4","name":"Write","input":{"file_path":"b.go"}}]}}',
    '{"type":"user","timestamp":"2026-01-01T00:01:00Z","message":{"content":[{"type":"tool_result","tool_use_id":"1","content":"short"},{"type":"tool_result","tool_use_id":"2","content":[{"type":"text","text":"' + "x" * 7000 + '"}]},{"type":"tool_result","tool_use_id":"9","content":"?"}]}}',
    '{"type":"user","isMeta":true,"message":{"content":"reminder"}}',
    '{"type":"user","message":{"content":"This session is being continued"}}',
    '{"aiTitle":"Title","prNumber":7,"prUrl":"u","messageCount":9}',
]


def test_transcripts(spark):
    lines = spark.createDataFrame([("p/abc-1.jsonl", k + 1, "-home-app", t) for k, t in enumerate(TRANSCRIPT)], "path string, line_no long, dir_name string, t string").withColumn("v", F.parse_json("t"))
    rows = N.entries(lines)
    blocks = N.blocks(rows)
    s = N.fold(rows).first()
    assert (s.id, s.project, s.branch, s.title, s.model, s.messages, s.duration_ms, s.input, s.output, s.cache_read, s.cache_creation) == ("abc", "app", "main", "Title", "m", 9, 1500, 5, 100, 200, 50)
    assert (s.end - s.start).total_seconds() == 60
    assert [r.text for r in N.prompts(rows, blocks).collect()] == ["fix it"]
    uses = N.tool_uses(blocks)
    results = N.attributed(N.tool_results(blocks), uses)
    assert sorted((r.tool, r.tokens) for r in results.collect()) == [("?", 0), ("Bash", 1), ("Read", 1750)]
    assert [(r.tool, r.tokens, r.brief) for r in N.fat_results(results).collect()] == [("Read", 1750, "a.go")]
    assert {(r.tool, r.calls, r.result_tokens) for r in N.tool_histogram(uses, results).collect()} == {("Bash", 1, 1), ("Read", 1, 1750), ("Edit", 1, 0), ("Write", 1, 0)}
    assert [(r.file, r.reads, r.edits, r.writes) for r in N.file_touches(uses).collect()] == [("a.go", 1, 1, 0), ("b.go", 0, 0, 1)]
    assert [(r.category, r.calls, r.unique) for r in N.command_summary(N.commands(uses)).collect()] == [("search", 1, 1)]
    assert [r.number for r in N.pull_requests_of(rows).collect()] == [7] and N.last_texts(rows, blocks).first().text == "ok"


def test_value(spark):
    m = 1_000_000
    rows = [("a", "x-2024", "2026-07-01", m, 0), ("b", "x", "2026-07-03", 0, m), ("c", "none", "2026-07-01", 2 * m, 0), ("d", "x", "2026-06-20", m, 0), ("e", "x", "2026-01-01", m, m)]
    s = spark.createDataFrame([(p, mod, e, e, i, o, 0, 0) for p, mod, e, i, o in rows], "path string, model string, start string, end string, input long, output long, cache_read long, cache_creation long").withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp"))
    v = N.value(s, spark.createDataFrame([("x", 5.0, 25.0)], "model string, input double, output double"), F.lit("2026-07-02 12:00:00").cast("timestamp"))
    assert {(r.period, r.sessions, r.cost, r.unpriced_tokens) for r in v["periods"].collect()} == {("current", 3, 30.0, 2 * m), ("previous", 1, 5.0, 0)}
    d = v["delta"].first()
    assert (d.delta, d.delta_pct) == (25.0, 500.0)
    assert [(r.model, r.priced) for r in v["by_model"].collect()] == [("x", True), ("x-2024", True), ("none", False)]
    assert N.value(s.limit(0), spark.createDataFrame([("x", 5.0, 25.0)], "model string, input double, output double"), F.lit("2026-07-02").cast("timestamp"))["delta"].first().delta_pct == 0.0


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord int, line string")


def test_changes(spark):
    status = lines(spark, "M\tsrc/a.go\nD\tsrc/gone.php\nR090\told.go\tnew.go\nA\tlogo.png")
    numstat = lines(spark, "3\t1\tsrc/a.go\n0\t9\tsrc/gone.php\n1\t0\t{old.go => new.go}\n-\t-\tlogo.png")
    hunks = lines(spark, "+++ b/src/a.go\n@@ -1 +1 @@ func B()\n@@ -9 +9 @@ func A()\n@@ -20 +20 @@ func B()\n+++ /dev/null\n@@ -1 +0 @@ class Gone\n+++ b/new.go\n@@ -1 +1 @@")
    got = {r.path: r for r in D.changes(status, numstat, hunks, lines(spark, "?? tests/n.php\n?? src/a.go\n M x")).collect()}
    assert set(got) == {"src/a.go", "src/gone.php", "new.go", "logo.png", "tests/n.php"}
    assert got["src/a.go"].symbols == ["func B()", "func A()"] and (got["src/a.go"].adds, got["src/a.go"].dels) == (3, 1)
    assert got["src/gone.php"].symbols == [] and got["new.go"].status == "R" and got["logo.png"].adds == 0 and got["tests/n.php"].status == "?"


def test_pull_requests_and_branches(spark):
    rows = [("owned", "acme/b", False, 1, "SUCCESS"), ("author", "acme/b", True, 11, "FAILURE"), ("owned", "acme/b", True, 11, "FAILURE"), ("owned", "acme/c", True, 3, None), ("reviewer", "acme/a", False, 2, "PENDING"), ("author", "acme/a", False, 2, "PENDING")]
    prs = spark.createDataFrame([(d, r, f, n, "t", False, None, c, "u", k) for k, (d, r, f, n, c) in enumerate(rows)], "dim string, repo string, is_fork boolean, number int, title string, is_draft boolean, review string, ci string, url string, ord int")
    assert [(r.repo, r.number, r.role) for r in R.pull_requests(prs).collect()] == [("acme/b", 11, "author"), ("acme/a", 2, "author"), ("acme/b", 1, "owned")]
    refs = spark.createDataFrame([("r", False, "main", "main", "x", 1, "OPEN"), ("r", False, "main", "o", "2026-06-01T00:00:00Z", 2, "OPEN"), ("r", False, "main", "m", "2026-06-01T00:00:00Z", 11, "MERGED"), ("r", False, "main", "n", "bad", None, None), ("z", True, "main", "q", "x", None, None)], "repo string, archived boolean, default_branch string, name string, committed_date string, pr_number int, pr_state string")
    assert [(r.branch, r.age_days, r.pr, r.status) for r in R.branches(refs, F.lit("2026-06-14").cast("timestamp")).collect()] == [("m", 13, "MERGED#11", "merged"), ("n", -1, "none", "no-pr"), ("o", 13, "OPEN#2", "open")]


def test_packages(spark):
    p = spark.createDataFrame([("a/x", None, {"php": "^8", "ext-json": "*", "b/y": "1"}, {"z": "1"}, "d1")], "name string, type string, require map<string,string>, dev map<string,string>, dir string")
    p = p.withColumnRenamed("dev", "require-dev").withColumn("version", F.lit("1.0")).withColumn("scripts", F.map_from_arrays(F.array(F.lit("test"), F.lit("check")), F.array(F.parse_json(F.lit('"x"')), F.parse_json(F.lit('["a","b"]')))))
    r = R.package_list(p).first()
    assert (r.type, r.php, r.scripts, r.deps, r.dev) == ("library", "^8", ["check", "test"], ["b/y"], ["z"])
    assert [(s.script, s.value) for s in R.package_scripts(p).collect()] == [("check", "a && b"), ("test", "x")]
    versions = spark.createDataFrame([("a", "1.0", 0), ("a", "v2.0.0", 1), ("a", "2.0", 2), ("a", "3.0-beta", 3), ("a", "dev-main", 4)], "name string, version string, ord int")
    assert R.latest_stable(versions).first().published == "v2.0.0"


def test_go_that_does_not_balance_has_no_declarations():
    assert X.go_decls("package a\nfunc x() {\n") == []
    assert X.python_decls("") == [] and X.php_decls("<?php\n") == [] and X.ts_decls("") == [] and X.route_rows("") == []


def test_adapters_and_registry():
    a = Adapter("k", ("go.mod",), (("ui", ("web/**",)),), "K_ROOT")
    assert a.root("/f", {}, "/x") == "/f" and a.root("", {"K_ROOT": "/e"}, "/x") == "/e"
    assert a.root("", {}, "/a/b/c", lambda p: p == "/a/go.mod") == "/a" and a.root("", {}, "/a", lambda p: False) is None
    for bad in ((("",), ()), ((), ()), (("m",), (("x", ("../y",)),)), (("m",), (("x", ()), ("x", ())))):
        with pytest.raises(ValueError):
            Adapter("k", *bad)
    r = Registry("2.1")
    r.add(Manifest("one", "2.0"), lambda: "found", managed=False)
    r.add(Manifest("one", "2.0"), lambda: "managed")
    r.add(Manifest("old", "0.5"), lambda: None)
    r.add(Manifest("off", "1.0"), lambda: None)
    r.disabled |= {"off", "old"}
    r.errors["broken"] = "no file"
    assert r.call("one") == "managed" and r.list() == [("broken", "error: no file", False), ("off", "disabled", True), ("old", "too-old", True), ("one", "enabled", True)]
    with pytest.raises(ValueError):
        r.call("off")
