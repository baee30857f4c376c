"""Orders, names, readers and renderings over whole tables: against brute force, and by their plans."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.operators import diffs, names, releases, sessions, structure
from tracewright.operators.documents import Section, document, load_document, save_document
from tracewright.operators.ordered import Ordered
from tracewright.plans import api_queries, source_queries
from tracewright.sources import api_documents as A
from tracewright.sources import files as SC

NESTED = re.compile("NestedLoop|Cartesian")


def plan(df) -> str:
    df.collect()  # the plan that ran
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_over_ranges(spark, many_ranges):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, None, "x", "y"]), rng.choice([None, 1, 5])) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "ord long, name string, n long").repartition(7)
    o = Ordered(df, "ord", sums={"upto": F.col("n")}, values={"latest": F.col("name")})
    got = sorted(tuple(r) for r in o.rows("place").collect())
    want, total, latest = [], 0, None
    for k, (ord_, name, n) in enumerate(sorted(rows), 1):
        total, latest = total + (n or 0), name or latest
        want.append((ord_, name, n, total, latest, k))
    assert got == want and o.total == 700
    assert len({r["_range"] for r in o.table.select("_range").distinct().collect()}) > 1
    empty = Ordered(df.limit(0), "ord", values={"latest": F.col("name")})
    assert empty.rows("place").collect() == [] and empty.total == 0


def test_no_window_takes_a_whole_table(spark, many_ranges):
    lines = spark.createDataFrame([(0, "+++ b/a.go"), (1, "@@ -1 +1 @@ func A()"), (2, "+++ b/b.go"), (3, "@@ -1 +1 @@ func B()")], "ord int, line string")
    listing = spark.createDataFrame(list(enumerate(["worktree /w/a", "HEAD abc", "branch refs/heads/x", "", "worktree /w/b", "detached"])), "ord int, line string")
    for df in (diffs.hunk_symbols(lines), releases.worktrees(listing)):
        assert "SinglePartition" not in plan(df)
    assert [(r.block, r.slug, r.branch, r.detached) for r in releases.worktrees(listing).orderBy("block").collect()] == [(1, "a", "x", False), (2, "b", None, True)]


# --- names ---------------------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def slow_nearest(words, known):
    out = {}
    for w in {w for w in words if w and w.strip()}:
        low = w.strip(" ").lower()
        most = max(1, -(-len(low) // 3))
        near = min(((distance(low, n.lower()), k, n) for n, k in known if n is not None and distance(low, n.lower()) <= most), default=None)
        if low and near:
            out[w] = (near[2], near[0])
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_nearest_names_against_brute_force(spark, letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    known = [(word(rng.randrange(0, 14)), k) for k in range(60)] + [(None, 99), ("Abba", 100), ("abBA", 101)]
    words = [word(rng.randrange(0, 16)) for _ in range(120)] + [None, "", "  ", " ABBA "]
    for n, _ in known[:40]:
        cut = list(n or "a")
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(cut) + 1)
            cut[at : at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
        words.append("".join(cut))
    got = names.nearest_names(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(known, "name string, ord int"))
    assert {r.word: (r.name, r.distance) for r in got.collect()} == slow_nearest(words, known)


@pytest.mark.parametrize(("target", "want"), [("Contact", "Contract"), ("Deals", "Deal"), ("deal", "Deal"), ("Invoice", None), ("", None), ("PlayerProfile", "PlayerProfile")])
def test_nearest_entity(spark, target, want):
    known = spark.createDataFrame([(n, k) for k, n in enumerate(["Contract", "Deal", "PlayerProfile", "MarketplaceListing"])], "name string, ord int")
    words = spark.createDataFrame([(target,)], "word string")
    got = names.nearest_names(words, known).collect()
    assert [r.name for r in got] == ([want] if want else [])
    assert names.nearest_names(words, known.limit(0)).collect() == []


def test_names_meet_by_equality(spark, no_broadcast):
    known = spark.createDataFrame([("alpha", 0), ("beta", 1)], "name string, ord int")
    assert not NESTED.search(plan(names.nearest_names(spark.createDataFrame([("alpa",)], "word string"), known)))
    classes = spark.createDataFrame([("App\\Sub\\X",), ("App\\Y",), ("AppZ\\W",), ("Q",)], "fqcn string")
    prefixes = spark.createDataFrame([("App\\", "src"), ("App\\Sub\\", "lib/sub/")], "prefix string, dir string")
    paths = structure.psr4_path(classes, prefixes)
    assert {r.fqcn: r.path for r in paths.collect()} == {"App\\Sub\\X": "lib/sub/X.php", "App\\Y": "src/Y.php"}
    assert not NESTED.search(plan(paths))
    every = structure.psr4_path(classes, prefixes.unionByName(spark.createDataFrame([("", "any")], "prefix string, dir string")))
    assert {r.fqcn: r.path for r in every.collect()}["AppZ\\W"] == "any/AppZ/W.php"
    models = spark.createDataFrame([("a", "m-large-2024"), ("b", "m-large"), ("c", "m"), ("d", "m-largest"), ("e", None), ("f", "other")], "id string, model string")
    rated = sessions.priced(models, spark.createDataFrame([("m", 1.0, 2.0), ("m-large", 3.0, 4.0)], "model string, input double, output double"))
    assert {r.id: r.rate_in for r in rated.collect()} == {"a": 3.0, "b": 3.0, "c": 1.0, "d": 1.0, "e": None, "f": None}
    assert not NESTED.search(plan(rated))


# --- readers -------------------------------------------------------------------------------------
def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 1), ("c", 0)):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"{name}.jsonl").write_text("".join((json.dumps({"k": k, "pad": "x" * (k % 50)}) if k % 9 else "broken") + "\n" for k in range(1, n + 1)))
    with source_queries.splits_of(spark, "1k"):
        rows = SC.transcripts(spark, str(tmp_path))
        got = rows.select("stem", "line_no", F.try_variant_get("v", "$.k", "long").alias("k")).collect()
    assert sorted((r.stem, r.line_no) for r in got) == [("a", k) for k in range(1, 401) if k % 9] + [("b", 1)]
    assert all(r.line_no == r.k for r in got)


def test_a_first_time_prunes_files(spark, tiny):
    """Files written before it aren't read at all."""
    rows = source_queries.late_sessions(spark, tiny, "dir=")
    assert {r.odd for r in rows.select((F.try_variant_get("v", "$.sessionId", "long") % 2).alias("odd")).distinct().collect()} == {1}
    root = rows.select(F.regexp_replace("path", "/dir=.*", "").alias("r")).first().r
    every = spark.read.text(f"{root}/*/*.txt").select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    first = min(r.file_modification_time for r in every if r.file_path in {x.path for x in rows.select("path").distinct().collect()})
    late = spark.read.text(f"{root}/*/*.txt").where(F.col("_metadata.file_modification_time") >= F.lit(first)).select("value")
    late.collect()
    scan = late._jdf.queryExecution().executedPlan()
    while scan.children().nonEmpty():
        scan = scan.children().head()
    read = scan.metrics().get("numFiles").get().value()
    assert 0 < read < len(every)


def test_package_documents(spark):
    docs = {"ok": '{"name":"a/b","require":{"php":"^8","x/y":"1"},"scripts":{"t":"run","l":["a","b"],"o":{"k":1}},"autoload":{"psr-4":{"A\\\\":"src"}}}', "cut": '{"name":', "list": '{"name":"c","require":[]}', "number": '{"name":"d","require":{"x":1}}', "array": "[1]", "bare": "{}", "nulls": '{"name":null,"require":null}', "empty": ""}
    p = SC.package_documents(spark.createDataFrame(list(docs.items()), "dir string, value string"))
    assert sorted(r.dir for r in p.collect()) == ["bare", "nulls", "ok"]
    one = releases.package_list(p.where("dir = 'ok'")).first()
    assert (one.name, one.type, one.php, one.scripts, one.deps) == ("a/b", "library", "^8", ["l", "o", "t"], ["x/y"])
    assert {r.script: r.value for r in releases.package_scripts(p).collect()} == {"t": "run", "l": "a && b", "o": '{"k":1}'}


def test_registry_attempts(spark):
    cases = {
        "found": ([(200, None, "1.2")], ("published", "1.2", 1, 0.0)),
        "missing": ([(404, None, None), (200, None, "1")], ("unpublished", None, 1, 0.0)),
        "second": ([(503, None, None), (200, None, "2.0")], ("published", "2.0", 2, 0.2)),
        "asked": ([(429, 7, None), (None, None, None), (200, None, "3")], ("published", "3", 3, 7.6)),
        "zero": ([(429, 0, None), (404, None, None)], ("unpublished", None, 2, 0.2)),
        "down": ([(500, None, None)] * 4 + [(200, None, "9")], ("unknown", None, 3, 0.8)),
        "forbidden": ([(403, None, None), (200, None, "1")], ("unknown", None, 1, 0.0)),
        "odd": ([(200, None, None)], ("unknown", None, 1, 0.0)),
        "broken off": ([(500, None, None)], ("unknown", None, 1, 0.0)),
    }
    rows = [(name, k, *a) for name, (attempts, _) in cases.items() for k, a in enumerate(attempts)]
    got = releases.registry_states(spark.createDataFrame(rows, "name string, ord int, status int, retry_after int, version string"))
    assert {r.name: (r.state, r.version, r.attempts, r.waited) for r in got.collect()} == {name: want for name, (_, want) in cases.items()}


def test_review_documents(spark):
    node = lambda repo, n, fork=False, review=None, ci="SUCCESS": {"number": n, "title": "t", "isDraft": False, "reviewDecision": review, "url": "u", "repository": {"nameWithOwner": repo, "isFork": fork}, "commits": {"nodes": [{"commit": {"statusCheckRollup": {"state": ci} if ci else None}}]}}
    doc = {"data": {
        "authored": {"nodes": [node("x/a", 5), node("x/b", 11, review="CHANGES_REQUESTED", ci="FAILURE"), node("x/c", 3, ci=None), {}, {"repository": {"nameWithOwner": ""}, "number": 1}]},
        "review": {"nodes": [node("y/d", 42, review="REVIEW_REQUIRED", ci="PENDING"), node("x/a", 5)]},
        "owned": {"nodes": [node("x/e", 7), node("x/f", 9, fork=True), node("x/a", 5)]},
    }}
    docs = spark.createDataFrame([(0, json.dumps(doc)), (1, '{"data":'), (2, "[]"), (3, None)], "ord int, value string")
    got = releases.pull_requests(A.pull_request_documents(docs)).collect()
    assert [(r.repo, r.number, r.ci, r.review, r.role) for r in got] == [("x/b", 11, "FAILURE", "CHANGES_REQUESTED", "author"), ("y/d", 42, "PENDING", "REVIEW_REQUIRED", "reviewer"), ("x/a", 5, "SUCCESS", "", "author"), ("x/c", 3, "NONE", "", "author"), ("x/e", 7, "SUCCESS", "", "owned")]
    ref = lambda name, day, *pulls: {"name": name, "target": {"committedDate": day}, "associatedPullRequests": {"nodes": [{"number": n, "state": s} for n, s in pulls]}}
    repo = lambda name, archived, main, *refs: {"nameWithOwner": name, "isArchived": archived, "defaultBranchRef": main and {"name": main}, "refs": {"nodes": list(refs)}}
    tree = {"data": {"repositoryOwner": {"repositories": {"nodes": [repo("x/a", False, "main", ref("main", "2026-06-13T00:00:00Z"), ref("done", "2026-06-01T00:00:00Z", (11, "MERGED"), (2, "OPEN")), ref("spike", "bad")), repo("x/old", True, "main", ref("q", "2026-01-01T00:00:00Z")), repo("x/none", False, None, ref("z", "2026-01-01T00:00:00Z")), repo("x/b", False, "main", ref("live", "2026-06-12T00:00:00Z", (7, "OPEN")))]}}}}
    rows = releases.branches(A.branch_documents(spark.createDataFrame([(json.dumps(tree),), ("{",)], "value string")), F.lit("2026-06-14").cast("timestamp")).collect()
    assert [(r.repo, r.branch, r.age_days, r.pr, r.status) for r in rows] == [("x/a", "done", 13, "MERGED#11", "merged"), ("x/a", "spike", -1, "none", "no-pr"), ("x/b", "live", 2, "OPEN#7", "open")]
    runs = A.run_documents(spark.createDataFrame([("p", '[{"databaseId":1,"status":"completed","conclusion":"success","createdAt":"2026-01-01"},{"databaseId":"x"}]'), ("p", '{"databaseId":2,"workflowName":"ci","createdAt":"2026-01-02"}'), ("q", "[]"), ("r", "no")], "pkg string, value string"))
    assert [(r.pkg, r.id, r.workflow, r.status) for r in releases.ci_latest(runs).collect()] == [("p", 2, "ci", "")]
    versions = A.registry_documents(spark.createDataFrame([("a/b", '{"packages":{"a/b":[{"version":"1.0"},{"version":"v1.10"},{"version":"2.0-beta"},{}],"c/d":[{"version":"9.0"}]}}'), ("e/f", '{"packages":[]}'), ("g/h", '{"packages":{}}')], "name string, value string"))
    assert [(r.name, r.published) for r in releases.latest_stable(versions).collect()] == [("a/b", "v1.10")]


def test_splits_do_not_grow_with_the_files(spark, tmp_path):
    for name, size in (("small", 1 << 10), ("large", 64 << 20)):
        (tmp_path / name / "d").mkdir(parents=True)
        with open(tmp_path / name / "d" / "f.txt", "wb") as f:
            f.truncate(size)
    assert source_queries.split_size(spark, str(tmp_path / "small")) == f"{source_queries.SPLIT}b"
    assert source_queries.split_size(spark, str(tmp_path / "large")) == f"{(64 << 20) // source_queries.SPLITS}b"


def test_captured_packages(spark, tmp_path):
    """As many packages as rows, in as few files as tasks write; vendored and other files aren't packages."""
    files = [("a/composer.json", '{"name":"x/a"}'), ("composer.json", '{"name":"x/top"}'), ("a/vendor/b/composer.json", '{"name":"x/b"}'), ("vendor/composer.json", '{"name":"x/c"}'), ("a/package.json", '{"name":"x/d"}'), ("e/composer.json", "[]"), ("f.git/composer.json", '{"name":"x/f"}')]
    got = SC.captured_packages(spark.createDataFrame(files, "path string, value string")).collect()
    assert {(r.name, r.dir) for r in got} == {("x/a", "a"), ("x/top", ""), ("x/f", "f.git")}
    spark.range(1, 401).select(F.col("id").alias("s_suppkey")).coalesce(2).write.parquet(f"{tmp_path}/supplier.parquet")
    p = source_queries.read_packages(spark, str(tmp_path))
    assert p.count() == sum(1 for k in range(1, 401) if k % 10 and k % 11) and len(p.inputFiles()) <= 2


def test_first_of_each_holds_no_group(spark, many_ranges):
    rows = spark.createDataFrame([(("a", "b", None)[k % 3], k) for k in random.Random(4).sample(range(9000), 9000)], "dim string, ord int")
    for limit in (5, 1500, 2999, 3000, 1 << 30):
        cut = releases.first_of_each(rows, "dim", "ord", limit)
        assert {(r.dim, r.n, r.last) for r in cut.groupBy("dim").agg(F.count("*").alias("n"), F.max("ord").alias("last")).collect()} == {(d, min(limit, 3000), 3 * (min(limit, 3000) - 1) + j) for j, d in enumerate(("a", "b", None))}
        assert limit == 5 or "Window" not in plan(cut) or "partitionBy(dim" not in plan(cut)
    assert "hashpartitioning(dim" not in plan(releases.first_of_each(rows, "dim", "ord", 1 << 30))


def test_documents_of_listings_are_bounded(spark, tmp_path):
    """However many rows a repository, package or name has, a document holds a page of them; equal versions keep their order over pages."""
    n = 4 * api_queries.PAGE
    day = F.lit("2024-01-01").cast("timestamp")
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 0).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    held = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(api_queries, "as_files", lambda docs, label, real=api_queries.as_files: held.append(real(docs, label)) or held[-1])
        assert api_queries.QUERIES["sc18_branches"](spark, str(tmp_path)).count() == n - n // 10
        assert api_queries.QUERIES["sc18_runs"](spark, str(tmp_path)).first()["id"] == n - 1
        first = min(k for k in range(n) if k % 7 == 6 and k % 17 and k % 5)
        assert api_queries.QUERIES["sc17_versions"](spark, str(tmp_path)).first()["published"] == ("v" if first % 2 == 0 else "") + "7.6" + ("+meta" if first % 11 == 0 else ".0" if first % 13 == 0 else "")
    assert all(d.agg(F.max(F.length("value"))).first()[0] < 250 * api_queries.PAGE for d in held) and [d.count() for d in held] == [4, 4 + n // 5, 4]


def test_tag_listings(spark):
    local = spark.createDataFrame([("a", "v1.0\n"), ("b", " 2.0 "), ("c", ""), ("d", "3.0"), ("e", "1.0")], "dir string, line string")
    remote = spark.createDataFrame([("a", "abc\trefs/tags/v1.0"), ("a", "def\trefs/tags/v1.0^{}"), ("b", "abc\trefs/tags/2.0.1"), ("e", "")], "dir string, line string")
    assert {r.dir: (r.local_tag, r.pushed) for r in A.tag_listings(local, remote).collect()} == {"a": ("v1.0", "yes"), "b": ("2.0", "no"), "d": ("3.0", "?"), "e": ("1.0", "no")}


def test_links_are_followed_to_their_end(spark):
    n = 24
    types = spark.createDataFrame([(f"t{k}",) for k in range(n)], "type string")
    links = spark.createDataFrame([(f"t{k}", "extends", f"t{k + 1}", 0) for k in range(n - 1)] + [(f"t{n - 1}", "extends", "t0", 0)], "type string, kind string, target string, ord int")
    methods = spark.createDataFrame([(f"t{n - 1}", "far", 0)], "type string, name string, ord int")
    got = structure.effective_api(types.where("type = 't0'"), links, methods).collect()
    assert [(r.root, r.method, r.via) for r in got] == [("t0", "far", f"t{n - 1}")]


# --- renderings ----------------------------------------------------------------------------------
def test_document_keeps_its_order(spark, tmp_path, many_ranges):
    df = spark.createDataFrame([(k, f"n,{k}" if k % 2 else "") for k in random.Random(2).sample(range(500), 500)], "k int, name string").repartition(5)
    doc = document(spark, "# top", Section("rows", df, ["-k"], most=450), "end", Section("md", df.where("k < 2"), ["k"], "md"), Section("none", df.limit(0), ["k"], "json"))
    want = ["# top", "rows[450]{k,name}:", *[f'  {k},"n,{k}"' if k % 2 else f'  {k},""' for k in range(499, 49, -1)], "# +50 more", "end", "| k | name |", "| --- | --- |", "| 0 |  |", "| 1 | n,1 |", "[", "]"]
    assert [(r.ordinal, r.line) for r in doc.orderBy("ordinal").collect()] == list(enumerate(want))
    save_document(doc, str(tmp_path / "doc"))
    with source_queries.splits_of(spark, "1k"):
        assert [(r.ordinal, r.line) for r in load_document(spark, str(tmp_path / "doc")).orderBy("ordinal").collect()] == list(enumerate(want))
    lines = Section("j", df.where("k < 3"), ["k"], "json")
    assert [r.line for r in document(spark, lines).orderBy("ordinal").collect()] == ["[", '  {"k":0,"name":""},', '  {"k":1,"name":"n,1"},', '  {"k":2,"name":""}', "]"]
