"""Queries of the diff, package, release and review operators, with their SQL; the driver's tables stand in for their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import scalars as S
from tracewright.operators import diffs as D
from tracewright.operators import releases as R
from tracewright.sources.stand_ins import table

NOW = "2024-06-14 12:00:00"
PATHS = ("src/app/{}.go", "tests/{}.php", "docs/{}.png", "db/migrations/{}.sql", "README{}.md", "config/{}.bin", "lib/{}_test.go", "web/{}.spec.ts", "go.mod", "x/{}.lock", "a/{}.YAML", "a/{}.vue", "img/{}.png", "Dockerfile.{}", "q/{}.scss", ".env.{}")
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def paths(spark, sf):
    d = table(spark, sf, "documents")
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    return d.select("doc_id", F.replace(pattern, F.lit("{}"), F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("path"), "n_chars", "text")


PATH_SQL = "WITH d AS (SELECT doc_id, replace([" + ", ".join(f"'{p}'" for p in PATHS) + f"][doc_id % {len(PATHS)} + 1], '{{}}', 'n' || doc_id) AS path, n_chars, text FROM documents), b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM d)\n"
LANG_SQL = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in ends)}) THEN '{lang}'" for lang, ends in C.LANGUAGES.items()) + " ELSE '' END"
CATEGORY_SQL = f"""CASE WHEN ends_with(base, '_test.go') OR ends_with(base, 'Test.php') OR contains(base, '.test.') OR contains(base, '.spec.') OR contains(path, '/tests/') OR contains(path, '/test/') OR starts_with(path, 'tests/') THEN 'test'
WHEN contains(path, 'migrations/') OR contains(lower(base), 'migration') THEN 'migration' WHEN ext IN {C.DOCS} OR contains(path, '/docs/') OR starts_with(path, 'docs/') THEN 'docs' WHEN base IN {C.BUILD} OR ends_with(path, '.lock') OR starts_with(base, 'Dockerfile') THEN 'build'
WHEN ext IN {C.CONFIG} OR starts_with(base, '.env') OR contains(path, '/config/') OR starts_with(path, 'config/') THEN 'config' WHEN {LANG_SQL} <> '' THEN 'source' ELSE 'other' END"""


@query("c2_c3_path_class", PATH_SQL + f"SELECT doc_id, {LANG_SQL} AS lang, {CATEGORY_SQL} AS category FROM b")
def _(spark, sf):
    return paths(spark, sf).select("doc_id", C.path_language(F.col("path")).alias("lang"), C.path_category(F.col("path")).alias("category"))


def listings(spark, sf):
    """Lines of a name-status, a numstat, a hunk and a status listing of changed documents."""
    p = paths(spark, sf).where("path <> 'go.mod'")
    k = F.col("doc_id")
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    status = p.where(k % 7 != 3).select(k.alias("ord"), F.concat(F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("D")), (k % 3 + 1).cast("int")), F.lit("\t"), F.col("path")).alias("line"))
    numstat = p.select(k.alias("ord"), F.concat(F.when(k % 5 == 0, "-").otherwise((F.col("n_chars") % 100).cast("string")), F.lit("\t"), F.when(k % 5 == 0, "-").otherwise((k % 9).cast("string")), F.lit("\t"), F.col("path")).alias("line"))
    header = p.select((k * 10).alias("ord"), F.when(k % 3 == 2, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), F.col("path"))).alias("line"))
    hunks = [p.select((k * 10 + j).alias("ord"), F.concat(F.lit("@@ -1 +1 @@ "), F.when(F.lit(j) == 3, F.lit("again")).otherwise(word)).alias("line")) for j in (1, 2, 3)]
    hunk = header
    for h in hunks:
        hunk = hunk.unionByName(h)
    porcelain = p.where(k % 7 == 3).select(k.alias("ord"), F.concat(F.lit("?? "), F.col("path")).alias("line"))
    return status, numstat, hunk, porcelain


def diff(spark, sf):
    return D.changes(*listings(spark, sf))


CHANGES_SQL = PATH_SQL + f""", c AS (SELECT doc_id AS k, path, {CATEGORY_SQL} AS category, {LANG_SQL} AS lang, regexp_extract(text, '([A-Za-z]+)', 1) AS w, n_chars FROM b WHERE path <> 'go.mod'),
changes AS (SELECT CASE WHEN k % 7 = 3 THEN '?' ELSE ['M', 'A', 'D'][k % 3 + 1] END AS status, path, category, lang, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE n_chars % 100 END AS INTEGER) AS adds, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k % 9 END AS INTEGER) AS dels,
CASE WHEN lang = '' OR k % 3 = 2 THEN '' WHEN w = '' THEN 'again' WHEN w = 'again' THEN 'again' ELSE w || '; again' END AS symbols FROM c)
"""


@query("j3_j4_changes", CHANGES_SQL + "SELECT * FROM changes")
def _(spark, sf):
    return diff(spark, sf).withColumn("symbols", F.array_join("symbols", "; "))


@query("a18_by_category", CHANGES_SQL + "SELECT category, count(*) AS files FROM changes GROUP BY 1")
def _(spark, sf):
    return D.by_category(diff(spark, sf))


@query("a18_totals", CHANGES_SQL + "SELECT count(*) AS files, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(dels) AS BIGINT) AS dels FROM changes")
def _(spark, sf):
    return D.totals(diff(spark, sf))


@query("n18_renames", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_name || '/c' WHEN 1 THEN 'a/c' ELSE p_name END AS path FROM part")
def _(spark, sf):
    name = F.col("p_name")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/{old => "), name, F.lit("}/c"))).when(F.col("p_partkey") % 3 == 1, F.lit("a/{old => }/c")).otherwise(F.concat(F.lit("was => "), name))
    return table(spark, sf, "part").select("p_partkey", S.renamed_to(line).alias("path"))


def versions(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, "-beta1").when(k % 11 == 0, "+meta").when(k % 13 == 0, ".0").otherwise("")
    version = F.when(k % 17 == 0, F.concat(F.lit("dev-x"), k.cast("string"))).otherwise(F.concat(F.when(k % 2 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (k % 7).cast("string"), tail))
    return p.select(F.col("p_brand").alias("name"), version.alias("version"), k.alias("ord"))


VERSIONS = """WITH v AS (SELECT p_brand AS name, p_partkey AS ord, p_size AS a, p_partkey % 7 AS b, CASE WHEN p_partkey % 17 = 0 THEN 'dev-x' || p_partkey ELSE CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '-beta1' WHEN p_partkey % 11 = 0 THEN '+meta' WHEN p_partkey % 13 = 0 THEN '.0' ELSE '' END END AS version FROM part)
"""


@query("a23_latest_stable", VERSIONS + "SELECT name, version AS published FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY a DESC, b DESC, ord) AS r FROM v WHERE ord % 17 <> 0 AND ord % 5 <> 0) WHERE r = 1")
def _(spark, sf):
    return R.latest_stable(versions(spark, sf))


@query("n15_version_compare", VERSIONS + "SELECT ord, CASE WHEN ord % 17 = 0 THEN -1 WHEN a > 25 OR a = 25 AND b > 3 THEN 1 WHEN a = 25 AND b = 3 THEN 0 ELSE -1 END AS cmp FROM v")
def _(spark, sf):
    return versions(spark, sf).select("ord", S.version_compare(F.col("version"), F.lit("v25.3")).alias("cmp"))


@query("j8_release_status", """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '1.' || (s_suppkey % 4) END AS tag, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '1.' || (s_suppkey % 3) END AS pub, s_suppkey % 4 AS t, s_suppkey % 3 AS p FROM supplier)
SELECT 'p' || k AS name, 'd' || k AS dir, coalesce(tag, '') AS local_tag, CASE WHEN tag IS NULL THEN '?' ELSE 'yes' END AS pushed, coalesce(pub, '') AS published, CASE WHEN tag IS NULL THEN 'no-tags' WHEN pub IS NULL THEN 'unpublished' WHEN p = t THEN 'in-sync' WHEN p < t THEN 'needs-update' ELSE 'local-stale' END AS state FROM s""")
def _(spark, sf):
    return release(spark, sf)


def release(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    text = lambda c: k.cast("string") if c is None else (k % c).cast("string")
    name, folder = F.concat(F.lit("p"), text(None)).alias("name"), F.concat(F.lit("d"), text(None)).alias("dir")
    tags = s.where(k % 6 != 0).select(folder, F.concat(F.lit("1."), text(4)).alias("local_tag"), F.lit("yes").alias("pushed"))
    return R.release_status(s.select(name, folder), tags, s.where(k % 5 != 0).select(name, F.concat(F.lit("1."), text(3)).alias("version"), k.alias("ord")))


@query("a22_drift", "SELECT count(*) FILTER (s_suppkey % 6 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 4 <> s_suppkey % 3) AS drift, CAST(0 AS BIGINT) AS unknown FROM supplier")
def _(spark, sf):
    return R.drift(release(spark, sf))


PULLS = """WITH p AS (SELECT ['owned', 'reviewer', 'author'][o_orderkey % 3 + 1] AS dim, 2 - o_orderkey % 3 AS prec, 'r' || (o_custkey % 9) AS repo, o_orderkey % 5 = 0 AS fork, CAST(o_orderkey % 400 AS INTEGER) AS number, ['SUCCESS', 'FAILURE', 'PENDING', ''][o_orderkey % 4 + 1] AS ci, ['APPROVED', 'CHANGES_REQUESTED', 'REVIEW_REQUIRED'][o_custkey % 3 + 1] AS review, o_orderkey AS ord FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY prec, ord) AS k FROM p WHERE NOT (dim = 'owned' AND fork))
SELECT repo, number, CASE WHEN ci = '' THEN 'NONE' ELSE ci END AS ci, review, dim AS role, CASE ci WHEN 'SUCCESS' THEN '✓' WHEN 'FAILURE' THEN '✗' WHEN 'PENDING' THEN '⏳' ELSE '–' END AS glyph, CAST(CASE WHEN ci = 'FAILURE' OR review = 'CHANGES_REQUESTED' THEN 0 WHEN ci = 'PENDING' OR review = 'REVIEW_REQUIRED' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM q WHERE k = 1"""


@query("j12_pull_requests", PULLS)
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    prs = o.select(at(k, "owned", "reviewer", "author").alias("dim"), F.concat(F.lit("r"), (c % 9).cast("string")).alias("repo"), (k % 5 == 0).alias("is_fork"), (k % 400).cast("int").alias("number"), F.lit("t").alias("title"), F.lit(False).alias("is_draft"), at(c, "APPROVED", "CHANGES_REQUESTED", "REVIEW_REQUIRED").alias("review"), at(k, "SUCCESS", "FAILURE", "PENDING", "").alias("ci"), F.lit("u").alias("url"), k.alias("ord"))
    found = R.pull_requests(prs, limit=1 << 30)
    return found.select("repo", "number", "ci", "review", "role", C.ci_glyph(F.col("ci")).alias("glyph"), C.action_rank(F.col("ci"), F.col("review")).alias("rank"))


@query("c5_branches", f"""SELECT 'r' || (o_custkey % 9) AS repo, 'b' || o_orderkey AS branch, CAST(date_diff('second', date_trunc('second', o_orderdate), TIMESTAMP '{NOW}') // 86400 AS BIGINT) AS age_days, coalesce(s || '#' || o_orderkey, 'none') AS pr, CASE s WHEN 'MERGED' THEN 'merged' WHEN 'CLOSED' THEN 'closed' WHEN 'OPEN' THEN 'open' ELSE 'no-pr' END AS status,
NOT starts_with('b' || o_orderkey, 'wt/') AND coalesce(s IN ('MERGED', 'CLOSED'), false) AS deletable FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'MERGED' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'OPEN' END AS s FROM orders) WHERE o_orderkey % 10 <> 0 AND o_custkey % 9 <> 4""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(k % 4 == 0, "MERGED").when(k % 4 == 1, "CLOSED").when(k % 4 == 2, "OPEN")
    name = F.concat(F.lit("b"), k.cast("string"))
    refs = o.select(F.concat(F.lit("r"), (c % 9).cast("string")).alias("repo"), (c % 9 == 4).alias("archived"), F.when(k % 10 == 0, name).otherwise("main").alias("default_branch"), name.alias("name"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_date"), k.cast("int").alias("pr_number"), state.alias("pr_state"))
    out = R.branches(refs, F.lit(NOW).cast("timestamp"))
    return out.withColumn("deletable", C.deletable(F.col("branch"), F.col("status"), "closed"))


def runs(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("pkg"), k.alias("id"), F.when(k % 3 == 0, "in_progress").otherwise("completed").alias("status"), F.element_at(F.array(F.lit("success"), F.lit("failure"), F.lit("")), (k % 4 % 3 + 1).cast("int")).alias("conclusion"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("created"))


RUNS = "WITH r AS (SELECT 'p' || (o_custkey % 50) AS pkg, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'in_progress' ELSE 'completed' END AS status, ['success', 'failure', ''][o_orderkey % 4 % 3 + 1] AS conclusion, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders)\n"


@query("d16_ci_latest", RUNS + "SELECT pkg, id, status, conclusion, created FROM (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY created DESC, id DESC) AS k FROM r) WHERE k = 1")
def _(spark, sf):
    return R.ci_latest(runs(spark, sf))


@query("f13_ci_failing", RUNS + "SELECT count(*) AS failing FROM r WHERE status = 'completed' AND conclusion <> '' AND conclusion <> 'success'")
def _(spark, sf):
    return R.ci_failing(runs(spark, sf))


@query("f11_real_dependencies", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a/x,' || p_brand ELSE p_brand END AS deps FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    one = F.lit("*")
    m = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.concat(F.lit("a/x")), one, F.lit("php"), one, F.col("p_brand"), one)).otherwise(F.create_map(F.lit("ext-json"), one, F.col("p_brand"), one, F.lit("php"), one))
    deps = R.real_dependencies(m)
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.array_join(F.concat(F.filter(deps, lambda d: d == "a/x"), F.filter(deps, lambda d: d != "a/x")), ",")).otherwise(F.array_join(deps, ",")).alias("deps"))


@query("f17_first_failure", "SELECT CAST(l_orderkey AS VARCHAR) AS dir, coalesce(min_by(line, n) FILTER (line LIKE '%error%'), max_by(line, n)) AS fail FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'an error in ' || l_partkey ELSE 'line ' || l_partkey END AS line FROM lineitem) GROUP BY 1")
def _(spark, sf):
    line = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("an error in "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("line "), F.col("l_partkey").cast("string")))
    return R.first_failure(table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("dir"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ord"), line.alias("line")))


@query("a26_bundle_drift", "SELECT source AS pack, count(*) FILTER (doc_id % 10 = 0) AS missing, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 <> 0) AS ok, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 = 0) AS modified FROM documents GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    receipts = d.select(F.col("source").alias("pack"), k.cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return R.bundle_drift(receipts, d.where(k % 10 != 0).select(k.cast("string").alias("path"), F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))


@query("j13_precedence", "SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'managed' ELSE 'found' END AS path, p_partkey % 2 = 0 AS managed FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_partkey")
    return R.with_precedence(p.where("p_partkey % 2 = 0").select("name", F.lit("managed").alias("path")), p.select("name", F.lit("found").alias("path"))).select("name", "path", "managed")


@query("f16_read_guard", "SELECT doc_id, CASE WHEN (doc_id % 16 IN (0, 6, 11) OR doc_id % 16 = 1 OR doc_id % 16 = 7) AND n_chars >= 2000 THEN 'deny' ELSE 'allow' END AS action FROM documents")
def _(spark, sf):
    none, zero = F.lit(None).cast("string"), F.lit(0)
    return paths(spark, sf).select("doc_id", C.guard_action(F.lit("Read"), F.col("path"), zero, zero, none, F.col("n_chars"), F.lit(False), "nudge", 2000).alias("action"))


@query("n24_routes", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/' || s_name WHEN 1 THEN '/top' ELSE '/top/' || s_name END AS path FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    child = F.when(k % 3 == 0, F.concat(F.lit("/"), F.col("s_name"))).when(k % 3 == 1, "").otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", S.route_path(F.lit("/top"), child).alias("path"))


@query("n16_protocol", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'invalid' WHEN p_partkey % 6 > 3 THEN 'too-new' WHEN p_partkey % 6 < 2 THEN 'too-old' WHEN p_partkey % 6 = 3 AND p_size > 20 THEN 'too-new' ELSE 'ok' END AS state FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 6
    plugin = F.when(k == 5, "x.y").otherwise(F.concat(k.cast("string"), F.lit("."), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", S.compatible(F.lit("3.20"), plugin).alias("state"))


@query("sc21_worktrees", "SELECT row_number() OVER (ORDER BY s_suppkey) AS block, '/w/' || s_name AS dir, s_name AS slug, CASE WHEN s_suppkey % 4 <> 0 THEN 'b' || s_suppkey END AS branch, s_suppkey % 4 = 0 AS detached FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    part = lambda j, line: s.select((k * 10 + j).alias("ord"), line.alias("line"))
    lines = part(0, F.concat(F.lit("worktree /w/"), F.col("s_name"))).unionByName(part(1, F.lit("HEAD abc"))).unionByName(part(2, F.when(k % 4 == 0, "detached").otherwise(F.concat(F.lit("branch refs/heads/b"), k.cast("string")))))
    return R.worktrees(lines).select("block", "dir", "slug", "branch", "detached")
