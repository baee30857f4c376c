"""Queries of the scalar functions and small views that no other query shows alone, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import scalars as S
from tracewright.operators import calllog as L
from tracewright.operators import search as T
from tracewright.operators import sessions as N
from tracewright.plans import log_queries as LQ
from tracewright.plans import session_queries as SQ
from tracewright.plans import source_queries as SO
from tracewright.plans.text_queries import TOKENS
from tracewright.sources.stand_ins import call_log, table, turns

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def part(spark, sf):
    return table(spark, sf, "part"), F.col("p_partkey"), F.col("p_name")


def by(k, *values):
    """The value whose place is k modulo their number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(k % len(values) == i, v).otherwise(out)
    return out


def cases(*values: str) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- identity and time ---------------------------------------------------------------------------
@query("n5_dedup_key", LQ.LOG + "SELECT ord, left(sha256(array_to_string(list_sort(['tool=' || tool, 'k' || k, tool]), chr(31))), 16) AS key FROM log")
def _(spark, sf):
    return call_log(spark, sf).select("ord", S.dedup_key(F.col("tool"), F.col("args")).alias("key"))


SPANS = {"7d": "7 DAY", "36h": "36 HOUR", "1h30m": "90 MINUTE", "2.5h": "150 MINUTE", "0": "0 SECOND"}


@query("n7_since", LQ.LOG + " UNION ALL ".join(f"SELECT '{k}' AS since, count(*) AS calls FROM log WHERE t >= TIMESTAMP '{LQ.NOW}' - INTERVAL {v}" for k, v in SPANS.items()))
def _(spark, sf):
    log, now, out = call_log(spark, sf), F.lit(LQ.NOW).cast("timestamp"), None
    for spec in SPANS:
        one = L.filtered(log, since=now - F.lit(S.parse_since(spec))).agg(F.count("*").alias("calls")).select(F.lit(spec).alias("since"), "calls")
        out = one if out is None else out.unionByName(one)
    return out


@query("n8_buckets", LQ.LOG + " UNION ALL ".join(f"SELECT '{n}' AS name, {key} AS bucket, count(*) AS calls FROM log WHERE t IS NOT NULL GROUP BY 2" for n, key in (("Hour", "substr(ts, 12, 2)"), ("h", "substr(ts, 12, 2)"), ("DAY", "substr(ts, 1, 10)"), ("d", "substr(ts, 1, 10)"))))
def _(spark, sf):
    log, out = call_log(spark, sf), None
    for name in ("Hour", "h", "DAY", "d"):
        one = L.histogram(log, S.parse_bucket(name)).select(F.lit(name).alias("name"), "bucket", F.col("count").alias("calls"))
        out = one if out is None else out.unionByName(one)
    return out


@query("n13_days_before", "SELECT event_id, CAST(date_trunc('second', ts) - INTERVAL 3 DAY AS TIMESTAMP) AS then FROM events")
def _(spark, sf):
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", S.days_before(at, 3).cast("timestamp_ntz").alias("then"))


# --- names and paths -----------------------------------------------------------------------------
@query("n11_relative", "SELECT p_partkey, " + cases("p_name || '/x'", "'/other/' || p_name", "'/w' || p_name", "'/w'") + " AS path FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", S.relative(by(k, text("/w/", name, "/x"), text("/other/", name), text("/w", name), text("/w")), F.lit("/w")).alias("path"))


@query("n17_release_tags", "SELECT p_partkey, p_partkey % 8 IN (0, 2, 3, 6) AS release FROM part")
def _(spark, sf):
    p, k, _ = part(spark, sf)
    n = k.cast("string")
    return p.select("p_partkey", S.is_release_tag(by(k, text("v1.", n, ".3"), text("v1.", n), text("0.0.", n, "-rc.1"), text(n, ".2.3+build.5"), text("x1.2.", n), text("1.2.", n, "-"), text("v", n, ".0.0-a-b+c"), text("1.2.3.", n))).alias("release"))


@query("n19_hunk_sections", "SELECT p_partkey, " + cases("'func ' || p_name", "''", "''", "p_name", "'a @@ ' || p_name") + " AS section FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", S.hunk_section(by(k, text("@@ -1,2 +3,4 @@ func ", name), text("@@ -1 +1 @@"), text("--- a/", name), text("@@ -1 +1 @@   ", name, "  "), text("@@ -1 +1 @@ a @@ ", name))).alias("section"))


@query("n25_components", "SELECT p_partkey, p_name AS component FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", S.component_name(by(k, text("@/views/", name, ".vue"), text("./x/y/", name, ".ts"), name, text("../", name, ".tsx"), text("lib/", name, ".js"))).alias("component"))


@query("n30_dotted", "SELECT p_partkey, " + cases("'show.' || replace(p_name, ' ', '.')", "''", "'a.b.c'") + " AS tool FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", S.dotted_tool(by(k, text(" prog  show ", name, " "), text("prog"), text("prog a  b\tc"))).alias("tool"))


@query("n31_logged", "SELECT p_partkey, p_partkey % 8 IN (1, 3, 5) AS logged FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", S.is_logged(by(k, text("history.stats"), text("grep"), text(""), text("cc.show"), text("cc"), F.concat(F.lit("x."), name), text("completion.bash"), text("version"))).alias("logged"))


@query("n33_slugs", "SELECT p_partkey, 'own' || (p_partkey % 9) || '/' || p_name AS slug FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    own = text("own", (k % 9).cast("string"), "/", name)
    return p.select("p_partkey", S.repo_slug(by(k, text("git@host.org:", own, ".git"), text("https://host.org/", own, "/"), text("ssh://git@host.org/", own, ".git/"), text("https://host.org/group/", own))).alias("slug"))


@query("n34_checksums", "SELECT p_partkey, " + cases("sha256(p_name)", "sha256(p_name)", "''") + " AS sum, " + cases("'tool_linux_' || (p_partkey % 2) || '.tar.gz'", "p_name", "''") + " AS file, p_partkey % 3 = 0 AND p_partkey % 2 = 1 AS asked FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    digest = F.sha2(name, 256)
    line = S.checksum_of(by(k, text(digest, "  tool_linux_", (k % 2).cast("string"), ".tar.gz"), text(digest, " *", name), text("abc  ", name)))
    asset = S.asset_name("tool_{os}_{arch}.tar.gz", os="linux", arch="1")
    return p.select("p_partkey", line.alias("c")).select("p_partkey", "c.sum", "c.file", (F.col("c.file") == asset).alias("asked"))


# --- transcripts ---------------------------------------------------------------------------------
@query("n21_result_texts", "SELECT p_partkey, " + cases("p_name", "'a' || chr(10) || p_name || chr(10)", "''", "chr(10)", "''") + " AS text FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    body = by(k, text('"', name, '"'), text('[{"type":"text","text":"a"},{"type":"image","text":"no"},{"type":"text","text":"', name, '"}]'), text("[]"), text('[{"type":"text"}]'), text('{"type":"text","text":"', name, '"}'))
    return p.select("p_partkey", S.result_text(F.parse_json(body)).alias("text"))


@query("n22_tool_briefs", "SELECT p_partkey, " + cases("CASE WHEN length(repeat(p_name, 12)) <= 100 THEN repeat(p_name, 12) ELSE left(repeat(p_name, 12), 99) || '…' END", "'f/' || p_name", "p_name || '*'", "'Other'", "'f/' || p_name") + " AS brief FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    tool = by(k, *[F.lit(t) for t in ("Bash", "Read", "Grep", "Other", "NotebookEdit")])
    return p.select("p_partkey", S.tool_brief(tool, F.repeat(name, F.lit(12)), text("f/", name), text(name, "*")).alias("brief"))


@query("a10_fat", SQ.BASE + "SELECT path, k, tokens, tool, brief FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tokens DESC, line_no) AS k FROM a WHERE tokens >= 20) WHERE k <= 2")
def _(spark, sf):
    return N.fat_results(SQ.attributed(spark, sf), 20, 2).withColumn("k", F.col("k").cast("long"))


def message_lines(spark, sf):
    """Turns as transcript lines: contents that are text, lists of text blocks, and lists with a result, by turns."""
    t = turns(spark, sf)
    block = lambda kind, **v: F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in v.items()])
    two = F.to_json(F.array(block("text", text=F.col("text")), block("text", text=F.lit("tail"))))
    mixed = text("[", F.to_json(block("tool_result", tool_use_id=F.lit("1"), content=F.lit("r"))), ",", F.to_json(block("text", text=F.col("text"))), "]")
    content = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("x")))).otherwise(text('{"x":', F.when(F.col("conv_id") % 3 == 1, two).otherwise(mixed), "}"))
    body = F.substring(content, F.lit(6), F.length(content) - 6)
    pr = F.when(F.col("line_no") % 3 == 0, text(',"prNumber":', (F.col("conv_id") % 4 + F.col("line_no") % 2).cast("string"), ',"prUrl":"u', F.col("line_no").cast("string"), '"')).otherwise("")
    line = text('{"type":"', F.col("role"), '","message":{"content":', body, "}", pr, "}")
    return t.select("path", "line_no", F.lit("d").alias("dir_name"), F.parse_json(line).alias("v"))


@query("f7_list_prompts", "SELECT 'c' || conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn AS line_no, md5(text || CASE WHEN conv_id % 3 = 1 THEN chr(10) || 'tail' ELSE '' END) AS text FROM conversations WHERE role = 'user' AND conv_id % 3 < 2 AND NOT regexp_matches(ltrim(text), '^(<|Caveat:|\\[Request interrupted|API Error|This session is being continued)') AND (conv_id % 3 = 1 OR trim(text) <> '')")
def _(spark, sf):
    rows = N.entries(message_lines(spark, sf))
    return N.prompts(rows, N.blocks(rows)).select("path", F.col("i").cast("long").alias("i"), "line_no", F.md5("text").alias("text"))


@query("u2_pull_requests", "SELECT 'c' || conv_id AS path, CAST(conv_id % 4 + turn % 2 AS INTEGER) AS number, 'u' || min(turn) AS url, min(turn) AS line_no FROM conversations WHERE turn % 3 = 0 GROUP BY ALL")
def _(spark, sf):
    return N.pull_requests_of(N.entries(message_lines(spark, sf))).withColumn("number", F.col("number").cast("int"))


@query("j14_sessions_with_calls", LQ.LOG + "SELECT 'c' || conv_id AS path, 's' || conv_id AS sid, count(ord) AS calls, CAST(coalesce(sum(out_tokens), 0) AS BIGINT) AS out_tokens FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN log ON sid = 's' || conv_id GROUP BY ALL")
def _(spark, sf):
    sessions = turns(spark, sf).select("path", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sid")).distinct()
    return N.with_calls(sessions, call_log(spark, sf))


# --- checks, limits and costs --------------------------------------------------------------------
@query("c7_checks", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'FAIL' WHEN p_partkey % 3 = 0 THEN 'skip' ELSE 'ok' END AS status FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    return p.select("p_partkey", C.check_status(k % 2 == 0, by(k, name, F.lit(""), F.lit(None))).alias("status"))


@query("c8_builds", "SELECT o_orderkey, CASE WHEN o_custkey > o_orderkey THEN 'fail' WHEN o_orderkey % 3 = 0 THEN 'warn' ELSE 'ok' END AS status FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.build_status(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0).alias("status"))


@query("c9_hints", "SELECT tool, count(*) AS calls, CASE tool WHEN 'click' THEN 'one' WHEN 'view' THEN 'two' ELSE '' END AS hint FROM (SELECT event_type AS tool FROM events) GROUP BY tool")
def _(spark, sf):
    calls = call_log(spark, sf).groupBy("tool").agg(F.count("*").alias("calls"))
    return calls.withColumn("hint", C.heavy_tool_hint(F.col("tool"), {"click": "one", "view": "two"}))


@query("l2_most_refs", SO.DECLARED_SQL + " UNION ALL ".join(f"SELECT {asked} AS asked, {n} AS shown FROM r" for asked, n in ((0, "least(count(*), 30)"), (7, "least(count(*), 7)"), (-1, "count(*)"))))
def _(spark, sf):
    refs, out = T.refs(SO.declared(spark, sf), "the"), None
    for asked in (0, 7, -1):
        most = T.most_refs(asked)
        shown = refs if most is None else refs.limit(most)
        one = shown.agg(F.count("*").alias("shown")).select(F.lit(asked).alias("asked"), "shown")
        out = one if out is None else out.unionByName(one)
    return out


def tokens_sql(t: str) -> str:
    return "CAST(floor(" + TOKENS.format(t=t) + " + 0.5) AS BIGINT)"


@query("sk6_smaller", f"SELECT doc_id, md5(CASE WHEN {tokens_sql('raw')} < {tokens_sql('compact')} THEN raw ELSE compact END) AS text FROM (SELECT doc_id, coalesce(text, '') AS raw, repeat('compact ', 150) AS compact FROM documents)")
def _(spark, sf):
    raw = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(S.smaller_of(F.repeat(F.lit("compact "), F.lit(150)), raw)).alias("text"))


@query("sk7_footers", LQ.LOG + "SELECT ord, '# ≈' || out_tokens || ' tok' || CASE WHEN raw > 0 AND raw > out_tokens THEN ' · raw ≈' || raw || ' · saved ≈' || (raw - out_tokens) WHEN raw > 0 THEN ' · raw passthrough' ELSE '' END AS footer FROM (SELECT ord, out_tokens, CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE out_tokens * 2 END AS raw FROM log)")
def _(spark, sf):
    tok = F.col("out_tokens")
    raw = F.when(F.col("ord") % 3 == 0, F.lit(0).cast("long")).when(F.col("ord") % 3 == 1, F.lit(50).cast("long")).otherwise(tok * 2)
    return call_log(spark, sf).select("ord", S.footer(tok, raw).alias("footer"))


# --- branches, reviews and plugins ---------------------------------------------------------------
@query("f12_deletable", " UNION ALL ".join(f"SELECT '{mode}' AS mode, o_orderkey, o_orderkey % 5 > 0 AND o_orderkey % 4 {which} AS deletable FROM orders" for mode, which in (("merged", "= 0"), ("closed", "< 2"), ("", "> 9"))))
def _(spark, sf):
    k = F.col("o_orderkey")
    branch = text(F.when(k % 5 == 0, "wt/").otherwise("feat/"), k.cast("string"))
    status, out = C.branch_status(by(k, F.lit("MERGED"), F.lit("CLOSED"), F.lit("OPEN"), F.lit(None))), None
    for mode in ("merged", "closed", ""):
        one = table(spark, sf, "orders").select(F.lit(mode).alias("mode"), "o_orderkey", C.deletable(branch, status, mode).alias("deletable"))
        out = one if out is None else out.unionByName(one)
    return out


@query("c6_reviews", "SELECT p_partkey, " + cases("'approved'", "'changes'", "'review'", "'–'", "'–'") + " AS review, " + cases("'✗'", "'⏳'", "'✓'", "'–'", "'⏳'") + " AS glyph FROM part")
def _(spark, sf):
    p, k, _ = part(spark, sf)
    review = by(k, *[F.lit(x) for x in ("APPROVED", "CHANGES_REQUESTED", "REVIEW_REQUIRED", "DISMISSED", None)])
    state = by(k, *[F.lit(x) for x in ("ERROR", "EXPECTED", "SUCCESS", None, "PENDING")])
    return p.select("p_partkey", C.review_short(review).alias("review"), C.ci_glyph(C.ci_state(state)).alias("glyph"))


@query("e6_plugin_states", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'error: no ' || p_name WHEN p_partkey % 3 = 0 THEN 'too-new' WHEN p_partkey % 3 = 1 AND p_size > 5 THEN 'too-new' WHEN p_partkey % 2 = 0 THEN 'disabled' ELSE 'enabled' END AS state FROM part")
def _(spark, sf):
    p, k, name = part(spark, sf)
    protocol = by(k, F.lit("3.0"), text("2.", F.col("p_size").cast("string")), text("1.", F.col("p_size").cast("string")))
    error = F.when(k % 7 == 0, text("no ", name))
    return p.select("p_partkey", C.plugin_state(error, S.compatible(F.lit("2.5"), protocol), k % 2 == 0).alias("state"))
