"""Queries of the transcript operators over the conversations table, with their SQL.

A conversation stands in for a session: an assistant's turn is a tool use, the user's next turn its result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import classify as C
from tracewright.functions import scalars as S
from tracewright.operators import sessions as N
from tracewright.plans.text_queries import TOKENS
from tracewright.sources.stand_ins import MODELS, RATES, prices, turns

NOW = "2024-02-01 00:00:00"
COMMANDS = ("git status", "grep -rn foo .", "cat a.go | head", "go test ./...", "psql -c select", "rm -rf x", "npm run build", "echo hi", "make test", "npm test")
TOOLS = ("Bash", "Read", "Edit", "Write")
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def uses(spark, sf):
    t = turns(spark, sf).where("role = 'assistant'")
    k = F.col("conv_id") + F.col("line_no")
    tool = pick(TOOLS, k)
    command = F.when(tool == "Bash", pick(COMMANDS, F.col("conv_id") * 7 + F.col("line_no")))
    file = F.when(tool != "Bash", F.concat(F.lit("f"), (k % 40).cast("string"), F.lit(".go")))
    rows = t.select("path", "line_no", F.lit(0).alias("block"), F.concat(F.lit("t"), (F.col("line_no") % 3).cast("string")).alias("id"), tool.alias("tool"), command.alias("command"), file.alias("file"), F.lit(None).cast("string").alias("pattern"))
    return rows.withColumn("brief", S.tool_brief(F.col("tool"), F.col("command"), F.col("file"), F.col("pattern")))


def results(spark, sf):
    t = turns(spark, sf).where("role = 'user' AND line_no > 0")
    return t.select("path", "line_no", F.lit(0).alias("block"), F.concat(F.lit("t"), ((F.col("line_no") - 1) % 3).cast("string")).alias("ref"), S.tokens(F.col("text")).alias("tokens"))


def entries(spark, sf):
    t = turns(spark, sf)
    n = S.tokens(F.col("text"))
    day = F.col("conv_id") % 40
    at = F.concat(F.lit("2024-01-"), F.lpad((day % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((F.col("line_no") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    model = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 6 > 0), pick(MODELS, F.col("conv_id") + F.when(F.col("line_no") > 3, 1).otherwise(0)))
    is_ = lambda r: F.when(F.col("role") == r, n).otherwise(F.lit(0))
    return t.select(
        "path", F.concat(F.lit("-home-p"), (F.col("conv_id") % 5).cast("string")).alias("dir_name"), "line_no", F.when(F.col("line_no") > 0, F.concat(F.lit("/w/proj"), (F.col("conv_id") % 3 + F.col("line_no") % 2).cast("string"))).otherwise("").alias("cwd"),
        F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("b"), F.col("line_no").cast("string"))).otherwise("").alias("branch"), F.lit("1").alias("version"), F.when(F.col("role") == "user", F.left("text", F.lit(20))).alias("title"), model.alias("model"), F.col("path").alias("sid"),
        F.col("line_no").cast("int").alias("messages"), (F.length("text") - 300).cast("long").alias("duration_ms"), F.when(F.col("conv_id") % 9 == 0, "").otherwise(at).alias("ts"), is_("user").alias("input"), is_("assistant").alias("output"), (is_("system") * 3).alias("cache_read"), is_("system").alias("cache_creation"),
    )


N1 = "CAST(floor(" + TOKENS.format(t="text") + " + 0.5) AS BIGINT)"


def choose(values, k):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({k}) % {len(values)} + 1]"


BASE = f"""WITH t AS (SELECT 'c' || conv_id AS path, turn AS line_no, role, text, conv_id, {N1} AS n FROM conversations),
u AS (SELECT *, CASE WHEN tool = 'Bash' THEN {choose(COMMANDS, 'conv_id * 7 + line_no')} END AS command, CASE WHEN tool <> 'Bash' THEN 'f' || ((conv_id + line_no) % 40) || '.go' END AS file FROM (SELECT *, 't' || (line_no % 3) AS id, {choose(TOOLS, 'conv_id + line_no')} AS tool FROM t WHERE role = 'assistant')),
r AS (SELECT path, line_no, 't' || ((line_no - 1) % 3) AS ref, n AS tokens FROM t WHERE role = 'user' AND line_no > 0),
a AS (SELECT r.path, r.line_no, r.tokens, coalesce(max_by(u.tool, u.line_no), '?') AS tool, coalesce(max_by(coalesce(u.command, u.file), u.line_no), '') AS brief FROM r LEFT JOIN u ON u.path = r.path AND u.id = r.ref AND u.line_no < r.line_no GROUP BY ALL)
"""
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(command), '{p}') THEN '{c}'" for c, p in C.SHELL_RULES) + " ELSE 'other' END"


def attributed(spark, sf):
    return N.attributed(results(spark, sf), uses(spark, sf))


@query("j1_attributed_results", BASE + "SELECT * FROM a")
def _(spark, sf):
    return attributed(spark, sf).select("path", "line_no", "tokens", "tool", "brief")


HISTOGRAM = "SELECT c.path, c.tool, c.calls, coalesce(s.n, 0) AS result_tokens FROM (SELECT path, tool, count(*) AS calls FROM u GROUP BY ALL) c LEFT JOIN (SELECT path, tool, CAST(sum(tokens) AS BIGINT) AS n FROM a GROUP BY ALL) s USING (path, tool)"


@query("a6_tool_histogram", BASE + HISTOGRAM)
def _(spark, sf):
    return N.tool_histogram(uses(spark, sf), attributed(spark, sf))


@query("a7_commands", BASE + f"SELECT path, command, count(*) AS count, {CATEGORY} AS category FROM u WHERE tool = 'Bash' GROUP BY ALL")
def _(spark, sf):
    return N.commands(uses(spark, sf))


@query("a7_command_summary", BASE + f"SELECT path, category, CAST(sum(n) AS BIGINT) AS calls, count(*) AS unique FROM (SELECT path, command, count(*) AS n, {CATEGORY} AS category FROM u WHERE tool = 'Bash' GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return N.command_summary(N.commands(uses(spark, sf)))


@query("f8_bash_view", BASE + f"SELECT count, category, command FROM (SELECT command, count(*) AS count, {CATEGORY} AS category FROM u WHERE tool = 'Bash' GROUP BY ALL) WHERE count >= 2 AND category = 'test'")
def _(spark, sf):
    one = N.commands(uses(spark, sf).withColumn("path", F.lit("all")))
    return N.bash_view(one, category="test", least=2)


@query("a8_fold", f"""WITH e AS (SELECT 'c' || conv_id AS path, '-home-p' || (conv_id % 5) AS dir_name, turn AS o, conv_id, CASE WHEN turn > 0 THEN '/w/proj' || (conv_id % 3 + turn % 2) END AS cwd, CASE WHEN turn % 2 = 0 THEN 'b' || turn END AS branch,
CASE WHEN role = 'user' THEN left(text, 20) END AS title, CASE WHEN role = 'assistant' AND conv_id % 6 > 0 THEN {choose(MODELS, 'conv_id + CASE WHEN turn > 3 THEN 1 ELSE 0 END')} END AS model, role, {N1} AS n, length(text) - 300 AS d,
CASE WHEN conv_id % 9 <> 0 THEN make_timestamp(2024, 1, conv_id % 40 % 28 + 1, turn % 24, 0, 0) END AS stamp FROM conversations)
SELECT path, coalesce(regexp_extract(min_by(cwd, o), '[^/]*$'), split_part(dir_name, '-', 3)) AS project, max_by(branch, o) AS branch, max_by(title, o) AS title, max_by(model, o) AS model, CAST(max(o) AS INTEGER) AS messages, CAST(sum(greatest(d, 0)) AS BIGINT) AS duration_ms, min(stamp) AS "start", max(stamp) AS "end",
CAST(sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS BIGINT) AS input, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS output, CAST(sum(CASE WHEN role = 'system' THEN n * 3 ELSE 0 END) AS BIGINT) AS cache_read FROM e GROUP BY path, dir_name""")
def _(spark, sf):
    f = N.fold(entries(spark, sf))
    return f.select("path", "project", "branch", "title", "model", "messages", "duration_ms", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "input", "output", "cache_read")


TOUCHES = "SELECT path, file, count(*) FILTER (tool = 'Read') AS reads, count(*) FILTER (tool = 'Edit') AS edits, count(*) FILTER (tool = 'Write') AS writes FROM u WHERE file IS NOT NULL GROUP BY ALL"


@query("a9_file_touches", BASE + TOUCHES)
def _(spark, sf):
    return N.file_touches(uses(spark, sf))


@query("a10_fat_results", BASE + "SELECT path, k, tokens, tool, brief FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tokens DESC, line_no) AS k FROM a WHERE tokens >= 200) WHERE k <= 15")
def _(spark, sf):
    return N.fat_results(attributed(spark, sf), 200).withColumn("k", F.col("k").cast("long"))


HINTS = {"Read": "structure instead of whole files", "Bash": "a tool of its own"}


@query("a11_heavy_tools", BASE + f"SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(result_tokens) AS BIGINT) AS result_tokens, CASE tool WHEN 'Read' THEN '{HINTS['Read']}' WHEN 'Bash' THEN '{HINTS['Bash']}' ELSE '' END AS suggestion FROM ({HISTOGRAM}) GROUP BY tool")
def _(spark, sf):
    return N.heavy_tools(N.tool_histogram(uses(spark, sf), attributed(spark, sf)), HINTS)


@query("a12_repeated_commands", BASE + f"SELECT command, count(*) AS count, count(DISTINCT path) AS sessions, {CATEGORY} AS category FROM u WHERE tool = 'Bash' GROUP BY command HAVING count(*) >= 2 ORDER BY count DESC, command LIMIT 20")
def _(spark, sf):
    return N.repeated_commands(N.commands(uses(spark, sf)).withColumnRenamed("path", "session"))


@query("a13_repeated_reads", BASE + "SELECT file, count(*) AS reads, count(DISTINCT path) AS sessions FROM u WHERE tool = 'Read' GROUP BY file HAVING count(*) >= 2 ORDER BY reads DESC, file LIMIT 20")
def _(spark, sf):
    return N.repeated_reads(N.file_touches(uses(spark, sf)).withColumnRenamed("path", "session"))


VALUE = f"""WITH e AS (SELECT 'c' || conv_id AS path, turn, role, {N1} AS n, conv_id, CASE WHEN role = 'assistant' AND conv_id % 6 > 0 THEN {choose(MODELS, 'conv_id + CASE WHEN turn > 3 THEN 1 ELSE 0 END')} END AS model,
CASE WHEN conv_id % 9 <> 0 THEN make_timestamp(2024, 1, conv_id % 40 % 28 + 1, turn % 24, 0, 0) END AS stamp FROM conversations),
s AS (SELECT path, max_by(model, turn) AS m, max(stamp) AS t, sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS input, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS output, sum(CASE WHEN role = 'system' THEN n * 3 ELSE 0 END) AS cache_read, sum(CASE WHEN role = 'system' THEN n ELSE 0 END) AS cache_creation FROM e GROUP BY path),
p(known, ri, ro) AS (VALUES {', '.join(f"('{m}', {i}, {o})" for m, i, o in RATES)}),
v AS (SELECT s.*, CASE WHEN t >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'current' ELSE 'previous' END AS period, ri, ro FROM s LEFT JOIN p ON m = known OR starts_with(m, known || '-') WHERE t >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY),
l AS (SELECT path, period, coalesce(m, '?') AS model, ri IS NOT NULL AS priced, unnest(['input', 'output', 'cache_read', 'cache_creation']) AS type, unnest([input, output, cache_read, cache_creation]) AS n, unnest([ri, ro, ri * 0.1, ri * 1.25]) AS rate FROM v)
"""


def valued(spark, sf):
    return N.value(N.fold(entries(spark, sf)), prices(spark), F.lit(NOW).cast("timestamp"), 7)


@query("a14_value_by_type", VALUE + "SELECT period, type, CAST(sum(n) AS BIGINT) AS tokens, round(coalesce(sum(n / 1e6 * rate), 0), 9) AS cost FROM l WHERE n > 0 GROUP BY ALL")
def _(spark, sf):
    return valued(spark, sf)["by_type"].withColumn("cost", F.round("cost", 9))


@query("a15_value_by_model", VALUE + "SELECT model, count(DISTINCT path) AS sessions, CAST(sum(n) AS BIGINT) AS tokens, round(coalesce(sum(n / 1e6 * rate), 0), 9) AS cost, bool_or(priced) AS priced FROM l WHERE period = 'current' GROUP BY model")
def _(spark, sf):
    return valued(spark, sf)["by_model"].withColumn("cost", F.round("cost", 9))


@query("a14_value_periods", VALUE + "SELECT period, count(DISTINCT path) AS sessions, CAST(sum(n) AS BIGINT) AS tokens, round(coalesce(sum(n / 1e6 * rate), 0), 9) AS cost, CAST(coalesce(sum(n) FILTER (NOT priced), 0) AS BIGINT) AS unpriced_tokens FROM l GROUP BY period")
def _(spark, sf):
    return valued(spark, sf)["periods"].withColumn("cost", F.round("cost", 9))


@query("a16_value_delta", VALUE + ", c AS (SELECT coalesce(sum(n / 1e6 * rate) FILTER (period = 'current'), 0) AS cur, coalesce(sum(n / 1e6 * rate) FILTER (period = 'previous'), 0) AS prev FROM l) SELECT round(cur, 9) AS current, round(prev, 9) AS previous, round(cur - prev, 9) AS delta, round(CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 ELSE 0 END, 6) AS delta_pct FROM c")
def _(spark, sf):
    d = valued(spark, sf)["delta"]
    return d.select(F.round("current", 9).alias("current"), F.round("previous", 9).alias("previous"), F.round("delta", 9).alias("delta"), F.round("delta_pct", 6).alias("delta_pct"))


@query("o6_working_set", BASE + f"SELECT path, k, file FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY edits + writes DESC, reads DESC, reads + edits + writes DESC, file) AS k FROM ({TOUCHES})) WHERE k <= 12")
def _(spark, sf):
    return N.working_set(N.file_touches(uses(spark, sf))).select("path", F.col("k").cast("long").alias("k"), "file")


@query("o7_index", "SELECT 'c' || conv_id AS path, max(make_timestamp(2024, 1, conv_id % 40 % 28 + 1, turn % 24, 0, 0)) AS updated FROM conversations WHERE conv_id % 9 <> 0 GROUP BY 1 ORDER BY updated DESC, path LIMIT 30")
def _(spark, sf):
    f = N.fold(entries(spark, sf)).withColumn("mtime", F.lit("2023-01-01").cast("timestamp"))
    return N.index_view(f).select("path", F.col("updated").cast("timestamp_ntz").alias("updated"))


@query("f6_human_turns", "SELECT 'c' || conv_id AS path, turn AS line_no FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT regexp_matches(ltrim(text), '^(<|Caveat:|\\[Request interrupted|API Error|This session is being continued)')")
def _(spark, sf):
    return turns(spark, sf).where((F.col("role") == "user") & C.is_human(F.col("text"))).select("path", "line_no")


@query("x15_resume", """WITH p AS (SELECT conv_id, text, turn FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, min_by(text, turn) AS f, max_by(text, turn) AS l FROM p GROUP BY 1)
SELECT 'c' || conv_id AS path, md5(f) AS goal, CASE WHEN l <> f THEN md5(l) END AS now FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)""")
def _(spark, sf):
    t = turns(spark, sf)
    p = t.where("role = 'user'").select("path", F.col("line_no").alias("i"), F.md5("text").alias("text"))
    a = t.where("role = 'assistant'").groupBy("path").agg(F.max_by("text", "line_no").alias("text"))
    return N.resume(t.select("path").distinct().withColumn("project", F.lit("")), p, a).select("path", "goal", "now")


@query("n9_n10_labels", "SELECT DISTINCT conv_id, 'c' || conv_id AS id, split_part('-home-x-p' || conv_id, '-', 4) AS project, regexp_replace('a b/' || conv_id, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM conversations")
def _(spark, sf):
    c = F.col("conv_id").cast("string")
    return turns(spark, sf).select("conv_id").distinct().select("conv_id", S.short_id(F.concat(F.lit("c"), c, F.lit("-4711-aa"))).alias("id"), S.project_of_dir(F.concat(F.lit("-home-x-p"), c)).alias("project"), S.safe_session(F.concat(F.lit("a b/"), c)).alias("safe"))
