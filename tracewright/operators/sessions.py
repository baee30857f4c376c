"""Transcript analytics.

Every function takes flat tables: entries (one row per transcript line), tool uses and results, and
session digests. Folds go by line number, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.classify import heavy_tool_hint, is_human, shell_category
from tracewright.functions.scalars import collapse, cost, cut_bytes, project_of_dir, result_text, short_id, strict_time, tokens, tool_brief
from tracewright.operators.names import longest_prefix

#: A result of so many tokens is a heavy one; so many are listed.
FAT_TOKENS, FAT_LISTED = 1500, 15
COMMANDS, CANDIDATES, INDEX, PROMPTS, WORKING_SET, MOST_PROMPTS = 30, 20, 30, 15, 12, 2000
#: Cache writes and reads as parts of the input rate.
CACHE_WRITE, CACHE_READ = 1.25, 0.1
TOKEN_TYPES = ("input", "output", "cache_read", "cache_creation")


def number(c: str) -> Column:
    return F.coalesce(F.try_variant_get("v", c, "long"), F.lit(0))


def entries(lines: DataFrame) -> DataFrame:
    """lines(path, line_no, dir_name, v) as typed columns; content stays a variant, as it is text or a list."""
    text = lambda f, a: F.try_variant_get("v", f"$.{f}", "string").alias(a)
    flag = lambda f, a: F.coalesce(F.try_variant_get("v", f"$.{f}", "boolean"), F.lit(False)).alias(a)
    return lines.select(
        "path", "line_no", "dir_name", text("type", "type"), text("cwd", "cwd"), text("gitBranch", "branch"), text("version", "version"), text("sessionId", "sid"), text("timestamp", "ts"), number("$.durationMs").alias("duration_ms"),
        flag("isMeta", "meta"), text("aiTitle", "title"), F.try_variant_get("v", "$.messageCount", "int").alias("messages"), F.try_variant_get("v", "$.prNumber", "int").alias("pr_number"), text("prUrl", "pr_url"),
        text("message.role", "role"), text("message.model", "model"), F.try_variant_get("v", "$.message.content", "variant").alias("content"),
        number("$.message.usage.input_tokens").alias("input"), number("$.message.usage.output_tokens").alias("output"), number("$.message.usage.cache_read_input_tokens").alias("cache_read"), number("$.message.usage.cache_creation_input_tokens").alias("cache_creation"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """Content blocks of each entry: (path, line_no, block, kind, id, name, ref, body, input)."""
    every = F.coalesce(F.try_variant_get("content", "$", "array<variant>"), F.array().cast("array<variant>"))
    b = rows.select("path", "line_no", F.posexplode(every).alias("block", "b"))
    text = lambda f, a: F.try_variant_get("b", f"$.{f}", "string").alias(a)
    return b.select("path", "line_no", "block", text("type", "kind"), text("id", "id"), text("name", "name"), text("tool_use_id", "ref"), text("text", "body"), F.try_variant_get("b", "$.content", "variant").alias("result"), text("input.command", "command"), text("input.file_path", "file"), text("input.pattern", "pattern"))


def tool_uses(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'tool_use'").select("path", "line_no", "block", "id", F.col("name").alias("tool"), "command", "file", "pattern", tool_brief(F.col("name"), F.col("command"), F.col("file"), F.col("pattern")).alias("brief"))


def tool_results(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'tool_result'").select("path", "line_no", "block", "ref", tokens(result_text(F.col("result"))).alias("tokens"))


def attributed(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Results with the tool and brief of the latest use of their id before them in the session; '?' without one."""
    u = uses.select("path", F.col("id").alias("ref"), F.struct("line_no", "block").alias("used"), "tool", "brief")
    before = F.col("used") < F.struct("line_no", "block")
    joined = results.join(u, ["path", "ref"], "left").groupBy("path", "line_no", "block", "ref", "tokens")
    last = joined.agg(F.max_by(F.struct("tool", "brief"), F.when(before, F.col("used"))).alias("u"))
    return last.select("path", "line_no", "block", "tokens", F.coalesce("u.tool", F.lit("?")).alias("tool"), F.coalesce("u.brief", F.lit("")).alias("brief"))


def first_of(value: Column, order: str = "line_no") -> Column:
    """The value of the first row that has one."""
    return F.min_by(value, F.when(F.coalesce(value, F.lit("")) != "", F.col(order)))


def last_of(value: Column, order: str = "line_no") -> Column:
    return F.max_by(value, F.when(F.coalesce(value, F.lit("")) != "", F.col(order)))


def fold(rows: DataFrame) -> DataFrame:
    """A row for each session file. Tokens add up over every line that has usage."""
    at = strict_time(F.col("ts"))
    out = rows.groupBy("path", "dir_name").agg(
        first_of(F.col("cwd")).alias("cwd"), last_of(F.col("branch")).alias("branch"), last_of(F.col("version")).alias("version"), last_of(F.col("title")).alias("title"), last_of(F.col("model")).alias("model"), first_of(F.col("sid")).alias("sid"),
        F.coalesce(F.max("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.greatest("duration_ms", F.lit(0))), F.lit(0)).alias("duration_ms"), F.min(at).alias("start"), F.max(at).alias("end"),
        *[F.sum(c).alias(c) for c in TOKEN_TYPES],
    )
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", "")
    project = F.coalesce(F.nullif(F.substring_index("cwd", "/", -1), F.lit("")), project_of_dir(F.col("dir_name")))
    return out.withColumn("id", short_id(stem)).withColumn("project", project)


def pull_requests_of(rows: DataFrame) -> DataFrame:
    """Distinct pull requests of a session, the first mention of each."""
    return rows.where("pr_number IS NOT NULL").groupBy("path", F.col("pr_number").alias("number")).agg(F.min_by("pr_url", "line_no").alias("url"), F.min("line_no").alias("line_no")).orderBy("path", "line_no")


def prompts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """what people wrote, in order: text, or the text blocks of a list without results; injected turns go."""
    plain = rows.where("type = 'user' AND NOT meta").select("path", "line_no", F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get("content", "$", "string")).alias("own"))
    listed = blocks.groupBy("path", "line_no").agg(F.count_if(F.col("kind") == "tool_result").alias("results"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("block", "body")))), lambda s: s["body"]), "\n").alias("joined"))
    both = plain.join(listed, ["path", "line_no"], "left").withColumn("text", F.coalesce("own", F.when(F.col("results") == 0, F.col("joined"))))
    kept = both.where(is_human(F.col("text"))).withColumn("i", F.row_number().over(W.partitionBy("path").orderBy("line_no")))
    return kept.where(F.col("i") <= MOST_PROMPTS).select("path", "i", "line_no", "text")


def tool_histogram(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and result tokens of each tool of a session; results without a tool have no row."""
    calls = uses.groupBy("path", "tool").agg(F.count("*").alias("calls"))
    size = results.groupBy("path", "tool").agg(F.sum("tokens").alias("result_tokens"))
    return calls.join(size, ["path", "tool"], "left").select("path", "tool", "calls", F.coalesce("result_tokens", F.lit(0)).alias("result_tokens")).orderBy("path", F.desc("calls"), "tool")


def commands(uses: DataFrame) -> DataFrame:
    """Each command of a session, how often it ran and its category."""
    ran = uses.where("tool = 'Bash' AND coalesce(command, '') <> ''")
    return ran.groupBy("path", "command").agg(F.count("*").alias("count")).withColumn("category", shell_category(F.col("command")))


def command_summary(commands: DataFrame) -> DataFrame:
    """A7."""
    return commands.groupBy("path", "category").agg(F.sum("count").alias("calls"), F.count("*").alias("unique")).orderBy("path", F.desc("calls"), "category")


def bash_view(commands: DataFrame, category: str = "", least: int = 1, limit: int = COMMANDS, full: bool = False) -> DataFrame:
    """Commands, most frequent first; the summary doesn't heed these filters."""
    out = commands.where(F.col("count") >= least)
    out = out.where(F.col("category") == category) if category else out
    shown = F.col("command") if full else cut_bytes(collapse(F.col("command")), 120)
    return out.orderBy(F.desc("count"), "command").limit(limit).select("count", "category", shown.alias("command"))


def file_touches(uses: DataFrame) -> DataFrame:
    """Reads, edits and writes of each file, most first."""
    f = uses.where("tool IN ('Read', 'Edit', 'Write', 'NotebookEdit') AND coalesce(file, '') <> ''")
    t = F.col("tool")
    out = f.groupBy("path", "file").agg(F.count_if(t == "Read").alias("reads"), F.count_if(t == "Edit").alias("edits"), F.count_if(t.isin("Write", "NotebookEdit")).alias("writes"))
    return out.orderBy("path", (F.col("reads") + F.col("edits") + F.col("writes")).desc(), "file")


def fat_results(results: DataFrame, least: int = FAT_TOKENS, limit: int = FAT_LISTED) -> DataFrame:
    """A10: the largest results of each session, the earlier first on a tie."""
    over = W.partitionBy("path").orderBy(F.desc("tokens"), "line_no", "block")
    return results.where(F.col("tokens") >= least).withColumn("k", F.row_number().over(over)).where(F.col("k") <= limit).select("path", "k", "tokens", "tool", "brief")


def heavy_tools(histogram: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """Tools over all sessions by result tokens, then calls."""
    out = histogram.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("result_tokens").alias("result_tokens"))
    return out.withColumn("suggestion", heavy_tool_hint(F.col("tool"), hints or {})).orderBy(F.desc("result_tokens"), F.desc("calls"), "tool")


def repeated_commands(commands: DataFrame, least: int = 2, limit: int = CANDIDATES) -> DataFrame:
    """commands(session, command, count) that ran at least so often, over all sessions."""
    out = commands.groupBy("command").agg(F.sum("count").alias("count"), F.count_distinct("session").alias("sessions")).where(F.col("count") >= least)
    out = out.orderBy(F.desc("count"), "command")
    return (out.limit(limit) if limit > 0 else out).withColumn("category", shell_category(F.col("command")))


def repeated_reads(touches: DataFrame, least: int = 2, limit: int = CANDIDATES) -> DataFrame:
    """touches(session, file, reads)."""
    out = touches.where("reads > 0").groupBy("file").agg(F.sum("reads").alias("reads"), F.count_distinct("session").alias("sessions")).where(F.col("reads") >= least).orderBy(F.desc("reads"), "file")
    return out.limit(limit) if limit > 0 else out


def priced(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Sessions with the rates of their model: the exact name, or one that it continues after a dash, the longest; null without one.

    Models meet names by equality, whatever the size of either table.
    """
    rates = prices.select(F.col("model").alias("_name"), F.col("input").alias("rate_in"), F.col("output").alias("rate_out"))
    return longest_prefix(sessions, "model", rates, "_name", "-").drop("_name")


def value(sessions: DataFrame, prices: DataFrame, now: Column, days: int = 7) -> dict[str, DataFrame]:
    """Tokens and dollars of the last `days` and of as many days before.

    A session counts in the window of its end (its start without one). The current window has no end;
    the previous one is [start, current). Models without a price keep their tokens and cost nothing.
    """
    current, previous = now - F.make_dt_interval(F.lit(days)), now - F.make_dt_interval(F.lit(2 * days))
    at = F.coalesce("end", "start")
    period = F.when(at >= current, "current").when(at >= previous, "previous")
    rate = {"input": F.col("rate_in"), "output": F.col("rate_out"), "cache_read": F.col("rate_in") * CACHE_READ, "cache_creation": F.col("rate_in") * CACHE_WRITE}
    timed = priced(sessions.withColumn("period", period).where("period IS NOT NULL"), prices)
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("tokens"), cost(F.col(k), rate[k]).alias("cost")) for k in TOKEN_TYPES])
    long = timed.select("path", "period", F.coalesce(F.nullif("model", F.lit("")), F.lit("?")).alias("model"), F.col("rate_in").isNotNull().alias("priced"), F.explode(kinds).alias("t")).select("path", "period", "model", "priced", "t.*")
    dollars = F.coalesce(F.sum("cost"), F.lit(0.0))
    by_type = long.where("tokens > 0").groupBy("period", "type").agg(F.sum("tokens").alias("tokens"), dollars.alias("cost")).orderBy("period", F.desc("cost"), "type")
    by_model = long.where("period = 'current'").groupBy("model").agg(F.count_distinct("path").alias("sessions"), F.sum("tokens").alias("tokens"), dollars.alias("cost"), F.bool_or("priced").alias("priced")).orderBy(F.desc("cost"), "model")
    periods = long.groupBy("period").agg(F.count_distinct("path").alias("sessions"), F.sum("tokens").alias("tokens"), dollars.alias("cost"), F.coalesce(F.sum(F.when(~F.col("priced"), F.col("tokens"))), F.lit(0)).alias("unpriced_tokens"))
    both = periods.agg(*[F.coalesce(F.max(F.when(F.col("period") == p, F.col("cost"))), F.lit(0.0)).alias(p) for p in ("current", "previous")])
    change = F.col("current") - F.col("previous")
    delta = both.select("current", "previous", change.alias("delta"), F.when(F.col("previous") > 0, change / F.col("previous") * 100).otherwise(0.0).alias("delta_pct"))
    return {"by_type": by_type, "by_model": by_model, "periods": periods.orderBy("period"), "delta": delta}


def index_view(sessions: DataFrame, limit: int = INDEX) -> DataFrame:
    """Sessions by last activity (their end, else the file's time), newest first."""
    out = sessions.withColumn("updated", F.coalesce("end", "mtime")).orderBy(F.desc("updated"), "path")
    return out.limit(limit) if limit > 0 else out


def working_set(touches: DataFrame, limit: int = WORKING_SET) -> DataFrame:
    """A session's files, edited ones first, then by reads, touches and name."""
    edited, every = F.col("edits") + F.col("writes"), F.col("reads") + F.col("edits") + F.col("writes")
    over = W.partitionBy("path").orderBy(edited.desc(), F.desc("reads"), every.desc(), "file")
    return touches.withColumn("k", F.row_number().over(over)).where(F.col("k") <= limit)


def resume(sessions: DataFrame, prompts: DataFrame, last_texts: DataFrame) -> DataFrame:
    """Goal (the first prompt), now (the last, unless it is the first) and next (the last answer) of each session."""
    ends = prompts.groupBy("path").agg(F.min_by("text", "i").alias("goal"), F.max_by("text", "i").alias("last"))
    trim = lambda c, n: cut_bytes(collapse(F.col(c)), n)
    both = sessions.join(ends, "path", "left").join(last_texts.select("path", F.col("text").alias("answer")), "path", "left")
    return both.select("path", "project", trim("goal", 240).alias("goal"), F.when(F.col("last") != F.col("goal"), trim("last", 240)).alias("now"), trim("answer", 600).alias("next"))


def last_texts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last text block that an assistant wrote in each session."""
    said = blocks.where("kind = 'text' AND coalesce(body, '') <> ''").join(rows.where("type = 'assistant'").select("path", "line_no"), ["path", "line_no"])
    return said.groupBy("path").agg(F.max_by("body", F.struct("line_no", "block")).alias("text"))


def with_calls(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """J14, an extension: calls of the log that were made in each session."""
    calls = log.groupBy("sid").agg(F.count("*").alias("calls"), F.sum("out_tokens").alias("out_tokens"))
    return sessions.join(calls, "sid", "left").select("path", "sid", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("out_tokens", F.lit(0)).alias("out_tokens"))
