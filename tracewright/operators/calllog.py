"""Call-log analytics (A1-A5, A17, A25, F1-F5, W1, W2, W5, J9, ST1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.scalars import json_flag, json_number, json_texts, strict_time

AGENT = "agent"
#: Seconds of the sliding quota window, and of the repeat-call window.
QUOTA_SECONDS, REPEAT_SECONDS = 5 * 3600, 180


def source_of(c: Column) -> Column:
    """rows from before sources were logged are an agent's."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(AGENT))


def filtered(log: DataFrame, tool: str = "", source: str = "", session: str = "", tag: str = "", failed: bool = False, since: Column | None = None) -> DataFrame:
    """Prefix of the tool and of the session, source, tag, failures, and a first time (inclusive).

    Rows whose time can't be read go only if a first time is given.
    """
    if tool:
        log = log.where(F.startswith("tool", F.lit(tool)))
    if source:
        log = log.where(source_of(F.col("source")) == source)
    if session:
        log = log.where(F.startswith("sid", F.lit(session)))
    if tag:
        log = log.where(F.col("tag") == tag)
    if failed:
        log = log.where("exit <> 0")
    if since is not None:
        log = log.where(strict_time(F.col("ts")) >= since)
    return log


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    """The last rows in the order in which they were appended, newest first; 0 is all."""
    out = log.orderBy(F.desc("ord"))
    return out.limit(limit) if limit > 0 else out


def percentiles(log: DataFrame, by: str, value: str, at: tuple[int, ...]) -> DataFrame:
    """A2: for each p the value at place n * p div 100 (from 0, at most n - 1) of the sorted values.

    Values are counted first, so that a group is a running sum over its distinct values, not a list of its rows.
    """
    counts = log.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    along = W.partitionBy(by).orderBy("v")
    ranked = counts.withColumn("upto", F.sum("c").over(along)).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    place = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > place(p), F.col("v"))).alias(f"p{p}") for p in at])


def tool_stats(log: DataFrame) -> DataFrame:
    """A1: calls, failures, times, sizes and first and last time of each tool, most calls first (ties by name).

    The mean is truncated; the largest time is at least 0; first and last are the least and greatest text of ts, '' aside.
    """
    ts = F.nullif("ts", F.lit(""))
    stats = log.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("exit") != 0).alias("errors"), F.sum("dur_ms").alias("total_ms"), F.greatest(F.max("dur_ms"), F.lit(0)).cast("long").alias("max_ms"),
        F.sum("out_bytes").alias("total_out_bytes"), F.sum("out_tokens").alias("total_out_tokens"), F.min(ts).alias("first"), F.max(ts).alias("last"),
    )
    out = stats.join(percentiles(log, "tool", "dur_ms", (50, 95)), "tool")
    mean = F.expr("total_ms div calls")
    return out.select("tool", "calls", "errors", "total_ms", mean.alias("mean_ms"), F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"), "max_ms", "total_out_bytes", "total_out_tokens", "first", "last").orderBy(F.desc("calls"), "tool")


def top_inputs(log: DataFrame, n: int = 5) -> DataFrame:
    """A3: how often each tool was asked for each input, most first (ties by tool and input); n <= 0 is all."""
    out = log.select("tool", F.explode(json_texts(F.col("summary"), "inputs")).alias("input")).groupBy("tool", "input").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tool", "input")
    return out.limit(n) if n > 0 else out


def histogram(log: DataFrame, bucket: str) -> DataFrame:
    """A4: calls, time and output by hour of the day or by day, as the clock of the row's own zone had it.

    Rows whose time can't be read and empty buckets are left out.
    """
    text = F.substring("ts", 12, 2) if bucket == "hour" else F.substring("ts", 1, 10)
    ok = log.where(strict_time(F.col("ts")).isNotNull())
    return ok.groupBy(text.alias("bucket")).agg(F.count("*").alias("count"), F.sum("dur_ms").alias("total_ms"), F.sum("out_bytes").alias("total_out_bytes"), F.sum("out_tokens").alias("total_out_tokens")).orderBy("bucket")


def adoption(log: DataFrame) -> DataFrame:
    """A5: calls, distinct sessions, failures and output by tag and source, most calls first, then by tag and source."""
    tag = F.coalesce(F.nullif("tag", F.lit("")), F.lit("?"))
    out = log.groupBy(tag.alias("tag"), source_of(F.col("source")).alias("source")).agg(F.count("*").alias("calls"), F.count_distinct(F.nullif("sid", F.lit(""))).alias("sessions"), F.count_if(F.col("exit") != 0).alias("errors"), F.sum("out_tokens").alias("out_tokens"))
    return out.select("tag", "source", "calls", "sessions", "errors", (F.col("errors") * 100.0 / F.col("calls")).alias("failed_pct"), "out_tokens").orderBy(F.desc("calls"), "tag", "source")


def savings(log: DataFrame) -> DataFrame:
    """(at, emitted, baseline, saved, stub) of each row: what it printed against what the raw output would have been.

    The baseline is the number tok_raw, else tok_rep; text isn't a number. A row never saves less than 0.
    """
    baseline = F.coalesce(json_number(F.col("summary"), "tok_raw"), json_number(F.col("summary"), "tok_rep"))
    row = log.select(strict_time(F.col("ts")).alias("at"), F.coalesce("out_tokens", F.lit(0)).alias("emitted"), baseline.alias("baseline"), json_flag(F.col("summary"), "dedup").alias("stub"))
    return row.withColumn("saved", F.when(F.col("baseline").isNotNull(), F.greatest(F.col("baseline") - F.col("emitted"), F.lit(0))))


def in_quota(log: DataFrame, now: Column, days: int) -> DataFrame:
    """an agent's rows (named so, not by default) of the last days, both ends included."""
    at = strict_time(F.col("ts"))
    return log.where((F.col("source") == AGENT) & at.between(now - F.make_dt_interval(F.lit(days)), now))


def quota(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row of totals; pct is the part of the baseline that was saved, 0 without one."""
    s = savings(in_quota(log, now, days))
    has = F.col("baseline").isNotNull()
    total = s.agg(F.count("*").alias("calls"), F.count_if(has).alias("with_baseline"), F.count_if("stub").alias("dedup_stubs"), *[F.coalesce(F.sum(F.when(has, F.col(c))), F.lit(0)).alias(c) for c in ("emitted", "baseline", "saved")])
    return total.withColumn("pct", F.when(F.col("baseline") > 0, F.col("saved") * 100.0 / F.col("baseline")).otherwise(0.0))


def busiest_window(points: DataFrame, seconds: int = QUOTA_SECONDS, chunk: int = 16) -> DataFrame:
    """(start, end, saved) of the window of so many seconds (both ends included) that saved most; the earliest on a tie.

    points(at, saved) are summed by instant first. Instants are dealt by spans of `chunk` windows, each with
    the window before it, so no task holds them all. Inside a span a sum runs over instants that come and those that go,
    so that the work grows with the instants, not with how many a window holds. No row if nothing was saved.
    """
    width = seconds * 1_000_000
    span = width * chunk
    sums = points.where("at IS NOT NULL").groupBy(F.unix_micros("at").alias("us")).agg(F.sum(F.coalesce("saved", F.lit(0))).alias("saved"))
    home = F.floor(F.col("us") / span)
    also = F.floor((F.col("us") + width) / span)
    dealt = sums.withColumn("span", F.explode(F.array_distinct(F.array(home, also)))).withColumn("own", F.col("span") == home)
    following = dealt.withColumn("next", F.lead("us").over(W.partitionBy("span").orderBy("us")))
    # an instant comes at its time and goes after the last window that holds it; the first one still there follows the last that went
    none = F.lit(None).cast("long")
    comes = F.struct("own", "us", F.lit(0).alias("gone"), "saved", F.col("us").alias("first"), none.alias("next"))
    goes = F.struct(F.lit(False).alias("own"), (F.col("us") + width).alias("us"), F.lit(1).alias("gone"), (-F.col("saved")).alias("saved"), none.alias("first"), "next")
    moves = following.select("span", F.explode(F.array(comes, goes)).alias("m")).select("span", "m.*")
    over = W.partitionBy("span").orderBy("us", "gone").rowsBetween(W.unboundedPreceding, 0)
    seen = moves.select("own", "us", F.sum("saved").over(over).alias("total"), F.coalesce(F.max("next").over(over), F.min("first").over(over)).alias("from"))
    best = seen.where("own AND total > 0").orderBy(F.desc("total"), "us").limit(1)
    return best.select(F.timestamp_micros("from").alias("start"), F.timestamp_micros("us").alias("end"), F.col("total").alias("saved"))


def repeat_calls(calls: DataFrame, seconds: int = REPEAT_SECONDS, order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """calls(sid, fp, ts, tok, force, ord) with stub, n and original tok; order ("ord",) takes them as they were appended.

    A call repeats one of the same session and fingerprint if the latest of those is less than `seconds`
    old; a stub renews that time and keeps the n and tok of its original. n counts the session's rows.
    A forced call, and one from before the latest (a clock ahead), is always an original. 0 seconds turn repeats off.
    """
    same = W.partitionBy("sid", "fp").orderBy(*order)
    session = W.partitionBy("sid").orderBy(*order)
    gap = F.col("ts") - F.lag("ts").over(same)
    fresh = gap.isNull() | (gap >= seconds) | (gap < 0) | F.coalesce("force", F.lit(False))
    step = calls.withColumn("seq", F.row_number().over(session).cast("long")).withColumn("fresh", fresh).withColumn("island", F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(same))
    first = W.partitionBy("sid", "fp", "island").orderBy(*order)
    return step.select("sid", "fp", "ts", "ord", (~F.col("fresh")).alias("stub"), F.first("seq").over(first).alias("n"), F.first("tok").over(first).alias("tok"))


def first_touches(calls: DataFrame, key: str) -> DataFrame:
    """J9, ST3: the first row of each session and key."""
    return calls.withColumn("k", F.row_number().over(W.partitionBy("sid", key).orderBy("ord"))).where("k = 1").drop("k")


def feedback(log: DataFrame, limit: int = 20) -> DataFrame:
    """Notes left through the feedback tool, newest first; a note falls back to the arguments."""
    note = F.coalesce(F.try_variant_get("summary", "$.note", "string"), F.array_join("args", " "))
    out = log.where("tool = 'gripe'").select("ord", F.date_format(strict_time(F.col("ts")), "yyyy-MM-dd HH:mm").alias("when"), F.coalesce(F.nullif("tag", F.lit("")), F.lit("?")).alias("project"), source_of(F.col("source")).alias("source"), note.alias("note")).orderBy(F.desc("ord"))
    return out.limit(limit) if limit > 0 else out


def feedback_since(log: DataFrame, built: Column) -> DataFrame:
    """How many notes of agents there are since a build."""
    return log.where((F.col("tool") == "gripe") & (source_of(F.col("source")) == AGENT) & (strict_time(F.col("ts")) >= built)).agg(F.count("*").alias("notes"))
