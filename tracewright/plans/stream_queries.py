"""Queries of the streams: events written as files, taken batch by batch, and what their sinks hold; with their SQL."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tracewright.operators import calllog
from tracewright.plans import log_queries
from tracewright.sources.files import parse_log
from tracewright.sources.stand_ins import call_log, table
from tracewright.streaming import log_stream as X

QUERIES, ORACLES = {}, {}
#: Batches of a stream, and the seconds after which st4's state goes.
BATCHES, KEEP = 3, 2.0


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def slices(df, by: str, parts: int = BATCHES):
    """df in so many parts of equal ranges of a whole-numbered column."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [df]
    part = F.expr(f"({by} - {low}) * {parts} div {high - low + 1}")
    return [df.where(part == k) for k in range(parts)]


def calls(spark, sf):
    """Calls in the order in which they were appended: every fiftieth forced, the clock of every 37th three days ahead; failed ones leave no record."""
    e = table(spark, sf, "events").where("event_id % 41 <> 0")
    ahead = F.when(F.col("event_id") % 37 == 0, 3 * 86_400).otherwise(0)
    return e.select(F.col("user_id").cast("string").alias("sid"), F.col("event_type").alias("fp"), (F.unix_seconds(F.col("ts").cast("timestamp")) + ahead).alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("tok"), (F.col("event_id") % 50 == 0).alias("force"), F.col("event_id").alias("ord"))


#: {parts}: what else a session's rows are apart by.
REPEATS = """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS sid, event_type AS fp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CASE WHEN event_id % 37 = 0 THEN 259200 ELSE 0 END AS ts, CAST(json_extract(props, '$.k') AS BIGINT) AS tok, event_id % 50 = 0 AS force, event_id AS ord FROM events WHERE event_id % 41 <> 0),
p AS (SELECT *, {part} AS part FROM c, (SELECT min(ord) AS low, max(ord) AS high FROM c)),
s AS (SELECT *, row_number() OVER (PARTITION BY part, sid ORDER BY ord) AS seq, ts - lag(ts) OVER (PARTITION BY part, sid, fp ORDER BY ord) AS gap FROM p),
f AS (SELECT *, gap IS NULL OR gap >= {seconds} OR gap < 0 OR force AS fresh FROM s),
i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY part, sid, fp ORDER BY ord) AS island FROM f)
SELECT sid, fp, ts, ord, NOT fresh AS stub, first_value(seq) OVER w AS n, first_value(tok) OVER w AS tok FROM i WINDOW w AS (PARTITION BY part, sid, fp, island ORDER BY ord)"""


@query("st1_stream_repeats", REPEATS.format(part="0", seconds=log_queries.DEDUP_SECONDS))
def _(spark, sf):
    return X.replay(slices(calls(spark, sf), "ord"), lambda s: X.stream_repeats(s, log_queries.DEDUP_SECONDS), "st1")


@query("st4_stream_expiry", REPEATS.format(part="(ord - low) * 2 // (high - low + 1)", seconds=log_queries.DEDUP_SECONDS))
def _(spark, sf):
    # idle for longer than state is kept: whatever the second half has is new to its session
    return X.replay(slices(calls(spark, sf), "ord", 2), lambda s: X.stream_repeats(s, log_queries.DEDUP_SECONDS, KEEP), "st4", between=lambda: time.sleep(KEEP + 0.5))


@query("st3_stream_first_touches", """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS sid, event_type AS key, date_trunc('second', ts) AS t FROM events),
g AS (SELECT sid, key, min(t) AS t FROM c GROUP BY sid, key UNION ALL SELECT g.sid, g.key, min(c.t) FROM g JOIN c ON c.sid = g.sid AND c.key = g.key AND c.t >= g.t + INTERVAL 48 HOUR GROUP BY g.sid, g.key)
SELECT sid, key, CAST(t AS TIMESTAMP) AS "at" FROM g""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sid"), "event_type", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    parts = slices(e, "s")
    # the first part's rows come again when the watermark has passed them: they are late and give nothing
    late = parts[0].where("ord % 20 = 0") if len(parts) > 1 else parts[0].limit(0)
    return X.replay([*parts, late], lambda s: X.stream_first_touches(s, "event_type", "at"), "st3").select("sid", "key", F.col("at").cast("timestamp_ntz").alias("at"))


def logged(spark, sf):
    """The call log as JSONL files, streamed into a table; every batch reaches the sink twice, as after a failure."""
    lines = [part.select(F.to_json(F.struct("ts", "tool", "source", "sid", "tag", "args", "dur_ms", "exit", "out_bytes", "out_tokens", "summary")).alias("value")) for part in slices(call_log(spark, sf), "ord")]

    def twice(folder: str):
        put = X.append_batch(folder)

        def sink(rows, number):
            put(rows, number)
            put(rows, number)

        return sink

    return X.replay(lines, lambda s: parse_log(s.withColumn("ord", F.lit(None).cast("long"))), "st6", twice)


@query("st6_stream_tool_stats", log_queries.ORACLES["a1_tool_stats"])
def _(spark, sf):
    return calllog.tool_stats(logged(spark, sf))


@query("st6_stream_adoption", log_queries.ORACLES["a5_adoption"])
def _(spark, sf):
    return calllog.adoption(logged(spark, sf))
