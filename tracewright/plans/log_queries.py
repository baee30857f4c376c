"""Queries of the call-log operators over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import calllog as L
from tracewright.sources.stand_ins import call_log, table

NOW = "2024-01-20 12:00:00"
SINCE = "2024-01-15 00:00:00"
DEDUP_SECONDS = 86_400

LOG = """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events),
log AS (SELECT event_id AS ord, CASE WHEN event_id % 17 = 0 THEN 'bogus' ELSE iso END AS ts, event_type AS tool,
 CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'manual' ELSE 'agent' END AS source, 's' || user_id AS sid,
 CASE WHEN user_id % 7 = 0 THEN '' ELSE 'tag' || (user_id % 7) END AS tag, k, CAST(trunc(value * 100) AS BIGINT) AS dur_ms,
 CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS exit, k * 4 AS out_bytes, k AS out_tokens, event_id % 5 = 0 AS stub,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t FROM e)
"""
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


STATS = """, r AS (SELECT tool, dur_ms, row_number() OVER (PARTITION BY tool ORDER BY dur_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM {log})
SELECT l.*, p.p50_ms, p.p95_ms FROM (SELECT tool, count(*) AS calls, CAST(sum(exit) AS BIGINT) AS errors, CAST(sum(dur_ms) AS BIGINT) AS total_ms, CAST(sum(dur_ms) AS BIGINT) // count(*) AS mean_ms, greatest(max(dur_ms), 0) AS max_ms,
 CAST(sum(out_bytes) AS BIGINT) AS total_out_bytes, CAST(sum(out_tokens) AS BIGINT) AS total_out_tokens, min(ts) AS first, max(ts) AS last FROM {log} GROUP BY tool) l
JOIN (SELECT tool, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN dur_ms END) AS p50_ms, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN dur_ms END) AS p95_ms FROM r GROUP BY tool) p USING (tool)"""


@query("a1_tool_stats", LOG + STATS.format(log="log"))
def _(spark, sf):
    return L.tool_stats(call_log(spark, sf))


@query("f1_f4_filtered_stats", LOG + f", f AS (SELECT * FROM log WHERE starts_with(tool, 'p') AND (CASE WHEN source = '' THEN 'agent' ELSE source END) = 'agent' AND starts_with(sid, 's1') AND t >= TIMESTAMP '{SINCE}')" + STATS.format(log="f"))
def _(spark, sf):
    return L.tool_stats(L.filtered(call_log(spark, sf), tool="p", source="agent", session="s1", since=F.lit(SINCE).cast("timestamp")))


@query("f3_failed_recent", LOG + "SELECT ord, ts, tool, sid, exit FROM log WHERE exit <> 0 AND tag = 'tag3' ORDER BY ord DESC LIMIT 20")
def _(spark, sf):
    return L.recent(L.filtered(call_log(spark, sf), tag="tag3", failed=True)).select("ord", "ts", "tool", "sid", "exit")


@query("a2_percentile_lineitem", """WITH r AS (SELECT l_suppkey, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY trunc(l_extendedprice * 100)) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN v END) AS p50, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN v END) AS p95 FROM r GROUP BY l_suppkey""")
def _(spark, sf):
    return L.percentiles(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * 100).cast("long").alias("v")), "l_suppkey", "v", (50, 95))


@query("a3_top_inputs", LOG + "SELECT tool, input, count(*) AS count FROM (SELECT tool, unnest([tool, 'k' || (k % 10)]) AS input FROM log) GROUP BY ALL ORDER BY count DESC, tool, input LIMIT 12")
def _(spark, sf):
    return L.top_inputs(call_log(spark, sf), 12)


HISTOGRAM = "SELECT {key} AS bucket, count(*) AS count, CAST(sum(dur_ms) AS BIGINT) AS total_ms, CAST(sum(out_bytes) AS BIGINT) AS total_out_bytes, CAST(sum(out_tokens) AS BIGINT) AS total_out_tokens FROM log WHERE t IS NOT NULL GROUP BY 1"


@query("a4_histogram_hour", LOG + HISTOGRAM.format(key="substr(ts, 12, 2)"))
def _(spark, sf):
    return L.histogram(call_log(spark, sf), S.parse_bucket("H"))


@query("a4_histogram_day", LOG + HISTOGRAM.format(key="substr(ts, 1, 10)"))
def _(spark, sf):
    return L.histogram(call_log(spark, sf), S.parse_bucket("day"))


@query("a5_adoption", LOG + "SELECT CASE WHEN tag = '' THEN '?' ELSE tag END AS tag, CASE WHEN source = '' THEN 'agent' ELSE source END AS source, count(*) AS calls, count(DISTINCT sid) AS sessions, CAST(sum(exit) AS BIGINT) AS errors, sum(exit) * 100.0 / count(*) AS failed_pct, CAST(sum(out_tokens) AS BIGINT) AS out_tokens FROM log GROUP BY 1, 2")
def _(spark, sf):
    return L.adoption(call_log(spark, sf))


QUOTA = f", q AS (SELECT *, greatest(k * 3 - out_tokens, 0) AS saved FROM log WHERE source = 'agent' AND t BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}')"


@query("a17_quota", LOG + QUOTA + "SELECT count(*) AS calls, count(k) AS with_baseline, count(*) FILTER (stub) AS dedup_stubs, CAST(sum(out_tokens) AS BIGINT) AS emitted, CAST(sum(k * 3) AS BIGINT) AS baseline, CAST(sum(saved) AS BIGINT) AS saved, sum(saved) * 100.0 / sum(k * 3) AS pct FROM q")
def _(spark, sf):
    return L.quota(call_log(spark, sf), F.lit(NOW).cast("timestamp"), 7)


@query("w1_busiest_window", LOG + QUOTA + """, p AS (SELECT t, sum(saved) AS saved FROM q GROUP BY t),
w AS (SELECT t, sum(saved) OVER o AS total, min(t) OVER o AS f FROM p WINDOW o AS (ORDER BY t RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW))
SELECT f AS "start", t AS "end", CAST(total AS BIGINT) AS saved FROM w ORDER BY total DESC, t LIMIT 1""")
def _(spark, sf):
    return L.busiest_window(L.savings(L.in_quota(call_log(spark, sf), F.lit(NOW).cast("timestamp"), 7)).select("at", "saved")).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "saved")


def calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("sid"), F.col("event_type").alias("fp"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("tok"), (F.col("event_id") % 50 == 0).alias("force"), F.col("event_id").alias("ord"))


@query("w2_repeat_calls", f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS sid, event_type AS fp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, CAST(json_extract(props, '$.k') AS BIGINT) AS tok, event_id % 50 = 0 AS force, event_id AS ord FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, ord) AS seq, lag(ts) OVER (PARTITION BY sid, fp ORDER BY ts, ord) AS p FROM c),
i AS (SELECT *, p IS NULL OR ts - p >= {DEDUP_SECONDS} OR force AS fresh, sum(CASE WHEN p IS NULL OR ts - p >= {DEDUP_SECONDS} OR force THEN 1 ELSE 0 END) OVER (PARTITION BY sid, fp ORDER BY ts, ord) AS island FROM s)
SELECT sid, fp, ts, ord, NOT fresh AS stub, first_value(seq) OVER w AS n, first_value(tok) OVER w AS tok FROM i WINDOW w AS (PARTITION BY sid, fp, island ORDER BY ts, ord)""")
def _(spark, sf):
    return L.repeat_calls(calls(spark, sf), DEDUP_SECONDS)


@query("w5_recent", LOG + "SELECT ord, ts, tool, dur_ms, exit, out_bytes, out_tokens FROM log ORDER BY ord DESC LIMIT 20")
def _(spark, sf):
    return L.recent(call_log(spark, sf)).select("ord", "ts", "tool", "dur_ms", "exit", "out_bytes", "out_tokens")


@query("j9_first_touches", "SELECT CAST(user_id AS VARCHAR) AS sid, event_type AS fp, min(event_id) AS ord FROM events GROUP BY 1, 2")
def _(spark, sf):
    return L.first_touches(calls(spark, sf), "fp").select("sid", "fp", "ord")


@query("n4_fingerprint", LOG + "SELECT ord, left(sha256(least('k' || k, tool) || chr(31) || greatest('k' || k, tool)), 16) AS fp FROM log")
def _(spark, sf):
    return call_log(spark, sf).select("ord", S.fingerprint(F.col("args")).alias("fp"))


@query("a25_feedback", LOG + f"SELECT count(*) AS notes FROM log WHERE tool = 'error' AND source <> 'manual' AND t >= TIMESTAMP '{SINCE}'")
def _(spark, sf):
    return L.feedback_since(call_log(spark, sf).withColumn("tool", F.when(F.col("tool") == "error", "gripe").otherwise(F.col("tool"))), F.lit(SINCE).cast("timestamp"))


@query("d23_feedback", LOG + "SELECT ord, strftime(t, '%Y-%m-%d %H:%M') AS \"when\", CASE WHEN tag = '' THEN '?' ELSE tag END AS project, CASE WHEN source = '' THEN 'agent' ELSE source END AS source, 'k' || k || ' error' AS note FROM log WHERE tool = 'error' ORDER BY ord DESC LIMIT 20")
def _(spark, sf):
    return L.feedback(call_log(spark, sf).withColumn("tool", F.when(F.col("tool") == "error", "gripe").otherwise(F.col("tool"))))


@query("sk9_formats", LOG + """SELECT ord, CASE WHEN dur_ms < 1000 THEN dur_ms || 'ms' ELSE printf('%d.%02ds', (dur_ms + 5) // 1000, (dur_ms + 5) // 10 % 100) END AS ms, CASE WHEN out_bytes < 1024 THEN out_bytes || 'B' WHEN out_bytes < 1048576 THEN printf('%.1fKB', out_bytes / 1024.0) ELSE printf('%.1fMB', out_bytes / 1048576.0) END AS size,
CASE WHEN dur_ms >= 1000 THEN ((dur_ms + 500) // 1000) || 'K' ELSE CAST(dur_ms AS VARCHAR) END AS k, CASE WHEN dur_ms <= 0 THEN '0s' WHEN dur_ms < 60 THEN dur_ms || 's' WHEN dur_ms < 3600 THEN (dur_ms // 60) || 'm' ELSE (dur_ms // 3600) || 'h' || (dur_ms // 60 % 60) || 'm' END AS span,
CASE WHEN dur_ms < 60 THEN dur_ms || 's' ELSE ((dur_ms + 30) // 60) || 'm' END AS age FROM log WHERE dur_ms >= 0""")
def _(spark, sf):
    d = F.col("dur_ms")
    return call_log(spark, sf).where("dur_ms >= 0").select("ord", S.format_ms(d).alias("ms"), S.format_bytes(F.col("out_bytes")).alias("size"), S.format_k(d).alias("k"), S.format_duration(d).alias("span"), S.format_age(d).alias("age"))
