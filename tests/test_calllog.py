import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import calllog as L
from tracewright.sources.files import parse_log

LOG = "ord long, ts string, tool string, source string, sid string, tag string, args array<string>, dur_ms long, exit long, out_bytes long, out_tokens long, summary string"


def log(spark, rows):
    base = {"ord": 0, "ts": "2026-01-01T00:00:00Z", "tool": "a", "source": "agent", "sid": "s", "tag": "", "args": [], "dur_ms": 0, "exit": 0, "out_bytes": 0, "out_tokens": 0, "summary": "{}"}
    full = [tuple({**base, "ord": k, **r}.values()) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, LOG).withColumn("summary", F.parse_json("summary"))


def test_recent_is_append_order_reversed(spark):
    df = log(spark, [{"tool": t, "ts": f"2026-01-0{9 - k}T00:00:00Z"} for k, t in enumerate("abcd")])
    assert [r.tool for r in L.recent(df, 0).collect()] == list("dcba")
    assert [r.tool for r in L.recent(df, 2).collect()] == list("dc")


def test_filters(spark):
    df = log(spark, [{"sid": "abc123", "exit": 0}, {"sid": "abc999", "exit": 1, "tag": "app2"}, {"sid": "def456", "source": ""}, {"sid": None, "exit": 2, "ts": "2026-05-21"}])
    assert L.filtered(df, session="abc").count() == 2
    assert L.filtered(df, tag="app2").count() == 1
    assert L.filtered(df, failed=True).count() == 2
    assert L.filtered(df, source="agent").count() == 4
    # a time that can't be read goes only if a first time is given; the first time itself stays
    assert L.filtered(df, since=F.lit("2026-01-01").cast("timestamp")).count() == 3
    assert L.filtered(df).count() == 4


@pytest.mark.parametrize(("values", "p", "want"), [([10], 50, 10), ([10, 20], 50, 20), ([1, 2, 3, 4, 5], 50, 3), ([1, 2, 3, 4, 5], 95, 5), (list(range(1, 21)), 95, 20), ([7, 7, 7, 9], 50, 7)])
def test_percentile(spark, values, p, want):
    df = log(spark, [{"dur_ms": v} for v in values])
    assert L.percentiles(df, "tool", "dur_ms", (p,)).first()[f"p{p}"] == want


def test_tool_stats(spark):
    rows = [{"dur_ms": 100, "out_bytes": 1000, "out_tokens": 250, "ts": "2026-01-01T00:00:00Z", "summary": '{"inputs":["FOO"]}'}, {"dur_ms": 200, "out_bytes": 2000, "out_tokens": 500, "ts": "2026-01-02T00:00:00Z", "summary": '{"inputs":["FOO","BAR",3]}'}, {"dur_ms": 301, "exit": 1, "ts": "2026-01-03T00:00:00Z"}, {"tool": "b", "dur_ms": 50}]
    a = L.tool_stats(log(spark, rows)).first()
    assert (a.tool, a.calls, a.errors, a.total_ms, a.mean_ms, a.max_ms, a.total_out_bytes, a.total_out_tokens, a.first[:10], a.last[:10]) == ("a", 3, 1, 601, 200, 301, 3000, 750, "2026-01-01", "2026-01-03")
    top = L.top_inputs(log(spark, rows)).collect()
    assert [(r.tool, r.input, r["count"]) for r in top] == [("a", "FOO", 2), ("a", "BAR", 1)]


def test_histograms_use_the_rows_own_clock(spark):
    df = log(spark, [{"ts": "2026-05-20T23:00:00+02:00", "dur_ms": 100}, {"ts": "2026-05-21T03:15:00Z", "dur_ms": 200}, {"ts": "bogus"}, {"ts": "2026-05-21"}])
    assert [(r.bucket, r["count"], r.total_ms) for r in L.histogram(df, "hour").collect()] == [("03", 1, 200), ("23", 1, 100)]
    assert [(r.bucket, r["count"]) for r in L.histogram(df, "day").collect()] == [("2026-05-20", 1), ("2026-05-21", 1)]


def test_adoption(spark):
    rows = [{"tag": "app1", "sid": "s1", "out_tokens": 100}, {"tag": "app1", "sid": "s1", "out_tokens": 50, "exit": 1}, {"tag": "app1", "sid": "s2", "out_tokens": 30}, {"tag": "app1", "source": "manual"}, {"tag": "", "source": ""}]
    got = L.adoption(log(spark, rows)).collect()
    assert (got[0].calls, got[0].sessions, got[0].errors, round(got[0].failed_pct, 1), got[0].out_tokens) == (3, 2, 1, 33.3, 180)
    assert ("?", "agent") in {(r.tag, r.source) for r in got}


def test_quota(spark):
    rows = [
        {"out_tokens": 100, "summary": '{"tok_raw":500}'}, {"out_tokens": 50, "summary": '{"tok_raw":10}'}, {"out_tokens": 5, "summary": '{"tok_rep":300,"dedup":true}'}, {"out_tokens": 80},
        {"source": "manual", "summary": '{"tok_raw":9999}'}, {"source": "", "summary": '{"tok_raw":9999}'}, {"out_tokens": 1, "summary": '{"tok_raw":"77"}', "ts": "2025-01-01T00:00:00Z"},
    ]
    q = L.quota(log(spark, [{"ts": "2026-07-04T00:00:00Z", **r} for r in rows]), F.lit("2026-07-06 12:00:00").cast("timestamp")).first()
    assert (q.calls, q.with_baseline, q.dedup_stubs, q.emitted, q.baseline, q.saved) == (4, 3, 1, 155, 810, 695)
    assert q.pct == pytest.approx(100 * 695 / 810)


def test_busiest_window(spark):
    at = lambda h: datetime(2026, 7, 6, h)
    points = lambda rows: spark.createDataFrame(rows, "at timestamp, saved long")
    best = L.busiest_window(points([(at(2), 10), (at(4), 15), (at(8), 20), (at(11), 40)])).first()
    assert (best.start.hour, best.saved) == (8, 60)
    assert L.busiest_window(points([(at(2), 0), (at(3), None)])).count() == 0
    assert L.busiest_window(points([])).count() == 0


def test_busiest_window_against_brute_force(spark):
    rng = random.Random(1)
    base = datetime(2026, 1, 1)
    rows = [(base + timedelta(minutes=rng.randrange(60 * 24 * 9)), rng.randrange(20)) for _ in range(300)]
    got = L.busiest_window(spark.createDataFrame(rows, "at timestamp, saved long"), chunk=3).first()
    totals = {end: sum(s for t, s in rows if end - timedelta(hours=5) <= t <= end) for end, _ in rows}
    best = min(totals, key=lambda e: (-totals[e], e))
    assert (got.end, got.saved) == (best, totals[best])


def test_busiest_window_runs_along_its_instants(spark):
    """The start, too, by brute force, with ends of windows that meet; and no frame that is added up anew for each row."""
    rng = random.Random(3)
    base = datetime(2026, 1, 1)
    for seconds, chunk in ((5, 1), (7, 2), (60, 16)):
        rows = [(base + timedelta(seconds=rng.randrange(400)), rng.randrange(-2, 9)) for _ in range(150)]
        df = L.busiest_window(spark.createDataFrame(rows, "at timestamp, saved long"), seconds, chunk)
        got = df.first()
        held = {end: [(t, s) for t, s in rows if end - timedelta(seconds=seconds) <= t <= end] for end, _ in rows}
        best = min(held, key=lambda e: (-sum(s for _, s in held[e]), e))
        assert (got.start, got.end, got.saved) == (min(t for t, _ in held[best]), best, sum(s for _, s in held[best]))
        assert "RangeFrame" not in df._jdf.queryExecution().optimizedPlan().toString().replace("RangeFrame, unboundedpreceding", "")


def brute_repeats(rows, seconds):
    out, state, count = {}, {}, {}
    for sid, fp, ts, tok, force, o in sorted(rows, key=lambda r: (r[2], r[5])):
        count[sid] = count.get(sid, 0) + 1
        held = state.get((sid, fp))
        stub = bool(held and not force and 0 <= ts - held[2] < seconds)
        n, t = (held[0], held[1]) if stub else (count[sid], tok)
        state[sid, fp] = (n, t, ts)
        out[o] = (stub, n, t)
    return out


@pytest.mark.parametrize("seconds", [0, 180])
def test_repeat_calls_against_brute_force(spark, seconds):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(3)}", f"f{rng.randrange(3)}", 60 * rng.randrange(60), rng.randrange(100), rng.random() < 0.1, k) for k in range(200)]
    got = {r.ord: (r.stub, r.n, r.tok) for r in L.repeat_calls(spark.createDataFrame(rows, "sid string, fp string, ts long, tok long, force boolean, ord long"), seconds).collect()}
    assert got == brute_repeats(rows, seconds)


def test_parse_log_skips_bad_lines(spark):
    lines = spark.createDataFrame([(0, '{"tool":"a","ts":"t","dur_ms":5,"args":["x"],"extra":1}'), (1, "not json"), (2, "[1]"), (3, '{"tool":"b","dur_ms":"7"}'), (4, "")], "ord long, value string")
    got = parse_log(lines).orderBy("ord").collect()
    assert [(r.tool, r.dur_ms, r.args) for r in got] == [("a", 5, ["x"]), ("b", 0, None)]


@pytest.mark.parametrize(("text", "seconds"), [("30m", 1800), ("1h", 3600), ("24h", 86400), ("7d", 604800), ("1h30m", 5400), ("1.5h", 5400), ("500ms", 0.5), ("-2d", -172800)])
def test_parse_since(text, seconds):
    assert S.parse_since(text).total_seconds() == seconds


@pytest.mark.parametrize("text", ["", "abc", "3w", "5"])
def test_parse_since_refuses(text):
    with pytest.raises(ValueError):
        S.parse_since(text)
