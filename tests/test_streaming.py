import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import calllog
from tracewright.sources import shared
from tracewright.sources.files import parse_log
from tracewright.streaming import log_stream as X


def appended(rows, seconds):
    """(stub, n, tok) by ord: a session's rows in the order of ord, each against the latest of its fingerprint."""
    out, count, latest = {}, {}, {}
    for sid, fp, ts, tok, force, place in sorted(rows, key=lambda r: r[5]):
        count[sid] = count.get(sid, 0) + 1
        held = latest.get((sid, fp))
        stub = held is not None and not force and 0 <= ts - held[2] < seconds
        n, t = held[:2] if stub else (count[sid], tok)
        latest[sid, fp] = (n, t, ts)
        out[place] = (stub, n, t)
    return out


def some_calls(seed, n):
    rng = random.Random(seed)
    # a clock that runs ahead at times, forced calls, a null session
    return [(rng.choice(["s0", "s1", None]), f"f{rng.randrange(3)}", 45 * k + rng.choice([0, 0, 0, 400, -90]), rng.randrange(50), rng.random() < 0.1, k) for k in range(n)]


def test_repeats_as_a_stream_equal_the_table(spark):
    rows = some_calls(5, 120)
    df = spark.createDataFrame(rows, X.CALLS)
    want = appended(rows, 180)
    got = {r.ord: (r.stub, r.n, r.tok) for r in X.replay([df.where("ord < 50"), df.where("ord >= 50")], X.stream_repeats, "repeats").collect()}
    assert got == want
    assert {r.ord: (r.stub, r.n, r.tok) for r in calllog.repeat_calls(df, 180, ("ord",)).collect()} == want
    assert sum(s for s, _, _ in want.values()) > 10


@pytest.mark.parametrize(("pause", "second"), [(0, (True, 1, 7)), (1.5, (False, 1, 9))])
def test_state_goes_by_its_own_age(spark, pause, second):
    """The second call is a stub of the first while state is kept, and the first of a new session's count once it has gone."""
    rows = [("s", "f", 100, 7, False, 0), ("s", "f", 101, 9, False, 1)]
    df = spark.createDataFrame(rows, X.CALLS)
    out = X.replay([df.where("ord = 0"), df.where("ord = 1")], lambda s: X.stream_repeats(s, 180, 600 if not pause else 1), "expiry", between=lambda: time.sleep(pause))
    assert {r.ord: (r.stub, r.n, r.tok) for r in out.collect()} == {0: (False, 1, 7), 1: second}


def test_no_window_no_repeats(spark):
    df = spark.createDataFrame([("s", "f", 1, 7, False, 0), ("s", "f", 1, 7, False, 1)], X.CALLS)
    assert not any(r.stub for r in X.replay([df], lambda s: X.stream_repeats(s, 0), "off").collect())


def test_first_touches_by_the_rows_own_time(spark):
    at = lambda hours: datetime(2026, 1, 1) + timedelta(hours=hours)
    rows = [("a", "x", at(0), 0), ("a", "x", at(47), 1), ("b", "x", at(1), 2), ("a", "y", None, 3), ("a", "x", at(48), 4), ("a", "x", at(95), 5), ("a", "x", at(96), 6), ("c", "z", at(200), 7), ("b", "x", at(201), 8), ("late", "x", at(2), 9)]
    df = spark.createDataFrame(rows, "sid string, path string, at timestamp, ord long")
    cuts = [(0, 4), (4, 7), (7, 8), (8, 10)]
    got = X.replay([df.where(f"ord >= {a} AND ord < {b}") for a, b in cuts], lambda s: X.stream_first_touches(s, "path", "at"), "touches").collect()
    # b's touch is long past; the row of the session `late` comes when the watermark has passed its time
    assert sorted(r.ord for r in got) == [0, 2, 4, 6, 7, 8]


def test_a_batch_that_comes_again_replaces_its_rows(spark, tmp_path):
    """The stream stops after its sink was written and before the batch was noted as done, and starts again."""
    lines = [spark.createDataFrame([(json.dumps({"tool": t, "tag": "t", "exit": k, "out_tokens": 5, "dur_ms": 10}),) for k, t in enumerate("xy")], "value string") for _ in range(2)]
    build = lambda s: parse_log(s.withColumn("ord", F.lit(None).cast("long")))
    folders = []

    def sink(folder):
        folders.append(folder)
        return X.append_batch(folder)

    log = X.replay(lines, build, "again", sink)
    assert log.count() == 4
    base = folders[0].removesuffix("/out").removeprefix("file:")
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{base}/state/commits/{name}"):
            os.remove(f"{base}/state/commits/{name}")
    out = build(spark.readStream.format("text").load(f"{base}/in"))
    out.writeStream.option("checkpointLocation", f"{base}/state").trigger(once=True).foreachBatch(X.append_batch(f"{base}/out")).start().awaitTermination()
    assert sorted(os.listdir(f"{base}/state/commits"))[-1] == "1"
    again = spark.read.schema(out.schema).parquet(f"{base}/out")
    assert again.count() == 4
    assert [(r.tool, r.calls, r.errors) for r in calllog.tool_stats(again).collect()] == [("x", 2, 0), ("y", 2, 2)]


def test_counts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"tool":"x","tag":"t","exit":1,"out_tokens":5}\nbroken\n{"tool":"y","tag":"t","out_tokens":7}\n')
    q = X.stream_counts(X.stream_log(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.tag, r.source, r.calls, r.errors, r.out_tokens) for r in spark.table("counts").collect()] == [("t", "agent", 2, 1, 12)]


def test_only_a_local_master_may_name_no_folder(monkeypatch):
    class Session:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_path(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert shared.shared_path(Session, "x").startswith("/tmp/checkpoints/app/x-")
