"""The call log as a stream (ST1-ST4, ST6): running views, first touches and repeat calls with native state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewright.operators import calllog
from tracewright.sources.files import parse_log
from tracewright.sources.shared import shared_path

#: How long state of an idle session is kept.
STATE_SECONDS = 48 * 3600
CALLS = "sid string, fp string, ts bigint, tok bigint, force boolean, ord bigint"
REPEATS = "sid string, fp string, ts bigint, ord bigint, stub boolean, n bigint, tok bigint"
TOUCHES = "sid string, key string, at timestamp, ord bigint"
#: The store that keeps maps and expiring entries as rows of their own.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def native_state(spark: SparkSession):
    """Queries started inside keep their state in the store that transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_log(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """ST6: rows of the JSONL files that appear in a folder, read as calllog rows."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(folder)
    return parse_log(lines.withColumn("ord", F.lit(None).cast("long")))


def stream_counts(log: DataFrame) -> DataFrame:
    """ST6, A5: running calls, failures and output by tag and source, for complete or update mode."""
    tag = F.coalesce(F.nullif("tag", F.lit("")), F.lit("?"))
    return log.groupBy(tag.alias("tag"), calllog.source_of(F.col("source")).alias("source")).agg(F.count("*").alias("calls"), F.count_if(F.col("exit") != 0).alias("errors"), F.sum("out_tokens").alias("out_tokens"))


def _repeats(seconds: int, keep: int) -> StatefulProcessor:
    # made in a function, so that it travels whole to workers that can't import this module

    class Repeats(StatefulProcessor):
        """A session: how many rows it has had, and for each fingerprint the n, tok and time of its latest row."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rows = handle.getValueState("rows", "count bigint", keep)
            self.held = handle.getMapState("held", "fp string", "n bigint, tok bigint, ts bigint", keep)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the names that Spark calls
            before = self.rows.get()  # each call of the state is a message; absent state is None
            count = before[0] if before else 0
            known: dict[str, tuple | None] = {}
            for r in sorted(rows, key=lambda r: r["ord"]):
                count += 1
                fp = r["fp"]
                if fp not in known:  # each fingerprint of a batch is read and written once
                    known[fp] = self.held.getValue((fp,))
                held = known[fp]
                stub = held is not None and not r["force"] and 0 <= r["ts"] - held[2] < seconds
                n, tok = held[:2] if stub else (count, r["tok"])
                known[fp] = (n, tok, r["ts"])
                yield Row(sid=key[0], fp=fp, ts=r["ts"], ord=r["ord"], stub=stub, n=n, tok=tok)
            self.rows.update((count,))
            for fp, value in known.items():
                self.held.updateValue((fp,), value)

        def close(self) -> None:
            pass

    return Repeats()


def stream_repeats(calls: DataFrame, seconds: int = calllog.REPEAT_SECONDS, keep: float = STATE_SECONDS) -> DataFrame:
    """ST1, ST2, ST4: calls (CALLS) in the order of ord with stub, n and original tok, as repeat_calls(order=("ord",)) has them for a table.

    A row is a stub if the latest row of its session and fingerprint is less than `seconds` old; one from before that row
    (a clock ahead) or a forced one is an original. A stub renews the time. Each fingerprint is an entry of native map state
    that goes when it has had no row for `keep` seconds of the engine's clock; so does a session's count of rows, which then
    starts again. Rows must come in order of ord over batches; null sessions and fingerprints are values like others.
    """
    return calls.groupBy("sid").transformWithState(_repeats(seconds, round(keep * 1000)), REPEATS, "append", "processingTime")


def _touches(seconds: int) -> StatefulProcessor:
    class Touches(StatefulProcessor):
        """A session and key: the time of its latest first touch, which goes when the watermark has passed it by `seconds`."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.touched = handle.getValueState("touched", "ms bigint")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
            held = self.touched.get()[0] if self.touched.exists() else None
            before = held
            for r in sorted(rows, key=lambda r: (r["ms"], r["ord"])):
                if held is None or r["ms"] - held >= seconds * 1000:
                    held = r["ms"]
                    yield Row(sid=key[0], key=key[1], at=r["at"], ord=r["ord"])
            if held != before:
                if before is not None:
                    self.handle.deleteTimer(before + seconds * 1000)
                self.touched.update((held,))
                self.handle.registerTimer(held + seconds * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            self.touched.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Touches()


def stream_first_touches(calls: DataFrame, key: str, at: str, seconds: int = STATE_SECONDS) -> DataFrame:
    """ST3, ST4: the first row of each session and key, and the first one `seconds` or more after it, and so on (TOUCHES).

    Times are those of the rows. A row that comes when the watermark (`seconds` behind the latest row of earlier batches) has
    passed it is late and dropped; state goes once the watermark makes it useless. Rows without a time are left out.
    """
    rows = calls.select("sid", F.col(key).alias("key"), F.col(at).alias("at"), "ord", F.unix_millis(F.col(at)).alias("ms")).where("at IS NOT NULL").withWatermark("at", f"{seconds} seconds")
    return rows.groupBy("sid", "key").transformWithState(_touches(seconds), TOUCHES, "append", "eventTime")


def append_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """ST6: a sink for foreachBatch that holds each batch once: a batch that comes again replaces its own rows, by its number."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return put


def replay(slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], label: str, sink: Callable[[str], Callable] | None = None, between: Callable[[], None] | None = None) -> DataFrame:
    """The rows that a stream over slices has written to its sink.

    The slices are appended to a folder one after the other, and after each the stream, which goes on from its
    checkpoint, takes what is new and ends: every slice is a batch, whatever its number of files. Slices that are text (one column
    `value`) are text files, others Parquet. The sink is Spark's own file sink, or what sink(folder) gives for foreachBatch.
    between runs before the second and each later slice.
    """
    base, out = None, None
    for k, part in enumerate(slices):
        spark = part.sparkSession
        base = base or shared_path(spark, label)
        if k and between:
            between()
        text = part.columns == ["value"]
        (part.write.mode("append").text if text else part.write.mode("append").parquet)(f"{base}/in")
        source = spark.readStream.format("text").load(f"{base}/in") if text else spark.readStream.schema(part.schema).parquet(f"{base}/in")
        out = build(source)
        started = out.writeStream.option("checkpointLocation", f"{base}/state").trigger(once=True)  # state that expires by the clock would keep availableNow going without data
        with native_state(spark):
            started = started.foreachBatch(sink(f"{base}/out")).start() if sink else started.format("parquet").start(f"{base}/out")
            started.awaitTermination()
    if out is None:
        raise ValueError("a stream needs a slice at least")
    return spark.read.schema(out.schema).parquet(f"{base}/out")
