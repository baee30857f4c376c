"""The driver's tables as the operators' inputs: events as a call log, conversations as transcripts, documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that take turns over documents, so that every scope rule has files.
ENDINGS = (".php", ".ts", ".ini", ".html", ".go", ".txt")
MODELS = ("alpha-large", "alpha-large-2024", "beta", "gamma-small", "unlisted")
#: Dollars for a million input and output tokens.
RATES = (("alpha-large", 5.0, 25.0), ("beta", 3.0, 15.0), ("gamma-small", 1.0, 5.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 from events. Every eleventh row has no source and every thirteenth a person's; every seventeenth has a time that can't be read."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.concat(F.lit('{"inputs":["'), F.col("event_type"), F.lit('","k'), (k % 10).cast("string"), F.lit('",7],"tok_raw":'), (k * 3).cast("string"), F.lit(',"dedup":'), (F.col("event_id") % 5 == 0).cast("string"), F.lit("}"))
    return e.select(
        F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, "bogus").otherwise(at).alias("ts"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "manual").otherwise("agent").alias("source"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sid"), F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("tag"), (F.col("user_id") % 7).cast("string"))).alias("tag"), F.array(F.concat(F.lit("k"), k.cast("string")), F.col("event_type")).alias("args"),
        F.lit("").alias("fp"), (F.col("value") * 100).cast("long").alias("dur_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("exit"), F.lit("").alias("err"), (k * 4).alias("out_bytes"), k.alias("out_tokens"), F.parse_json(text).alias("summary"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (path, ext, content) from documents: source/lang/id with an ending."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("ext"), F.col("text").alias("content"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as (path, line_no, role, text)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line_no"), "role", "text", "conv_id")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES), "model string, input double, output double")
