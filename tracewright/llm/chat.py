"""Chat formatting: each dialogue from every participant's side, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm._common import read, stash

START, END = "<|im_start|>", "<|im_end|>"
#: What the two marks become inside a message, so that a text can't open or close a turn.
INNER_START, INNER_END = "<im_start>", "<im_end>"
#: The role that stays itself from every side.
SYSTEM = "system"


def rotated(turns: DataFrame) -> DataFrame:
    """One row for each turn and participant of its dialogue: the turn as that participant's side sees it.

    Columns: conv_id, perspective, position (from 0), turn, speaker, role, name, segment, start, length,
    mask_start, mask_length. The segments of a conv_id and perspective in order of position, joined, are
    the rendered dialogue; start is a segment's first character there and length its characters. The
    perspective's own turns have role assistant and are to be learnt: mask_start and mask_length cover
    text and end mark. Other speakers are named users and system turns stay; their mask_length is zero.

    Speakers are the distinct roles of a dialogue but system; a dialogue with none has no rows, and a
    null role is a user without a name and no perspective. Turns go by number (null first), then
    role, then text; repeated turns all stay. A null or empty text is an empty message. Rows without
    a conv_id form one dialogue. Rows are dealt by range of (conv_id, turn), so a dialogue of any length
    spreads over tasks; offsets add up the ranges before, one row for each range of a dialogue.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = F.replace(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(START), F.lit(INNER_START)), F.lit(END), F.lit(INNER_END))
    lean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("speaker"), clean.alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "speaker", "text", "row"]
    ranged = lean.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = stash(ranged.drop("row"), "chat-turns")
    lean = ranged.select("part", "at", "conv_id", "speaker", F.length("text").cast("long").alias("chars"))
    sides = lean.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).agg(F.lit(1).alias("one")).drop("one")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    system = F.coalesce(F.col("speaker") == SYSTEM, F.lit(False))
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, F.col("speaker"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    # offsets come from lengths alone; no text is carried through the windows
    seen = lean.join(sides, F.col("conv_id").eqNullSafe(F.col("conv"))).withColumn("head", F.length(head)).withColumn("length", F.col("head") + F.col("chars") + len(END + "\n"))
    seen = seen.select("part", "at", "conv_id", "perspective", "head", "length")
    key = ["part", "conv_id", "perspective"]
    along = W.partitionBy(*key).orderBy("at")
    totals = seen.groupBy(*key).agg(F.sum("length").alias("chars"), F.count("*").alias("rows"))
    before = W.partitionBy("conv_id", "perspective").orderBy("part")
    base = totals.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.col("perspective").alias("s"), (F.sum("chars").over(before) - F.col("chars")).alias("chars"), (F.sum("rows").over(before) - F.col("rows")).alias("rows"))
    inner = seen.withColumn("run", F.sum("length").over(along) - F.col("length")).withColumn("k", F.row_number().over(along) - 1)
    placed = inner.join(base, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("s")))
    placed = placed.select("at", "perspective", "head", "length", (F.col("chars") + F.col("run")).alias("start"), (F.col("rows") + F.col("k")).cast("long").alias("position"))
    whole = placed.join(ranged.drop("part"), "at")
    return whole.select(
        "conv_id", "perspective", "position", "turn", "speaker", role.alias("role"), name.alias("name"), F.concat(head, "text", F.lit(END + "\n")).alias("segment"), "start", "length",
        F.when(own, F.col("start") + F.col("head")).otherwise(F.col("start")).alias("mask_start"), F.when(own, F.col("length") - F.col("head") - 1).otherwise(F.lit(0)).cast("long").alias("mask_length"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rotated() of the whole conversations table; nulls, empty texts, repeated rows and an empty table as there."""
    return rotated(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, role AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text
  FROM conversations
), sides AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), seen AS (
  SELECT t.*, perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name
  FROM t JOIN sides USING (conv_id)
), made AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen
), whole AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM made
), placed AS (
  SELECT *, CAST(length(segment) AS BIGINT) AS length,
         row_number() OVER w - 1 AS position,
         CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS start
  FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, speaker, role, name, segment, start, length,
       CASE WHEN role = 'assistant' THEN start + length(head) ELSE start END AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN length - length(head) - 1 ELSE 0 END AS BIGINT) AS mask_length
FROM placed
"""
