"""Helpers shared by the corpus operators: shared-folder tables, bounded Arrow batches, hashed words."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go if a local session names no checkpoint folder.
LOCAL_FOLDER = "/tmp/checkpoints"
#: Bits of the filters that spare shuffles of rows that meet nothing; a false hit costs a row in a join, nothing else.
BITS = 1 << 26


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; any other columns, whatever their names, stay out of the plan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local master may name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def stash(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives a lost executor.

    All tables of an application are in a folder of its id, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """docs as a table with a number for each row, _row, that stays the same however often it is read."""
    return stash(docs.withColumn("_row", F.monotonically_increasing_id()), label)


def bounded_batches(spark: SparkSession, rows: int = 512, mb: int = 8) -> None:
    """Arrow batches of so many rows and bytes at most, so that a run of long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def plain(texts: pa.Array) -> pa.Array:
    """Texts as large strings, null as empty. A slice is copied: some string kernels misread the bytes of one."""
    if texts.offset:
        texts = pa.array(texts.to_pylist(), texts.type)
    return pc.fill_null(texts.cast(pa.large_string()), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashed_words(texts: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text as 64-bit hashes: (offsets, hashes). A null text has none.

    Words are lower-cased runs of letters and digits; with marks, the case stays and runs of other
    characters than white space are words, too. Each distinct word of the batch is hashed once.
    """
    import xxhash

    if marks:
        apart = pc.replace_substring_regex(plain(texts), r"([^\p{L}\p{N}\s]+)", r" \1 ")
        spaced = pc.replace_substring_regex(apart, r"[\s\p{Z}]+", " ")
    else:
        spaced = pc.replace_substring_regex(pc.utf8_lower(plain(texts)), r"[^\p{L}\p{N}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    if len(coded) == 0:
        return offsets - offsets[0], np.empty(0, np.uint64)
    table = np.fromiter((xxhash.xxh64_intdigest(w, 0) if w else 0 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = table[np.asarray(coded.indices)]
    empty = hashes == 0  # a text without words splits into one empty string
    if empty.any():
        kept = np.concatenate(([0], np.cumsum(~empty)))
        offsets = kept[offsets - offsets[0]]
        hashes = hashes[~empty]
    else:
        offsets = offsets - offsets[0]
    return offsets, hashes


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n consecutive words over the flat array; runs that span two texts are the caller's to drop."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def bits_of(rows: DataFrame, column: str) -> np.ndarray:
    """A filter of BITS bits of a column's values, whatever their number."""
    slot = F.pmod(F.col(column), F.lit(BITS))
    parts = rows.groupBy(F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect()
    bits = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts:
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def in_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) % BITS
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def hex16(column: str):
    """A signed long as 16 lower-case hex digits of its two's complement."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
