"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: The contracts' words: runs of anything but space and the five ASCII control spaces.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a read, not a recomputation. The
    folder goes when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidence_jobs/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, names: list[str] | None = None) -> Column:
    """The columns as one struct, by position, so that no name of theirs clashes with an operator's own."""
    names = df.columns if names is None else names
    return F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(names))) if names else F.struct(F.lit(True).alias("none"))


def unpacked(row: str, names: list[str]) -> list[Column]:
    """The columns of a struct made by packed()."""
    return [F.col(row).getField(f"c{i}").alias(c) for i, c in enumerate(names)]


def slices(batches, rows: int = 256):
    """Arrow batches in slices, so that what a task makes of one at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text: Column) -> Column:
    """Number of the contracts' words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that hashes made by sums are spread evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), 1
    for i in range(k):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
        total += words[i : i + n] * np.uint64(factor)
    return mixed(total)


def bit_table(hashes: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A one-hash Bloom filter of the long column, 2**bits bits, as 64-bit words.

    At most 2**(bits - 6) words come to the driver, whatever the input's size. When
    it fills up it passes more rows; what it passes is always a superset.
    """
    slot = F.col(column).bitwiseAND(F.lit(2**bits - 1))
    words = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).cast("int").alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    table = np.zeros(2 ** (bits - 6), dtype=np.int64)
    found = words.toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64).view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
