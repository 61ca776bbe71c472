"""Mixing sources to target weights by hash thresholds, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.llm.common import column, packed, saved, unpacked, word_count

#: Hash bits of a document, and of one histogram level.
HASH_BITS, LEVEL_BITS = 60, 12
#: A source gives at most so many times its own size.
MOST_TIMES = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with the target of each source.

    Sources weigh 1, 2, 3, repeating, in code point order with null last. A target
    stops at MOST_TIMES its source's size; what is left over is shared again by weight.
    That is a water level: target = min(cap, level * weight), where the level is found
    at the first source, by cap over weight, that its level does not overflow. The
    table has one row a source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_cap_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("_weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("_cap", MOST_TIMES * F.col("source_size"))
        .withColumn("_cap_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap), F.lit(0)))
        .withColumn("_weighed", F.coalesce(F.sum("_weight").over(by_cap), F.lit(0)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_capped")) / (F.sum("_weight").over(everything) - F.col("_weighed")))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_cap_ratio"), F.struct("_cap_ratio", "_level"))).over(everything)["_level"])
    )
    return ranked.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")).alias("target"))


def thresholds(rows: DataFrame) -> DataFrame:
    """For rows (source, size, hash): source, source_size, target, copies, below.

    A row is taken `copies` times, and once more if its hash is under `below`. The
    remaining budget of each source is looked up in a histogram of its hashes; only the
    bucket where the budget ends is split again, and in the end hash by hash.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = source_targets(sizes).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_TIMES))).otherwise(0).cast("int")
    )
    state = saved(state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")))
    shift = HASH_BITS
    for shift in range(HASH_BITS - LEVEL_BITS, HASH_BITS - 3 * LEVEL_BITS, -LEVEL_BITS):
        inside = rows.join(state.select(F.col("source").alias("_s"), "prefix", "left"), F.col("source").eqNullSafe(F.col("_s")))
        buckets = (
            inside.where((F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")) & (F.col("left") > 0))
            .groupBy("source", "left", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("size"))
            .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        )
        crossed = buckets.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("size")).alias("left")), "bucket").alias("hit"))
        state = saved(_stepped(state, crossed, F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)))
    inside = rows.join(state.select(F.col("source").alias("_s"), "prefix", "left"), F.col("source").eqNullSafe(F.col("_s")))
    single = (
        inside.where((F.shiftright("hash", shift) == F.col("prefix")) & (F.col("left") > 0))
        .groupBy("source", "left", "hash")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("hash")))
    )
    # The last one is taken if that comes nearer to the budget than leaving it.
    last = single.where(F.col("upto") - F.col("size") / 2 <= F.col("left")).groupBy("source").agg((F.max("hash") + 1).alias("_below"))
    none = F.when(F.col("left") > 0, F.shiftleft(F.col("prefix"), shift)).otherwise(F.lit(0)).cast("long")
    found = last.withColumnRenamed("source", "_s")
    return saved(
        state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "copies", F.coalesce("_below", none).alias("below")
        )
    )


def _stepped(state: DataFrame, crossed: DataFrame, past: Column) -> DataFrame:
    """The state with the boundary bucket as the new prefix; `past` where no bucket is crossed."""
    hit = crossed.withColumnRenamed("source", "_s")
    return state.join(hit, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "copies",
        F.when(F.col("left") > 0, F.coalesce("hit.left", "left")).otherwise(0.0).alias("left"),
        F.when(F.col("left") > 0, F.coalesce("hit.bucket", past)).otherwise(F.shiftleft("prefix", LEVEL_BITS)).cast("long").alias("prefix"),
    )


def row_hash(key_columns: list[str], seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(column(c) for c in key_columns)), 64 - HASH_BITS)


def mix_sources(df: DataFrame, key_columns: list[str], source: str = "source", text: str = "text", seed: int = 29) -> DataFrame:
    """df with size, source_size, target and times: how often the mix takes the row (0 to 3).

    size counts the text's words (null: 0). Taken words come near each source's target,
    by half a document's size at most. Rows with equal key_columns share one decision.
    Samples are nested: a larger budget takes what a smaller one takes. Reruns agree. An
    empty table gives an empty result; a null source is a source of its own, the last.
    Existing columns of the four names are replaced; all others may have any name.
    """
    names = [c for c in df.columns if c not in ("size", "source_size", "target", "times")]
    sized = df.select(packed(df, names).alias("row"), column(source).alias("source"), word_count(column(text)).alias("size"), row_hash(key_columns, seed).alias("_hash"))
    cuts = thresholds(saved(sized.select("source", "size", F.col("_hash").alias("hash"))))
    return _taken(sized, cuts).select(*unpacked("row", names), "size", "source_size", "target", "times")


def _taken(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """sized (source, size, _hash, more) with source_size, target and times."""
    cuts = cuts.withColumnRenamed("source", "_s")
    times = F.col("copies") + F.when(F.col("_hash") < F.col("below"), 1).otherwise(0)
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("times", times.cast("int")).drop("_s", "copies", "below")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(["doc_id"], 29).alias("_hash")))
    cuts = thresholds(narrow.select("source", "size", F.col("_hash").alias("hash")))
    return _taken(narrow, cuts).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
