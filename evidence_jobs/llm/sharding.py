"""A uniform shuffle into shards of exact sizes, with DataFrame functions only.

A hypergeometric communication matrix says how many rows each logical partition
sends to each shard. Drawn first, it lets every partition permute its rows locally
and cut them by those counts; each shard then permutes what it got.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.llm.common import column, packed, shuffle_partitions, unpacked

#: numpy draws from populations below this; larger ones are drawn by rejection, from the same distribution.
NUMPY_POPULATION = 10**9


def _log_ratio(good: int, bad: int, draws: int, start: int, end: int) -> float:
    """log of P(end) / P(start) of a hypergeometric count, summed up over the steps between."""
    low, high = sorted((start, end))
    i = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - i) / (i + 1)) + np.log((draws - i) / (bad - draws + i + 1))
    return float(steps.sum()) * (1 if end >= start else -1)


def rejected_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw by rejection, for populations of any size.

    The probabilities are log-concave, so with mode m, p = P(m) and w = 1 + p / 2 they lie
    under p * min(1, exp(w - p * |x - m|)), which is drawn from and thinned exactly.
    """
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    spread = (draws * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - draws) / (good + bad - 1)) ** 0.5
    p = 0.9 * min(1.0, 1 / (1 + (2 * np.pi) ** 0.5 * spread))  # a little below P(mode): the bound stays above
    w = 1 + p / 2
    while True:
        far = (rng.random() * w if rng.random() <= w / (1 + w) else w + rng.exponential()) / p
        x = mode + round(far) * (1 if rng.random() < 0.5 else -1)
        if low <= x <= high and np.log(1 - rng.random()) + min(0.0, w - p * far) <= _log_ratio(good, bad, draws, mode, x):
            return x


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, taken without replacement, are among the `good`."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws))
    return rejected_hypergeometric(rng, good, bad, draws)


def communication_matrix(row_counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard: exact row and column sums."""
    rng, left = np.random.default_rng(seed), list(shard_sizes)
    matrix = []
    for count in row_counts:
        open_slots, row = sum(left), []
        for s, size in enumerate(left):
            open_slots -= size
            sent = hypergeometric(rng, size, open_slots, count)
            row.append(sent)
            left[s] -= sent
            count -= sent
        matrix.append(row)
    return matrix


def uniform_shards(df: DataFrame, n_shards: int, key_columns: list[str], seed: int = 17) -> DataFrame:
    """df with `shard` int (0 to n_shards - 1) and `slot` long (gapless from 0 in each shard).

    Shard counts differ by one at most. key_columns identify a row; rows equal in all
    of them are interchangeable and may be told apart in any way. Nulls are ordinary values, an empty table
    gives an empty result. Existing columns named shard or slot are replaced, all others
    may have any name. What the driver handles is partitions x n_shards counts, however
    many rows there are; no task gets a whole shard.
    """
    spark, n_parts = df.sparkSession, max(64, shuffle_partitions(df.sparkSession))
    bits = max(1, (n_parts - 1).bit_length())
    names = [c for c in df.columns if c not in ("shard", "slot")]
    key = lambda salt: F.xxhash64(F.lit(seed + salt), *(column(c) for c in key_columns))
    rows = df.select(packed(df, names).alias("row"), F.pmod(key(0), F.lit(n_parts)).cast("int").alias("part"), key(1).alias("first"), key(2).alias("second"))

    in_row = [F.col("row").getField(f"c{names.index(c)}") for c in key_columns]

    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    order = sorted(counts)
    cuts = [(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(order, communication_matrix([counts[p] for p in order], sizes, seed), strict=True)]
    matrix = spark.createDataFrame(cuts, "part int, cuts array<bigint>")

    local = Window.partitionBy("part").orderBy("first", *in_row)
    dealt = (
        rows.withColumn("place", F.row_number().over(local))
        .join(F.broadcast(matrix), "part")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))).cast("int"))
        .withColumn("run", F.shiftrightunsigned("second", 64 - bits).cast("int"))
        .select("row", "second", "shard", "run")
    )
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # n_shards x 2**bits rows at most
        dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    final = Window.partitionBy("shard", "run").orderBy("second", *in_row)
    placed = dealt.join(offsets, ["shard", "run"]).withColumn("slot", (F.col("offset") + F.row_number().over(final) - 1).cast("long"))
    return placed.select(*unpacked("row", names), "shard", "slot")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    return uniform_shards(docs, 16, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
