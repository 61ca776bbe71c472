"""Cosine similarity and exact cosine ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evidence_jobs.operators.places import is_dictionary
from evidence_jobs.sources.stored import stored

#: Queries of a group that are scored together, chunks that they meet in one task, and chunks of one product.
QUERY_BLOCK, CHUNK_STREAM, PIECE = 256, 65_536, 4096


def cosine(left: Column, right: Column) -> Column:
    """0 for empty vectors, unequal lengths or a zero norm."""
    a, b = left.cast("array<double>"), right.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)


def _column_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of left and right, summed from the first component on, as cosine() does."""
    out = np.zeros((len(left), len(right)))
    for a, b in zip(left.T, right.T, strict=True):
        out += a[:, None] * b[None, :]
    return out


def _matrices(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (positions, matrix) of vectors; empty ones and those that hold a null are left out."""
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v and None not in v:
            sizes.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.array([vectors[i] for i in at], dtype=float)) for n, at in sizes.items()}


def block_similarities(queries: list, chunks: list) -> np.ndarray:
    """cosine() of every query vector with every chunk vector."""
    out = np.zeros((len(queries), len(chunks)))
    left, right = _matrices(queries), _matrices(chunks)
    for n in left.keys() & right.keys():
        (i, a), (j, b) = left[n], right[n]
        norm = lambda m: np.sqrt(sum((c * c for c in m.T), np.zeros(len(m))))
        size = norm(a)[:, None] * norm(b)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[np.ix_(i, j)] = np.where(size == 0, 0.0, _column_sums(a, b) / size)
    return out


def _first(found: list[tuple[float, object]], k: int) -> list[tuple[float, object]]:
    """The k best (similarity, id): not a number is above all numbers, ties go to the smaller id."""
    return sorted(found, key=lambda f: (-np.inf if np.isnan(f[0]) else -f[0], f[1]))[:k]


def _local_best(k: int, id_type: pa.DataType):
    """Rows (block, side, query_id, chunk_id, vector), block after block with its queries (side 0) first, to the best chunks of each query in the block."""

    def search(batches):
        key, names, vectors, best = None, [], [], []

        def done():
            rows = [(q, c, s) for q, found in zip(names, best, strict=True) for s, c in found]
            kinds = [names_type, id_type, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "chunk_id", "similarity"])

        for batch in batches:
            rows = batch.to_pydict()
            names_type = batch.schema.field("query_id").type
            keys = list(zip(rows["block"], rows["side"], strict=True))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if lo == hi:
                    continue
                block, side = keys[lo]
                if block != key:
                    if names:
                        yield done()
                    key, names, vectors, best = block, [], [], []
                if side == 0:
                    names += rows["query_id"][lo:hi]
                    vectors += rows["vector"][lo:hi]
                    best += [[] for _ in range(lo, hi)]
                    continue
                for at in range(lo, hi, PIECE):
                    ids, end = rows["chunk_id"][at : min(hi, at + PIECE)], min(hi, at + PIECE)
                    table = block_similarities(vectors, rows["vector"][at:end])
                    order = np.where(np.isnan(table), np.inf, table)
                    cut = np.partition(order, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -np.inf)
                    for q in range(len(names)):
                        near = np.flatnonzero(order[q] >= cut[q])
                        best[q] = _first([*best[q], *((float(table[q, c]), ids[c]) for c in near)], k)
        if names:
            yield done()

    return search


def rank_by_cosine(queries: DataFrame, chunks: DataFrame, group: str, top_k: int) -> DataFrame:
    """(query_id, chunk_id, rank, similarity): the best chunks of each query's own group.

    queries (query_id, group, query_vector), chunks (group, chunk_id, vector). A query
    without a vector, or whose group has a chunk without one, has no rows: the caller
    falls back to lexical ranking.

    Each block of a group's queries meets each stream of its chunks in one place, so that a
    large group is many tasks' work; a block keeps the best of its stream, and what blocks
    kept is ranked once more.
    """
    whole = chunks.groupBy(group).agg(F.bool_and(F.col("vector").isNotNull()).alias("_all"), F.count(F.lit(1)).alias("_nc")).where("_all").select(group, "_nc")
    asked = queries.where(F.col("query_vector").isNotNull())
    sizes = stored(asked.groupBy(group).agg(F.count(F.lit(1)).alias("_nq")).join(whole, group).select(group, F.ceil(F.col("_nq") / QUERY_BLOCK).cast("int").alias("_qbs"), F.ceil(F.col("_nc") / CHUNK_STREAM).cast("int").alias("_cbs")))
    sizes = F.broadcast(sizes) if is_dictionary(sizes) else sizes
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ids = {"query_id": queries.schema["query_id"].dataType, "chunk_id": chunks.schema["chunk_id"].dataType}
    none = {c: F.lit(None).cast(t).alias(c) for c, t in ids.items()}
    left = asked.join(sizes, group).select(group, part("query_id", "_qbs").alias("qb"), every("_cbs").alias("cb"), F.lit(0).alias("side"), "query_id", none["chunk_id"], F.col("query_vector").cast("array<double>").alias("vector"))
    right = chunks.join(sizes, group).select(group, every("_qbs").alias("qb"), part("chunk_id", "_cbs").alias("cb"), F.lit(1).alias("side"), none["query_id"], "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    met = left.unionByName(right).repartition(group, "qb", "cb").sortWithinPartitions(group, "qb", "cb", "side")
    rows = met.select(F.to_json(F.struct(F.col(group).alias("g"), "qb", "cb")).alias("block"), "side", "query_id", "chunk_id", "vector")
    schema = T.StructType([*(T.StructField(c, t) for c, t in ids.items()), T.StructField("similarity", T.DoubleType())])
    kept = rows.mapInArrow(_local_best(top_k, to_arrow_type(ids["chunk_id"])), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "rank", "similarity")
