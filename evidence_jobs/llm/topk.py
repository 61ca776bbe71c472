"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.llm.common import shuffle_partitions

#: Queries of a block, candidates that a task scores at once, and candidates that share a stream of tasks at most.
QUERY_BLOCK, CANDIDATE_BLOCK, STREAM_ROWS = 2048, 8192, 1 << 18
#: Sums below this are exact in 64 bits; beyond it Python's integers are used.
EXACT = 2**62


def postings(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per dimension the rows with a non-zero weight, and these weights."""
    out = []
    for column in weights.T:
        rows = np.flatnonzero(column)
        out.append((rows, np.ascontiguousarray(column[rows])))
    return out


def integers(rows: list, scale: float) -> np.ndarray:
    """floor(scale * x) of equal-length vectors, as 64-bit integers where these are exact, else as Python's."""
    floats = np.floor(np.array(rows, dtype=np.float64).reshape(len(rows), -1) * scale)
    if floats.size and (not np.isfinite(floats).all() or np.abs(floats).max() >= EXACT):
        exact = [[int(f) if math.isfinite(f) else int(x) * int(scale) for x, f in zip(r, fr, strict=True)] for r, fr in zip(rows, floats, strict=True)]
        return np.array(exact, dtype=object)
    return floats.astype(np.int64)


class Accumulator:
    """The best k candidates of each query so far."""

    def __init__(self, k: int):
        self.k, self.queries = k, {}

    def add(self, ids: list[int], vectors: list, scale: float) -> None:
        """Queries of equal length; zero components have no postings to scatter."""
        for i, v in zip(ids, integers(vectors, scale), strict=True):
            self.queries[i] = (v, [])

    def score(self, ids: np.ndarray, vectors: list, scale: float) -> None:
        """Scatter every query's weighted postings into a dense score array over the block; keep the best."""
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], integers(vectors, scale)[order]
        lists = postings(block)
        top = max((abs(int(x)) for x in (block.max(initial=0), block.min(initial=0))), default=0)
        for own, (query, best) in self.queries.items():
            if len(query) != block.shape[1]:
                continue
            small = top * sum(abs(int(x)) for x in query) < EXACT
            scores = np.zeros(len(ids), dtype=np.int64 if small and query.dtype != object else object)
            for d in np.flatnonzero(query):
                rows, weights = lists[d]
                scores[rows] += query[d] * (weights if scores.dtype != object else weights.astype(object))
            if scores.dtype == object:
                scores = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], dtype=np.int64)
            best += self.selected(own, ids, scores)
            if len(best) > 64:
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[self.k :]

    def selected(self, own: int, ids: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, id) of a block whose ids ascend, but for the query's own rows; ties to the smaller id."""
        others = np.flatnonzero(ids != own)
        if len(others) < len(ids):
            ids, scores = ids[others], scores[others]
        if len(ids) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above = np.flatnonzero(scores > least)
            ties = np.flatnonzero(scores == least)[: self.k - len(above)]
            at = np.concatenate([above, ties])
            ids, scores = ids[at], scores[at]
        return [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]

    def results(self) -> list[tuple[int, int, int]]:
        out = []
        for query, (_, best) in self.queries.items():
            best.sort(key=lambda x: (-x[0], x[1]))
            out += [(query, i, s) for s, i in best[: self.k]]
        return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 1.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k candidates with the largest integer inner products.

    Components count as floor(scale * x). Every row is a candidate of every query with
    another id; fewer than k candidates are all returned; ties go to the smaller id.
    Vectors that are null, empty or hold null or non-finite components take no part, nor
    do rows without an id. Vectors of different lengths never meet. A repeated query id
    counts once, with its smallest vector; repeated candidate rows each count. Scores
    beyond 64 bits are cut to the nearest long first. Empty tables give an empty result.

    Queries come in blocks of fixed size, candidates in streams; a task holds one query
    block and one block of candidates. Both sides are dealt to (query block, stream)
    pairs, and each pair returns k rows a query, which are merged by query.
    """
    spark = vectors.sparkSession
    finite = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & finite("v"))
    asked = rows(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_queries, n_rows = asked.count(), vectors.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    streams = max(1, -(-n_rows // STREAM_ROWS), -(-shuffle_partitions(spark) // blocks))

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    stream = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(streams)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(block.alias("block"), everywhere(streams).alias("stream"), F.lit(False).alias("candidate"), "id", "v")
    right = rows(vectors).withColumn("stream", stream).select(everywhere(blocks).alias("block"), "stream", F.lit(True).alias("candidate"), "id", "v")
    pair = F.col("block") * streams + F.col("stream")
    dealt = left.unionByName(right).select(pair.alias("pair"), "candidate", "id", "v")
    parts = min(blocks * streams, 1 << 20)

    def search(batches):
        now, best, ids, held = None, None, [], []

        def flush():
            by_length: dict[int, list[int]] = {}
            for at, v in enumerate(held):
                by_length.setdefault(len(v), []).append(at)
            for at in by_length.values():
                best.score(np.array([ids[i] for i in at], dtype=np.int64), [held[i] for i in at], scale)
            ids.clear()
            held.clear()

        def results():
            flush()
            found = best.results()
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

        for batch in batches:
            for pair, candidate, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pair != now:
                    if best is not None:
                        yield results()
                    now, best = pair, Accumulator(k)
                if not candidate:
                    best.add([i], [v], scale)
                    continue
                ids.append(i)
                held.append(v)
                if len(ids) >= CANDIDATE_BLOCK:
                    flush()
        if best is not None:
            yield results()

    found = dealt.repartitionById(parts, "pair").sortWithinPartitions("pair", "candidate").mapInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, scale=256.0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
