import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidence_jobs.operators import vectors

SCHEMAS = "query_id long, g string, query_vector array<float>", "g string, chunk_id string, vector array<float>"


def plain(queries, chunks, k):
    whole = chunks.groupBy("g").agg(F.bool_and(F.col("vector").isNotNull()).alias("ok")).where("ok").select("g")
    scored = queries.where("query_vector IS NOT NULL").join(whole, "g", "left_semi").join(chunks, "g").withColumn("similarity", vectors.cosine(F.col("query_vector"), F.col("vector")))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return {tuple(r) for r in scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "similarity").collect()}


def tables(spark):
    r = np.random.default_rng(5)
    vector = lambda: [float(x) for x in r.integers(-2, 3, 3)]
    odd = [[], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("inf"), 1.0, 1.0]]
    queries = [(i, "hot" if i % 3 else "small", odd[i] if i < 5 else vector()) for i in range(40)] + [(100, "broken", [1.0, 2.0, 3.0]), (101, "hot", None), (102, "none", [1.0]), (103, None, [1.0])]
    chunks = [("hot", f"c{i}", odd[i % 5] if i % 20 == 0 else vector()) for i in range(300)] + [("small", f"s{i}", vector()) for i in range(2)] + [("broken", "b", None), ("broken", "b2", [1.0, 2.0, 3.0]), ("alone", "a", [1.0])]
    return spark.createDataFrame(queries, SCHEMAS[0]), spark.createDataFrame(chunks, SCHEMAS[1])


def test_blocks_rank_as_rows_do(spark, monkeypatch):
    queries, chunks = tables(spark)
    same = lambda rows: {(q, c, n, "nan" if s != s else s) for q, c, n, s in rows}
    want = same(plain(queries, chunks, 4))
    assert same(tuple(r) for r in vectors.rank_by_cosine(queries, chunks, "g", 4).collect()) == want
    for name, size in (("QUERY_BLOCK", 7), ("CHUNK_STREAM", 50), ("PIECE", 9)):
        monkeypatch.setattr(vectors, name, size)
    assert same(tuple(r) for r in vectors.rank_by_cosine(queries, chunks, "g", 4).collect()) == want
    assert vectors.rank_by_cosine(queries.limit(0), chunks, "g", 4).count() == 0 and vectors.rank_by_cosine(queries, chunks.limit(0), "g", 4).count() == 0
