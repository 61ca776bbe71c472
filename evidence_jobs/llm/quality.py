"""A quality classifier: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_jobs.llm.common import column, mixed, packed, slices, unpacked, word_hashes

#: Labelled documents that fit the model at most (the first by a hash of their id), latent dimensions, neighbours that vote.
SAMPLE_ROWS, DIMENSIONS, NEIGHBOURS = 4096, 48, 9
#: A document is kept when label 1 has at least this share of the votes.
THRESHOLD = 0.3
#: Shares of the cosine: character shape pairs, repetition, and word buckets.
SHAPES, REPEATS, WORDS = 32, 24, 256
SHARES = [1.0, 1.5, 0.15]


def _shape_table() -> np.ndarray:
    """A class from 0 to SHAPES - 1 for every UTF-8 byte: letters by case, digits, white space, each common mark."""
    table = np.zeros(256, np.uint8)
    table[128:] = 1
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 2, 3, 4
    for i, mark in enumerate(" \n.,!?;:|$%&#*<>(){}[]/\\=_-+\"'~@^`"):
        table[ord(mark)] = 5 + i % (SHAPES - 5)
    return table


_SHAPE = _shape_table()
FEATURES = SHAPES * SHAPES + REPEATS + WORDS


def features(text: str | None) -> np.ndarray:
    """Non-negative term counts of the whole text, as frequencies: pairs of character shapes, repeated words, word buckets."""
    data = (text or "").encode()
    out = np.zeros(FEATURES)
    shapes = _SHAPE[np.frombuffer(data, np.uint8)].astype(np.int64)
    if len(shapes) > 1:
        out[: SHAPES * SHAPES] = np.bincount(shapes[:-1] * SHAPES + shapes[1:], minlength=SHAPES * SHAPES) / (len(shapes) - 1)
    words = word_hashes(data.lower().split())
    if len(words):
        at = SHAPES * SHAPES
        for lag in range(1, 9):  # the same word again, so many words before
            out[at + lag] = np.count_nonzero(words[lag:] == words[:-lag]) / len(words)
        distinct = len(np.unique(words)) / len(words) * min(1.0, len(words) / 200)
        out[at + 9 + int(distinct * 9.99)] = 0.3
        out[at + REPEATS :] = np.bincount((mixed(words) & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS) / len(words)
    return out


@dataclass
class Model:
    """weights: of the terms; axes: terms to latent dimensions; vectors and labels: of the fitted sample."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (np.sqrt(x) * self.weights) @ self.axes
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 in the similarity-weighted votes of the nearest labelled vectors, by exact cosines in blocks."""
        out = np.full(len(texts), float(self.labels.mean()) if len(self.labels) else 1.0)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts), 256):
            block = self.latent(np.array([features(t) for t in texts[start : start + 256]]))
            cosine = block @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** 4 + 1e-9
            out[start : start + len(block)] = np.clip((vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1), 0, 1)
        return out


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Term weights by inverse document frequency, then the leading right singular vectors of the sample."""
    if not texts:
        return Model(np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.empty((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        x[i] = features(t)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3
    part = np.repeat(SHARES, [SHAPES * SHAPES, REPEATS, WORDS])
    weights = idf * part
    terms = np.sqrt(x) * weights.astype(np.float32)
    axes = np.linalg.eigh((terms.T @ terms).astype(float))[1][:, ::-1][:, :DIMENSIONS]  # right singular vectors, strongest first
    model = Model(weights, axes, np.zeros((0, 1), np.float32), np.array(labels, float))
    model.vectors = model.latent(x)
    return model


def fold(id_column: str):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the labelled documents outside the held-out fold, SAMPLE_ROWS of them at most.

    An id with several labels counts with the smallest; null ids and labels don't count.
    Only the sample comes to the driver.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & (fold(id_column) != 0)).groupBy(id_column).agg(F.min(label).alias("_label"))
    sample = known.orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE_ROWS)
    rows = docs.select(id_column, F.col(text).alias("_text")).join(F.broadcast(sample), id_column)
    rows = rows.groupBy(id_column, "_label").agg(F.min("_text").alias("_text")).orderBy(id_column).collect()
    return fit([r["_text"] for r in rows], [int(r["_label"]) for r in rows])


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` double in 0 to 1: how likely label 1 is.

    The whole text is read. Null and empty texts are like each other and get the votes
    of the neighbours of an empty vector. With no labelled row at all every score is 1.
    An existing column named score is replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]
    others = [c for c in names if c != text]
    rows = docs.select(packed(docs, others).alias("row"), column(text).alias("text"))

    def score(batches):
        for batch in slices(batches):
            found = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["row", "text", "score"])

    scored = rows.mapInArrow(score, rows.select("row", "text").schema.add("score", "double"))
    own = dict(zip([*others, text], [*unpacked("row", others), F.col("text").alias(text)], strict=True))
    return scored.select(*(own[c] for c in names), "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches THRESHOLD, with their own columns."""
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(packed(docs, kept).alias("row"), "text")
    own = dict(zip([*kept, "text"], [*unpacked("row", kept), F.col("text")], strict=True))
    return score_quality(rows, train(docs, labels)).where(F.col("score") >= THRESHOLD).select(*(own[c] for c in docs.columns))


def op7_quality_knn(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.withColumn("held_out", fold("doc_id") == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
