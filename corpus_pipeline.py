"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_jobs.llm.common import column, packed, saved, unpacked
from evidence_jobs.llm.line_dedup import dedup_lines
from evidence_jobs.llm.mixing import mix_sources
from evidence_jobs.llm.ngram_jaccard import drop_near_duplicates
from evidence_jobs.llm.packing import pack_documents, tokenizer_file
from evidence_jobs.llm.quality import keep_good


def _with_others(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and all others in one struct, `row`, where no name of theirs meets an operator's own."""
    return docs.select(*(column(c).alias(c) for c in needed), packed(docs, [c for c in docs.columns if c not in needed]).alias("row"))


def _own_columns(rows: DataFrame, docs: DataFrame, needed: list[str]) -> DataFrame:
    """The columns of docs, in order, of rows that came from _with_others."""
    others = [c for c in docs.columns if c not in needed]
    own = {c: F.col(c) for c in needed} | dict(zip(others, unpacked("row", others), strict=True))
    return rows.select(*(own[c] for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that earlier ones hold; n_chars, if there is one, follows the text."""
    cleaned = _own_columns(dedup_lines(_with_others(docs, ["doc_id", "text"])), docs, ["doc_id", "text"])
    counted = {c: F.length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return cleaned.select(*(counted.get(c, column(c)).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    needed = ["doc_id", "source", "text"]
    mixed = mix_sources(_with_others(docs, needed), ["doc_id"]).where("times > 0")
    return _own_columns(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))), docs, needed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
