"""Canonical exact digests of documents, with byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from evidence_jobs.llm.common import bit_table, column, in_table, saved, shuffle_partitions, slices

#: Tasks that share the rows of one repeated fingerprint.
SALTS = 16


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, runs of white space as one space, trimmed; null as empty."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def digest(text: str | None) -> str:
    """128-bit xxhash of the canonical form, as 32 hex digits."""
    return xxh3_128_hexdigest(canonical(text))


def _short(fingerprint: Column) -> Column:
    """The first 60 bits as a long."""
    return F.conv(F.substring(fingerprint, 1, 15), 16, 10).cast("long")


def repeated_forms(docs: DataFrame, fingerprints: DataFrame, text: str = "text") -> DataFrame:
    """(fingerprint, form, n): the canonical forms behind every fingerprint that several rows have.

    Only texts that pass a bit table of these fingerprints (16 MB, whatever the input)
    leave their task. Grouping by the form's bytes is the byte comparison; copies
    collapse before the shuffle, so a large group of them costs one row a task.
    """
    several = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(several.select(_short(F.col("fingerprint")).alias("h")), "h", 27))

    def forms(batches):
        for batch in slices(batches):
            found = [canonical(t) for t in batch.column(0).to_pylist()]
            names = [xxh3_128_hexdigest(f) for f in found]
            keep = np.flatnonzero(in_table(table.value, np.array([int(n[:15], 16) for n in names], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.string()), pa.array([found[i] for i in keep], pa.binary())], ["fingerprint", "form"])

    kept = docs.select(text).mapInArrow(forms, "fingerprint string, form binary")
    return kept.groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("n")).join(several, "fingerprint", "left_semi")


def _renamed(docs: DataFrame, colliding: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, fingerprint, fingerprint_now) of the rows whose fingerprint stands for several forms."""
    ranked = colliding.withColumn("fingerprint_now", F.concat_ws(":", "fingerprint", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form"))))
    kind = docs.schema[id_column].dataType.simpleString()

    def forms(batches):
        for batch in slices(batches):
            found = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(xxh3_128_hexdigest, found), pa.string()), pa.array(found, pa.binary())], ["_rid", "fingerprint", "form"])

    rows = docs.select(id_column, text).mapInArrow(forms, f"_rid {kind}, fingerprint string, form binary")
    return rows.join(ranked, ["fingerprint", "form"]).select("_rid", F.col("fingerprint").alias("_rf"), "fingerprint_now").distinct()


def resolved(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """found (id, fingerprint, more), where different canonical forms never share a fingerprint.

    A fingerprint that stands for several forms gets `:rank` of the form added. With a
    128-bit hash there is none in practice; the check decides, not the odds.
    """
    forms = repeated_forms(docs, found.select("fingerprint"), text)
    colliding = saved(forms.join(forms.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "fingerprint", "left_semi").drop("n"))
    if colliding.isEmpty():
        return found
    renamed = _renamed(docs, colliding, id_column, text)
    joined = found.join(renamed, F.col(id_column).eqNullSafe(F.col("_rid")) & (F.col("fingerprint") == F.col("_rf")), "left")
    return joined.withColumn("fingerprint", F.coalesce("fingerprint_now", "fingerprint")).select(*found.columns)


def with_groups(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """found with group_id, the smallest id of its equal fingerprints, and copies, their number.

    Only repeated fingerprints are joined back, each once for every salt, so the rows of
    a large group are spread over SALTS tasks.
    """
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(column(id_column), F.monotonically_increasing_id()), F.lit(SALTS)))
    groups = found.groupBy("fingerprint").agg(F.min(column(id_column)).alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["fingerprint", "_salt"], "left")
    own = [column(c) for c in found.columns]
    return joined.select(*own, F.coalesce("group_id", column(id_column)).alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint, group_id and copies.

    Null text counts as empty, an empty text has a fingerprint like any other; repeated
    rows each keep a row; a null id stays null; other columns are left out, whatever their names.
    """

    def digests(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, batch.column(1).to_pylist()), pa.string())], ["id", "fingerprint"])

    rows = docs.select(column(id_column).alias("id"), column(text).alias("text"))
    found = saved(rows.mapInArrow(digests, rows.select("id").schema.add("fingerprint", "string")))
    grouped = with_groups(resolved(rows, found, "id"), "id")
    return grouped.select(F.col("id").alias(id_column), "fingerprint", "group_id", "copies")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDIT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OPEN = pa.schema([*_EDIT, ("part", pa.int32()), ("head", pa.string()), ("text", pa.string())])
_OPEN_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, head string, text string"


def _edit_row(doc_id, text: str, following: str) -> dict:
    own, after = canonical(text), canonical(following)
    changed = edited(text, following)
    new = canonical(changed)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": xxh3_128_hexdigest(own), "edited_fingerprint": xxh3_128_hexdigest(new),
        "near_edited": float(own == new), "near_next": float(own == after),
    }


def _edit_partition(batches):
    """Rows in order, each with its successor; the first text and the last row wait for the neighbours."""
    part, before, head = TaskContext.get().partitionId(), None, None
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if before:
                rows.append(_edit_row(*before, text or ""))
            else:
                head = text or ""
            before = (doc_id, text or "")
        yield pa.RecordBatch.from_pylist(rows, schema=_OPEN)
    if before:
        yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "part": part, "head": head, "text": before[1]}], schema=_OPEN)


def _edit_last(batches):
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        yield pa.RecordBatch.from_pylist([_edit_row(*r) for r in rows], schema=_EDIT)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The next document is found by one range shuffle: each task walks its range in
    descending doc_id and leaves one open row, which the next range's first text closes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = saved(docs.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_edit_partition, _OPEN_DDL))
    ends = walked.where("part is not null").select("doc_id", "text", "part", "head")  # one row a task
    around = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part")))
    last = ends.select("doc_id", "text", around.alias("following")).mapInArrow(_edit_last, _OPEN_DDL.partition(", part")[0])
    found = walked.where("part is null").select(*_EDIT.names).unionByName(last)
    return resolved(docs, found).select(*_EDIT.names)
