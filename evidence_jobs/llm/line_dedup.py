"""Removal of repeated passages by content-defined chunks of lines and by the shortest long runs around every line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from evidence_jobs.llm.common import column, mixed, packed, saved, slices, unpacked

#: A line of so many words is a paragraph and stands as a chunk of its own, like several wrapped lines.
PARAGRAPH_WORDS = 50
#: Lines in the rolling window; one of so many windows ends a chunk.
WINDOW, DIVISOR = 2, 3


def chunk_ends(lines: list[bytes]) -> list[int]:
    """End positions (exclusive) of a document's chunks.

    A chunk ends where the rolling hash of the last WINDOW line hashes is divisible by
    DIVISOR. That hangs on the nearby lines alone, so lines put in before do not shift
    later boundaries. Paragraph lines are chunks by themselves.
    """
    if not lines:
        return []
    hashes = mixed(np.fromiter(map(xxh3_64_intdigest, lines), np.uint64, len(lines)))
    roll = hashes.copy()
    for back in range(1, WINDOW):
        roll[back:] += hashes[:-back] * np.uint64(2 * back + 1)
    long = [len(line) > PARAGRAPH_WORDS and len(line.split()) >= PARAGRAPH_WORDS for line in lines]
    wanted = (mixed(roll) % np.uint64(DIVISOR) == 0).tolist()
    return [i for i in range(1, len(lines) + 1) if i == len(lines) or wanted[i - 1] or long[i - 1] or long[i]]


def chunks(text: str | None) -> list[bytes]:
    """The chunks' bytes; joined by a newline they give the text."""
    lines = (text or "").encode().split(b"\n")
    ends = chunk_ends(lines)
    return [b"\n".join(lines[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def eligible(chunk: bytes) -> bool:
    """Several lines with words in two of them at least, or a paragraph."""
    lines = chunk.split(b"\n")
    if len(lines) == 1:
        return len(chunk) > PARAGRAPH_WORDS and len(chunk.split()) >= PARAGRAPH_WORDS
    return sum(bool(line.strip()) for line in lines) >= 2


def line_starts(data: bytes) -> list[int]:
    """Offsets of the lines, and that of one more behind the end."""
    return [0, *np.cumsum([len(line) + 1 for line in data.split(b"\n")]).tolist()]


def spans(data: bytes) -> list[tuple[int, int]]:
    """Line ranges (end exclusive) to compare: eligible chunks, and for each line the shortest runs of PARAGRAPH_WORDS words that begin or end with it.

    A run of lines with so many words stands elsewhere only if the short runs inside it
    do, and these cover all its lines, whatever stands before and after.
    """
    lines = data.split(b"\n")
    ends = chunk_ends(lines)
    found = {(a, b) for a, b in zip([0, *ends], ends, strict=False) if eligible(b"\n".join(lines[a:b]))}
    words = np.cumsum([0, *(len(line.split()) for line in lines)])
    if words[-1] >= PARAGRAPH_WORDS:
        stop = np.searchsorted(words, words[:-1] + PARAGRAPH_WORDS, "left").tolist()
        start = (np.searchsorted(words, words[1:] - PARAGRAPH_WORDS, "right") - 1).tolist()
        found.update((a, b) for a, b in enumerate(stop) if b <= len(lines))
        found.update((a, b) for b, a in enumerate(start, 1) if a >= 0)
    return sorted(found)


def _hashes(batches):
    for batch in slices(batches):
        at, places, high, low = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = (text or "").encode()
            starts = line_starts(data)
            for a, b in spans(data):
                wide = np.frombuffer(xxh3_128_digest(data[starts[a] : starts[b] - 1]), np.int64)
                at.append(i)
                places.append(a << 32 | b)
                high.append(wide[0])
                low.append(wide[1])
        keys = batch.column(0).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["_key", "place", "high", "low"])


def repeated_places(docs: DataFrame, key: str = "_key") -> DataFrame:
    """(_key, place, first, high, low): the spans whose hash occurs more than once; `first` is the place of the first occurrence, by key and place, if that is in the same document.

    A place has the first line in its upper half and the end in its lower one.
    """
    schema = docs.select(key).schema.add("place", "long").add("high", "long").add("low", "long")
    rows = saved(docs.select(key, "_text").mapInArrow(_hashes, schema))
    first = rows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "place")).alias("first")).where("n > 1").drop("n")
    here = F.when(F.struct(key) == F.struct(F.col(f"first.{key}")), F.col("first.place"))
    return rows.join(first, ["high", "low"]).select(key, "place", here.alias("first"), "high", "low")


def _marked_spans(batches):
    for batch in slices(batches):
        out = []
        for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            starts = line_starts(data)
            out += [(m["high"], m["low"], data[starts[m["place"] >> 32] : starts[m["place"] & 0xFFFFFFFF] - 1]) for m in marks]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["high", "low", "form"])


def _cleaned(batches):
    for batch in slices(batches):
        names = batch.schema.names
        texts, marks = batch.column(names.index("_text")).to_pylist(), batch.column(names.index("_marks")).to_pylist()
        out, removed_chunks, removed_words = [], [], []
        for text, mark in zip(texts, marks, strict=True):
            again = [(m["place"] >> 32, m["place"] & 0xFFFFFFFF, (m["first"] or 0) & 0xFFFFFFFF) for m in mark or () if m["place"] != m["first"]]
            if not again:
                out.append(text)
                removed_chunks.append(0)
                removed_words.append(0)
                continue
            lines = text.encode().split(b"\n")
            drop = np.zeros(len(lines), bool)
            for a, b, kept in again:  # a run that overlaps its own first occurrence leaves that whole
                drop[max(a, kept) : b] = True
            ends = chunk_ends(lines)
            whole = {(a, b) for a, b in zip([0, *ends], ends, strict=False) if eligible(b"\n".join(lines[a:b]))}
            out.append(b"\n".join(line for line, gone in zip(lines, drop, strict=True) if not gone).decode())
            removed_chunks.append(len(whole & {(a, b) for a, b, kept in again if kept <= a}))
            removed_words.append(sum(len(lines[i].split()) for i in np.flatnonzero(drop)))
        yield pa.RecordBatch.from_arrays([batch.column(names.index("_row")), pa.array(out, pa.string()), pa.array(removed_chunks, pa.int32()), pa.array(removed_words, pa.int64())], ["_row", "_text", "removed_chunks", "removed_words"])


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages of lines taken out of `text`, and removed_chunks int, removed_words long.

    A run of whole lines with PARAGRAPH_WORDS words or more, or an eligible chunk, is
    removed where its bytes occur earlier, in order of id, text hash and place; the first
    occurrence stays, and so do shorter runs that are no chunk. removed_chunks counts the
    chunks among them, removed_words all words that go. Boundaries and hashes come from
    whole texts. Equal hashes are grouped by their bytes; if one hash ever stands for
    different bytes, its spans all stay. Null texts stay null. Repeated
    rows are equal in id and text: their spans count as one document's and each row
    keeps the first occurrence. An empty table stays empty; other columns are kept;
    columns of the two new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("removed_chunks", "removed_words")]
    key = F.struct(column(id_column).alias("id"), F.xxhash64(column(text)).alias("hash"))
    marks = saved(repeated_places(docs.select(key.alias("_key"), column(text).alias("_text"))))
    per_doc = marks.groupBy("_key").agg(F.collect_set(F.struct("place", "first", "high", "low")).alias("_marks"))
    others = [c for c in names if c != text]
    lone = docs.select(packed(docs, others).alias("_row"), key.alias("_key"), column(text).alias("_text"))
    per_doc = per_doc.select(F.col("_key.id").alias("_mid"), F.col("_key.hash").alias("_mhash"), "_marks")
    same = F.col("_key.id").eqNullSafe(F.col("_mid")) & (F.col("_key.hash") == F.col("_mhash"))

    forms = lone.join(per_doc, same).select("_text", "_marks").mapInArrow(_marked_spans, "high long, low long, form binary")
    several = saved(forms.groupBy("high", "low", "form").agg(F.lit(1).alias("one")).groupBy("high", "low").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1"))
    if not several.isEmpty():
        kept = marks.join(several.drop("forms"), ["high", "low"], "left_anti")
        per_doc = kept.groupBy("_key").agg(F.collect_set(F.struct("place", "first", "high", "low")).alias("_marks"))
        per_doc = per_doc.select(F.col("_key.id").alias("_mid"), F.col("_key.hash").alias("_mhash"), "_marks")

    marked = lone.join(per_doc, same, "left").select("_row", "_text", "_marks")
    done = marked.mapInArrow(_cleaned, lone.select("_row", "_text").schema.add("removed_chunks", "integer").add("removed_words", "long"))
    own = dict(zip([*others, text], [*unpacked("_row", others), F.col("_text").alias(text)], strict=True))
    return done.select(*(own[c] for c in names), "removed_chunks", "removed_words")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
