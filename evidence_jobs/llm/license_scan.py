"""License scans by diagonal voting over rolling word k-gram hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from evidence_jobs.llm.common import column, rolling_hashes, slices, word_hashes

# Phrases whose consecutive places are counted, with their labels.
BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Notices, with the words that may not be missing and those that name another license, and wordings of public licenses.
NOTICES = [
    ("mit", "licensed under the mit license", "mit", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache", ""),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "commons attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "commons noncommercial", "sharealike noderivatives"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "commons sharealike", "noncommercial"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general 2", "affero lesser"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general 3", "affero lesser"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser", ""),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero", ""),
    ("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla", ""),
    ("bsd", "licensed under the bsd license", "bsd", ""),
]
WORDINGS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: Words in a k-gram (the shortest phrase has three); diagonals this near are one match; least share of a template's k-grams that must vote.
K, SLACK, LEAST_VOTES = 3, 3, 0.25
#: Least share of a notice's, and of a wording's, words that must stand in order.
NOTICE_SHARE, WORDING_SHARE = 0.8, 0.5
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """words: of the wording; share: of them that must stand in order (None: exactly these, consecutive); must: those that may not be missing; never: those that name another license."""

    label: str
    words: tuple[bytes, ...]
    share: float | None
    must: frozenset[bytes] = frozenset()
    never: frozenset[bytes] = frozenset()

    @property
    def least_votes(self) -> int:
        return max(1, int(LEAST_VOTES * (len(self.words) - K + 1)))


def _template(label: str, text: str, share: float | None, must: str = "", never: str = "") -> Template:
    return Template(label, tuple(text.encode().split()), share, frozenset(must.encode().split()), frozenset(never.encode().split()))


TEMPLATES = (
    *(_template(label, text, None) for label, text in BASE_PHRASES),
    *(_template(label, text, NOTICE_SHARE, must, never) for label, text, must, never in NOTICES),
    *(_template(label, text, WORDING_SHARE) for label, text in WORDINGS),
)


def license_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; none for null."""
    return (text or "").encode().translate(_TO_WORDS).split()


def _grams(batches):
    for batch in slices(batches):
        hashes = [rolling_hashes(word_hashes(license_words(t)), K).view(np.int64) for t in batch.column("_text").to_pylist()]
        offsets = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
        values = np.concatenate([*hashes, np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.ListArray.from_arrays(offsets, pa.array(values))], ["_key", "grams"])


def license_spans(keyed: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(_key, spans) of the documents (_key, _text) that have any, with spans as (template, first, last) in words.

    All k-grams of all documents are joined to the template positions, a fixed table of
    about a thousand rows, so the join is a broadcast and only hits are shuffled. Votes
    are summed by (row, template, diagonal), where the diagonal is document position
    minus template position; rows with equal keys are copies and vote once. Neighbouring diagonals are one match, which needs a least
    number of votes. A span is what the whole template would cover from these diagonals.
    """
    spark = keyed.sparkSession
    positions = [(int(h), t, j) for t, x in enumerate(templates) for j, h in enumerate(rolling_hashes(word_hashes(list(x.words)), K).view(np.int64))]
    table = F.broadcast(spark.createDataFrame(positions, "gram long, template int, at int"))
    sizes = F.broadcast(spark.createDataFrame([(t, len(x.words), x.least_votes, x.share is None) for t, x in enumerate(templates)], "template int, size int, least int, exact boolean"))
    schema = keyed.select("_key").schema.add("grams", ArrayType(LongType()))
    votes = (
        keyed.mapInArrow(_grams, schema)
        .withColumn("copy", F.monotonically_increasing_id())
        .select("_key", "copy", F.posexplode("grams").alias("i", "gram"))
        .join(table, "gram")
        .groupBy("_key", "copy", "template", (F.col("i") - F.col("at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("_key", "template", "diagonal")
        .agg(F.max("votes").alias("votes"))
        .join(sizes, "template")
    )
    ordered = Window.partitionBy("_key", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(ordered), F.lit(1_000_000))
    runs = votes.withColumn("new", (F.col("exact") | (gap > SLACK)).cast("int")).withColumn("run", F.sum("new").over(ordered))
    matches = runs.groupBy("_key", "template", "run", "size", "least").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    span = F.struct("template", F.greatest("low", F.lit(0)).alias("first"), (F.col("high") + F.col("size") - 1).alias("last"))
    return matches.where("votes >= least").groupBy("_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def ordered_words(found: list[bytes], wanted: tuple[bytes, ...]) -> int:
    """The most words of `wanted` that stand in `found` in the same order."""
    best, have = np.zeros(len(found) + 1, np.int64), np.array(found, dtype=object)
    for word in wanted:
        step = best.copy()
        step[1:] = np.maximum(best[1:], best[:-1] + (have == word))
        best = np.maximum.accumulate(step)
    return int(best[-1])


def covered(words: list[bytes], first: int, last: int, template: Template) -> float:
    """The share of the template that stands in order in a window of the span, somewhat longer than the template; 0 without the words that must be there."""
    size, best = len(template.words), 0.0
    width = size + SLACK + size // 2
    for start in range(first, max(first, last + 1 - width) + 1, max(1, size // 2)):
        window = words[start : min(last + 1 + SLACK, start + width)]
        if template.must <= set(window) and not template.never.intersection(window):
            best = max(best, ordered_words(window, template.words) / size)
    return best


def verified(text: str | None, spans: list[dict], templates: tuple[Template, ...] = TEMPLATES) -> tuple:
    words = license_words(text)
    base, labels, score = [], set(), 0.0
    for span in spans or ():
        template = templates[span["template"]]
        if template.share is None:
            if tuple(words[span["first"] : span["last"] + 1]) == template.words:
                base.append((span["first"], template.label))
            continue
        share = covered(words, span["first"], span["last"], template)
        if share >= template.share:
            labels.add(template.label)
            score = max(score, share)
    places = [p for p, _ in base]
    own = {label for _, label in base}
    join = lambda s: ",".join(sorted(s))
    return len(words), len(base), min(places, default=None), max(places, default=None), join(own), join(own | labels), 1.0 if base else score


_FOUND = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count where their words stand consecutively. Other templates give their
    label where enough of their words stand in order near each other: a word put in,
    left out or changed does no harm, the same words in another order do. Every candidate
    span is compared with its template, so equal hashes alone decide nothing. score is 1
    with a base phrase, else the best share of a template that gave a label, else 0.
    Null and empty texts have no words and no labels; repeated rows each keep a row, with
    the result of one; a null id is an ordinary value; other columns are left out, whatever their names.
    """
    rows = docs.select(column(id_column).alias("_id"), column(text).alias("_text"))
    keyed = rows.select(F.struct(F.col("_id").alias("id"), F.xxhash64("_text").alias("hash")).alias("_key"), "_text")
    spans = license_spans(keyed, templates).select(F.col("_key.id").alias("_sid"), F.col("_key.hash").alias("_shash"), "spans")
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_sid")) & (F.xxhash64("_text") == F.col("_shash")), "left").select("_id", "_text", "spans")

    def verify(batches):
        for batch in slices(batches):
            found = [verified(t, s, templates) for t, s in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True))], ["_id", *_FOUND.names])

    schema = StructType().add("_id", rows.schema["_id"].dataType)
    for f in _FOUND:
        schema = schema.add(f.name, {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}[f.type])
    return joined.mapInArrow(verify, schema).withColumnRenamed("_id", id_column)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
