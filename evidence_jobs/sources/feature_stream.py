"""Features of GeoJSON collections, read by splits.

A file is divided at closing braces, so a feature always ends where a piece ends. A first
pass counts the quotes and brackets of each split for both states that it can start in,
inside a string or outside; windows over the splits give the state, depth and container
that each starts in. A second pass cuts the features out. Only features that cross splits
are put together by a shuffle. What is left of a file, its frame, is a few bytes a split;
it tells which array holds the features and whether the file is a collection at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_jobs.operators.places import is_dictionary
from evidence_jobs.sources.csv_rows import MARK, with_start
from evidence_jobs.sources.stored import stored

_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]++|\\.)*+("?)', re.DOTALL)
_TOKEN = re.compile(rb'["\[\]{},]|[^"\[\]{},]++')
_NO_BRACKETS = bytes(set(range(256)) - set(b"[]{}"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, block, piece): what lies between closing braces, with the start of its split; in file order within a split."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Both passes must see the same splits, however many executors there are by then.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    meta = lambda name: F.col(f"_metadata.{name}")
    return spark.read.option("lineSep", "}").text(path).select(meta("file_path").alias("path"), meta("file_size").alias("size"), meta("file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def without_strings(data: bytes, quoted: bool) -> tuple[bytes, bool]:
    """What stands outside strings, and whether data ends inside one."""
    if b'"' not in data:
        return (b"" if quoted else data), quoted
    left = _STRING.sub(b"", b'"' + data if quoted else data)
    at = left.find(b'"')
    return (left, False) if at < 0 else (left[:at], True)


def _nested(brackets: bytes, closed: int, opened: list[int]) -> int:
    """Closers of brackets that were open before, in all; those that stay open are put on `opened`."""
    before = None
    while before != brackets:
        before, brackets = brackets, brackets.replace(b"[]", b"").replace(b"{}", b"")
    for b in brackets:
        if b in b"[{":
            opened.append(b)
        elif opened:
            opened.pop()
        else:
            closed += 1
    return closed


_SUMMARY = "path string, size long, block long, length long, exit_out boolean, exit_in boolean, closed_out long, opened_out long, head_out string, closed_in long, opened_in long, head_in string"
_SUMMARY_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64(), pa.int64(), pa.string()] * 2]


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[bytes], int]]:
    """(key, pieces, index of the first) of a batch's runs of one split; the key is all but the piece, which comes last of the four."""
    paths, sizes, blocks, pieces = (batch.column(i).to_pylist() for i in range(4))
    at = 0
    for i in range(1, len(pieces) + 1):
        if i == len(pieces) or (paths[i], blocks[i]) != (paths[at], blocks[at]):
            yield (paths[at], sizes[at], blocks[at]), pieces[at:i], at
            at = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its bytes, and for both starts the state it ends in, what it closes and leaves open."""
    key, length, states = None, 0, []

    def row() -> tuple:
        sums = [v for _, closed, opened in states for v in (closed, len(opened), bytes(opened[:2]).decode())]
        return (*key, length, states[0][0], states[1][0], *sums)

    for batch in batches:
        done = []
        for own, pieces, _ in _runs(batch):
            if own != key:
                if key is not None:
                    done.append(row())
                key, length, states = own, 0, [[False, 0, []], [True, 0, []]]
            data = b"}".join(pieces) + b"}"
            length += len(data)
            for s in states:
                outside, s[0] = without_strings(data, s[0])
                s[1] = _nested(outside.translate(None, _NO_BRACKETS), s[1], s[2])
        if done:
            yield _batch(done, _SUMMARY_KINDS, _SUMMARY)
    if key is not None:
        yield _batch([row()], _SUMMARY_KINDS, _SUMMARY)


def feature_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, holds, quoted, depth, inner, unclosed): per split what it starts in, and whether its file may hold an object.

    `inner` is the bracket at the second level; `unclosed` says that the file doesn't end
    with the brace that is put after its last piece (null: not known, as it is compressed).
    """
    placed = with_start(stored(_pieces(spark, path).mapInArrow(_summaries, _SUMMARY)))
    files, so_far = Window.partitionBy("path"), Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({n: F.when(F.col("quoted"), F.col(f"{n}_in")).otherwise(F.col(f"{n}_out")) for n in ("closed", "opened", "head")})
    placed = placed.withColumn("depth", F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(so_far), F.lit(0)))
    # A split that climbs to the first level or out of it says what is open at the second one after it.
    lowest = F.col("depth") - F.col("closed")
    inner = F.last(F.when(lowest <= 1, F.substring("head", F.lit(2) - lowest.cast("int"), F.lit(1))), ignorenulls=True).over(so_far)
    # A first split that leaves nothing open is cut like any other; its frame tells what it holds.
    outer = F.min_by(F.substring("head", 1, 1), "block").over(files)
    # A byte order mark may be gone from the first piece.
    spare = F.sum("length").over(files) - F.col("size")
    unclosed = F.when(spare.isin(1, -2), True).when(spare.isin(0, -3), False)
    return placed.select("path", "block", (outer != "[").alias("holds"), "quoted", "depth", F.coalesce(inner, F.lit("")).alias("inner"), unclosed.alias("unclosed"))


class _Scanner:
    """Cuts a split into features and its share of the frame.

    Positions count the elements of all arrays at the second level, within the split; an
    array's opening counts as one, so that positions of two arrays differ.
    """

    def __init__(self, quoted: bool, depth: int, inner: str):
        self.quoted, self.depth, self.inner = quoted, depth, inner.encode()
        self.position, self.commas, self.frame = 0, 0, []
        # A split that starts below an array's level is inside an element; one that is no object gives no feature later.
        self.part, self.begins = ([] if depth >= 3 and self.inner == b"[" else None), False
        self.continues = depth >= 2 and self.inner == b"["

    def _count(self) -> None:
        """The commas of an array in this split stand for its elements in the frame."""
        self.frame.append(b",%d" % self.commas if self.continues else b"%d" % self.commas)
        self.commas, self.continues = 0, False

    def _keep(self, piece: bytes) -> None:
        if self.part is not None:
            self.part.append(piece)
        elif self.depth < 2:
            self.frame.append(piece)

    def _bracket(self, b: bytes) -> tuple | None:
        """Steps over a bracket; returns the feature that it ends."""
        if b in b"[{":
            if self.depth == 2 and self.inner == b"[":
                self.part, self.begins = [], True
            self._keep(b)
            self.depth += 1
            if self.depth == 2:
                self.inner = b
                if b == b"[":
                    self.position += 1
                    self.continues = False
            return None
        if self.depth == 2 and self.inner == b"[":
            self._count()
        self.depth -= 1
        self._keep(b)
        return self._ended() if self.depth == 2 and self.part is not None else None

    def _ended(self) -> tuple:
        found = (self.position, self.begins, True, b"".join(self.part))
        self.part, self.begins = None, False
        return found

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """(position, begins, ends, bytes) of the elements that end in a piece."""
        at = 0
        while at < len(piece):
            if self.quoted:
                found = _REST_OF_STRING.match(piece, at)
                self.quoted = not found[1]
                self._keep(found[0])
                at = found.end()
                continue
            if self.depth >= 3:
                # Only the brace at the end of a piece can close an object, so most bytes are counted, not walked.
                rest, opened = piece[at:], []
                outside, quoted = without_strings(rest, False)
                closed = _nested(outside.translate(None, _NO_BRACKETS).removesuffix(b"}"), 0, opened)
                if self.depth - closed >= 3:
                    self._keep(rest)
                    self.depth += len(opened) - closed - outside.endswith(b"}")
                    self.quoted, at = quoted, len(piece)
                    if self.depth == 2 and self.part is not None:
                        yield self._ended()
                    continue
            token = _TOKEN.match(piece, at)[0]
            at += len(token)
            if token == b'"':
                self.quoted = True
                self._keep(token)
            elif token in (b"[", b"{", b"]", b"}"):
                found = self._bracket(token)
                if found:
                    yield found
            else:
                if token == b"," and self.depth == 2 and self.inner == b"[":
                    self.position += 1
                    self.commas += 1
                self._keep(token)

    def rest(self) -> Iterator[tuple]:
        """The element that goes on in the next split."""
        if self.depth >= 2 and self.inner == b"[":
            self._count()
        if self.part is not None:
            yield self.position, self.begins, False, b"".join(self.part)


_CUT = "path string, block long, position long, begins boolean, ends boolean, part binary, elements long"
_CUT_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements of arrays at the second level, and a row with the frame for each split (its `elements` is set)."""
    key, scanner = None, None

    def finish() -> list[tuple]:
        rest = list(scanner.rest())
        return [(key[0], key[2], *e, None) for e in rest] + [(key[0], key[2], None, None, None, b"".join(scanner.frame), scanner.position)]

    for batch in batches:
        rows = []
        quoted, depth, inner = (batch.column(i).to_pylist() for i in (4, 5, 6))
        for own, pieces, first in _runs(batch):
            if own != key:
                if scanner is not None:
                    rows += finish()
                key, scanner = own, _Scanner(quoted[first], depth[first], inner[first])
                if own[2] == 0:
                    pieces[0] = pieces[0].removeprefix(MARK)
            rows.extend((key[0], key[2], *e, None) for piece in pieces for e in scanner.feed(piece + b"}"))
        yield _batch(rows, _CUT_KINDS, _CUT)
    if scanner is not None:
        yield _batch(finish(), _CUT_KINDS, _CUT)


def features_of_frame(frame: bytes) -> tuple[int, int] | None:
    """First and last position of the elements of `features`, if the frame is a collection's; of names that repeat the last one counts."""
    try:
        top = json.loads(frame, object_pairs_hook=tuple)
    except ValueError:
        return None
    if not isinstance(top, tuple) or dict(top).get("type") != "FeatureCollection":
        return None
    at, found = 0, None
    for name, value in top:
        span = (at + 1, at + 1 + sum(value)) if isinstance(value, list) else None
        at = span[1] if span else at
        found = span if name == "features" else found
    return found


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, parts, unclosed = (batch.column(i).to_pylist() for i in range(3))
        whole = [b"".join(p["part"] for p in ps) for ps in parts]
        spans = [(None if u else features_of_frame(w)) or (None if u is False else features_of_frame(w.removesuffix(b"}"))) for w, u in zip(whole, unclosed, strict=True)]
        kept = [(p, *s) for p, s in zip(own, spans, strict=True) if s]
        yield _batch(kept, [pa.string(), pa.int64(), pa.int64()], "path, low, high")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature_idx, feature) of feature collections: each element that is an object, as its JSON text, with its place in the list.

    A file that is no object, has another `type`, no list of `features` or unbalanced brackets
    is empty. The text of a feature isn't looked into: one that can't be parsed is for the
    reader to leave out. A compressed file is one task's work.
    """
    blocks = stored(feature_blocks(spark, path))
    pieces, starts = _pieces(spark, path), blocks.drop("unclosed")
    if is_dictionary(starts):
        met = pieces.join(F.broadcast(starts), ["path", "block"], "left")
    else:
        met = pieces.withColumn("seq", F.monotonically_increasing_id()).join(starts, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "seq")
    met = met.where(F.coalesce("holds", F.raise_error(F.concat("path", F.lit(" was divided otherwise in the first pass, at "), "block")).cast("boolean")))
    cut = stored(met.select("path", "size", "block", "piece", "quoted", "depth", "inner").mapInArrow(_cut, _CUT))
    splits = cut.where("elements IS NOT NULL").select("path", "block", "elements", "part")
    ends = blocks.groupBy("path").agg(F.max("unclosed").alias("unclosed"))
    frames = splits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts")).join(ends, "path")
    spans = frames.select("path", "parts", "unclosed").mapInArrow(_frames, "path string, low long, high long")
    so_far = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "block", F.coalesce(F.sum("elements").over(so_far), F.lit(0)).alias("before"))
    placed = stored(before.join(spans, "path"))
    elements = cut.where("elements IS NULL").join(F.broadcast(placed) if is_dictionary(placed) else placed, ["path", "block"])
    elements = elements.withColumn("place", F.col("before") + F.col("position")).where("place BETWEEN low AND high").withColumn("feature_idx", (F.col("place") - F.col("low")).cast("int"))
    whole = elements.where("begins AND ends").select("path", "feature_idx", "part")
    crossing = elements.where("NOT (begins AND ends)").groupBy("path", "feature_idx").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    joined = crossing.select("path", "feature_idx", F.aggregate("parts", F.unhex(F.lit("")), lambda text, p: F.concat(text, p["part"])).alias("part"))
    found = whole.unionByName(joined).withColumn("feature", F.col("part").cast("string"))
    return found.where("startswith(feature, '{')").select("path", "feature_idx", "feature")
