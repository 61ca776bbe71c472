"""Best-fit packing of tokenised documents, with bounds that certify each partition."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidence_jobs.llm.common import column, saved, slices

#: Pieces that one partition packs at a time, and rounds of exchange at most.
PART_PIECES, ROUNDS = 50_000, 4
#: The byte-level pre-tokens of the vocabulary file (a fixed value of its format).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone, with single spaces, take the quick way to the same ids; others go to the tokenizer.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\u024F\u2010-\u2027]*")


def _byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _quick_encoder(path: str):
    """Ids of a text by the same merges, without the tokenizer's bookkeeping; None if the file is of another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    model, before = parsed["model"], parsed.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab")
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not parsed.get("normalizer")
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    if model.get("type") != "BPE" or not plain or any(vocabulary.get(p) != 256 + i for i, p in enumerate(pairs)):
        return None
    names, special = _byte_names(), {t["content"] for t in parsed.get("added_tokens", [])}
    ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    encoding = tiktoken.Encoding("words", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def _encoder(path: str):
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    Each task makes its own, so that a worker holds nothing of it afterwards.
    """
    from tokenizers import Tokenizer

    tokenizer, quick_ids = Tokenizer.from_file(path), _quick_encoder(path)

    def encode(text: str) -> bytes:
        if quick_ids is None or "<|" in text or "  " in text or text[-1:] == " " or not PLAIN.fullmatch(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return quick_ids(text).astype("<u4").tobytes()

    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones with the rest first."""
    if length <= capacity:
        return [(0, length)]
    rest = length % capacity
    return [(0, rest)] * (rest > 0) + [(s, capacity) for s in range(rest, length, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, id, piece, start, length, ids_crc32): all pieces of all documents, saved.

    _row tells repeated rows apart.
    """
    rows = docs.select(column(id_column).alias("doc"), column(text).alias("text"))
    names = ["_row", "doc", "piece", "start", "length", "ids_crc32"]

    def tokenize(batches):
        encode, row = _encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            at = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((row, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    at.append(i)
                row += 1
            rows, pieces, starts, lengths, crcs = zip(*out, strict=True) if out else [()] * 5
            columns = [pa.array(rows, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType().add("_row", "long").add("doc", rows.schema["doc"].dataType).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return saved(rows.mapInArrow(tokenize, schema))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions.

    The volume bound, and for every limit k up to half the capacity: a piece over
    capacity - k counts as a whole bin, one under k as nothing, others as they are; and
    for large pieces, floor((m + 1) * x) / m rounded, for m from 1 to 20.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    volume = np.cumsum(counts * np.arange(capacity + 1))
    number = np.cumsum(counts)
    k = np.arange(1, capacity // 2 + 1)
    whole = number[capacity] - number[capacity - k]
    middle = volume[capacity - k] - volume[k - 1]
    best = max(-(-int(volume[-1]) // capacity), int((whole + -(-middle // capacity)).max()))
    x = np.arange(capacity + 1)
    for m in range(1, 21):
        share = np.where((m + 1) * x % capacity == 0, x * m, (m + 1) * x // capacity * capacity)  # times m * capacity
        best = max(best, -(-int((share * counts).sum()) // (m * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin. Longest first, each into the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    some, fill = 0, []  # bit f of some: a bin with f free
    for i in order.tolist():
        size = int(lengths[i])
        fitting = some >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                some &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            open_bins[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def _packer(capacity: int, base: int, last: bool):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_row", "piece"], ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = len(fill) - bound
        # The emptiest bins go back: a fixed number when certified, else those around the gap.
        back = np.argsort(fill, kind="stable")[: 0 if last else max(4, 32 * gap)]
        kept = np.ones(len(fill), bool)
        kept[back[fill[back] < capacity]] = False
        key = base + int(part["_part"].iloc[0])
        return pd.DataFrame({"_row": part["_row"], "piece": part["piece"], "sequence_id": (key << 32) + bins, "offset": offsets, "bins": len(fill), "bound": bound, "kept": kept[bins]})

    return pack


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (_row, piece, length) with sequence_id and offset.

    Every partition packs its pieces by best-fit decreasing. A partition whose number
    of bins equals its lower bound is certified. One with a gap, and every partition's
    last bins that are far from full, give their pieces back; these are dealt anew into
    fewer partitions and packed again, until nothing is given back that could help.
    A piece's place hangs on its hash, so no partition gets more than its share. `bins`
    and `bound` are the certificate of the partition that packed a piece: how many bins
    it used, and the least that any packing of its pieces needs.
    """
    schema = "_row long, piece int, sequence_id long, offset long, bins int, bound int, kept boolean"
    left, n = pieces.select("_row", "piece", "length"), pieces.count()
    done, used = [], 0
    for step in range(ROUNDS + 1):
        parts, last = max(1, -(-n // PART_PIECES)), step == ROUNDS or n <= PART_PIECES

        dealt = left.withColumn("_part", F.pmod(F.xxhash64(F.lit(step), "_row", "piece"), F.lit(parts)).cast("int"))
        packed = saved(dealt.groupBy("_part").applyInPandas(_packer(capacity, used, last), schema))
        done.append(packed.where("kept").drop("kept"))
        used += parts
        if last:
            break
        left = left.join(packed.where(~F.col("kept")).select("_row", "piece"), ["_row", "piece"])
        n = packed.where(~F.col("kept")).count()
        if not n:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return pieces.join(out, ["_row", "piece"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound.

    Null and empty texts are the end id alone. Repeated rows are documents of their own.
    A null id stays null; other columns are left out. No document is dropped; only those
    over the capacity are cut.
    """
    packed = pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id, id_column, text), capacity)
    return packed.select(F.col("doc").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
