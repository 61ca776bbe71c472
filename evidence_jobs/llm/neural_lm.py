"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from evidence_jobs.llm.common import column, packed, saved, slices, unpacked

#: The token that ends every text; no word is empty.
END = b""
#: What the base model adds to every count.
ADDED = 0.1
#: The model: embedding size, noise tokens to a token, passes over the pair counts, contexts of a step, its rate, and the prior's weight.
SIZE, NOISE, PASSES, BLOCK, RATE, PRIOR = 48, 8, 40, 256, 0.03, 0.5
#: Terms that a counting task holds, and tokens it collects, before it hands on.
HELD, CODES = 200_000, 1_000_000
#: Contexts whose counts come to the driver in one row.
ROWS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Sizes:
    """words, classes: units beside the END, which are the commonest words, and classes by ending of all others.

    frequent: tokens whose counts are broadcast, at most; the others' counts are joined.
    """

    words: int = 1_535
    classes: int = 256
    frequent: int = 65_536

    @property
    def units(self) -> int:
        return 1 + self.words + self.classes


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one END; for null the END alone."""
    return [*(text or "").encode().translate(_LOWER).split(), END]


def word_class(word: bytes, classes: int) -> int:
    """The class of a word without a unit of its own, by its last three characters."""
    return xxh3_64_intdigest(word.decode()[-3:].encode()) % classes


@dataclass(frozen=True)
class Vocabulary:
    """What scoring knows of all tokens: totals, the frequent tokens' counts and units, and the mass of each class.

    A word without a unit of its own has a class by its ending; a class gives its words
    shares by count + ADDED, and one more share of ADDED to all words it never saw.
    """

    sizes: Sizes
    total: int
    distinct: int
    place: dict[bytes, int]
    counts: np.ndarray
    units: np.ndarray
    in_class: np.ndarray
    masses: np.ndarray

    @property
    def base_divisor(self) -> float:
        return self.total + ADDED * (self.distinct + 1)


def _counted(batches):
    found: Counter = Counter()

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    for part in slices(batches, 64):
        for text in part.column(0).to_pylist():
            found.update(tokens(text))
        if len(found) >= HELD:
            yield batch()
            found.clear()
    yield batch()


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts (one column); tasks count before they hand on."""
    return texts.mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The tokens of at least the least count that at most `most` tokens reach; the END always.

    Counts are binned finely by their logarithm, so the histogram that comes to the
    driver has some thousand rows at any size.
    """
    bins = F.floor(F.log2("n") * F.lit(64)).cast("int")
    over, least = 0, 1 << 30
    for row in counts.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("bin").desc()).toLocalIterator():
        if over + row["rows"] > most - 1:
            break
        over, least = over + row["rows"], row["bin"]
    return counts.where((bins >= least) | (F.col("token") == F.lit(END)))


def learn_vocabulary(counts: DataFrame, sizes: Sizes) -> Vocabulary:
    """Of the saved (token, n): exact totals over all tokens, and the frequent tokens."""

    def class_of(batches):
        for batch in slices(batches, 4096):
            found = [word_class(w, sizes.classes) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column(1)], ["class", "n"])

    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = _frequent(counts, sizes.frequent).select("token", "n").toArrow()
    found = sorted(zip(common["n"].to_pylist(), common["token"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    words = [t for _, t in found]
    units = np.zeros(len(words), np.int64)
    single = [w for w in words if w != END][: sizes.words]
    number = {w: i for i, w in enumerate(single, 1)} | {END: 0}
    for i, word in enumerate(words):
        units[i] = number[word] if word in number else 1 + sizes.words + word_class(word, sizes.classes)
    masses = np.full(sizes.classes, ADDED)
    for row in counts.mapInArrow(class_of, "class int, n long").groupBy("class").agg(F.sum(F.col("n") + F.lit(ADDED)).alias("mass")).collect():
        masses[row["class"]] += row["mass"]
    numbers = np.array([n for n, _ in found], np.int64)
    in_class = units > sizes.words
    for i, word in enumerate(words):
        if not in_class[i]:  # it has a unit of its own, so its class goes without it
            masses[word_class(word, sizes.classes)] -= numbers[i] + ADDED
    return Vocabulary(sizes, total, distinct, {w: i for i, w in enumerate(words)}, numbers, units, in_class, np.maximum(masses, ADDED))


def unit_sequence(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(places among the frequent tokens, -1 for others; units) of a text's tokens."""
    places = np.fromiter(map(vocabulary.place.get, words, repeat(-1)), np.int64, len(words))
    units = vocabulary.units[places] if len(vocabulary.units) else np.zeros(len(words), np.int64)
    for i in np.flatnonzero(places < 0):
        units[i] = 1 + vocabulary.sizes.words + word_class(words[i], vocabulary.sizes.classes) if words[i] != END else 0
    return places, units


def pair_counts(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts by unit and unit of (unit before, unit) over all tokens of all texts; before the first stands END.

    Tasks sum into a matrix of their own; at most units^2 sums come to the driver, at any size.
    """
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)
    units_all = vocabulary.sizes.units

    def pairs(batches):
        sums, codes, held = np.zeros(units_all * units_all, np.int64), [], 0
        for batch in slices(batches, 64):
            for text in batch.column(0).to_pylist():
                _, units = unit_sequence(tokens(text), known.value)
                codes.append(np.concatenate([[0], units[:-1]]) * units_all + units)
                held += len(units)
            if held >= CODES:
                sums += np.bincount(np.concatenate(codes), minlength=len(sums))
                codes, held = [], 0
        if codes:
            sums += np.bincount(np.concatenate(codes), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield from pa.Table.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["code", "n"]).to_batches(max_chunksize=100_000)

    width = ROWS * units_all

    def block(table: pa.Table) -> pa.Table:
        codes, counts = table["code"].to_numpy(), np.zeros(width, np.int64)
        counts[codes % width] = table["n"].to_numpy()
        return pa.table({"block": pa.array([codes[0] // width], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    sums = texts.mapInArrow(pairs, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = sums.groupBy(F.call_function("div", F.col("code"), F.lit(width)).alias("block")).applyInArrow(block, "block int, counts binary")
    out = np.zeros((-(-units_all // ROWS), width))
    for row in found.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)[: units_all * units_all].reshape(units_all, units_all)


@dataclass(frozen=True)
class LogBilinear:
    """score(unit before u, unit v) = context[u] . target[v] + bias[v]."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all units after each of the units, by one matrix product."""
        scores = self.context[before] @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return scores / np.log(10)

    def table(self) -> np.ndarray:
        """log_probabilities of every unit, in batches."""
        return np.concatenate([self.log_probabilities(np.arange(i, min(i + BLOCK, len(self.bias)))) for i in range(0, len(self.bias), BLOCK)])


def train(pairs: np.ndarray, seed: int = 7) -> LogBilinear:
    """The model that tells the pairs from noise.

    Noise-contrastive estimation: each token stands against NOISE tokens drawn by unit
    frequency, and the model learns to tell which is which by logistic regression on
    score - log(NOISE * frequency). Pairs come as counts of the whole corpus, and noise
    with its expected counts, which is the estimator's limit of ever new draws; so a
    step is a few matrix products over a block of contexts, and training costs the same
    at any size of the corpus. The bias begins at the log frequency, so before any
    step the model gives the unit frequencies.
    """
    rng, units = np.random.default_rng(seed), len(pairs)
    frequency = (pairs.sum(axis=0) + ADDED) / (pairs.sum() + ADDED * units)
    log_noise = np.log(NOISE * frequency).astype(np.float32)
    state = [rng.normal(0, 0.1, (units, SIZE)).astype(np.float32), rng.normal(0, 0.1, (units, SIZE)).astype(np.float32), np.log(frequency).astype(np.float32)]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    used = np.flatnonzero(pairs.sum(axis=1))
    noise = (NOISE * frequency).astype(np.float32)
    weight = PRIOR / max(1, len(used))
    steps = 0
    for done in range(PASSES):
        rate = RATE * (1 - done / PASSES)
        rng.shuffle(used)
        for start in range(0, len(used), BLOCK):
            rows = used[start : start + BLOCK]
            real = pairs[rows].astype(np.float32)
            drawn = real.sum(axis=1, keepdims=True) * noise
            scores = state[0][rows] @ state[1].T + state[2]
            told = 1 / (1 + np.exp(-np.clip(scores - log_noise, -30, 30)))
            slope = (real - (real + drawn) * told) / real.sum(axis=1, keepdims=True) ** 0.5
            # A context counts by the root of its number, so that a few do not drown the rest.
            gradients = [slope @ state[1] - PRIOR * state[0][rows], slope.T @ state[0][rows] - weight * state[1] * len(rows), slope.sum(axis=0)]
            steps += 1
            for i, gradient in enumerate(gradients):
                at = rows if i == 0 else slice(None)
                first[i][at] = 0.9 * first[i][at] + 0.1 * gradient
                second[i][at] = 0.98 * second[i][at] + 0.02 * gradient**2
                moves = done * (1 if i == 0 else -(-len(used) // BLOCK)) + (1 if i == 0 else start // BLOCK + 1)
                state[i][at] += rate * (first[i][at] / (1 - 0.9**moves)) / (np.sqrt(second[i][at] / (1 - 0.98**moves)) + 1e-6)
    return LogBilinear(*state)


_SCORED = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.struct([("token", pa.binary()), ("m", pa.int64())])))])
_SCORED_DDL = "rid long, n_tokens long, n_known long, base double, model double, rare array<struct<token: binary, m: bigint>>"


def _scored(rows: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """rows (rid, text) with what a task can tell of a text: all but the counts of its rarer tokens, which are listed."""
    known = rows.sparkSession.sparkContext.broadcast((vocabulary, model))

    def score(batches):
        vocabulary, model = known.value
        table = model.table()
        shares = np.log10(vocabulary.counts + ADDED)
        masses = np.log10(vocabulary.masses)
        divisor = np.log10(vocabulary.base_divisor)
        for batch in slices(batches, 64):
            out = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                places, units = unit_sequence(words, vocabulary)
                met = places[places >= 0]
                rest = units[units > vocabulary.sizes.words] - vocabulary.sizes.words - 1
                # A class shares its probability by count; what the rare counts add comes with the join.
                inside = shares[met[vocabulary.in_class[met]]].sum() - masses[rest].sum()
                row = {"rid": rid, "n_tokens": len(words), "n_known": len(met), "base": shares[met].sum() - len(words) * divisor}
                row["model"] = table[np.concatenate([[0], units[:-1]]), units].sum(dtype=np.float64) + inside
                rare = Counter(words[i] for i in np.flatnonzero(places < 0))
                out.append(row | {"rare": [{"token": t, "m": m} for t, m in rare.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=_SCORED)

    return rows.mapInArrow(score, _SCORED_DDL)


def score_texts(docs: DataFrame, trained: Column, text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    Rows where `trained` holds are learnt from. Counts of all their tokens make the base
    score. The model predicts the unit after a unit; a word without a unit of its own
    takes its share of its class, by the counts of the corpus, so every word has a
    probability and all of them sum to one. Counts of the sizes.frequent commonest tokens are
    broadcast (as is the model, about 1 MB); rarer tokens, none of which is a hot key,
    meet their counts in a join.

    A null text is empty and has the END alone; without rows to learn from every score
    of the base is 0 and the model knows classes only; repeated rows each keep a row; an
    empty table gives an empty result. Existing columns of the five names are replaced;
    all others may have any name.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in docs.columns if c not in results]
    counts = saved(token_counts(docs.where(trained).select(column(text))))
    vocabulary = learn_vocabulary(counts, sizes)
    model = train(pair_counts(docs.where(trained).select(column(text)), vocabulary))
    rows = saved(_with_ids(docs, names, text))
    found = saved(_scored(rows.select("rid", "text"), vocabulary, model))
    met = found.select("rid", F.explode("rare").alias("x")).select("rid", "x.token", "x.m").join(counts, "token", "left")
    share = F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))
    late = met.groupBy("rid").agg(F.sum(share).alias("late"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("late_known"))
    joined = rows.select("rid", "row").join(found.drop("rare"), "rid").join(late, "rid", "left")
    more = F.coalesce("late", F.lit(0.0))
    return joined.select(
        *unpacked("row", names), "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def _with_ids(docs: DataFrame, names: list[str], text: str) -> DataFrame:
    """(rid, row, text), rid unique by task and place."""
    rows = docs.select(packed(docs, names).alias("row"), column(text).alias("text"))

    def number(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + batch.num_rows), pa.int64()), *batch.columns], ["rid", *batch.schema.names])
            rid += batch.num_rows

    return rows.mapInArrow(number, StructType().add("rid", "long").add("row", rows.schema["row"].dataType).add("text", "string"))


def held_out(key: Column) -> Column:
    """Whether the CRC of the key as text is divisible by 10; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score_texts(docs, ~F.col("held_out")).drop("text")
