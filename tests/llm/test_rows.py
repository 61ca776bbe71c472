import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_jobs.llm import mixing, packing, quality, sharding


def test_shards_are_even_and_slots_gapless(docs, empty):
    keyed = docs.withColumns({"shard": F.lit("clash"), "slot": F.lit("clash")})
    rows = sharding.uniform_shards(keyed, 16, ["doc_id", "text"], seed=3).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.uniform_shards(empty, 16, ["doc_id"]).count() == 0


def test_communication_matrix_is_exact():
    counts, sizes = [10, 0, 25, 7], [14, 14, 14]
    matrix = np.array(sharding.communication_matrix(counts, sizes, 1))
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes and (matrix >= 0).all()
    mean = np.mean([sharding.communication_matrix([10, 10], [10, 10], s)[0][0] for s in range(400)])
    assert abs(mean - 5) < 0.3
    big = sharding.hypergeometric(np.random.default_rng(1), 10**10, 10**10, 10**6)
    assert abs(big - 5 * 10**5) < 5000


def brute_targets(sizes):
    """Weights reshared until no source is over three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **{s: 3 * sizes[s] for s in capped}}
        capped |= over


def test_mix_comes_near_its_targets(docs, empty):
    rows = mixing.mix_sources(docs, ["doc_id", "text"]).collect()
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        assert r["size"] == n and 0 <= r["times"] <= 3
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["times"]
        most[r["source"]] = max(most[r["source"]], n)
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 3 * most[s] for s in sizes)
    again = Counter((r["doc_id"], r["times"]) for r in mixing.mix_sources(docs, ["doc_id", "text"]).collect())
    assert again == Counter((r["doc_id"], r["times"]) for r in rows)
    assert mixing.mix_sources(empty, ["doc_id"]).count() == 0


def test_targets_with_a_tiny_source(spark):
    sizes = {"a": 1000, "b": 1, "c": 0, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_ids_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    encode, tokenizer, rng = packing._encoder(packing.tokenizer_file()), Tokenizer.from_file(packing.tokenizer_file()), random.Random(1)
    parts = ["a", "b ", "\n", " ", "'s", "1", "\t", "é", "  ", ".\n", "!", "don't", "ß", "<|endoftext|>", "日本", "\x85", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(3000)] + [r["text"] or "" for r in docs.collect()]
    for t in texts:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_is_gapless_and_near_the_bound(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    rows = packing.pack_documents(docs, packing.tokenizer_file()).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for p, s in enumerate(starts):
            part = ids[s : starts[p + 1] if p + 1 < len(starts) else None]
            want[r["doc_id"], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024
    assert len(sequences) == packing.lower_bound(np.array([r["length"] for r in rows]), 1024)
    assert packing.pack_documents(empty, packing.tokenizer_file()).count() == 0


def test_exchange_lowers_the_number_of_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 40)
    rng = random.Random(4)
    pieces = spark.createDataFrame([(i, 0, rng.choice([rng.randrange(1, 400), rng.randrange(300, 1025)])) for i in range(400)], "_row long, piece int, length long").repartition(1)
    got = packing.pack_pieces(pieces, 1024).collect()
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert len(got) == 400 and max(fills.values()) <= 1024
    assert len(fills) <= packing.lower_bound(np.array([r["length"] for r in got]), 1024) * 1.03 + 1


def test_lower_bound_never_exceeds_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        assert packing.lower_bound(lengths, 100) <= len(packing.best_fit_decreasing(lengths, 100)[2])
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3 and packing.lower_bound(np.array([], int), 100) == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op7_quality_knn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    bad = [r for r in rows if r["quality"] == 0]
    assert right >= 0.95 and sum(r["predicted"] == 0 for r in bad) >= 0.7 * len(bad)


def test_quality_defines_odd_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score_quality(docs, quality.train(empty, labels)).collect()} == {1.0}
    assert quality.score_quality(empty, model).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns
