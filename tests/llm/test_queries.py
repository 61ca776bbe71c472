"""The registered queries against brute force, on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidence_jobs.llm import fingerprint, line_dedup, mixing, ngram_jaccard, packing, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_op4(spark, texts):
    rows = sharding.op4_sharding(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_large_populations_are_drawn_from_the_same_distribution():
    rng, n = np.random.default_rng(3), 4000
    for good, bad, draws in ((40, 60, 30), (900, 100, 500), (5, 4000, 700)):
        own = np.array([sharding.rejected_hypergeometric(rng, good, bad, draws) for _ in range(n)])
        other = rng.hypergeometric(good, bad, draws, n)
        assert own.min() >= max(0, draws - bad) and own.max() <= min(good, draws)
        assert abs(own.mean() - other.mean()) < 5 * other.std() / n**0.5 * 2**0.5
        assert abs(own.std() / other.std() - 1) < 0.08
    assert abs(sharding.hypergeometric(rng, 10**11, 10**12, 10**10) - 10**21 / (1.1 * 10**12)) < 10**6


def test_op5(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.op5_fingerprints(spark, SF).collect()}
    assert set(got) == set(texts)
    by_form = defaultdict(set)
    for i, doc in enumerate(order):
        text, after = texts[doc]["text"] or "", texts[order[(i + 1) % len(order)]]["text"] or ""
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        form = lambda t: fingerprint.unicodedata.normalize("NFKC", fingerprint.unicodedata.normalize("NFKC", t).casefold()).split()
        assert r["near_edited"] == float(form(text) == form(edited)) and r["near_next"] == float(form(text) == form(after))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (form(text) == form(edited))
        by_form[tuple(form(text))].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_form.values()) and len({next(iter(x)) for x in by_form.values()}) == len(by_form)


def test_op6(spark, texts):
    rows = mixing.op6_mixing(spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    taken, largest, target = Counter(), Counter(), {}
    for r in rows:
        source, n = texts[r["doc_id"]]["source"], len(words(texts[r["doc_id"]]["text"]))
        assert r["size"] == n and r["taken"] <= 3 * n
        taken[source] += r["taken"]
        largest[source], target[source] = max(largest[source], n), r["target"]
    total = sum(len(words(r["text"])) for r in texts.values())
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def brute_dedup(rows):
    """Every run of whole lines of 50 words or more, and every eligible chunk, against all earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = text.encode().split(b"\n")
        ends = line_dedup.chunk_ends(lines)
        runs = {(a, b) for a, b in zip([0, *ends], ends) if line_dedup.eligible(b"\n".join(lines[a:b]))}
        for a in range(len(lines)):
            n = 0
            for b in range(a + 1, len(lines) + 1):
                n += len(lines[b - 1].split())
                if n >= 50:
                    runs.add((a, b))
        drop, now = set(), set()
        for a, b in sorted(runs):
            key = tuple(lines[a:b])
            if key in seen or key in now:
                drop |= set(range(a, b))
            now.add(key)
        seen |= now
        out[doc] = "\n".join(x.decode() for i, x in enumerate(lines) if i not in drop)
    return out


def test_line_dedup_against_all_runs(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared = [[line(rng.randrange(4, 40)) for _ in range(rng.randrange(2, 12))] for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [line(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.7:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(shared)
        rows.append((i, "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "a b": F.lit(2), "removed_words": F.lit(3)})
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_row", "a b", "removed_chunks", "removed_words"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_dedup(rows)


def test_votes_against_all_cosines(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in quality.op7_quality_knn(spark, SF).collect():
        own = model.latent(quality.features(texts[r["doc_id"]]["text"])[None])[0].astype(float)
        cosines = sorted(((float(own @ v), float(y)) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        k = min(quality.NEIGHBOURS, len(cosines))
        if len(cosines) > k and cosines[k - 1][0] - cosines[k][0] < 1e-5:
            continue  # a tie at the edge
        votes = [(max(c, 0) ** 4 + 1e-9, y) for c, y in cosines[:k]]
        assert r["score"] == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=1e-3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


ODD = "doc_id long, text string, lang string, source string, n_chars int"


def test_pipeline_stages_on_odd_tables(spark, texts, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    good = next(r["text"] for r in texts.values() if r["source"] and len(r["text"] or "") > 800)
    rows = [(1, good, "en", "a", len(good)), (1, good, "en", "a", len(good)), (2, good, None, None, None), (3, None, None, "a", None), (None, "", "en", "b", 0), (None, None, None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, ODD)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
            docs = corpus_pipeline.saved(out)


@pytest.mark.parametrize("clash", [["copies", "below", "_hash", "row"], ["part", "_part", "place", "cuts"], ["key", "did", "th", "_row"], ["score", "a.b", "x y", "`q`"]])
def test_clashing_names(spark, clash):
    df = spark.createDataFrame([(i, f"one two three {i % 2}", "s", *[i] * len(clash)) for i in range(6)], f"doc_id long, text string, source string, {', '.join('`' + c.replace('`', '``') + '` long' for c in clash)}")
    own = [c for c in clash if c not in ("score",)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    results = [
        mixing.mix_sources(df, ["doc_id"]), sharding.uniform_shards(df, 4, ["doc_id"]), line_dedup.dedup_lines(df), ngram_jaccard.drop_near_duplicates(df), quality.score_quality(df, quality.train(df, labels)),
    ]
    for out in results:
        assert set(own) <= set(out.columns) and out.count() in (2, 6)
    assert packing.pack_documents(df, packing.tokenizer_file()).count() == 6 and fingerprint.fingerprint_documents(df).count() == 6
