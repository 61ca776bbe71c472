"""Automaton, first rows, reachability and the shared search, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evidence_jobs.operators import index, places, resolve, retrieval
from evidence_jobs.operators.firsts import first_rows, first_values
from evidence_jobs.operators.phrases import shards, with_phrases

WORDS = "ab abc b bc ca ward 1 2 x".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_phrases(spark, most_bytes):
    phrases = sorted({" ".join(t.split()[:3]) for t in texts(40, 2)})
    rows = [(i, t) for i, t in enumerate([*texts(60), None, ""])]
    given = spark.createDataFrame([(p,) for p in [*phrases, None, phrases[-1]]], "p string")
    df = spark.createDataFrame(rows, "id int, text string")
    got = with_phrases(df, {"inside": ("text", given, False), "words": ("text", given, True)}, most_bytes).collect()
    assert len(list(shards(given, most_bytes))) > 1 or most_bytes > 40
    for r in got:
        held = [] if r["text"] is None else [p for p in phrases if p]
        assert r["inside"] == [p for p in held if p in r["text"]]
        assert r["words"] == [p for p in held if f" {p} " in f" {r['text']} "]


def test_containments_and_candidates(spark):
    names, queries = sorted(set(texts(30, 3))), sorted(set(texts(30, 4)))
    p = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "place_id int, query string")
    wards = spark.createDataFrame([(f"w{i}", n, n.upper(), "", n[:4]) for i, n in enumerate(names)], "ward_key string, normalized_name string, zone string, corporation string, assembly_constituency string")
    got = {(r["place_id"], r["ward_key"], r["match_score"]) for r in places.ward_candidates(p, wards).collect()}
    score = lambda n, q: 1.0 if n == q else 0.85 if q in n else 0.75 if n in q else 0
    want = {(i, f"w{j}", score(n, q)) for i, q in enumerate(queries) for j, n in enumerate(names) if q and n and score(n, q)}
    assert got == want
    assert places.area_candidates(p, wards).count() > 0


def test_first_rows(spark):
    rows = [(k, random.Random(k * i).random(), i) for k in range(5) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, at double, v int")
    got = {r["k"]: r["v"] for r in first_values(df, ["k"], ["at", "v"], "v", 3).collect()}
    assert got == {k: [v for _, v in sorted((a, v) for kk, a, v in rows if kk == k)[:3]] for k in range(5)}
    plan = first_rows(df, ["k"], ["at"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def walked(mappings):
    """What the walk reaches, mapping by mapping in order."""
    out = set()
    for start in {n for m in mappings for n in m[1:] if n}:
        known = {start}
        for seq in sorted({m[0] for m in mappings}):
            before = set(known)
            known |= {y for s, a, b in mappings if s == seq and a != b and a and b for x, y in ((a, b), (b, a)) if x in before}
        out |= {(start, n) for n in known}
    return out


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_reachability(spark, monkeypatch, limit):
    rng = random.Random(9)
    mappings = [(i // 2, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(40)] + [(99, "", "n1"), (7, "n3", "n3")]
    monkeypatch.setattr(places, "DICTIONARY_ROWS", limit)
    df = spark.createDataFrame(mappings, "seq long, o string, n string")
    got = {tuple(r) for r in resolve.reached_through(df, "o", "n").collect()}
    assert got == {(s, r) for s, r in walked(mappings) if any(s in (a, b) and a != b and a and b for _, a, b in mappings)}


def test_reachability_of_dense_mappings_is_quick(spark):
    rng = random.Random(4)
    dense = [(i, f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for i in range(1000)]
    chain = [(1000 + i, f"c{i}", f"c{i + 1}") for i in range(1000)]
    df = spark.createDataFrame(dense + chain, "seq long, o string, n string")
    began = time.time()
    got = resolve.reached_through(df, "o", "n").groupBy(F.substring("start", 1, 1).alias("k")).count().collect()
    assert time.time() - began < 60
    assert {r["k"]: r["count"] for r in got} == {"n": 36, "c": 1001 * 1002 // 2 + 1000}


def asked(spark, rows):
    schema = "case_id int, query string, names array<string>, numbers array<string>, issue_keys array<string>, wants_complaints boolean, wants_money boolean, needs_money boolean, wants_assets boolean, terms array<string>, all_terms array<string>, complaint_terms array<string>, money_terms array<string>"
    return spark.createDataFrame(rows, schema)


def chunk_table(spark):
    made = [(f"complaint|s|f|{i}", "complaint", "s", "f", i, f"Road complaint {i}", t, {"status": "Open" if i % 2 else "Closed", "external_complaint_id": f"e{i}", "staff_name": "x", "grievance_date": f"2025-01-{i + 1:02d}"}, f"2025-01-{i + 1:02d}") for i, t in enumerate(["pothole at ward12 near market", "pothole in alpha", "garbage in alpha", "road of beta"])]
    rows = spark.createDataFrame(made, "chunk_key string, chunk_type string, source_id string, raw_file string, row_number long, title string, text string, fields map<string,string>, date string")
    return index.with_search_text(rows)


def test_spoken_numbers_raise_the_score(spark):
    """A row that only the spoken ward number meets passes and gets the place's ten points."""
    q = asked(spark, [(1, "road at gamma", ["gamma"], ["12"], ["road"], True, False, False, False, ["road"], ["road", "road", "at"], ["pothole"], []), (2, "road at gamma", ["gamma"], ["12"], ["road"], True, False, False, False, ["road"], ["road", "road", "at"], ["pothole"], [])])
    chunks = chunk_table(spark)
    buckets = chunks.select("chunk_key", "chunk_type", F.lit("place").alias("kind"), F.lit("complaint:place:gamma").alias("bucket"))
    found = retrieval.search(q, chunks, buckets)
    assert found.questions.count() == 1
    rows = found.to_cases(found.rows).collect()
    assert {(r["case_id"], r["external_complaint_id"]) for r in rows} == {(1, "e0"), (2, "e0")}
    assert {r["score"] for r in rows} == {3 + 8 + 10}  # road twice, at once


def test_tracks_and_stats(spark):
    q = asked(spark, [(1, "alpha road garbage", ["alpha"], [], ["garbage", "road", "water"], True, False, False, False, ["alpha"], ["alpha"], [], []), (2, "any road", [], [], ["garbage", "road"], True, False, False, False, ["road"], ["road"], [], [])])
    chunks = chunk_table(spark)
    names, numbers = spark.createDataFrame([("alpha",), ("beta",)], "name string"), spark.createDataFrame([("12", ["gamma"])], "number string, names array<string>")
    buckets = index.bucket_keys(chunks, index.place_keys(chunks, names, numbers))
    assert {(r["bucket"], r["chunk_key"][-1]) for r in buckets.where("kind = 'place'").collect()} == {("complaint:place:alpha", "1"), ("complaint:place:alpha", "2"), ("complaint:place:beta", "3"), ("complaint:place:gamma", "0")}
    found = retrieval.search(q, chunks, buckets)
    tracks = {(r["case_id"], r["issue"]): (r["rows"], r["complaint_ids"]) for r in found.to_cases(retrieval.issue_tracks(found.questions, found.rows)).collect()}
    assert tracks[(1, "garbage")] == (1, "e2") and tracks[(1, "water")] == (0, "")
    assert tracks[(2, "road")][0] == 4 and tracks[(2, "road")][1] == ",".join(r["external_complaint_id"] for r in sorted(found.to_cases(found.rows).where("case_id = 2").collect(), key=lambda r: r["rank"])[:3])
    stats = index.bucket_stats(index.stats_rows(chunks, names, numbers))
    got = {r["case_id"]: r for r in index.question_stats(q, stats).collect()}
    assert got[1]["complaint_count"] == 2 and got[1]["latest_record_date"] == "2025-01-03"
    assert got[2]["complaint_count"] == 5  # a row of both issues counts in both
    assert got[2]["example_ids"] == ["e2", "e0", "e1", "e3"]


def test_empty_tables(spark):
    q = asked(spark, []).limit(0)
    chunks = chunk_table(spark).limit(0)
    buckets = chunks.select("chunk_key", "chunk_type", F.lit("place").alias("kind"), F.lit("b").alias("bucket"))
    found = retrieval.search(q, chunks, buckets)
    assert found.to_cases(found.rows).count() == 0
    empty = spark.createDataFrame([], "seq long, o string, n string")
    assert resolve.reached_through(empty, "o", "n").count() == 0
