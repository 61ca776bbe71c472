import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_jobs.llm import components, fingerprint, line_dedup, ngram_jaccard, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least if sets[i] else rows[i][0]) for i in members]
    return Counter(out)


@pytest.mark.parametrize("block", [16, 1])
def test_components_are_those_of_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_jaccard, "SMALL_BLOCK", block + 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_components(docs).collect())
    assert got == brute_components(rows)


def test_split_columns_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT_BITS", 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_components(docs).collect())
    assert got == brute_components(rows)


def test_one_document_of_each_component_stays(docs, empty):
    kept = ngram_jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for (d, n, c) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]) if n}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(i for i in ids if (texts[i] or "").split()) == Counter(want)
    assert ngram_jaccard.ngram_components(empty).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.05, (300, 16)).round(2).tolist()
    vectors[7] = vectors[9] = vectors[11]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (450, [float("nan")] * 16), (500, [None, *[1.0] * 15]), (None, [1.0] * 16), (550, [1e30] + [0.0] * 15), (551, [1e30] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, 256.0).collect()}
    exact = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in exact if i % 50 == 0]:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(exact[q], exact[i], strict=True)))), i) for i in exact if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    assert topk.exact_topk(df.limit(0), df, 5).count() == 0


def test_fingerprints_group_equal_forms(docs, empty, spark):
    rows = fingerprint.fingerprint_documents(docs).collect()
    forms = defaultdict(list)
    for r in docs.collect():
        forms[fingerprint.canonical(r["text"])].append(r["doc_id"])
    by_id = {r["doc_id"]: r for r in rows}
    for ids in forms.values():
        known = [i for i in ids if i is not None]
        assert {by_id[i]["fingerprint"] for i in ids} == {by_id[ids[0]]["fingerprint"]}
        assert by_id[ids[0]]["copies"] == len(ids) and by_id[ids[0]]["group_id"] == min(known, default=None)
    assert len({r["fingerprint"] for r in rows}) == len(forms)
    assert fingerprint.fingerprint_documents(empty).count() == 0
    assert fingerprint.digest("ﬁ  Straße\n") == fingerprint.digest("fi STRASSE")


def test_colliding_fingerprints_are_told_apart(docs, monkeypatch):
    found = docs.select("doc_id", F.lit("00112233445566778899aabbccddeeff").alias("fingerprint"))
    monkeypatch.setattr(fingerprint, "repeated_forms", lambda d, f, t: d.select(F.lit("00112233445566778899aabbccddeeff").alias("fingerprint"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("form")).distinct().withColumn("n", F.lit(1)))
    monkeypatch.setattr(fingerprint, "canonical", lambda t: (t or "").encode())
    assert fingerprint.resolved(docs, found).count() >= docs.count()


def test_edited_texts_follow_the_next_document(spark, tmp_path):
    rows = [(1, "abcdef"), (2, None), (5, "xy"), (3, "päö!"), (4, "q" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    import hashlib

    order = sorted(rows, reverse=True)
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint.op5_fingerprints(spark, str(tmp_path)).collect()} == want


def test_line_dedup_keeps_first_occurrences(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "removed_chunks", "removed_words"]
    rows = got.collect()
    assert len(rows) == docs.count()
    seen, left = {}, Counter()
    for r in sorted(docs.dropDuplicates(["doc_id", "text"]).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        for c in line_dedup.chunks(r["text"]):
            if line_dedup.eligible(c):
                left[c] += c in seen
                seen.setdefault(c, r["doc_id"])
    by_id = {r["doc_id"]: r for r in rows}
    assert sum(r["removed_chunks"] for r in by_id.values()) == sum(left.values()) > 0
    for r in rows:
        assert (r["text"] is None) == (next(x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"]) is None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_chunk_boundaries_survive_a_shift():
    lines = [f"line {i} words".encode() for i in range(200)]
    a, b = line_dedup.chunk_ends(lines), line_dedup.chunk_ends([b"new", b"lines", *lines])
    assert len(set(a) & {x - 2 for x in b}) >= 0.95 * len(a)
    assert line_dedup.chunk_ends([]) == [] and b"\n".join(line_dedup.chunks("a\n\nb")) == b"a\n\nb"


def test_line_dedup_removes_every_repeated_run_of_fifty_words(spark):
    """Two lines of 30, three of 20, six of 10 and one of 60 words, each between other lines; short lines and short runs stay."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    runs = [[line(f"p{n}k{i}w", n) for i in range(k)] for k, n in ((2, 30), (3, 20), (6, 10), (1, 60), (7, 8))] * 4
    rows, want = [], {}
    for i, run in enumerate(runs * 3):
        run = [f"{x} g{i % len(runs)}" for x in run]
        around = [line(f"d{i}x{j}y", 7) for j in range(4)]
        rows.append((i, "\n".join([*around[:2], *run, *around[2:], "said once more"])))
        want[i] = rows[-1][1] if i < len(runs) else "\n".join([*around, "said once more"])
    rows.append((900, "\n".join([line("t", 10)] * 12)))
    want[900] = "\n".join([line("t", 10)] * 5)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    words = {i: len(t.split()) for i, t in rows}
    assert all(r["removed_words"] == words[r["doc_id"]] - len(want[r["doc_id"]].split()) for r in got)


@pytest.mark.parametrize("block", [256, 2])
def test_links_are_those_of_all_pairs(docs, monkeypatch, block):
    """Links inside a component count too: near copies of one text, copies and repeated rows."""
    monkeypatch.setattr(ngram_jaccard, "LINK_BLOCK", block)
    base = [f"v{i}" for i in range(90)]
    more = [(700 + i, " ".join([*base[: i * 3], f"new{i}", *base[i * 3 + 1 :]]), "s", 0) for i in range(20)]
    df = docs.unionByName(docs.sparkSession.createDataFrame(more + more[:3], docs.schema))
    rows, sets = [(r["doc_id"], r["text"]) for r in df.collect()], []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    want = Counter((rows[i][0], len(a), sum(near(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets))
    got = Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in ngram_jaccard.ngram_components(df, links=True).collect())
    assert got == want and max(n for _, _, n in want) > 15
