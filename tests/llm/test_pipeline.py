from collections import Counter

import pytest

import corpus_pipeline
from evidence_jobs.llm import quality
from evidence_jobs.llm.common import saved

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert list(STAGES) == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == docs.columns
        sizes.append(out.count())
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            kept = {r["doc_id"] for r in out.collect()}
            rows = docs.collect()
            scores = model.scores([r["text"] for r in rows])
            assert kept == {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
        docs = out
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2]


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with a shared passage, near copies, exact copies, null and empty texts, and columns that clash with the operators' own."""
    shared = words("s", 60)
    texts = [f"{words('a', 40)}\n{shared}", f"{words('b', 30)}\n{shared}\n{words('c', 20)}", words("d", 100), words("d", 98) + " x y", words("e", 50), words("e", 50), None, "", "one two", "One two", *(words(f"k{i}x", 20 + i) for i in range(30))]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, -1, "keep", -2, 0.5, -3, "r", 7, -4) for i, t in enumerate(texts)]
    names = "doc_id long, text string, source string, size int, `a.b` string, removed_words int, target double, times int, row string, _copy int, source_size int"
    return spark.createDataFrame([*rows, rows[4]], names)


def result(spark, name, docs):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and out.schema == docs.schema or name in ("line_dedup", "mixing")
    rows = [r.asDict() for r in out.collect()]
    own = {"size": -1, "a.b": "keep", "removed_words": -2, "target": 0.5, "times": -3, "row": "r", "_copy": 7, "source_size": -4}
    assert all(r[k] == v for r in rows for k, v in own.items())
    return rows


def test_line_dedup_stage(spark, corpus):
    got = {r["doc_id"]: r["text"] for r in result(spark, "line_dedup", corpus)}
    shared, first = words("s", 60), {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert got[0] == first[0] and got[1] == f"{words('b', 30)}\n{words('c', 20)}"
    assert shared not in got[1] and got[6] is None
    assert all(got[i] == first[i] for i in first if i not in (1, 5))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicate_stage(spark, corpus):
    rows = sorted({(r["doc_id"], r["text"]) for r in corpus.collect()}, key=lambda r: r[0])
    kept = []
    for i, text in rows:  # here links make groups without chains, so the first of each stays
        own = shingles(text)
        if not any(own and 100 * len(own & shingles(t)) >= 75 * len(own | shingles(t)) for _, t in kept):
            kept.append((i, text))
    got = Counter((r["doc_id"], r["text"]) for r in result(spark, "near_duplicates", corpus))
    assert got == Counter(kept)
    assert len(kept) < len(rows)


def test_mixing_stage(spark, corpus):
    """Copies are whole, at most three, and each source comes within a document of its water-level target."""
    first = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in corpus.collect()]
    got = Counter((r["doc_id"], r["source"]) for r in result(spark, "mixing", corpus))
    sizes = Counter()
    for _, source, n in first:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    held = Counter(i for i, _, _ in first)
    taken = Counter()
    for i, source, n in first:
        taken[source] += n * got[i, source] / held[i]
    most = max(n for _, _, n in first) * 2
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert all(got[i, s] <= 3 * held[i] for i, s, _ in first)


def test_packing_stage(spark, corpus):
    rows = [r.asDict() for r in STAGES["packing"](spark, corpus, SF).collect()]
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in corpus.collect())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 1024


def test_stages_of_nothing(spark, corpus):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus.limit(0), SF).count() == 0, name


def test_columns_that_are_missing(spark, corpus):
    bare = corpus.select("doc_id", "text", "source")
    for name in ("quality", "line_dedup", "near_duplicates", "mixing"):
        assert STAGES[name](spark, bare, SF).columns == bare.columns
