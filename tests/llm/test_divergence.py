from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evidence_jobs.llm import divergence
from evidence_jobs.llm.divergence import joint_tables, level_products, source_divergence, term_counts, terms_of


def rows_of(df):
    return [(r["lang"] or "", r["source"] or "", r["text"] or "") for r in df.collect()]


def brute(rows, least, most):
    """The audit of (lang, source, text) by dictionaries."""
    out = []
    for lang in sorted({r[0] for r in rows}):
        docs = [(s, terms_of(t)) for la, s, t in rows if la == lang]
        seen = Counter(x for _, t in docs for x in set(t))
        kept = sorted(t for t in seen if seen[t] >= least)
        sources = sorted({s for s, _ in docs}, key=str.encode)
        counts = {s: Counter(x for o, t in docs if o == s for x in t if seen[x] >= least) for s in sources}
        whole = sum(counts.values(), Counter())
        part = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        gap = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in sources:
            pairs = [(o, sum(gap(part(counts[s], t), part(counts[o], t)) for t in kept)) for o in sources if o != s]
            own = [(t.decode(), gap(part(counts[s], t), part(whole, t))) for t in kept if counts[s][t] and part(counts[s], t) > part(whole, t)]
            for name, found, cut in (("pair", pairs, None), ("term", own, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, s, name, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_docs(spark):
    words = ["Élan", "zeta", "alpha", "beta", "B2b", "x-y", "gamma"]
    rows = [("en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, " ".join(words[: 1 + i % 7] * (1 + i % 5)), "clash", 1) for i in range(90)]
    rows += [("xx", "only", None, "clash", 1), ("xx", "other", "", "clash", 1), ("en", "bare", "12 34", "clash", 1), *rows[:3]]
    return spark.createDataFrame(rows, "lang string, source string, text string, item string, value long")


def test_against_brute_force(spark):
    docs = odd_docs(spark)
    assert found_of(source_divergence(docs, least_docs=10, most=3)) == brute(rows_of(docs), 10, 3)


def test_many_groups_and_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("BLOCK_GROUPS", 2)):
        monkeypatch.setattr(divergence, name, value)
    docs = odd_docs(spark)
    assert found_of(source_divergence(docs, least_docs=2, most=5)) == brute(rows_of(docs), 2, 5)


def test_joint_tables(spark):
    docs = odd_docs(spark).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(docs, 2)
    numbers = {s: i for i, s in enumerate(sorted({r[1] for r in rows_of(docs)}))}
    of = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
    levels = counts.withColumn("g", of[F.col("source")].cast("int"))
    groups = docs.select("lang", "source").distinct()
    got = Counter({tuple(r)[:5]: r["terms"] for r in joint_tables(levels, groups).collect()})
    cells, by_term = Counter(), {}
    for r in levels.collect():
        by_term.setdefault((r["lang"], r["term"]), []).append((r["g"], r["n"]))
    for (lang, _), held in by_term.items():
        cells.update((lang, *a, *b) for a, b in combinations(sorted(held), 2))
    assert got == cells and got


def test_products_are_joint_counts(monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 5)
    rng = np.random.default_rng(1)
    seen = {(int(t), int(g)): int(n) for t, g, n in rng.integers(0, 9, (300, 3))}
    term, group = (np.array(x) for x in zip(*seen, strict=True))
    level = np.array(list(seen.values()))
    first, (i, j, n) = level_products(term, group, level)
    got = {(group[first[a]], level[first[a]], group[first[b]], level[first[b]]): c for a, b, c in zip(i, j, n, strict=True)}
    want = Counter((g, seen[t, g], h, seen[t, h]) for t in range(9) for g, h in combinations(range(9), 2) if (t, g) in seen and (t, h) in seen)
    assert got == want


def test_empty(spark):
    assert source_divergence(odd_docs(spark).limit(0)).count() == 0
