"""Source divergence audit: joint tables of term counts by one-hot level products."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.llm.common import column, saved, slices

#: Bytes that end a term become spaces; A-Z become a-z.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms that a task holds before it hands its counts on.
HELD_TERMS = 200_000
#: Count rows of a block, sources of a block, and columns of a tile of its product.
BLOCK_ROWS, BLOCK_GROUPS, TILE = 4096, 32, 512
#: Parts that stand for the whole mass.
SCALE = 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    """Matches of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; none for null."""
    return (text or "").encode().translate(_TO_TERMS).split()


def _batch(own: dict) -> pa.RecordBatch:
    flat = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in own.items() for term, n in counts.items()]
    langs, sources, terms, ns, ds = zip(*flat, strict=True) if flat else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _counted(batches):
    own: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in slices(batches, 64):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, docs = own.setdefault((lang, source), (Counter(), Counter()))
            terms, before = terms_of(text), len(counts)
            counts.update(terms)
            docs.update(set(terms))
            held += len(counts) - before
            if held >= HELD_TERMS:
                yield _batch(own)
                own, held = {}, 0
    yield _batch(own)


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total) of docs (lang, source, text): terms in at least least_docs documents of their lang.

    Tasks count before they hand on. One shuffle by (lang, term) serves the sums and
    the number of documents alike.
    """
    of_term = Window.partitionBy("lang", "term")
    return (
        docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact for any long counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = (wide(n) + F.lit(2).cast("decimal(3,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    down = wide(total) + wide(terms) * F.lit(2).cast("decimal(3,0)")
    return F.lit(1) + F.call_function("div", up.cast("decimal(38,0)"), down.cast("decimal(38,0)")).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); below 2^63 as p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def level_products(term: np.ndarray, group: np.ndarray, level: np.ndarray):
    """The columns (first row of each) of the one-hot matrix of a block, and (i, j, terms) of its product with its transpose.

    The matrix has a row for each term and a column for each (group, level); a cell of
    the product counts the terms that have level of i in group of i and level of j in
    group of j, so the cells of two groups are their joint table. It is made in tiles,
    in floats that hold counts up to 2^24 exactly. Only cells of group i < group j are given.
    """
    _, rows = np.unique(term, return_inverse=True)
    _, levels = np.unique(level, return_inverse=True)
    codes, first, columns = np.unique(group.astype(np.int64) * (levels.max() + 1) + levels, return_index=True, return_inverse=True)
    hot = np.zeros((rows.max() + 1, len(codes)), np.float32)
    hot[rows, columns] = 1
    of = group[first]
    cells = []
    for i in range(0, len(codes), TILE):
        for j in range(i, len(codes), TILE):
            product = hot[:, i : i + TILE].T @ hot[:, j : j + TILE]
            a, b = np.nonzero(product)
            keep = of[a + i] < of[b + j]
            cells.append((a[keep] + i, b[keep] + j, product[a[keep], b[keep]].astype(np.int64)))
    return first, tuple(np.concatenate(c) for c in zip(*cells, strict=True))


_BLOCK = ["lang", "class", "slice", "left", "right"]


def blocks(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """levels (lang, g, term, total, n, more) dealt into blocks of about BLOCK_ROWS rows and two times BLOCK_GROUPS groups.

    Terms of like frequency meet, so that a block has few levels. A row goes to every
    pair of group blocks that its own takes part in.
    """
    classed = levels.withColumn("class", F.floor(F.log2("total")).cast("int"))
    sizes = classed.groupBy("lang", "class").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("_slices"))
    widths = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_GROUPS)).alias("_blocks"))
    own = F.call_function("div", F.col("g"), F.lit(BLOCK_GROUPS)).cast("int")
    return (
        classed.join(sizes.join(widths, "lang"), ["lang", "class"])
        .withColumn("slice", F.pmod(F.xxhash64("term"), F.col("_slices")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
        .withColumns({"own": own, "left": F.least(own, "_other"), "right": F.greatest(own, "_other")})
        .drop("_slices", "_blocks", "_other")
    )


def _between(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of a block that are its own: of its left with its right groups."""
    own, left, right = (table[c].to_numpy() for c in ("own", "left", "right"))
    return (own[a] == left[0]) & (own[b] == right[0])


def _arrays(table: pa.Table, *names: str):
    return (table[c].to_numpy() for c in names)


def _joint(table: pa.Table) -> pa.Table:
    term, group, level = _arrays(table, "term", "g", "n")
    first, (a, b, n) = level_products(term, group, level)
    a, b = first[a], first[b]
    own = _between(table, a, b)
    a, b, n = a[own], b[own], n[own]
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "g": group[a], "level_g": level[a], "h": group[b], "level_h": level[b], "terms": n})


def joint_tables(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, level_g, h, level_h, terms): for every two groups g < h of a lang, how many terms have these counts, both over 0.

    What is missing to a group's terms of a level stands at level 0 of the other.
    """
    schema = "lang string, g int, level_g long, h int, level_h long, terms long"
    cells = blocks(levels, groups).groupBy(*_BLOCK).applyInArrow(_joint, schema)
    return cells.groupBy("lang", "g", "level_g", "h", "level_h").agg(F.sum("terms").alias("terms"))


def _priced(table: pa.Table) -> pa.Table:
    term, group, level, p, none = _arrays(table, "term", "g", "n", "p", "p_none")
    first, (a, b, n) = level_products(term, group, level)
    a, b = first[a], first[b]
    own = _between(table, a, b)
    a, b, n = a[own], b[own], n[own]
    value = n * (_gap(p[a], p[b]) - _gap(p[a], none[b]) - _gap(none[a], p[b]) + _gap(none[a], none[b]))
    pair, at = np.unique(group[a].astype(np.int64) << 32 | group[b], return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, at, value)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(pair), pa.string()), "g": (pair >> 32).astype(np.int32), "h": (pair & 0xFFFFFFFF).astype(np.int32), "value": total})


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a lang differ, and by which terms a source stands out.

    Part `pair` has every two sources of a lang, both ways, with the sum of gap() over
    the kept terms, taken from their joint tables: each block prices the cells of its
    products, cells at level 0 follow from how often a level occurs. Part `term` has the
    first `most` terms of each source that take a larger share there than in the lang.
    All arithmetic is in integers. Null langs, sources and texts count as ''; a source without terms is a group
    like any other; without kept terms values are 0; an empty table gives an empty
    result; repeated rows count each; ties go by the item's bytes; other columns are not read.
    """
    blank = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    kept = saved(term_counts(rows, least_docs))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_held"))
    groups = saved(
        rows.select("lang", "source").distinct()
        .join(held, ["lang", "source"], "left").join(terms, "lang", "left")
        .select(
            "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"),
            F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_held", F.lit(0)).alias("lang_held"),
        )
    )
    groups = groups.withColumn("p_none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("held"), F.col("terms"))))
    levels = saved(
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", "g", "term", "total", "n", share(F.col("n"), F.col("held"), F.col("terms")).alias("p"), "p_none", share(F.col("total"), F.col("lang_held"), F.col("terms")).alias("q"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    standing = (
        levels.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= most)
    )
    return pair_values(levels, groups).withColumn("rank", F.row_number().over(by_value)).unionByName(standing)


def pair_values(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every two groups of a lang, both ways."""
    priced = blocks(levels.select("lang", "g", "term", "total", "n", "p", "p_none"), groups).groupBy(*_BLOCK).applyInArrow(_priced, "lang string, g int, h int, value long")
    both = priced.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = both.unionByName(both.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p_none").alias("h_none"))
    pairs = groups.join(other, "lang").where("g != h")
    base = gap(F.col("p_none"), F.col("h_none"))
    found = levels.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("m"))
    single = found.join(pairs.select("lang", "g", "h", "p_none", "h_none"), ["lang", "g"]).groupBy("lang", "g", "h").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("h_none")) - base)).alias("value"))
    single = single.unionByName(single.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    added = both.unionByName(single).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    none = F.when(F.col("terms") > 0, F.col("terms") * base).otherwise(F.lit(0))
    return pairs.join(added, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (none + F.coalesce("value", F.lit(0))).alias("value"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The divergence audit of all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
e AS (SELECT lang, source, rid, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cell),
whole AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v.v) AS q FROM whole JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q)
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
