"""Near-duplicate components by an exact Jaccard join over word n-grams.

Documents by n-grams is a sparse matrix, of which the product with its transpose is
wanted where it is large. Size-derived bounds keep it sparse: only the rarest n-grams of
a document, as many as a partner may lack and one more, can be its first common one
(prefix bound); sizes must be alike (size bound); and what follows the first common one
must suffice (position bound). Column blocks of the bounded matrix are dealt by n-gram;
pairs that reach a bound are summed up over whole rows, which gives exact overlaps. The
links of each document are then counted by products of blocks of rows inside components.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from evidence_jobs.llm.common import bit_table, column, in_table, packed, rolling_hashes, saved, slices, unpacked, word_hashes
from evidence_jobs.llm.components import connected_components

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 75
#: The order of n-grams comes from counts in 2**TABLE_BITS buckets (4 MB, one byte each), sent in runs of CHUNK.
TABLE_BITS, CHUNK = 22, 4096
#: N-grams counted over 2**HOT_BITS times have their column split into blocks of about that many rows.
HOT_BITS = 14
#: Classes of the signature whose sums bound an overlap from above.
CLASSES = 64
#: Blocks of columns up to this many rows give all their pairs at once; longer ones are tied by stars first.
SMALL_BLOCK = 16
#: While the pairs still to compare are more than so many times the postings, a round of stars comes first, as long as it halves them.
PAIRS_PER_POSTING = 4
#: Sets of a component that are multiplied with as many others at once, about, where links are counted.
LINK_BLOCK = 256
#: Bits of a size and of a position in a posting's packed word, and steps of an order level in an octave.
BITS, STEPS = 27, 4


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k consecutive words; of all words if there are fewer; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(rolling_hashes(hashes, min(k, len(hashes))) ^ np.uint64(max(0, k - len(hashes))))


def set_id(s: np.ndarray) -> int:
    """The first 64 bits of a set's 128-bit hash."""
    return int(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)[0])


def signature(s: np.ndarray) -> bytes:
    """How many shingles fall in each class, up to 65535."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES), 65535).astype("<u2").tobytes()


def _rows(batches):
    """One row a document, and the task's n-gram counts in compressed runs."""
    counts = np.zeros(1 << TABLE_BITS, np.uint32)
    schema = ["did", "th", "n", "sid", "second", "sig", "chunk", "counts"]
    kind = pa.int64()
    for batch in slices(batches):
        kind = batch.column(0).type
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        np.add.at(counts, (np.concatenate(sets) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64), np.uint32(1))
        wide = [np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
        some = [len(s) > 0 for s in sets]
        pick = lambda x: pa.array([v if ok else None for v, ok in zip(x, some, strict=True)], pa.int64())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pick([int(w[0]) for w in wide]), pick([int(w[1]) for w in wide]),
             pa.array(map(signature, sets), pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema)
    runs = [(i, r) for i, r in enumerate(counts.reshape(-1, CHUNK)) if r.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(runs), kind), *(pa.nulls(len(runs), t) for t in [pa.int64()] * 4), pa.nulls(len(runs), pa.binary()),
         pa.array([i for i, _ in runs], pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for _, r in runs], pa.binary())], schema)


def _summed(batches):
    """Runs that come sorted by chunk: one row of size classes a chunk."""
    now, total, out = None, None, []
    done = lambda: (now, np.ceil(STEPS * np.log2(total + 1.0)).astype(np.uint8).tobytes())
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != now:
                if now is not None:
                    out.append(done())
                now, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(zlib.decompress(data), np.uint32)
    if now is not None:
        out.append(done())
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["chunk", "levels"])


def ngram_levels(rows: DataFrame) -> np.ndarray:
    """STEPS times log2 of the count of every bucket of n-grams, over all documents."""
    runs = rows.where("chunk is not null").select("chunk", "counts")
    table = np.zeros((1 << TABLE_BITS) // CHUNK * CHUNK, np.uint8)
    for r in runs.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, levels binary").collect():
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return table


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of n n-grams, rarest first, hold a common one with every partner."""
    return n - -(-n * percent // 100) + 1


def postings(docs: DataFrame, levels) -> DataFrame:
    """(h, sid, w): the bounded matrix, column by column; w packs a hot flag, salt, size and position."""

    def bounded(batches):
        table, seen = levels.value, set()
        for batch in slices(batches):
            parts: list[tuple] = []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in seen:
                    continue
                seen.add(sid)
                level = table[(s & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
                first = np.lexsort((s, level))[: prefix_length(len(s))]
                over = np.clip(level[first].astype(np.int64) // STEPS - HOT_BITS, 0, 8)
                salt = (sid & 0xFF) % (1 << over)
                word = ((over > 0).astype(np.int64) << 62) | (salt << (2 * BITS)) | (len(s) << BITS) | np.arange(len(first))
                parts.append((s[first].view(np.int64), np.full(len(first), sid, np.int64), word))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "sid", "w"])

    return docs.select("_text").mapInArrow(bounded, "h long, sid long, w long")


def posting_columns(columns: DataFrame) -> DataFrame:
    """(h, sid, salt, hot, n, pos)."""
    w = F.col("w")
    part = lambda shift, bits: F.shiftright(w, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return columns.select("h", "sid", part(2 * BITS, 8).cast("int").alias("salt"), (part(62, 1) == 1).alias("hot"), part(BITS, BITS).cast("int").alias("n"), w.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("pos"))


def may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int = PERCENT) -> Column:
    """Size bound, and position bound for a first common n-gram at these positions."""
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    left = F.least(na - pa_, nb - pb)
    return sizes & (left.cast("long") * (100 + percent) >= (na + nb).cast("long") * percent)


def _sig_bound(batches):
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, CLASSES) for i in (4, 5))
        least = np.minimum(sa, sb)
        top = np.where((least == 65535).any(axis=1), np.minimum(na, nb), least.sum(axis=1, dtype=np.int64))
        ok = top * (100 + PERCENT) >= (na + nb) * PERCENT
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(na[ok]), pa.array(nb[ok])], ["a", "b", "na", "nb"])


def _overlaps(batches):
    for batch in slices(batches):
        a, b = batch.column(0), batch.column(1)
        sa, sb = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * (100 + PERCENT) >= (len(x) + len(y)) * PERCENT)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by whole rows.

    A bound from the signatures discards most pairs that don't. The sets of the others
    are made again from the text of each class's first document, which a bit table of
    the wanted documents finds; other texts are not looked at.
    """
    sig = lambda c: classes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    bounded = pairs.select("a", "b").join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    key = lambda c: classes.select(F.col("sid").alias(c), F.col("key").alias(f"k{c}"))
    left = saved(bounded.mapInArrow(_sig_bound, "a long, b long, na long, nb long").select("a", "b").join(key("a"), "a").join(key("b"), "b"))
    wanted = left.select(F.explode(F.array("ka", "kb")).alias("key")).distinct()
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "key", 26))

    def sets(batches):
        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(in_table(table.value, keys))
            found = [shingles(t).view(np.int64) for t in batch.column(1).take(pa.array(at)).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.concatenate([*found, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values))], ["key", "s"])

    own = docs.select("key", "_text").mapInArrow(sets, "key long, s array<bigint>")
    joined = left.join(own.select(F.col("key").alias("ka"), F.col("s").alias("sa")), "ka").join(own.select(F.col("key").alias("kb"), F.col("s").alias("sb")), "kb")
    return saved(joined.select("a", "b", "sa", "sb").mapInArrow(_overlaps, "a long, b long").distinct())


def _stars(columns: DataFrame, comp: Column, turn: int) -> DataFrame:
    """At most two pairs a set: with the star centres of the block that it meets most often and of its largest block.

    The centre of a block is, in the first turn, the member with the largest share of
    its n-grams in these columns, as an original has among its edited copies; later, one
    drawn by hash. Members of the centre's component have no pair. Blocks of a split
    column are tied by a star over their centres.
    """
    first = -F.col("share") if turn == 0 else F.lit(0.0)
    rank = F.struct(first.alias("f"), F.xxhash64(F.lit(turn), comp).alias("r"), comp.alias("c"), "sid", "n", "pos")
    block = Window.partitionBy("h", "salt")
    with_centre = columns.withColumn("centre", F.min(rank).over(block)).withColumn("size", F.count(F.lit(1)).over(block))
    own = with_centre.where((comp != F.col("centre.c")) & may_link(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos")))
    own = own.select("sid", F.col("centre.sid").alias("other"), "size")
    tops = with_centre.where("hot").groupBy("h", "salt").agg(F.first("centre").alias("centre"))
    top = tops.groupBy("h").agg(F.min("centre").alias("top"))
    ties = tops.join(top, "h").where("centre.c <> top.c").select(F.col("centre.sid").alias("sid"), F.col("top.sid").alias("other"), F.lit(0).cast("long").alias("size"))
    met = own.unionByName(ties).groupBy("sid", "other").agg(F.count(F.lit(1)).alias("m"), F.max("size").alias("size"))
    best = met.groupBy("sid").agg(F.max_by("other", F.struct("m", "other")).alias("x"), F.max_by("other", F.struct("size", "m", "other")).alias("y"))
    return best.select(F.col("sid").alias("a"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))


def _with_components(columns: DataFrame, comps: DataFrame) -> DataFrame:
    return columns.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")


def set_links(docs: DataFrame, classes: DataFrame, levels) -> DataFrame:
    """(node, component) of the distinct sets that have links.

    All pairs of short columns that the bounds allow are compared first. Long columns
    are tied by stars, which link a large group of near copies with a comparison or two
    a member. What then stands in a column in different components is compared pair by
    pair, so no link between components is missed; pairs inside one can't change it.
    """
    block = Window.partitionBy("h", F.shiftright("w", 2 * BITS))
    before = block.orderBy("sid").rowsBetween(1 - SMALL_BLOCK, -1)
    counted = postings(docs, levels).withColumn("m", F.count(F.lit(1)).over(block)).withColumn("prior", F.collect_list(F.struct("sid", "w")).over(before))
    short = (F.col("m") <= SMALL_BLOCK) & (F.col("w") < (1 << 62))
    dealt = counted.where("m > 1 or w >= " + str(1 << 62)).select("h", "sid", "w", short.alias("short"), F.when(short, F.col("prior")).alias("prior"))
    dealt = saved(dealt.where("not short or size(prior) > 0"))
    at = lambda w, shift: F.shiftright(w, shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    each = dealt.where("short").select("sid", "w", F.explode("prior").alias("o")).where(F.col("sid") != F.col("o.sid"))
    allowed = each.where(may_link(at(F.col("w"), BITS), at(F.col("w"), 0), at(F.col("o.w"), BITS), at(F.col("o.w"), 0)))
    found = verified(allowed.select(F.greatest("sid", "o.sid").alias("a"), F.least("sid", "o.sid").alias("b")).distinct(), docs, classes)
    links, comps = [found], connected_components(found)

    long = posting_columns(dealt.where("not short"))
    shares = long.groupBy("sid").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    columns = saved(long.join(shares, "sid"))
    n_postings, turn, last = columns.count(), 0, float("inf")
    while True:
        now = saved(_with_components(columns, comps))
        groups = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
        per_column = groups.groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m").cast("double") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("k")).where("k > 1")
        pairs = per_column.agg(F.coalesce(F.sum((F.col("m").cast("double") * F.col("m") - F.col("same")) / 2), F.lit(0.0))).first()[0]
        if turn and (pairs <= PAIRS_PER_POSTING * n_postings or pairs > last / 2):
            break
        found = verified(_stars(now, F.col("comp"), turn), docs, classes)
        turn, last = turn + 1, pairs
        links.append(found)
        comps = connected_components(reduce(DataFrame.unionByName, links))
    open_ = now.join(per_column.select("h"), "h", "left_semi")
    side = lambda c: open_.select("h", *(F.col(x).alias(f"{x}_{c}") for x in ("sid", "n", "pos", "comp")))
    ordered = (F.col("comp_a") != F.col("comp_b")) & (F.struct("n_a", "sid_a") < F.struct("n_b", "sid_b"))
    crossed = side("a").join(side("b"), "h").where(ordered & may_link(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")))
    links.append(verified(crossed.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct(), docs, classes))
    return connected_components(reduce(DataFrame.unionByName, links))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the left shares with each of the right: a sparse product, summed up shingle by shingle."""
    total = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return total
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), [len(s) for s in right])[order]
    for row, s in zip(total, left, strict=True):
        first, last = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        counts = last - first
        at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        row += np.bincount(owner[at], minlength=len(right))
    return total


def _block_links(table: pa.Table) -> pa.Table:
    """Two blocks of a component: (sid, links), the documents that link with each set by pairs across the blocks (within one, if both are the same)."""
    sides: list[dict] = [{}, {}]
    for sid, size, block, low, high, text in zip(*(table.column(c).to_pylist() for c in ("sid", "size", "block", "low", "high", "_text")), strict=True):
        if sid in sides[block != low]:
            continue
        s = shingles(text)
        if len(s) and set_id(s) == sid:
            sides[block != low][sid] = (s, size)
    same = table.num_rows > 0 and table.column("low")[0] == table.column("high")[0]
    left, right = sides[0], sides[0] if same else sides[1]
    lengths = [np.array([len(s) for s, _ in side.values()], np.int64) for side in (left, right)]
    weights = [np.array([size for _, size in side.values()], np.int64) for side in (left, right)]
    linked = overlaps([s for s, _ in left.values()], [s for s, _ in right.values()]) * (100 + PERCENT) >= (lengths[0][:, None] + lengths[1][None, :]) * PERCENT
    if same:
        np.fill_diagonal(linked, False)
    links = [linked @ weights[1], *([] if same else [weights[0] @ linked])]
    sids = [*left, *([] if same else right)]
    return pa.table({"sid": pa.array(sids, pa.int64()), "links": pa.array(np.concatenate(links), pa.int64())})


def link_counts(docs: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(sid, links): the documents with other sets that link with each set.

    Links stay inside components. The sets of one are dealt to blocks, and each two
    blocks (and each block with itself) are multiplied whole, so no pair is skipped; what
    leaves a block are sums by set, not pairs. The work grows with the square of a
    component's distinct sets.
    """
    sizes = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / LINK_BLOCK).cast("int").alias("blocks"))
    several = F.broadcast(sizes.where("blocks > 1"))
    members = comps.join(several, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumnRenamed("node", "sid")
    members = saved(members.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).join(classes.select("sid", "key", "size"), "sid"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(members, "key", 26))

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_table(table.value, batch.column(0).to_numpy(zero_copy_only=False))))

    own = docs.select("key", "_text").mapInArrow(wanted, "key long, _text string")
    each = own.join(members, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "size", "_text")
    summed = each.groupBy("component", "low", "high").applyInArrow(_block_links, "sid long, links long")
    return saved(summed.groupBy("sid").agg(F.sum("links").alias("links")))


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """One row per document: id, n_shingles long, component_id, and text_hash (xxhash64 of the text).

    With `links` also n_links long: how many other documents its set links with, equal
    sets included, whether a component needs these links or not.

    A document's set: distinct shingles of five words, lower-cased A-Z; with fewer words
    the whole sequence; without words it is empty and linked with nothing, and its
    component is its own id. Two sets link at a Jaccard similarity of 0.75 or more;
    component_id is the smallest id that links reach. Equal sets are one class and are
    compared once. Null texts count as empty; null ids stay null and are no component's
    smallest while another id is there; repeated rows each keep a row; other columns are
    left out. Shingles are compared by 64-bit hashes and sets by 128 bits; should two
    different sets share the first 64 of these, the run stops with an error.
    """
    hashed = F.xxhash64(column(text))
    rows = docs.select(column(id_column).alias("did"), hashed.alias("th"), column(text).alias("_text"), F.xxhash64(column(id_column), hashed).alias("key"))
    schema = StructType().add("did", rows.schema["did"].dataType).add("th", "long").add("n", "long").add("sid", "long").add("second", "long").add("sig", "binary").add("chunk", "integer").add("counts", "binary")
    made = saved(rows.select("did", "th", "_text").mapInArrow(_rows, schema))
    own = made.where("chunk is null")
    classes = saved(own.where("sid is not null").groupBy("sid").agg(F.min("did").alias("did"), F.min("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min("sig").alias("sig"), F.min_by(F.xxhash64("did", "th"), F.struct("did", "th")).alias("key"), F.min("second").alias("lo"), F.max("second").alias("hi")))
    if not classes.where("lo <> hi").isEmpty():
        raise ValueError("two different sets share a 64-bit hash")
    levels = docs.sparkSession.sparkContext.broadcast(ngram_levels(made))
    comps = set_links(rows, classes, levels)
    linked = classes.select("sid", "did").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = linked.groupBy("component").agg(F.min("did").alias("component_id"))
    named = linked.join(least, "component").select("sid", "component_id")
    if links:
        counted = classes.select("sid", "size").join(link_counts(rows, classes, comps), "sid", "left")
        named = named.join(counted.select("sid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "sid")
    out = own.select("did", "th", "n", "sid").join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("did")).otherwise(F.col("component_id"))
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select(F.col("did").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), *n_links, F.col("th").alias("text_hash"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; documents without words all stay."""
    found = saved(ngram_components(docs, id_column, text))
    stays = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(column(id_column).isNull().alias("none"), column(id_column).alias("id"), "text_hash")).alias("first"))
    keep = stays.select(F.col("first.id").alias("_kid"), F.col("first.text_hash").alias("_kth"), F.lit(False).alias("_bare"))
    bare = found.where("n_shingles = 0").select(column(id_column).alias("_kid"), F.col("text_hash").alias("_kth"), F.lit(True).alias("_bare")).distinct()
    rows = docs.select(packed(docs).alias("_row"), column(id_column).alias("_id"), F.xxhash64(column(text)).alias("_th"))
    joined = rows.join(keep.unionByName(bare), F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_th") == F.col("_kth")))
    once = Window.partitionBy("_kid", "_kth").orderBy(F.lit(1))
    return joined.withColumn("_n", F.row_number().over(once)).where("_bare or _n = 1").select(*unpacked("_row", docs.columns))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents, and the links of each."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), links=True).drop("text_hash")
