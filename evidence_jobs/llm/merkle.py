"""Merkle manifests of a dataset by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructType

from evidence_jobs.llm.common import column, packed, saved, shuffle_partitions, slices, unpacked

#: Children of a node, and levels that one round climbs: a task takes stretches of RUN^LEVELS nodes.
RUN, LEVELS = 16, 2
#: The lower-casing of a tampered text.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
_PATH_DDL = "array<struct<place: int, others: string>>"


def joined_digest(parts: str) -> str:
    """Lowercase hex SHA-256 of digests as hex text."""
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown)), 256)


def numbered(nodes: DataFrame, key: list[Column]) -> DataFrame:
    """nodes (grp, digest, more) with `at`, the place in their group by key (from 0), and `n`, the group's size.

    One range shuffle orders all groups at once; a task counts in its range, and what
    earlier ranges hold of the group is added from a table of one row for each range and group.
    """
    order = [F.col("grp").asc_nulls_first(), *key, F.col("digest")]
    parts = shuffle_partitions(nodes.sparkSession)

    def counted(batches):
        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for grp in batch.column("grp").to_pylist():
                at = at + 1 if grp == last else 0
                last = grp
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "in_part"])

    schema = StructType(nodes.schema.fields).add("part", LongType()).add("in_part", LongType())
    walked = saved(nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(counted, schema))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        walked.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("grp").alias("_g"), F.col("part").alias("_p"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_start"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    )
    found = walked.join(starts, (F.col("part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_g")))
    return found.select(*nodes.columns, (F.col("in_part") + F.col("_start")).alias("at"), "n")


def levels_of(n: int, most: int) -> int:
    """Levels over a group of n nodes, `most` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // RUN), levels + 1
    return levels


def swept_up(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """The digests of a stretch by label (level, index).

    Labels are visited in ascending order. Every node sends its digest to its parent's
    label; messages wait in a priority queue, so a node finds its children's digests, in
    order, at the head of the queue when its time has come.
    """
    found = {(0, i): d for i, d in enumerate(digests)}
    queue = [((1, i // RUN), i, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        found[label] = joined_digest("".join(children))
        if label[0] < levels:
            heapq.heappush(queue, ((label[0] + 1, label[1] // RUN), label[1], found[label]))
    return found


def swept_down(found: dict[tuple[int, int], str], levels: int, suffix: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """The proof of each leaf of a stretch: (place in its run, siblings' digests) level by level, ended by the suffix.

    The reversed sweep: labels in descending order, each sends its children what follows
    their own siblings in a proof, and finds its own message at the head of the queue.
    """
    top = max(label for label in found)
    queue, proofs = [((-top[0], -top[1]), suffix)], [suffix] * sum(label[0] == 0 for label in found)
    while queue:
        (level, index), after = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            proofs[index] = after
            continue
        children = [i for i in range(index * RUN, index * RUN + RUN) if (level - 1, i) in found]
        run = [found[(level - 1, i)] for i in children]
        for place, i in enumerate(children):
            heapq.heappush(queue, ((-(level - 1), -i), [(place, "".join(run[:place] + run[place + 1 :])), *after]))
    return proofs


def folded(digest: str, proof: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, others in proof:
        digest = joined_digest(others[: 64 * place] + digest + others[64 * place :])
    return digest


def _stretches(batches, names: list[str]):
    """Runs of rows with equal (grp, stretch), as lists of dicts; rows come ordered."""
    rows, key = [], None
    for batch in slices(batches):
        for row in batch.select(names).to_pylist():
            own = (row["grp"], row["stretch"])
            if rows and own != key:
                yield rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield rows


def _climbed(nodes: DataFrame, climb: int) -> DataFrame:
    """The nodes (grp, at, n, digest) that stand over the stretches of the given ones."""

    def up(batches):
        for rows in _stretches(batches, ["grp", "stretch", "n", "digest"]):
            n = rows[0]["n"]
            levels = levels_of(n, climb)
            top = swept_up([r["digest"] for r in rows], levels)[(levels, 0)]
            yield pa.RecordBatch.from_pylist([{"grp": rows[0]["grp"], "at": rows[0]["stretch"], "n": -(-n // RUN**climb), "digest": top}], schema=schema)

    schema = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    ordered = _by_stretch(nodes.select("grp", _stretch(climb), "at", "n", "digest"), "at")
    return ordered.mapInArrow(up, "grp string, at long, n long, digest string")


def _stretch(climb: int) -> Column:
    return F.call_function("div", F.col("at"), F.lit(RUN**climb)).alias("stretch")


def _by_stretch(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("grp", "stretch").sortWithinPartitions("grp", "stretch", *order)


def _messages(nodes: DataFrame, messages: DataFrame, climb: int) -> DataFrame:
    """Each stretch's message (path, subroot, root), then its nodes in order."""
    mail = messages.select("grp", F.col("at").alias("stretch"), F.lit(-1).cast("long").alias("at"), "path", "subroot", "root")
    return _by_stretch(nodes.select("*", _stretch(climb)).unionByName(mail, allowMissingColumns=True), "at")


def _proofs(rows: list[dict], climb: int):
    """(row, proof) of a stretch that begins with its message."""
    mail, nodes = rows[0], rows[1:]
    levels = levels_of(nodes[0]["n"], climb)
    proofs = swept_down(swept_up([r["digest"] for r in nodes], levels), levels, [(s["place"], s["others"]) for s in mail["path"]])
    return mail, zip(nodes, proofs, strict=True)


def _delivered(nodes: DataFrame, messages: DataFrame, climb: int) -> DataFrame:
    """messages (grp, at, path, subroot, root) for the given nodes, out of those for their stretches."""
    schema = pa.schema([("grp", pa.string()), ("at", pa.int64()), ("path", _PATH), ("subroot", pa.string()), ("root", pa.string())])

    def down(batches):
        for rows in _stretches(batches, ["grp", "stretch", "at", "n", "digest", "path", "subroot", "root"]):
            mail, found = _proofs(rows, climb)
            out = [{"grp": r["grp"], "at": r["at"], "path": [{"place": p, "others": o} for p, o in proof], "subroot": mail["subroot"], "root": mail["root"]} for r, proof in found]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _messages(nodes.select("grp", "at", "n", "digest"), messages, climb).mapInArrow(down, f"grp string, at long, path {_PATH_DDL}, subroot string, root string")


def _rounds(nodes: DataFrame, climb: int) -> list[DataFrame]:
    """The nodes, and those over their stretches, round by round, until every group has one."""
    found = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(saved(_climbed(found[-1], climb)))
        most = -(-most // RUN**climb)
    return found


def merkle_manifest(leaves: DataFrame, group: str, key: str, digest: str, claim: str | None = None, climb: int = LEVELS) -> DataFrame:
    """leaves with subroot, root, proof_sha256, folded_root and verified.

    A tree over the digests of each group (a string column), ordered by key, and one
    over the groups' subroots, ordered by name; every RUN consecutive nodes have one
    parent. proof_sha256 is the digest of all siblings on a leaf's way to the root;
    folded_root is the root that `claim` (digest, where it is null or not given) and
    these siblings give, and verified tells if that is the root.

    Time-forward processing: nodes are visited by label, and their digests wait for the
    parents in a priority queue ordered by label. Inside a stretch of RUN^climb nodes that
    is a heap; beyond it the queue is external: message rows, which Spark's ordered
    exchange brings to the task that has their receivers, `climb` levels a round. Then
    the rounds are swept in reverse and proof suffixes are delivered down to the leaves.
    No task holds more than a stretch, however large a group is.

    A null group is a group of its own, the first; null keys come first; rows with equal
    keys are ordered by digest, and repeated rows each keep a leaf; a null digest counts
    as an empty one; an empty table gives an empty result. Other columns may have any
    name; those of the five results are replaced.
    """
    results = ["subroot", "root", "proof_sha256", "folded_root", "verified"]
    names = [c for c in leaves.columns if c not in results]
    rows = leaves.select(
        packed(leaves, names).alias("row"), column(group).cast("string").alias("grp"), F.coalesce(column(digest), F.lit("")).alias("digest"),
        (F.coalesce(column(claim), column(digest), F.lit("")) if claim else F.coalesce(column(digest), F.lit(""))).alias("claim"), column(key).alias("key"),
    )
    placed = saved(numbered(rows.select("row", "grp", "digest", "claim", "key"), [F.col("key").asc_nulls_first()]))
    rounds = _rounds(placed, climb)
    subroots = rounds[-1].select(F.col("grp").alias("name"), "digest")
    over = saved(numbered(subroots.select(F.lit(None).cast("string").alias("grp"), "digest", "name"), [F.col("name").asc_nulls_first()]))
    upper = _rounds(over, climb)
    messages = upper[-1].select("grp", "at", F.array().cast(_PATH_DDL).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        messages = saved(_delivered(nodes, messages, climb))
    messages = over.select("at", "name", "digest").join(messages.drop("grp", "subroot"), "at").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[1:-1]):
        messages = saved(_delivered(nodes, messages, climb))
    return _proven(placed, messages, rows.schema["row"].dataType, climb).select(*unpacked("row", names), *results)


def _proven(placed: DataFrame, messages: DataFrame, row_type: DataType, climb: int) -> DataFrame:
    def down(batches):
        for rows, carried in _with_rows(batches):
            mail, found = _proofs(rows, climb)
            out = [(mail["subroot"], mail["root"], joined_digest("".join(o for _, o in proof)), folded(r["claim"], proof)) for r, proof in found]
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
            same = pa.array([r[1] == r[3] for r in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([carried, *columns, same], ["row", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = StructType().add("row", row_type)
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, StringType())
    return _messages(placed.select("grp", "at", "n", "digest", "claim", "row"), messages, climb).mapInArrow(down, schema.add("verified", "boolean"))


def _with_rows(batches):
    """Stretches as by _stretches, with their nodes' carried rows as an Arrow array."""
    rows, held, key = [], [], None
    for batch in slices(batches):
        carried = batch.column("row")
        plain = batch.select(["grp", "stretch", "at", "n", "digest", "claim", "path", "subroot", "root"]).to_pylist()
        start = 0
        for i, row in enumerate(plain):
            own = (row["grp"], row["stretch"])
            if rows and own != key:
                yield rows, pa.concat_arrays([*held, carried.slice(start, i - start)]).slice(1)
                rows, held, start = [], [], i
            key = own
            rows.append(row)
        held.append(carried.slice(start))
    if rows:
        yield rows, pa.concat_arrays(held).slice(1)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every row whose id's CRC is divisible by 5 claims a leaf of its lower-cased text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = saved(
        docs.select(
            "doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"),
            F.when(tampered, leaf_digest(*fields, F.translate("text", UPPER, LOWER))).alias("claim"),
        )
    )
    return merkle_manifest(leaves, "source", "doc_id", "leaf", "claim").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels that the SQL climbs: 16^5 documents a source, 16^4 sources.
_SQL_LEVELS = {"s": 5, "t": 4}


def _level_sql(name: str, k: int) -> str:
    """Nodes of level k + 1, and for each node of level k its place and siblings."""
    return f"""
{name}{k + 1} AS (
  SELECT grp, pos // {RUN} AS pos, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (n + {RUN - 1}) // {RUN} AS n
  FROM {name}{k} GROUP BY grp, pos // {RUN}, n),
{name}o{k} AS (
  SELECT a.grp, a.pos, a.n, a.pos % {RUN} AS place, coalesce(string_agg(b.d, '' ORDER BY b.pos), '') AS others
  FROM {name}{k} a LEFT JOIN {name}{k} b ON a.grp IS NOT DISTINCT FROM b.grp AND a.pos // {RUN} = b.pos // {RUN} AND a.pos <> b.pos
  GROUP BY a.grp, a.pos, a.n),"""


def _fold_sql(before: str, name: str, k: int, grp: str, at: str) -> str:
    return f"""
f{name}{k} AS (
  SELECT f.* EXCLUDE (proof, claim), f.proof || o.others AS proof,
         CASE WHEN o.n = 1 THEN f.claim ELSE sha256(substr(o.others, 1, 64 * o.place) || f.claim || substr(o.others, 64 * o.place + 1)) END AS claim
  FROM {before} f JOIN {name}o{k} o ON o.grp IS NOT DISTINCT FROM f.{grp} AND o.pos = f.{at} // {RUN**k}),"""


def _op12_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bit = "list_transform({0}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    table = "range(0, 256)"
    for _ in range(8):
        table = bit.format(table)
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tbl[xor(a & 255, b) + 1])), 4294967295::BIGINT)"
    sql = f"""
WITH tbl AS (SELECT {table} AS tbl),
leaves AS (
  SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lower)}) ELSE sha256({head} || {field("text")}) END AS claim
  FROM documents, tbl),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
s0 AS (SELECT source AS grp, pos, leaf AS d, n FROM placed),"""
    for k in range(_SQL_LEVELS["s"]):
        sql += _level_sql("s", k)
    sql += f"""
t0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, d, count(*) OVER () AS n, grp AS name FROM s{_SQL_LEVELS["s"]}),"""
    for k in range(_SQL_LEVELS["t"]):
        sql += _level_sql("t", k)
    sql += f"""
fold AS (
  SELECT p.doc_id, p.leaf, p.source, p.pos, t0.d AS subroot, r.d AS root, 0 AS tree, t0.pos AS source_at, '' AS proof, p.claim
  FROM placed p JOIN t0 ON t0.name IS NOT DISTINCT FROM p.source CROSS JOIN t{_SQL_LEVELS["t"]} r),"""
    before = "fold"
    for name, grp, at in (("s", "source", "pos"), ("t", "tree", "source_at")):
        for k in range(_SQL_LEVELS[name]):
            sql += _fold_sql(before, name, k, grp, at)
            before = f"f{name}{k}"
    return f"{sql[:-1]}\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = root AS verified FROM {before}"


OP12_SQL = _op12_sql()
