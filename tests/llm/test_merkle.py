import hashlib

import pytest

from evidence_jobs.llm.merkle import folded, merkle_manifest, swept_down, swept_up

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    """Levels of a list of digests up to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((at % 16, "".join(run[: at % 16] + run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    """{key order: results} of (group, key, digest, claim)."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in groups}
    trees = {g: tree([r[2] for r in order[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for place, g in enumerate(groups):
        for at, row in enumerate(order[g]):
            path = way(trees[g], at) + way(top, place)
            back = row[3] if row[3] is not None else row[2]
            for where, others in path:
                back = H(others[: 64 * where] + back + others[64 * where :])
            out.append((*row[:3], trees[g][-1][0], top[-1][0], H("".join(o for _, o in path)), back, back == top[-1][0]))
    return sorted(out, key=str)


def leaves(spark, sizes):
    rows = [(g, i, H(f"{g}{i}"), H("no") if i % 5 == 0 else None) for g, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "grp string, at long, digest string, claim string, root string, n int")


def found(df):
    return sorted((tuple(r) for r in df.select("grp", "at", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 2, "é": 1, "z": 16}, {"b": 300, "a": 257, None: 1}, {f"g{i}": 1 + i % 3 for i in range(40)}])
def test_against_brute_force(spark, sizes):
    rows, df = leaves(spark, sizes)
    assert found(merkle_manifest(df, "grp", "at", "digest", "claim")) == brute(rows)


def test_many_rounds(spark):
    rows, df = leaves(spark, {"a": 600, "b": 20, **{f"g{i}": 1 for i in range(20)}})
    assert found(merkle_manifest(df, "grp", "at", "digest", "claim", climb=1)) == brute(rows)


def test_repeated_rows_null_keys_and_own_columns(spark):
    rows = [("a", 1, H("x"), None), ("a", 1, H("x"), None), ("a", None, H("y"), None), (None, 1, H("x"), None)]
    df = spark.createDataFrame([(*r, 7, "own") for r in rows], "grp string, `k.e` long, digest string, claim string, stretch int, row string")
    got = merkle_manifest(df, "grp", "k.e", "digest")
    assert found(got.withColumnRenamed("k.e", "at")) == brute(rows)
    assert {(r["stretch"], r["row"]) for r in got.select("stretch", "row").collect()} == {(7, "own")}
    assert all(r[0] for r in got.select("verified").collect())


def test_empty(spark):
    assert merkle_manifest(leaves(spark, {"a": 1})[1].limit(0), "grp", "at", "digest").count() == 0


def test_sweeps():
    digests = [H(str(i)) for i in range(200)]
    nodes = swept_up(digests, 2)
    assert nodes[(2, 0)] == tree(digests)[-1][0]
    for digest, proof in zip(digests, swept_down(nodes, 2, []), strict=True):
        assert folded(digest, proof) == nodes[(2, 0)]
