import gzip
import json
import random

import pytest

from evidence_jobs.sources import feature_stream, readers


def whole(data: bytes) -> list[tuple[int, object]]:
    """The objects of a collection that is parsed in one piece."""
    try:
        top = json.loads(data.removeprefix(feature_stream.MARK))
    except ValueError:
        return []
    if not isinstance(top, dict) or top.get("type") != "FeatureCollection" or not isinstance(top.get("features"), list):
        return []
    return [(i, f) for i, f in enumerate(top["features"]) if isinstance(f, dict)]


def made(seed: int) -> bytes:
    r = random.Random(seed)
    word = lambda: r.choice(["", "}", "{[", '"', "\\", '\\"}', "é}", "a,b", "]]}}", "\n"]) * r.randint(0, 9)

    def value(depth: int):
        kind = r.randint(0, 5 if depth else 2)
        if kind < 3:
            return [word(), r.random(), None][kind]
        return [value(depth - 1) for _ in range(r.randint(0, 4))] if kind < 5 else {word(): value(depth - 1) for _ in range(r.randint(0, 3))}

    element = lambda: r.choice([{"p": value(3)}, {"geometry": value(4), "q": word()}, value(2), [], {}, None, 3, word()])
    pairs = [("type", "FeatureCollection"), ("features", [element() for _ in range(r.randint(0, 120))]), ("bbox", [1, 2, 3]), ("crs", {"a": [{"b": 1}, word()]}), ("arcs", [[[1, 2], {"x": word()}]] * 20), (word(), word())]
    r.shuffle(pairs)
    text = json.dumps(dict(pairs), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
    return r.choice([b"", feature_stream.MARK]) + text.encode() + r.choice([b"", b"\n", b" \n\n"])


@pytest.fixture(params=["211", "1000000"])
def splits(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_features_of_divided_files_equal_whole_ones(spark, tmp_path, splits):
    collection = lambda inner: b'{"type":"FeatureCollection","features":' + inner + b"}"
    files = {f"f{i}.geojson": made(i) for i in range(12)} | {
        "empty.geojson": b"", "none.geojson": b"{}", "list.geojson": b"[" + b'{"type":"Feature"},' * 50 + b"1]", "type.geojson": b'{"type":"Topology","features":[{}]}',
        "long.geojson": collection(b'[{"a":[' + b"[1,2]," * 500 + b'{"b":"}"}]},7,{"c":1}]'), "string.geojson": collection(b'[{"a":"' + b'\\"}{' * 300 + b'"},{"d":2}]'),
        "object.geojson": collection(b'{"x":[{"y":1}]}'), "open.geojson": collection(b"[" + b'{"a":{"b":1}},' * 60 + b"{}]")[:-1], "torn.geojson": collection(b'[{"a":{"b":1}}]')[:-5],
        "twice.geojson": b'{"features":[{"a":1},{"b":2}],"type":"FeatureCollection","features":[0,{"c":3}]}', "closers.geojson": collection(b"[{}]") + b"}}}", "extra.geojson": collection(b"[{}]") + b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in readers.read_features(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["feature_idx"], json.loads(r["feature"])))
    for name, data in files.items():
        assert sorted(got.get(name, []), key=lambda p: p[0]) == whole(data), name


def test_splits_start_inside_strings_and_shapes(spark, tmp_path):
    (tmp_path / "a.geojson").write_bytes(made(3))
    (tmp_path / "b.geojson").write_bytes(b'{"type":"FeatureCollection","features":[{"a":"' + b'\\"}{' * 300 + b'"}]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    try:
        blocks = feature_stream.feature_blocks(spark, str(tmp_path))
        assert blocks.where("quoted").count() > 3 and blocks.where("depth > 2").count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compressed_collections(spark, tmp_path):
    for name, end in (("a", b""), ("b", b"\n")):
        (tmp_path / f"{name}.geojson.gz").write_bytes(gzip.compress(b'{"type":"FeatureCollection","features":[{"a":1},{"b":2}]}' + end))
    assert readers.read_features(spark, str(tmp_path)).count() == 4


def test_more_splits_than_a_broadcast_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feature_stream, "is_dictionary", lambda df: False)
    for i in range(3):
        (tmp_path / f"f{i}.geojson").write_bytes(made(i))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r["path"].rsplit("/", 1)[1], r["feature_idx"], r["feature"]) for r in readers.read_features(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(p, i, json.loads(f)) for p, i, f in got] == [(f"f{n}.geojson", i, f) for n in range(3) for i, f in whole(made(n))]
