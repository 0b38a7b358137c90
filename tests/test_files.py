"""Sources and sinks: exact spans, archives, hashes, CSV with odd texts, stages, shards."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from parley.functions import exact_json
from parley.sources import files


def test_exact_json_spans():
    data = b' [ {"a" : [1, "x]\\" ,"] , "b\\u0031":{}} ,\n -1.5e3, "s, [", [ ], true ]\n'
    spans = list(exact_json.children(data))
    assert [data[a:b] for _, a, b in spans] == [b'{"a" : [1, "x]\\" ,"] , "b\\u0031":{}}', b"-1.5e3", b'"s, ["', b"[ ]", b"true"]
    _, a, b = spans[0]
    assert [(k, data[x:y]) for k, x, y in exact_json.children(data, a, b)] == [(b"a", b'[1, "x]\\" ,"]'), (b"b\\u0031", b"{}")]
    assert data[slice(*exact_json.member(data, b"a", a, b))] == b'[1, "x]\\" ,"]'
    assert list(exact_json.children(b"[]")) == list(exact_json.children(b" { } ")) == []
    with pytest.raises(KeyError):
        exact_json.member(b"{}", b"x")
    for bad in (b"", b"1", b"[1,]", b"[1 2]", b"[1", b"[1}", b"[[1]", b"{1:2}", b'{"a"}', b'{"a":}', b'{"a":1,}', b"[1]]", b"[1] 2", b"[,1]", b'["x]', b'{"a" 1}', b'{"a":1 "b":2}', b"[:1]"):
        with pytest.raises(ValueError):
            list(exact_json.children(bad))


def test_exact_json_against_the_decoder():
    import random

    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 4)
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}
        return [rng.randrange(99), rng.choice(['"\\[', "é,}", ""]), None, 1.5][kind]

    for _ in range(300):
        v = [value(0) for _ in range(rng.randrange(5))]
        data = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        assert [json.loads(data[a:b]) for _, a, b in exact_json.children(data)] == v


def test_archives_and_hashes(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("d/one.txt", b"one"), ("two.bin", b"\xff")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("three.txt", "drei")
    got = {(r["name"], bytes(r["content"]), r["utf8"]) for r in files.archive_members(spark, f"{tmp_path}/*").collect()}
    assert got == {("d/one.txt", b"one", True), ("two.bin", b"\xff", False), ("three.txt", b"drei", True)}
    f = {r["path"].rsplit("/", 1)[1]: r for r in files.hashed_files(spark, f"{tmp_path}/*", {"b.zip": "0" * 64}).collect()}
    assert f["b.zip"]["verified"] is False and f["a.tar.gz"]["verified"] is None
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(Exception, match="unsafe member"):
        files.archive_members(spark, f"{tmp_path}/bad.zip").collect()


def test_csv_of_odd_texts(spark, tmp_path):
    rows = [(1, 'a "b", c\nd\r\n e'), (2, ""), (3, None), (4, "  \\N x\\\"y "), (5, "é\t🙂")]
    d = spark.createDataFrame(rows, "k int, t string")
    got = files.csv_table(spark, files.write_csv(d, f"{tmp_path}/c")).collect()
    want = {str(k): t for k, t in rows}
    assert {r["k"]: r["t"] and r["t"].replace("\r\n", "\n") for r in got} == {k: t and t.replace("\r\n", "\n") for k, t in want.items()}


def test_stages_and_shards(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for inputs in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert files.stage(spark, str(tmp_path), "s", inputs, make).count() == 3
    assert len(made) == 2
    files.stage(spark, str(tmp_path), "s", {"v": 2}, make, force=True)
    assert len(made) == 3
    seen = []

    def half(d):
        seen.append(d.count())
        return d

    todo = spark.range(100)
    files.resume_shards(todo.where("id < 0"), "id", 4, f"{tmp_path}/shards", half)
    assert files.resume_shards(todo, "id", 4, f"{tmp_path}/shards", half).count() == 100
    assert files.resume_shards(todo, "id", 4, f"{tmp_path}/shards", half).count() == 100 and seen == [0, 100, 0]


def test_review_page_and_manifest(spark, tmp_path):
    page = files.review_page(spark.createDataFrame([("<b>", None)], "a string, b string"), "t & u")
    assert "&lt;b&gt;" in page and "t &amp; u" in page and "<b>" not in page
    at = files.write_table(spark.range(10).repartition(2), f"{tmp_path}/m")
    m = files.manifest(spark, at).first()
    assert m["files"] == 2 and len(m["sha256"]) == 64


def test_blobs_fail_when_broken(spark, tmp_path):
    d = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "k int, c binary")
    rows = files.put_blobs(d, "c", f"{tmp_path}/b")
    assert rows.select("digest").distinct().count() == files.get_blobs(spark, f"{tmp_path}/b").count() == 2
    broken = spark.read.parquet(f"{tmp_path}/b").withColumn("digest", F.lit("0" * 64))
    broken.write.parquet(f"{tmp_path}/broken")
    with pytest.raises(Exception, match="is broken"):
        files.get_blobs(spark, f"{tmp_path}/broken").collect()
