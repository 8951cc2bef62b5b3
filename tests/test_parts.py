"""Parts of JSON lines: order, digests, and what is seen after failures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.sources import files, parts


def lines_of(path):
    manifest = parts.read_manifest(path)
    return b"".join(open(f"{path}/parts/{p['name']}", "rb").read() for p in manifest["parts"])


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k * 7 % 100, None if k % 9 == 0 else f"text {k}\né") for k in range(100)], "ord long, text string").repartition(6)


def test_parts_are_one_ordered_table(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    manifest = parts.write_parts(rows, path, ["ord"], part_rows=30)
    assert len(manifest["parts"]) == 4 and manifest["rows"] == 100
    got = [json.loads(x) for x in lines_of(path).splitlines()]
    assert got == [r.asDict() for r in rows.orderBy("ord").collect()]
    for p in manifest["parts"]:
        assert hashlib.sha256(open(f"{path}/parts/{p['name']}", "rb").read()).hexdigest() == p["sha256"]
    back = parts.read_parts(spark, path, "ord long, text string").orderBy("part", "line").collect()
    assert [r.ord for r in back] == list(range(100)) and parts.changed_parts(spark, path).count() == 0


def test_a_failed_write_leaves_nothing_visible(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    before = parts.write_parts(rows, path, ["ord"], part_rows=30)
    bad = rows.withColumn("text", F.when(F.col("ord") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        bad.sparkSession.dataSource.register(parts.PartsSink)
        bad.repartitionByRange(4, "ord").sortWithinPartitions("ord").select(F.to_json(F.struct("ord", "text")).alias("value")).write.format("jsonl_parts").option("path", path).mode("overwrite").save()
    assert parts.read_manifest(path) == before and parts.changed_parts(spark, path).count() == 0
    assert {p.name for p in (tmp_path / "out" / "parts").iterdir()} == {p["name"] for p in before["parts"]}
    (tmp_path / "out" / "parts" / "left-by-a-killed-task.jsonl").write_text('{"ord": -1}\n')
    assert parts.read_parts(spark, path, "ord long, text string").where("ord < 0").count() == 0


def test_replaced_and_appended(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    parts.write_parts(rows, path, ["ord"], part_rows=30)
    parts.write_parts(rows.where("ord < 10"), path, ["ord"])
    assert [json.loads(x)["ord"] for x in lines_of(path).splitlines()] == list(range(10)) and len(list((tmp_path / "out" / "parts").iterdir())) == 1
    parts.write_parts(rows.where("ord >= 95"), path, ["ord"], overwrite=False)
    assert [json.loads(x)["ord"] for x in lines_of(path).splitlines()] == [*range(10), *range(95, 100)]
    assert parts.write_parts(rows.limit(0), path, ["ord"])["rows"] == 0 and parts.read_parts(spark, path, "ord long").count() == 0


def test_changed_parts(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    manifest = parts.write_parts(rows, path, ["ord"], part_rows=30)
    one, two = (tmp_path / "out" / "parts" / manifest["parts"][k]["name"] for k in (0, 2))
    one.write_text("{}\n")
    two.unlink()
    assert {(r.name, r.problem) for r in parts.changed_parts(spark, path).collect()} == {(one.name, "digest"), (two.name, "missing")}
    with pytest.raises(FileNotFoundError):
        parts.read_parts(spark, str(tmp_path / "none"), "ord long")


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_digests_in_blocks(spark, tmp_path, block, monkeypatch):
    """A file far larger than a block, as one beyond memory would be."""
    texts = {"a.txt": b"one\n\n  \ntwo\nthree", "b.txt": b"", "c.txt": b"\n\n", "d.txt": b"x" * 5000 + b"\n" + b"y\r\n" * 300}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
        assert parts.streamed_digest(str(tmp_path / name), block) == (hashlib.sha256(data).hexdigest(), sum(bool(x.strip()) for x in data.split(b"\n")))
    got = {r.name: (r.sha256, r.rows) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), sum(bool(x.strip()) for x in d.split(b"\n"))) for n, d in texts.items()}
