import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks


@pytest.fixture
def tree(tmp_path):
    for d in ("", "dir.0", "dir.0/dir.0.0"):
        os.makedirs(tmp_path / "t" / d, exist_ok=True)
        for i in range(4):
            (tmp_path / "t" / d / f"dat.{i}").write_text(f"{d}-{i}\n")
    (tmp_path / "t" / ".hidden").write_text("x")
    return tmp_path / "t"


def test_names(spark, tree, tmp_path):
    assert files.file_names(spark, [str(tree)], subdirectories=True).count() == 12
    with pytest.raises(ValueError):
        files.file_names(spark, [str(tree)])
    with pytest.raises(FileNotFoundError):
        files.file_names(spark, [str(tree / "no")])
    (tmp_path / "list").write_text(f"# names\n  {tree}/dat.0 \n\n{tree}/dat.1")
    names = files.file_names(spark, [str(tmp_path / "list")], list_file=True)
    assert [os.path.basename(r["key"]) for r in names.orderBy("key").collect()] == ["dat.0", "dat.1"]
    sizes = files.map_file_names(names, lambda p: [(p, os.path.getsize(p))], "string", "long", 2)
    assert sorted(r["value"] for r in sizes.collect()) == [3, 3]


def test_lines(spark, tmp_path):
    (tmp_path / "f").write_text("".join(f"line {i}\n" for i in range(25)))
    got = files.file_lines(spark, str(tmp_path / "f")).orderBy("key").collect()
    assert [(r["key"], r["value"]) for r in got] == [(i, f"line {i}\n") for i in range(25)]
    (tmp_path / "g").write_text("one\ntwo\n")
    assert sorted(tuple(r) for r in files.file_lines(spark, str(tmp_path / "[fg]"), limit=3).collect()) == [(0, "line 0\n"), (0, "one\n"), (1, "line 1\n"), (1, "two\n"), (2, "line 2\n")]
    df = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, "c\n")], "id long, text string")
    assert [tuple(r) for r in files.lines_of_text(df, "text", "id").orderBy("id", "line").collect()] == [(1, 0, "a\n"), (1, 1, "\n"), (1, 2, "b"), (3, 0, "c\n")]


def test_records_and_segments(spark, tmp_path):
    raw = b"".join(bytes([65 + i]) * 10 + bytes([97 + i]) * 90 for i in range(5))
    (tmp_path / "r").write_bytes(raw)
    got = files.records(spark, str(tmp_path / "r")).orderBy("key").collect()
    assert [bytes(r["key"]) for r in got] == [bytes([65 + i]) * 10 for i in range(5)]
    seg = spark.createDataFrame([(0, 1, str(tmp_path / "r"), 100, 50), (0, 0, str(tmp_path / "r"), 0, 100), (1, 0, str(tmp_path / "r"), 450, -1)], "color long, rank long, path string, offset long, bytes long")
    out = {r["color"]: bytes(r["content"]) for r in files.reassembled(spark, seg).collect()}
    assert out == {0: raw[:150], 1: raw[450:]}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.reassembled(spark, seg.withColumn("path", F.lit(str(tmp_path / "none")))).collect()
    rows = spark.range(30).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("v").alias("value"))
    sinks.write_text_records(rows, str(tmp_path / "fixed"))
    assert files.records(spark, str(tmp_path / "fixed") + "/part-*").count() == 30


def test_edges_and_tables(spark, tmp_path):
    (tmp_path / "e").write_text("# head\n1\t2\n2\t3\nx\n")
    assert [tuple(r) for r in files.edges(spark, str(tmp_path / "e")).orderBy("from").collect()] == [(1, 2), (2, 3)]
    (tmp_path / "t.tbl").write_text("1|a|2.5|1995-01-02|\n2|b|3.5|1996-03-04|\n")
    t = files.delimited(spark, str(tmp_path / "t.tbl"), "k int, s string, r double, d date")
    assert t.columns == ["k", "s", "r", "d"] and t.agg(F.sum("r")).first()[0] == 6.0
    (tmp_path / "bad.tbl").write_text("x|a|2.5|1995-01-02|\n")
    with pytest.raises(Exception):
        files.delimited(spark, str(tmp_path / "bad.tbl"), "k int, s string, r double, d date").collect()


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, value long")
    sinks.write_key_files(p, str(tmp_path / "k"))
    assert sorted(x.strip() for d in (tmp_path / "k" / "_key=a").glob("part*") for x in d.read_text().splitlines()) == ["a 1", "a 3"]
    sinks.write_sorted(p, str(tmp_path / "s"), "key", "value")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    sinks.split_file(spark.createDataFrame([(str(i),) for i in range(20)], "value string"), str(tmp_path / "n"), 4)
    assert len(list((tmp_path / "n").glob("part*"))) == 4
