import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import positions


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    return [(i, r.randint(-50, 50)) for i in range(300)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, v long").repartition(7)


def test_positions_follow_the_order(frame, data):
    got = {r["id"]: r["pos"] for r in positions.with_positions(frame, "v", "id").collect()}
    want = {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in data))}
    assert got == want


def test_skipping(frame):
    p = positions.with_positions(frame, "id")
    assert sorted(r["pos"] for r in positions.skipping(p, 3, 10, 50).collect()) == [3, 13, 23, 33, 43]
    assert positions.skipping(p, 0, 1).count() == 300
    with pytest.raises(ValueError):
        positions.skipping(p, 0, 0)


@pytest.mark.parametrize("cyclic", [True, False])
def test_distribution_is_even(frame, cyclic):
    p = positions.distributed(positions.with_positions(frame, "id"), 8, cyclic)
    n = [r["n"] for r in positions.rank_counts(p, 8).orderBy("rank").collect()]
    assert sum(n) == 300 and max(n) == 38 and (min(n) >= 34)
    assert p.where(F.spark_partition_id() != F.col("rank")).count() == 0


def test_levelling_keeps_keys_together(spark):
    rows = [(k, i) for k in range(40) for i in range(k)]
    df = spark.createDataFrame(rows, "key long, value long")
    out = positions.levelled(df, 4)
    assert out.groupBy("key").agg(F.count_distinct("rank").alias("n")).where("n > 1").count() == 0
    h = positions.histogram(out, 4).first()
    assert h["n"] == len(rows) and h["most"] - h["least"] <= 2 * 40 and h["mean"] == len(rows) / 4


def test_exclusive_scans(frame, data):
    total, want = 0, {}
    for i, v in data:
        want[i] = total
        total += v
    got = {r["id"]: r["scan"] for r in positions.exclusive_sum(frame, "v", "id").collect()}
    assert got == want
    out, t = positions.exclusive_scan(frame, "v", lambda a, b: a + b, 0, "id")
    assert {r["id"]: r["scan"] for r in out.collect()} == want and t == total


def test_no_rows(spark):
    e = spark.createDataFrame([], "id long, v long")
    assert positions.with_positions(e, "id").count() == 0
    assert positions.exclusive_sum(e, "v", "id").count() == 0
    out, t = positions.exclusive_scan(e, "v", max, -1, "id")
    assert out.count() == 0 and t == -1
    assert [r["n"] for r in positions.rank_counts(e.withColumn("rank", F.lit(0)), 3).collect()] == [0, 0, 0]
