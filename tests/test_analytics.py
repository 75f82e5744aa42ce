import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import analytics
from millrace.streaming import events as streams


def test_page_ranks(spark):
    edges = [(1, 2), (1, 2), (1, 3), (2, 3), (4, 1)]
    df = spark.createDataFrame(edges, "from long, to long")
    ranks = {f: 1.0 for f, _ in edges}
    for _ in range(7):
        new = {f: 0.0 for f, _ in edges}
        for f, t in edges:
            if f in ranks:
                new[t] = new.get(t, 0.0) + ranks[f] / sum(1 for x, _ in edges if x == f)
        ranks = {k: 0.15 + 0.85 * v for k, v in new.items()}
    got = {r["node"]: r["rank"] for r in analytics.page_ranks(df, 7).collect()}
    assert got.keys() == ranks.keys() and all(abs(got[k] - ranks[k]) < 1e-12 for k in ranks)


def test_k_means(spark):
    r = random.Random(2)
    pts = [(i, [r.randint(-20, 20), r.randint(0, 50)]) for i in range(200)]
    means = [[-10, 10], [10, 40], [500, 500]]
    df = spark.createDataFrame(pts, "id long, point array<long>")
    want = [list(m) for m in means]
    for _ in range(4):
        own = [min(range(3), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, want[k])), k)) for _, p in pts]
        for k in range(3):
            mine = [p for (_, p), o in zip(pts, own) if o == k]
            if mine:
                want[k] = [int(sum(x) / len(mine)) for x in zip(*mine)]
    got, _ = analytics.k_means(df, means, rounds=4)
    assert got == want and got[2] == [500, 500]
    stable, own = analytics.k_means(df, means, until_stable=True)
    again, _ = analytics.k_means(df, stable, rounds=1)
    assert again == stable
    far, own = analytics.k_means(df, means, rounds=1, reach=100)
    near = {i: min((sum((a - b) ** 2 for a, b in zip(p, far[k])), k) for k in range(3)) for i, p in pts}
    assert {x["id"]: x["cluster"] for x in own.collect()} == {i: k if d < 100 else 0 for i, (d, k) in near.items()}
    real, _ = analytics.k_means(df, [[float(x) for x in m] for m in means], rounds=2, whole=False)
    assert all(isinstance(x, float) for m in real for x in m)


def test_random_graph(spark):
    g = analytics.random_graph(spark, 5, 3, 0.5, 0.2, 0.2, 0.1, 0.1)
    rows = {tuple(r) for r in g.collect()}
    assert len(rows) == 96 and all(0 <= x < 32 for e in rows for x in e)
    assert rows == {tuple(r) for r in analytics.random_graph(spark, 5, 3, 0.5, 0.2, 0.2, 0.1, 0.1).collect()}
    with pytest.raises(RuntimeError):
        analytics.random_graph(spark, 2, 4, 1.0, 0.0, 0.0, 0.0, rounds=2)


def test_pi(spark):
    assert abs(analytics.pi_estimate(spark, 200_000).first()["pi"] - math.pi) < 0.02


def test_matrices(spark):
    a = [(i, j, i - j) for i in range(4) for j in range(5)]
    b = [(j, k, j * k) for j in range(5) for k in range(3)]
    out = analytics.multiplied(spark.createDataFrame(a, "row long, col long, value long"), spark.createDataFrame(b, "row long, col long, value long"))
    assert {(r["row"], r["col"]): r["value"] for r in out.collect()} == {(i, k): sum((i - j) * j * k for j in range(5)) for i in range(4) for k in range(3)}


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in analytics.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


def test_grid_clusters(spark):
    r = random.Random(4)
    pts = [(i, [r.uniform(0, 0.1), r.uniform(0, 0.1)]) for i in range(60)] + [(100 + i, [r.uniform(0.85, 0.99), r.uniform(0.85, 0.99)]) for i in range(60)] + [(300, [0.5, 0.1])]
    df = spark.createDataFrame(pts, "id long, point array<double>")
    got = {x["id"]: x["cluster"] for x in analytics.grid_clusters(df, [0, 0], [1, 1], 4, 3, 3.0).collect()}
    assert 300 not in got
    assert not {got[i] for i in got if i < 100} & {got[i] for i in got if i >= 100}


def test_word_counts(spark):
    df = spark.createDataFrame([("a b, a-c 1a",), (None,)], "t string")
    assert {r["word"]: r["n"] for r in analytics.word_counts(df, "t").collect()} == {"a": 3, "b": 1, "c": 1}
    assert {r["n"] for r in analytics.word_counts(df, "t", times=4).where("word = 'b'").collect()} == {4}


def test_streaming_windows_match_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{(i * 7) % 60:02d}:00", i % 5, "view", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = streams.event_stream(spark, str(tmp_path))
    q = streams.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, streams.tumbling(df).collect()))
    assert sorted(map(tuple, spark.table("tumbling").collect())) == want
    assert streams.sliding(df).agg(F.sum("n")).first()[0] == 600
    q = streams.first_of_key(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 5
