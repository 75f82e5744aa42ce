import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.pairs import Builder, Pairs
from millrace.operators import pairs, tuples

FLOWERS = [(i, n) for i, n in enumerate(["Matsu", "Ume", "Sakura", "Fuji", "Ayame", "Botan", "Hagi", "Susuki", "Kiku", "Momiji", "Yanagi", "Kiri"])]


def rows(p):
    return sorted((r["key"], r["value"]) for r in p.df.collect())


@pytest.fixture(scope="module")
def flowers(spark):
    return Pairs.create(spark, FLOWERS, "long", "string")


def test_builder_seals(spark):
    b = Builder(spark, "string", "string")
    for i in range(5):
        b.add(f"key{i}", f"value{i}")
    assert b.done().count() == 5
    with pytest.raises(ValueError):
        b.add("x", "y")
    with pytest.raises(ValueError):
        b.done()


def test_five_pairs_through_the_pipeline(spark):
    p = Pairs.create(spark, [(f"key{i}", f"value{i}") for i in range(5)])
    copies = p.replicate(4)
    assert copies.count() == 20
    mapped = copies.map(lambda k, v: [(k, v + "x")], "string", "string").shuffle()
    assert mapped.count() == 20
    assert mapped.count_keys().count() == 5
    assert {r["value"] for r in mapped.count_keys().df.collect()} == {4}


def test_every_operator_on_no_pairs(spark):
    e = Pairs.create(spark, [], "long", "long")
    assert [x.count() for x in (e.reverse(), e.pair().unpair(), e.shuffle(3), e.replicate(2), e.count_keys(), e.distinct_keys(), e.match(e), e.sort(), Pairs.concat(e, e), e.combine(lambda k, v: [(k, 1)], "long", "long"), e.reduce_with(lambda k, v: [(k, 1)], "long", "long"))] == [0] * 11
    assert e.reduce_all(F.sum("value")) is None
    assert not e.any("true")


def test_map_and_errors(flowers):
    assert rows(flowers.map(lambda k, v: [(v, k)] * (k % 3), "string", "long")) == sorted((v, k) for k, v in FLOWERS for _ in range(k % 3))

    def odd(k, v):
        if k % 2:
            raise RuntimeError("odd")
        return [(k, v)]

    assert flowers.map(odd, "long", "string", on_error="warn").count() == 6
    with pytest.raises(Exception, match="odd"):
        flowers.map(odd, "long", "string").count()
    with pytest.raises(ValueError):
        flowers.map(odd, "long", "string", no_such_option=1)


def test_reverse_pair_match(flowers, spark):
    assert rows(flowers.reverse()) == sorted((v, k) for k, v in FLOWERS)
    assert rows(flowers.pair().unpair()) == FLOWERS
    a = Pairs.create(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")], "long", "string")
    b = Pairs.create(spark, [(1, 10), (1, 11), (3, 12), (None, 13)], "long", "long")
    assert rows(a.match(b)) == [("a", 10), ("a", 11), ("b", 10), ("b", 11)]
    with pytest.raises(ValueError):
        a.match(Pairs.create(spark, [("x", 1)], "string", "long"))


def test_match_of_one_key_keeps_all_tasks_busy(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_ROWS", 64)
    a = Pairs(spark.range(500).coalesce(1).selectExpr("1L AS key", "nullif(id, 7) AS value"))
    b = Pairs(spark.range(300).coalesce(1).selectExpr("1L AS key", "cast(nullif(id, 9) AS string) AS value"))
    got = a.match(b)
    busy = got.local_counts().collect()
    assert len(busy) == 4 and max(r["n"] for r in busy) < 75_000
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(None if i == 7 else i, None if j == 9 else str(j)) for i in range(500) for j in range(300)]
    assert sorted((tuple(r) for r in got.df.collect()), key=key) == sorted(want, key=key)
    c = Pairs(b.df.selectExpr("key", "array(value, NULL) AS value"))
    assert c.match(a).count() == 150_000


def test_reduce_forms_agree(spark):
    r = random.Random(1)
    data = [(r.choice([1, 1, 1, 2, 3, -4]), r.randint(-9, 9)) for _ in range(500)]
    p = Pairs.create(spark, data, "long", "long")
    want = sorted((k, sum(v for x, v in data if x == k)) for k in {k for k, _ in data})
    assert rows(p.reduce(F.sum("value"))) == want
    assert rows(p.reduce_with(lambda k, v: [(k, sum(v))], "long", "long")) == want
    assert rows(p.combine(lambda k, v: [(k, sum(v))], "long", "long").reduce(F.sum("value"))) == want
    assert p.reduce_all(F.max("value")) == max(v for _, v in data)
    assert p.reduce_some(F.sum("value"), "value is not null").count() == 1


def test_reduce_with_streams_groups(spark):
    """Many groups share a worker's call; nulls and NaN are groups, and whole numbers beside nulls stay whole."""
    big = (1 << 60) + 1
    data = [(i % 9000, i) for i in range(27_000)] + [(None, big), (None, None), (big, 1), (big - 1, 2), (5, None)]
    p = Pairs.create(spark, data, "long", "long")
    calls = []

    def fn(k, vs):
        calls.append(k)
        return [(k, f"{vs} {len(calls)}")]

    got = [(r["key"], *r["value"].rsplit(" ", 1)) for r in p.reduce_with(fn, "long", "string", order_by="value").df.collect()]
    want = {k: [k, k + 9000, k + 18_000] + [None] * (k == 5) for k in range(9000)} | {None: [big, None], big: [1], big - 1: [2]}
    assert len(got) == len(want) and {k: vs for k, vs, _ in got} == {k: str(vs) for k, vs in want.items()}
    assert max(int(n) for *_, n in got) > 1000
    d = Pairs.create(spark, [(float("nan"), 1), (None, 2), (float("nan"), 3), (0.0, 4), (-0.0, 5), (None, 6)], "double", "long")
    sums = lambda k, vs: [(k, sum(vs))]
    assert sorted(r["value"] for r in d.reduce_with(sums, "double", "long").df.collect()) == [4, 8, 9]
    nested = Pairs.of(d.df, F.array("key"), "value")
    assert nested.reduce_with(lambda k, vs: [(1, sum(vs))], "long", "long").count() == 3


def test_negative_maximum(spark):
    assert Pairs.create(spark, [(1, -5), (1, -3)], "long", "long").reduce_all(F.max("value")) == -3


def test_sort_is_global_and_bytewise(spark):
    words = ["b", "a", "aa", "é", "Z", "", "a"]
    got = [r["key"] for r in Pairs.create(spark, [(w, 1) for w in words], "string", "long").sort().df.collect()]
    assert got == sorted(words, key=lambda w: w.encode())
    down = [r["key"] for r in Pairs.create(spark, [(i, 1) for i in (3, -1, 2)], "long", "long").sort(descending=True).df.collect()]
    assert down == [3, 2, -1]


def test_doubles_group(spark):
    p = Pairs.create(spark, [(float("nan"), 1), (float("nan"), 2), (0.0, 3), (-0.0, 4)], "double", "long")
    assert sorted(r["value"] for r in p.count_keys().df.collect()) == [2, 2]


def test_key_as_rank(spark):
    p = Pairs.create(spark, [(i % 4, i) for i in range(40)], "long", "long").shuffle(4, key_as_rank=True)
    assert {r["n"] for r in p.local_counts().collect()} == {10}
    assert p.df.where(F.spark_partition_id() != F.col("key")).count() == 0
    with pytest.raises(Exception, match="no rank"):
        Pairs.create(spark, [(7, 1)], "long", "long").shuffle(4, key_as_rank=True).count()


def test_lookups(flowers, spark):
    assert flowers.find(2) == "Sakura"
    with pytest.raises(KeyError):
        flowers.find(99)
    with pytest.raises(ValueError):
        Pairs.concat(flowers, flowers).find(2)
    assert flowers.where("key = 3").one() == (3, "Fuji")
    with pytest.raises(ValueError):
        flowers.one()
    assert flowers.map_some("key > 5").count() == 1


def test_generate(spark):
    assert Pairs.generate(spark, lambda rank: [(rank, i) for i in range(3)], 4, "long", "long").count() == 12
    assert Pairs.generate(spark, lambda rank: [(rank, 0)], 4, "long", "long", once=True).one() == (0, 0)


def test_save_and_restore(flowers, spark, tmp_path):
    flowers.save(str(tmp_path / "p"))
    back = Pairs.restore(spark, str(tmp_path / "p"))
    assert rows(back) == FLOWERS and back.field_types() == flowers.field_types()


def test_concat_cancels(spark):
    r = random.Random(8)
    data = [(r.choice([7, 7, 7, r.randint(0, 50)]), i) for i in range(400)]
    p = Pairs.create(spark, data, "long", "long")
    moved = p.shuffle(5)
    both = Pairs.concat(p.select(value=F.lit(1)), moved.select(value=F.lit(-1)))
    assert both.reduce(F.sum("value")).where("value != 0").count() == 0


def test_tuples(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, a string")
    b = spark.createDataFrame([(1, 5), (3, 6)], "k long, b long")
    l, r = tuples.tagged(a, ["k"], ["k", "a"], 1), tuples.tagged(b, ["k"], ["b"], 2)
    out = tuples.product(l, r, [(1, 0), (0, 1)], [(0, 0)])
    assert sorted(tuple(x) for x in tuples.fields(out, "a", "b").collect()) == [("x", 5), ("y", 5)]
    both = l.select("key", "marker").union(r.select("key", "marker"))
    one, two = tuples.separated(both, (1, 2))
    assert (one.count(), two.count()) == (3, 2)
    with pytest.raises(Exception, match="marker"):
        tuples.separated(both.union(spark.createDataFrame([(1, 9)], both.schema)), (1, 2))[0].collect()
    with pytest.raises(ValueError):
        tuples.at_most(a, ["k"])
    assert sorted(tuple(x) for x in tuples.left_count(spark.createDataFrame([(1,), (2,), (9,)], "k long"), b, ["k"]).collect()) == [(1, 1), (2, 0), (9, 0)]
