"""All queries of the library but those of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import external, positions, tuples
from millrace.operators.pairs import Pairs
from millrace.plans import analytics, relational, workflows
from millrace.plans.tables import table
from millrace.sources.files import lines_of_text
from millrace.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
RANKS = 8

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


for _name, _sql in (("q7", relational.Q7), ("q9", relational.Q9), ("q10", relational.Q10), ("q13", relational.Q13), ("q21", relational.Q21)):
    _QUERIES[f"tpch_{_name}"], _SQL[f"tpch_{_name}"] = getattr(relational, _name), _sql


def _orders(spark: SparkSession, sf: str) -> Pairs:
    return Pairs.of(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


# pairs


@_query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{1,24}')) AS word FROM documents) GROUP BY 1")
def kv_wordcount(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.word_counts(table(spark, sf, "documents"), "text")


@_query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{1,24}')) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def kv_wordcount_top(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_words(table(spark, sf, "documents"), "text")


@_query(r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s.,;()<>/0-9" + '"' + r"-]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1 ORDER BY 1 LIMIT 10")
def kv_wordfreq_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each partition are combined before the shuffle."""
    words = table(spark, sf, "documents").select(F.explode(scalars.words_between_marks(F.col("text"))).alias("word"), F.lit(1).cast("long").alias("n"))
    combined = Pairs.of(words, "word", "n").combine(lambda word, ns: [(word, sum(ns))], "string", "long")
    return combined.reduce(F.sum("value")).df.toDF("word", "n").orderBy("word").limit(10)


@_query("SELECT o_orderkey AS key, o_custkey AS value FROM orders")
def kv_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).reverse().df


@_query("SELECT o_custkey AS key, o_orderkey AS value FROM orders")
def kv_pairing_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).pair().unpair().df


@_query("SELECT c_custkey AS key, c_nationkey AS value FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def kv_concat(spark: SparkSession, sf: str) -> DataFrame:
    a = Pairs.of(table(spark, sf, "customer"), "c_custkey", "c_nationkey")
    return Pairs.concat(a, Pairs.of(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey")).df


@_query("SELECT DISTINCT o_custkey AS key FROM orders")
def kv_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).distinct_keys().df.select("key")


@_query("SELECT c_custkey AS key, s_suppkey AS value FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def kv_match(spark: SparkSession, sf: str) -> DataFrame:
    return Pairs.of(table(spark, sf, "customer"), "c_nationkey", "c_custkey").match(Pairs.of(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey")).df


@_query("SELECT l_partkey AS key, l_extendedprice * (1 - l_discount) AS value FROM lineitem WHERE l_quantity > 40")
def kv_filter_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_quantity > 40")
    return Pairs.of(rows, "l_partkey", F.col("l_extendedprice") * (1 - F.col("l_discount"))).df


@_query("SELECT o_custkey AS key, o_orderkey * 2 AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 2 = 0")
def kv_map_python(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).map(lambda k, v: [(k, 2 * v), (k, v + 1)] if v % 2 == 0 else [], "long", "long").df


@_query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 7 = 3) AS some, EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0) AS none")
def kv_for_some(spark: SparkSession, sf: str) -> DataFrame:
    p = _orders(spark, sf)
    some, none = (p.map_some(t).df.agg((F.count(F.lit(1)) > 0).alias(n)) for t, n in (("value % 7 = 3", "some"), ("value < 0", "none")))
    return some.join(none)


@_query("SELECT o_custkey AS key, sum(o_totalprice) AS value FROM orders GROUP BY 1")
def kv_reduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return Pairs.of(table(spark, sf, "orders"), "o_custkey", "o_totalprice").reduce(F.sum("value")).df


@_query("SELECT o_custkey AS key, max(o_totalprice) AS value FROM orders GROUP BY 1")
def kv_reduce_max(spark: SparkSession, sf: str) -> DataFrame:
    return Pairs.of(table(spark, sf, "orders"), "o_custkey", "o_totalprice").reduce(F.max("value")).df


@_query("SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY 1")
def kv_reduce_count(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).count_keys().df


@_query("SELECT o_custkey AS key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1")
def kv_reduce_python(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).reduce_with(lambda k, vs: [(k, ",".join(str(v) for v in vs if v is not None) or None)], "long", "string", order_by="value").df


@_query("SELECT o_custkey AS key, CAST(sum(o_orderkey) AS BIGINT) AS value FROM orders GROUP BY 1")
def kv_combine_shuffle_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).combine(lambda k, vs: [(k, sum(known) if (known := [v for v in vs if v is not None]) else None)], "long", "long").reduce(F.sum("value")).df


@_query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, max(o_orderkey) AS most, count(*) AS n FROM orders")
def kv_reduce_as_one(spark: SparkSession, sf: str) -> DataFrame:
    """One aggregate over all pairs, whatever their keys."""
    found = _orders(spark, sf).reduce_all(F.struct(F.sum("value").alias("total"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n")))
    return spark.createDataFrame([tuple(found)], "total long, most long, n long")


@_query("SELECT o_custkey AS key, list_sort(list(o_orderkey))[1] AS least, CAST(len(list(o_orderkey)) AS INTEGER) AS n FROM orders GROUP BY 1")
def kv_collect(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).collect_values().df.select("key", F.sort_array("value")[0].alias("least"), F.size("value").alias("n"))


@_query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, CAST(count(*) * 8 AS BIGINT) AS copies FROM orders")
def kv_replicate_count(spark: SparkSession, sf: str) -> DataFrame:
    p = _orders(spark, sf)
    return p.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).join(p.replicate(RANKS).df.agg(F.count(F.lit(1)).alias("copies")))


@_query("SELECT CAST(o_custkey % 8 AS INTEGER) AS rank, count(*) AS n FROM orders GROUP BY 1")
def kv_shuffle_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = Pairs.of(table(spark, sf, "orders"), F.col("o_custkey") % RANKS, "o_orderkey").shuffle(RANKS, key_as_rank=True)
    return p.df.groupBy(F.spark_partition_id().alias("rank")).agg(F.count(F.lit(1)).alias("n"))


# positions


_POS = "(SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return positions.with_positions(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@_query(f"SELECT o_orderkey, o_totalprice, pos FROM {_POS}")
def kv_sort_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def kv_first_part(spark: SparkSession, sf: str) -> DataFrame:
    return positions.first_part(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@_query(f"SELECT o_orderkey, pos FROM {_POS} WHERE pos >= 5 AND (pos - 5) % 7 = 0 AND pos < 1000")
def kv_skipping(spark: SparkSession, sf: str) -> DataFrame:
    return positions.skipping(_ranked(spark, sf), 5, 7, 1000).select("o_orderkey", "pos")


@_query(f"SELECT CAST(pos % 8 AS INTEGER) AS rank, count(*) AS n FROM {_POS} GROUP BY 1")
def kv_distribute_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return positions.rank_counts(positions.distributed(_ranked(spark, sf), RANKS, True), RANKS)


@_query(f"SELECT CAST(pos // ((SELECT count(*) FROM orders) + 7) // 8 AS INTEGER) AS rank, count(*) AS n FROM {_POS} GROUP BY 1".replace("pos // ((SELECT count(*) FROM orders) + 7) // 8", "pos // (((SELECT count(*) FROM orders) + 7) // 8)"))
def kv_distribute_block(spark: SparkSession, sf: str) -> DataFrame:
    return positions.rank_counts(positions.distributed(_ranked(spark, sf), RANKS, False), RANKS)


_LEVEL = """(SELECT o_orderkey, o_custkey, CAST(floor(before * 8.0 / total) AS INTEGER) AS rank FROM orders JOIN (
  SELECT o_custkey AS k, coalesce(sum(count(*)) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(count(*)) OVER () AS total
  FROM orders GROUP BY 1) ON o_custkey = k)"""


@_query(f"SELECT o_custkey AS key, o_orderkey AS value, rank FROM {_LEVEL}")
def kv_level_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return positions.levelled(_orders(spark, sf).df, RANKS)


@_query(f"SELECT CAST(sum(n) AS BIGINT) AS n, avg(n) AS mean, var_pop(n) AS variance, min(n) AS least, max(n) AS most FROM (SELECT rank, count(*) AS n FROM {_LEVEL} GROUP BY 1)")
def kv_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return positions.histogram(positions.levelled(_orders(spark, sf).df, RANKS, place=False), RANKS)


@_query("SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM orders")
def kv_scan_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return positions.exclusive_sum(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "scan")


@_query("SELECT o_orderkey, coalesce(max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS scan FROM orders")
def kv_scan_generic(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = positions.exclusive_scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", max, -1, "o_orderkey")
    return out.select("o_orderkey", "scan")


@_query("SELECT substr(p_name, 1, 10) AS key, p_partkey AS value, row_number() OVER (ORDER BY substr(p_name, 1, 10), p_partkey) - 1 AS pos FROM part")
def sort_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.substring("p_name", 1, 10).alias("key"), F.col("p_partkey").alias("value"))
    return positions.with_positions(rows, "key", "value")


# tagged tuples


@_query("SELECT l_orderkey, l_suppkey, o_custkey, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 45")
def tuple_product(spark: SparkSession, sf: str) -> DataFrame:
    lines = tuples.tagged(table(spark, sf, "lineitem").where("l_quantity > 45"), ["l_orderkey"], ["l_orderkey", "l_suppkey", "l_extendedprice"], 1)
    orders = tuples.tagged(table(spark, sf, "orders").where("o_orderstatus = 'F'"), ["o_orderkey"], ["o_custkey", "o_orderkey", "o_totalprice"], 2)
    out = tuples.product(lines, orders, [(0, 0), (1, 0), (0, 1), (2, 0)], [(1, 0), (0, 1)])
    return tuples.fields(out, "l_orderkey", "l_suppkey", "o_custkey", "price").withColumn("price", F.round("price", 2))


@_query("SELECT c_nationkey AS nation, count(*) FILTER (WHERE side = 0) AS customers, count(*) FILTER (WHERE side = 1) AS suppliers FROM (SELECT c_nationkey, 0 AS side FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY 1")
def tuple_separate(spark: SparkSession, sf: str) -> DataFrame:
    c = tuples.tagged(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], 0)
    both = c.unionByName(tuples.tagged(table(spark, sf, "supplier"), ["s_nationkey"], ["s_suppkey"], 1))
    a, b = tuples.separated(both, (0, 1))
    n = lambda df, name: df.groupBy(F.col("key").alias("nation")).agg(F.count(F.lit(1)).alias(name))
    out = n(a, "customers").join(n(b, "suppliers"), "nation", "full")
    return out.fillna(0, ["customers", "suppliers"])


@_query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY 1")
def tuple_left_count(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return tuples.left_count(table(spark, sf, "customer").select("c_custkey"), big, ["c_custkey"])


def _late(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), lines.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))


@_query("SELECT l_orderkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)")
def tuple_semi_neq(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _late(spark, sf)
    return tuples.semi(a, b, (F.col("l_orderkey") == F.col("k")) & (F.col("l_suppkey") != F.col("s")))


@_query("SELECT l_orderkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)")
def tuple_anti_neq(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _late(spark, sf)
    return tuples.anti(a, b, (F.col("l_orderkey") == F.col("k")) & (F.col("l_suppkey") != F.col("s")))


# text and scalars


@_query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, CASE WHEN i < len(x) THEN x[i] || chr(10) ELSE x[i] END AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE i < len(x) OR x[i] <> ''")
def text_getline(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of_text(table(spark, sf, "documents"), "text", "doc_id")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level FROM orders")
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = scalars.format_date(F.col("o_orderdate"))
    date = scalars.decode_date(day)
    return table(spark, sf, "orders").select("o_orderkey", scalars.format_date(date).alias("day"), scalars.format_date(scalars.year_start(date)).alias("year"), scalars.to_int(F.substring("o_orderpriority", 1, 1)).alias("level"))


@_query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def scalar_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    first = F.array(*[F.lit(float(x)) for x in rows.where("vec_id = 0").first()["e"]])
    return rows.select("vec_id", F.round(scalars.squared_distance(F.col("e"), first), 6).alias("d"))


@_query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '')[1] AS first, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS INTEGER) AS n FROM part")
def scalar_argv(spark: SparkSession, sf: str) -> DataFrame:
    a = scalars.argv(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.get(a, F.lit(0)).alias("first"), F.size(a).alias("n"))


# iterative analytics


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("c_nationkey").cast("long").alias("from"), F.col("s_nationkey").cast("long").alias("to"))


_ROUND = "r{k} AS (SELECT node, 0.15 + 0.85 * sum(part) AS rank FROM (SELECT t AS node, rank / d AS part FROM e JOIN r{j} ON f = node JOIN g USING (f) UNION ALL SELECT f, 0.0 FROM g) GROUP BY 1)"


@_query(
    """WITH e AS (SELECT CAST(c_nationkey AS BIGINT) AS f, CAST(s_nationkey AS BIGINT) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT f, count(*) AS d FROM e GROUP BY 1), r0 AS (SELECT f AS node, 1.0::DOUBLE AS rank FROM g), """
    + ", ".join(_ROUND.format(k=k, j=k - 1) for k in (1, 2, 3))
    + " SELECT node, round(rank, 6) AS rank FROM r3"
)
def pagerank_k3(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.page_ranks(_trade(spark, sf), 3).select("node", F.round("rank", 6).alias("rank"))


_MEANS = [[5, 950], [15, 1000], [25, 1050], [45, 1100]]
_M0 = "m0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_MEANS)) + ") t(i, a, b))"
_STEP = """a{k} AS (SELECT id, x, y, arg_min(i, ((x - a) * (x - a) + (y - b) * (y - b)) * 10 + i) AS cluster FROM p, m{k} GROUP BY ALL),
m{n} AS (SELECT i, coalesce(trunc(CAST(sx AS DOUBLE) / c)::BIGINT, a) AS a, coalesce(trunc(CAST(sy AS DOUBLE) / c)::BIGINT, b) AS b FROM m{k} LEFT JOIN (SELECT cluster, sum(x) AS sx, sum(y) AS sy, count(*) AS c FROM a{k} GROUP BY 1) ON i = cluster)"""


@_query(
    "WITH p AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS x, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part), "
    + f"{_M0}, {_STEP.format(k=0, n=1)}, {_STEP.format(k=1, n=2)}, {_STEP.format(k=2, n=3)} SELECT id, CAST(cluster AS INTEGER) AS cluster FROM a2"
)
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.floor("p_retailprice")).alias("point"))
    return analytics.k_means(points, _MEANS, rounds=2)[1].select("id", "cluster")


@_query(
    """WITH a AS (SELECT i AS row, j AS col, (i * 7 + j * 3) % 11 - 5 AS value FROM range(32) x(i), range(32) y(j)),
b AS (SELECT i AS row, j AS col, (i * 5 + j) % 13 - 6 AS value FROM range(32) x(i), range(32) y(j))
SELECT a.row, b.col, CAST(sum(a.value * b.value) AS BIGINT) AS value FROM a JOIN b ON a.col = b.row GROUP BY ALL"""
)
def matmul(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.range(32 * 32).select(F.floor(F.col("id") / 32).alias("row"), (F.col("id") % 32).alias("col"))
    a = cells.withColumn("value", (F.col("row") * 7 + F.col("col") * 3) % 11 - 5)
    return analytics.multiplied(a, cells.withColumn("value", (F.col("row") * 5 + F.col("col")) % 13 - 6))


_STABLE = 40  # rounds of the SQL; the query ends when no point moves


@_query(
    "WITH p AS MATERIALIZED (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS x, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part), "
    + f"{_M0}, {', '.join(_STEP.format(k=k, n=k + 1).replace(' AS (', ' AS MATERIALIZED (') for k in range(_STABLE))} SELECT id, CAST(cluster AS INTEGER) AS cluster FROM a{_STABLE - 1}"
)
def kmeans_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Until no point changes its cluster."""
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.floor("p_retailprice")).alias("point"))
    return analytics.k_means(points, _MEANS, until_stable=True)[1].select("id", "cluster")


_FLOAT = """a{k} AS (SELECT id, x, y, CASE WHEN min((x - a) * (x - a) + (y - b) * (y - b)) < 2500 THEN arg_min(i, (x - a) * (x - a) + (y - b) * (y - b)) ELSE 0 END AS cluster FROM p, m{k} GROUP BY id, x, y),
m{n} AS (SELECT i, coalesce(sx / c, a) AS a, coalesce(sy / c, b) AS b FROM m{k} LEFT JOIN (SELECT cluster, sum(x) AS sx, sum(y) AS sy, count(*) AS c FROM a{k} GROUP BY 1) ON i = cluster)"""


@_query(
    "WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), m0 AS (SELECT i, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (VALUES "
    + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_MEANS))
    + f") t(i, a, b)), {_FLOAT.format(k=0, n=1)}, {_FLOAT.format(k=1, n=2)}, {_FLOAT.format(k=2, n=3)} SELECT id, CAST(cluster AS INTEGER) AS cluster FROM a2"
)
def kmeans_float(spark: SparkSession, sf: str) -> DataFrame:
    """Means of floats; points that no mean reaches belong to the first."""
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("point"))
    means = [[float(x) for x in m] for m in _MEANS]
    return analytics.k_means(points, means, rounds=2, whole=False, reach=2500.0)[1].select("id", "cluster")


def _uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


_DRAWS = ", ".join(f"{_uniform("'1234'", 'k', 'id', '(n + 1)', f"'{q}'")} AS u{q}" for q in range(5))
_PARTS = ", ".join(f"{x} * (1 + 0.1::DOUBLE * (u{q} - 0.5::DOUBLE)) AS p{x}" for q, x in enumerate("abcd", 1))


@_query(
    f"""WITH RECURSIVE s AS (SELECT k, id, 0 AS n, 0::BIGINT AS i, 0::BIGINT AS j, 0.57::DOUBLE AS a, 0.19::DOUBLE AS b, 0.19::DOUBLE AS c, 0.05::DOUBLE AS d FROM range(12) t(k), range(1024) u(id)
UNION ALL
SELECT k, id, n + 1, i * 2 + CASE WHEN u0 < a + b THEN 0 ELSE 1 END, j * 2 + CASE WHEN u0 >= a AND u0 < a + b OR u0 >= a + b + c THEN 1 ELSE 0 END,
       pa / (pa + pb + pc + pd), pb / (pa + pb + pc + pd), pc / (pa + pb + pc + pd), pd / (pa + pb + pc + pd)
FROM (SELECT *, {_PARTS} FROM (SELECT *, {_DRAWS} FROM s WHERE n < 8))),
first AS (SELECT i, j, min(k) AS k FROM s WHERE n = 8 GROUP BY i, j),
enough AS (SELECT min(k) AS k FROM (SELECT k, sum(count(*)) OVER (ORDER BY k) AS found FROM first GROUP BY k) WHERE found >= 1024)
SELECT i AS "from", j AS "to" FROM first WHERE k <= (SELECT k FROM enough) ORDER BY md5(i || ':' || j), i, j LIMIT 1024"""
)
def rmat(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.random_graph(spark, 8, 4, 0.57, 0.19, 0.19, 0.05, 0.1, seed=1234)


@_query(f"SELECT count(*) AS points, CAST(sum(inside) AS BIGINT) AS inside, 4 * sum(inside)::DOUBLE / count(*) AS pi FROM (SELECT CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END AS inside FROM (SELECT {_uniform("'1'", "'0'", 'id')} AS x, {_uniform("'1'", "'1'", 'id')} AS y FROM range(1000000) t(id)))")
def mc_pi(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.pi_estimate(spark, 1_000_000)


_AXIS = "CAST(least(greatest(ceil(({v} - {lo}) / {width}::DOUBLE * {cells}) - 1, 0), {cells} - 1) AS INTEGER)"


def _layer(k: int) -> str:
    """Points of a layer with their cells, and which cells are dense."""
    x, y = (_AXIS.format(v=v, lo=lo, width=width, cells=1 << k) for v, lo, width in (("x", 0, 51), ("y", 800, 1400)))
    above = "p" if k == 1 else f"(SELECT s{k - 1}.id, s{k - 1}.x, s{k - 1}.y FROM s{k - 1} JOIN c{k - 1} USING (i, j) WHERE NOT dense)"
    return f"""s{k} AS MATERIALIZED (SELECT id, x, y, {x} AS i, {y} AS j FROM {above}),
n{k} AS MATERIALIZED (SELECT i, j, count(*) AS n FROM s{k} GROUP BY i, j HAVING count(*) >= 3),
c{k} AS MATERIALIZED (SELECT i, j, {"TRUE" if k == 4 else f"n > floor(2.0 * (SELECT avg(n) FROM n{k}))"} AS dense FROM n{k})"""


_TOUCH = " UNION ALL ".join(
    f"SELECT f.cell AS a, c.cell AS b FROM kinds f JOIN kinds c ON c.layer = f.layer - {up} AND c.i = (f.i >> {up}) + {di} AND c.j = (f.j >> {up}) + {dj} WHERE f.layer > {up} AND ({edge.format(w=1 << up)})"
    for up in range(4)
    for di, dj, edge in ((-1, 0, "f.i % {w} = 0"), (1, 0, "(f.i + 1) % {w} = 0"), (0, -1, "f.j % {w} = 0"), (0, 1, "(f.j + 1) % {w} = 0"))
)


@_query(
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), {", ".join(_layer(k) for k in (1, 2, 3, 4))},
cells AS MATERIALIZED ({" UNION ALL ".join(f"SELECT id, {k} AS layer, i, j FROM s{k} JOIN c{k} USING (i, j) WHERE dense" for k in (1, 2, 3, 4))}),
kinds AS MATERIALIZED (SELECT layer, i, j, row_number() OVER () AS cell FROM (SELECT DISTINCT layer, i, j FROM cells)),
touch AS MATERIALIZED ({_TOUCH}),
links AS MATERIALIZED (SELECT a, b FROM touch UNION SELECT b, a FROM touch),
reach AS (SELECT cell AS a, cell AS b FROM kinds UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT a AS cell, min(b) AS root FROM reach GROUP BY a)
SELECT id, min(id) OVER (PARTITION BY root) AS cluster FROM cells JOIN kinds USING (layer, i, j) JOIN root USING (cell)"""
)
def grid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("point"))
    return analytics.grid_clusters(points, [0, 800], [51, 2200], 4, 3, 2.0)


@_query("SELECT CAST(r_regionkey AS BIGINT) AS task, 'echo ' || r_name AS command, 0 AS code, r_name || chr(10) AS stdout, '' AS stderr FROM region")
def command_farm(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.concat(F.lit("echo "), F.col("r_name")).alias("value"))
    return external.run_commands(tasks, slots=4).select("task", "command", "code", "stdout", "stderr")


# extras: set operations, roll-ups, windows over the events


@_query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@_query("SELECT o_custkey AS key FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).exceptAll(table(spark, sf, "customer").select("c_custkey"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 6))


@_query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"))


def queries() -> dict[str, Query]:
    return _QUERIES | workflows.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | workflows.oracle_sql()
