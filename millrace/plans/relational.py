"""Five decision-support queries over the star schema.

Only what a query needs is read; filters reach the scans; join strategies are Spark's, by size. Money is
rounded to cents in the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tuples import anti, left_count, semi
from millrace.plans.tables import table


def _volume():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def q7(spark: SparkSession, sf_dir: str, first: str = "NATION_2", second: str = "NATION_15") -> DataFrame:
    """Trade between two nations by year, in both directions."""
    t = lambda n: table(spark, sf_dir, n)
    names = t("nation").where(F.col("n_name").isin(first, second))
    s = t("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    c = t("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("l_shipdate")
    lines = t("lineitem").where((F.col("l_shipdate") >= "1995-01-01") & (F.col("l_shipdate") < "1997-01-01")).select("l_orderkey", "l_suppkey", F.year(day).cast("long").alias("l_year"), _volume().alias("volume"))
    rows = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("supp_nation != cust_nation")
    return rows.groupBy("supp_nation", "cust_nation", "l_year").agg(F.round(F.sum("volume"), 2).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


Q7 = """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_15') OR (n1.n_name = 'NATION_15' AND n2.n_name = 'NATION_2'))
  AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
GROUP BY ALL ORDER BY 1, 2, 3
"""


def q9(spark: SparkSession, sf_dir: str, part: str = "ring") -> DataFrame:
    """Profit by nation and year on parts whose name holds a word; cost is the retail price."""
    t = lambda n: table(spark, sf_dir, n)
    p = t("part").where(F.col("p_name").contains(part)).select("p_partkey", "p_retailprice")
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", _volume().alias("volume"))
    o = t("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("o_year"))
    rows = lines.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.col("volume") - F.col("p_retailprice") * F.col("l_quantity")
    return rows.groupBy("nation", "o_year").agg(F.round(F.sum(amount), 2).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


Q9 = """
SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 2) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY ALL ORDER BY 1, 2 DESC
"""


def q10(spark: SparkSession, sf_dir: str, start: str = "1995-10-01", end: str = "1996-01-01", n: int = 20) -> DataFrame:
    """The customers with most returned revenue of a quarter: a top-n, never a full sort."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)).select("o_orderkey", "o_custkey")
    lines = t("lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", _volume().alias("volume"))
    by_customer = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("volume").alias("volume"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "n_name")
    rows = by_customer.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_custkey", "c_name", F.round("volume", 2).alias("revenue"), "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(n)


Q10 = """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-10-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
"""


def q13(spark: SparkSession, sf_dir: str, without: str = "%URGENT%") -> DataFrame:
    """How many customers have how many orders of a kind; orders are counted before the outer join."""
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderpriority").like(without)).select(F.col("o_custkey").alias("c_custkey"))
    counted = left_count(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], "c_count")
    return counted.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


Q13 = """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY 1)
GROUP BY 1 ORDER BY 2 DESC, 1 DESC
"""


def q21(spark: SparkSession, sf_dir: str, nation: str = "NATION_15", n: int = 100) -> DataFrame:
    """Suppliers of a nation who alone were late in orders of several suppliers.

    One aggregate of each order tells both: its smallest and largest supplier differ, those that were late do not.
    """
    t = lambda n: table(spark, sf_dir, n)
    s = t("supplier").join(t("nation").where(F.col("n_name") == nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name")
    late = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    orders = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"), F.min(late).alias("late"), F.max(late).alias("last"), F.count(late).alias("lines"))
    alone = orders.where("late = last AND least != most").select("l_orderkey", "late", "lines")
    rows = alone.join(s, F.col("late") == F.col("s_suppkey")).join(t("orders").where(F.col("o_orderstatus") == "F").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("s_name").agg(F.sum("lines").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(n)


Q21 = """
SELECT s_name, count(*) AS numwait
FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_name = 'NATION_15'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
"""
