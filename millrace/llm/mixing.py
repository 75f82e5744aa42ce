"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output over its share of the input. Each
document is repeated as often as the inverse of the Poisson distribution with that mean says at a
number in [0, 1) hashed from the seed and the doc_id: the counts need no coordination, any subset of
the table gives the same counts, and the expected size of every source is its target. Copies are then
dealt out by a hash and sorted by it inside each partition, which shuffles them globally.

Defined results: a null source is a source of its own; a null doc_id hashes as the word null; rows
that repeat a doc_id get the same count each; a source with weight zero or without a weight is left
out; null and empty texts are repeated like others; an empty table gives an empty one. All columns
pass; copy, n_copies, rate and shuffle_key are added, and replace columns of those names. Names that begin
with _mr_ are the library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: A larger mean is drawn as a sum of means of this size at most, whose table fits a short array.
LARGEST_MEAN, TABLE = 16, 100
#: Up to so many sources the rates are broadcast (about 1 KB a source); beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 2_000, 32
ADDED = ("copy", "n_copies", "rate", "shuffle_key")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float | None = None) -> DataFrame:
    """source, n, rate, draws, cdf: one row a source, from one partial aggregate over the table.

    weights: target shares by source, of any scale; without them a source counts as its size to the power.
    size: documents wanted in all, by default as many as there are.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        n = n.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)))
    n = stored(n, "source-sizes")
    all_n, all_weight = n.agg(F.sum("n"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(all_weight or 1.0))
    n = n.select("source", "n", (share * F.lit(float(all_n or 0) if size is None else float(size)) / F.col("n")).alias("rate"))
    n = n.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    first = F.exp(-F.col("mean"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k).alias("cdf")),
    )
    return n.select("source", "n", "rate", "draws", table["cdf"].alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float | None = None, seed: int = 0) -> DataFrame:
    """Every copy of every document, before the shuffle."""
    docs = docs.drop(*ADDED)
    table = stored(rates(docs, weights, power, size), "rates")
    own = table.select(F.col("source").alias("_mr_of"), F.struct("rate", "draws", "cdf").alias("_mr_rate"))
    if table.count() <= BROADCAST_SOURCES:
        rows = docs.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("_mr_of")))
    else:
        salted = docs.withColumn("_mr_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        own = own.withColumn("_mr_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = salted.join(own, F.col("source").eqNullSafe(F.col("_mr_of")) & (F.col("_mr_salt") == F.col("_mr_part"))).drop("_mr_salt", "_mr_part")
    below = F.transform(
        F.sequence(F.lit(0), F.col("_mr_rate.draws") - 1),
        lambda k: F.transform(F.array(uniform(seed, F.col("doc_id"), k)), lambda u: F.size(F.filter("_mr_rate.cdf", lambda c: c <= u)))[0],
    )
    rows = rows.withColumn("n_copies", F.aggregate(below, F.lit(0), lambda a, b: a + b)).where("n_copies > 0").withColumn("rate", F.col("_mr_rate.rate"))
    return rows.drop("_mr_of", "_mr_rate").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, size: float | None = None, seed: int = 0) -> DataFrame:
    """The copies in a global order that depends on nothing but the seed and their doc_ids."""
    rows = replicated(docs, weights, power, size, seed)
    text = F.concat_ws(":", F.lit(f"order:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))
    rows = rows.withColumn("shuffle_key", F.md5(text))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


SQL = """
WITH n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
r AS (SELECT source, n, weight / (SELECT sum(weight) FROM n) * (SELECT CAST(sum(n) AS DOUBLE) FROM n) / n AS rate FROM n),
m AS (SELECT *, greatest(1, CAST(ceil(rate / 16) AS INTEGER)) AS draws FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM m, range(0, 101) t(k)),
u AS (SELECT doc_id, d.source, d.text, m.rate, j,
             CAST('0x' || substr(md5('0:' || doc_id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, range(0, 1000) t(j) WHERE j < m.draws),
x AS (SELECT u.doc_id, u.source, any_value(u.rate) AS rate, any_value(u.text) AS text, count(c.k) AS n_copies
      FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id, u.source)
SELECT doc_id, source, CAST(i AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, round(rate, 9) AS rate,
       md5('order:0:' || doc_id || ':' || i) AS shuffle_key, md5(text) AS text_md5
FROM x, range(1, 10000) t(i) WHERE i <= n_copies
"""
