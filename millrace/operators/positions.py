"""Positions in a global order, and what is defined by them.

A window over a whole table would put it into one partition. Instead rows are range-partitioned and
sorted, and written once with their partition and place in it; the partitions' sizes, one row each, give
the offsets. The order must be total for positions to be determined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import ship, stored

_SHIFT = 33  # of the partition in monotonically_increasing_id


def _placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows with _mr_part and _mr_place, stored: both must not change between the two readings."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mr_id", F.monotonically_increasing_id())
    return stored(rows.withColumn("_mr_part", F.shiftright("_mr_id", _SHIFT)).withColumn("_mr_place", F.col("_mr_id").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_mr_id"), "placed")


def _offsets(parts: DataFrame, value: str, to: str) -> DataFrame:
    """_mr_part and the sum of value over all parts before; parts has one row a partition."""
    w = Window.orderBy("_mr_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_mr_part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(to))


def with_positions(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Adds the row's 0-based position in the order."""
    rows = _placed(df, order)
    sizes = rows.groupBy("_mr_part").agg(F.count(F.lit(1)).alias("_mr_n"))
    out = rows.join(_offsets(sizes, "_mr_n", "_mr_before"), "_mr_part")
    return out.withColumn(name, F.col("_mr_before") + F.col("_mr_place")).select(*df.columns, name)


def first_part(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The n first rows: a top-n, without ranking the rest."""
    return df.orderBy(*order).limit(n)


def skipping(df: DataFrame, start: int, stride: int, limit: int = 0, pos: str = "pos") -> DataFrame:
    """Rows at positions start, start + stride, ... below the limit (0: no limit)."""
    if stride < 1 or start < 0:
        raise ValueError("start must not be negative, stride must be positive")
    p = F.col(pos)
    test = (p >= start) & ((p - start) % stride == 0)
    return df.where(test & (p < limit) if limit else test)


def distributed(df: DataFrame, ranks: int, cyclic: bool, pos: str = "pos", place: bool = True) -> DataFrame:
    """Adds rank: position modulo ranks, or position over the block size; place: also puts rows there."""
    if cyclic:
        out = df.withColumn("rank", (F.col(pos) % ranks).cast("int"))
    else:
        n = df.agg(F.max(pos)).first()[0]
        size = max(1, -(-(0 if n is None else n + 1) // ranks))
        out = df.withColumn("rank", F.floor(F.col(pos) / size).cast("int"))
    return out.repartitionById(ranks, F.col("rank")) if place else out


def levelled(df: DataFrame, ranks: int, key: str = "key", place: bool = True) -> DataFrame:
    """Adds rank so that a key's rows stay together and ranks get about as many rows.

    A key's rank comes from the rows of all smaller keys: the prefix sum of its counts, not of the rows.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_mr_n"))
    sums = exclusive_sum(counts, "_mr_n", key, name="_mr_before")
    total = max(1, sums.agg(F.sum("_mr_n")).first()[0] or 0)
    ranked = sums.select(F.col(key).alias("_key"), F.floor(F.col("_mr_before") * ranks / total).cast("int").alias("rank"))
    out = df.join(ranked, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return out.repartitionById(ranks, F.col("rank")) if place else out


def rank_counts(df: DataFrame, ranks: int, rank: str = "rank") -> DataFrame:
    """rank, n for every rank, empty ones too."""
    n = df.groupBy(F.col(rank).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(ranks).withColumnRenamed("id", "rank")
    return every.join(n, "rank", "left").select(F.col("rank").cast("int").alias("rank"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, ranks: int, rank: str = "rank") -> DataFrame:
    """n, mean, population variance, least and most rows of a rank."""
    c = rank_counts(df, ranks, rank)
    return c.agg(F.sum("n").alias("n"), F.avg("n").alias("mean"), F.var_pop("n").alias("variance"), F.min("n").alias("least"), F.max("n").alias("most"))


def exclusive_sum(df: DataFrame, value: str, *order: str | Column, name: str = "scan") -> DataFrame:
    """Adds the sum of value over all rows before in the order."""
    rows = _placed(df, order)
    inside = Window.partitionBy("_mr_part").orderBy("_mr_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_mr_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_mr_sum"))
    out = rows.withColumn("_mr_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(_offsets(parts, "_mr_sum", "_mr_before"), "_mr_part")
    return out.withColumn(name, F.col("_mr_before") + F.col("_mr_inside")).select(*df.columns, name)


def exclusive_scan(df: DataFrame, value: str, combine: Callable[[Any, Any], Any], identity: Any, *order: str | Column, name: str = "scan", kind: str | None = None) -> tuple[DataFrame, Any]:
    """Adds the fold of value over all rows before, for any associative combine; also returns the total.

    Each partition is folded, the partials (one a partition) are scanned on the driver, and a second pass adds them.
    Both passes go over sorted rows batch by batch. Empty partitions and tables count as the identity.
    """
    ship(df.sparkSession)
    kind = kind or df.schema[value].dataType.simpleString()
    rows = _placed(df, order).repartition("_mr_part").sortWithinPartitions("_mr_part", "_mr_place")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, Any] = {}
        for f in frames:
            for part, v in zip(f["_mr_part"], f["_v"]):
                totals[part] = combine(totals.get(part, identity), v)
        yield pd.DataFrame({"_mr_part": list(totals), "_total": list(totals.values())})

    partials = rows.select("_mr_part", F.col(value).alias("_v")).mapInPandas(fold, f"_mr_part long, _total {kind}")
    before, total = {}, identity
    for r in sorted(partials.collect(), key=lambda r: r["_mr_part"]):
        before[r["_mr_part"]] = total
        total = combine(total, r["_total"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for f in frames:
            out = []
            for part, v in zip(f["_mr_part"], f[value]):
                if part != at:
                    at, state = part, before[part]
                out.append(state)
                state = combine(state, v)
            yield f.drop(columns=["_mr_part", "_mr_place"]).assign(**{name: out})

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return rows.mapInPandas(scan, f"{fields}, `{name}` {kind}"), total


def local_sum(df: DataFrame, value: str, rank: str, *order: str | Column, carry: DataFrame | None = None, name: str = "scan") -> tuple[DataFrame, DataFrame]:
    """Adds the sum of value over the rows before in the rank's own order; also rank and carry: what each rank hands on.

    carry: rank and carry of the ranks that begin with something.
    """
    inside = Window.partitionBy(rank).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = df.groupBy(rank).agg(F.sum(value).alias("carry"))
    if carry is None:
        return out, totals
    given = carry.select(F.col(rank).alias("_mr_rank"), F.col("carry").alias("_mr_carry"))
    out = out.join(given, F.col(rank) == F.col("_mr_rank"), "left").withColumn(name, F.col(name) + F.coalesce("_mr_carry", F.lit(0))).select(*df.columns, name)
    sums = carry.select(rank, "carry").unionByName(totals).groupBy(rank).agg(F.sum("carry").alias("carry"))
    return out, sums
