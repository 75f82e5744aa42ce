"""Tagged tuples: rows of several kinds under one key, separated again and joined by chosen fields.

A tuple is a struct column and its kind an integer marker, so a union of kinds is a plain union and
a product of two kinds under a key is a join, which Spark may run as it likes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field of a product: its position and the side (0 or 1) that it comes from.
Slot = tuple[int, int]


def tagged(df: DataFrame, keys: Sequence[str], fields: Sequence[str], marker: int) -> DataFrame:
    """key, value, marker: value holds the fields as f0, f1, ...; a single key stays a plain column."""
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return df.select(key.alias("key"), F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)]).alias("value"), F.lit(marker).alias("marker"))


def separated(df: DataFrame, markers: tuple[int, int], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of the two markers; strict: another marker is an error when rows are read."""
    if strict:
        known = F.col("marker").isin(list(markers))
        df = df.withColumn("marker", F.when(known, F.col("marker")).otherwise(F.raise_error(F.lit("unexpected marker")).cast("int")))
    return tuple(df.where(F.col("marker") == m) for m in markers)


def _side(slot: Slot) -> Column:
    nth, side = slot
    return F.col(f"{'_left' if side == 0 else '_right'}.f{nth}")


def product(left: DataFrame, right: DataFrame, slots: Sequence[Slot], keys: Sequence[Slot], marker: int = 0) -> DataFrame:
    """Every pair of a left and a right tuple of one key, as a tuple of the slots under new keys."""
    a = left.select("key", F.col("value").alias("_left"))
    b = right.select("key", F.col("value").alias("_right"))
    new = [_side(k) for k in keys]
    key = new[0] if len(new) == 1 else F.struct(*[c.alias(f"k{i}") for i, c in enumerate(new)])
    return a.join(b, "key").select(key.alias("key"), F.struct(*[_side(s).alias(f"f{i}") for i, s in enumerate(slots)]).alias("value"), F.lit(marker).alias("marker"))


def crossed(left: DataFrame, right: DataFrame, slots: Sequence[Slot], marker: int = 0) -> DataFrame:
    """Every pair of a left and a right tuple, whatever their keys, as a tuple of the slots under the left key. As many rows as the product."""
    a, b = left.select("key", F.col("value").alias("_left")), right.select(F.col("value").alias("_right"))
    return a.crossJoin(b).select("key", F.struct(*[_side(s).alias(f"f{i}") for i, s in enumerate(slots)]).alias("value"), F.lit(marker).alias("marker"))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """The tuple's fields as columns of the given names."""
    return df.select(*[F.col(f"value.f{i}").alias(n) for i, n in enumerate(names)])


def at_most(df: DataFrame, keys: Sequence[str], n: int = 1) -> DataFrame:
    """The same rows; reading them fails if a key occurs more than n times. Costs one aggregate."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    check = counts.agg(F.max("_n").alias("_most"))
    most = check.first()["_most"]
    if most is not None and most > n:
        raise ValueError(f"a key of {', '.join(keys)} occurs {most} times")
    return df


def left_count(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "n") -> DataFrame:
    """Left rows with how many right rows match: counted before the join, so the join moves one row a key."""
    counts = right.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def semi(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Left rows with a right row that meets the condition, which may go beyond equality."""
    return left.join(right, condition, "left_semi")


def anti(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Left rows without such a right row."""
    return left.join(right, condition, "left_anti")
