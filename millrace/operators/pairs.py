"""Key-value algebra over DataFrames with columns key and value.

Each method returns a new Pairs over a lazy plan: inputs are never consumed, outputs may be read again,
and Catalyst sees every algebraic step. Python callables run over Arrow batches, for what has no
expression. Groups have no order inside unless order_by is given.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import ship

Emit = Callable[[Any, Any], Iterable[tuple[Any, Any]]]
Reduce = Callable[[Any, list[Any]], Iterable[tuple[Any, Any]]]

#: Options that operators accept for compatibility; they change nothing, since inputs are immutable and Spark schedules.
NEUTRAL = frozenset({"inspect", "nothreading", "pushoff", "collapse"})

#: Rows of a cell of match() at most, of values of few bytes and of texts and nested values; bytes of a batch that comes out of Python.
CELL_ROWS, WIDE_ROWS, BATCH_BYTES = 16_384, 256, 4 << 20
NESTED = (T.ArrayType, T.StructType, T.MapType)
BATCH_ROWS, BATCH_CONF = 10_000, "spark.sql.execution.arrow.maxBytesPerBatch"
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def checked(given: dict[str, Any], allowed: Iterable[str] = ()) -> dict[str, Any]:
    """The options that have a meaning; raises ValueError for one that the operator does not take."""
    unknown = set(given) - NEUTRAL - set(allowed)
    if unknown:
        raise ValueError(f"unsupported options: {', '.join(sorted(unknown))}")
    return {k: v for k, v in given.items() if k in set(allowed)}


def _weight(x: Any) -> int:
    """About how many bytes a value takes."""
    if isinstance(x, (str, bytes)):
        return len(x)
    if isinstance(x, dict):
        return sum(_weight(k) + _weight(v) for k, v in x.items())
    return sum(map(_weight, x)) if isinstance(x, (list, tuple)) else getattr(x, "nbytes", 8)


def framed(rows: Iterable[tuple[Any, ...]], *columns: str) -> Iterator[pd.DataFrame]:
    """Rows, as they come, in frames of 10,000 or 4 MB: a frame costs as much as thousands of rows. Columns are key and value by default."""
    names, held, size = list(columns) or ["key", "value"], [], 0
    for r in rows:
        held.append(r)
        size += sum(map(_weight, r))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _frame(held, names)
            held, size = [], 0
    if held:
        yield _frame(held, names)


def _frame(rows: list[tuple[Any, ...]], names: list[str]) -> pd.DataFrame:
    """Rows as a frame. Where numbers stand beside others or None, pandas would round whole ones to floats: such columns keep their values."""
    f = pd.DataFrame(rows, columns=names)
    for i, n in enumerate(names):
        if f[n].dtype == float and not all(type(r[i]) is float for r in rows):
            f[n] = pd.Series([r[i] for r in rows], dtype=object)
    return f


class Pairs:
    def __init__(self, df: DataFrame):
        if df.columns != ["key", "value"]:
            raise ValueError(f"columns must be key and value, not {df.columns}")
        self.df = df

    # construction

    @classmethod
    def of(cls, df: DataFrame, key: Column | str, value: Column | str) -> Pairs:
        col = lambda x: F.col(x) if isinstance(x, str) else x
        return cls(df.select(col(key).alias("key"), col(value).alias("value")))

    @classmethod
    def create(cls, spark: SparkSession, rows: Iterable[tuple[Any, Any]] = (), key: str = "string", value: str = "string") -> Pairs:
        """Typed pairs of driver-side rows; empty without rows."""
        return cls(spark.createDataFrame(list(rows), f"key {key}, value {value}"))

    @classmethod
    def generate(cls, spark: SparkSession, fn: Callable[[int], Iterable[tuple[Any, Any]]], ranks: int, key: str, value: str, once: bool = False) -> Pairs:
        """What fn(rank) emits on each of the ranks, or on rank 0 alone."""
        ship(spark)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for rank in f["id"]:
                    yield pd.DataFrame(list(fn(int(rank))), columns=["key", "value"])

        n = 1 if once else ranks
        return cls(spark.range(0, n, 1, n).mapInPandas(run, f"key {key}, value {value}"))

    @classmethod
    def concat(cls, *parts: Pairs) -> Pairs:
        """All pairs of all parts, repeats included."""
        if not parts:
            raise ValueError("nothing to concatenate")
        if len({tuple(f.dataType.simpleString() for f in p.df.schema) for p in parts}) > 1:
            raise ValueError("parts differ in their key or value type")
        return cls(functools.reduce(DataFrame.unionByName, (p.df for p in parts)))

    def save(self, path: str) -> None:
        self.df.write.parquet(path)

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> Pairs:
        """Types come with the data."""
        return cls(spark.read.parquet(path))

    # one pair at a time

    def select(self, key: Column | None = None, value: Column | None = None) -> Pairs:
        """New key and value expressions: projection that stays in the optimizer's sight."""
        return Pairs(self.df.select((F.col("key") if key is None else key).alias("key"), (F.col("value") if value is None else value).alias("value")))

    def where(self, test: Column | str) -> Pairs:
        return Pairs(self.df.where(test))

    def explode(self, values: Column) -> Pairs:
        """A pair for every element of an array expression."""
        return Pairs(self.df.select("key", F.explode(values).alias("value")))

    def map(self, fn: Emit, key: str, value: str, **options: Any) -> Pairs:
        """A Python function from a pair to any number of pairs. on_error="warn" skips pairs that raise."""
        skip = checked(options, ("on_error",)).get("on_error", "fail") == "warn"
        ship(self.df.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out: list[tuple[Any, Any]] = []
                for k, v in zip(f["key"], f["value"]):
                    try:
                        out += fn(k, v)
                    except Exception:
                        if not skip:
                            raise
                yield pd.DataFrame(out, columns=["key", "value"])

        return Pairs(self.df.mapInPandas(run, f"key {key}, value {value}"))

    def map_rank_by_rank(self, fn: Emit, key: str, value: str) -> Pairs:
        """map, one rank (partition) after the other in a single task, so that fn sees them in order. To look at small results."""
        ship(self.df.sparkSession)
        ranked = self.df.withColumn("_rank", F.spark_partition_id()).repartition(1).sortWithinPartitions("_rank")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([x for k, v in zip(f["key"], f["value"]) for x in fn(k, v)], columns=["key", "value"])

        return Pairs(ranked.mapInPandas(run, f"key {key}, value {value}"))

    def map_some(self, test: Column | str) -> Pairs:
        """At most one pair that passes the test; none if there is none."""
        return Pairs(self.df.where(test).limit(1))

    def any(self, test: Column | str) -> bool:
        return not self.df.where(test).isEmpty()

    def reverse(self) -> Pairs:
        return Pairs(self.df.select(F.col("value").alias("key"), F.col("key").alias("value")))

    def pair(self) -> Pairs:
        """(k, v) to (k, (k, v))."""
        return Pairs(self.df.select("key", F.struct("key", "value").alias("value")))

    def unpair(self) -> Pairs:
        """(k0, (k1, v1)) to (k1, v1)."""
        return Pairs(self.df.select(F.col("value.key").alias("key"), F.col("value.value").alias("value")))

    # exchange

    def shuffle(self, ranks: int | None = None, key_as_rank: bool = False) -> Pairs:
        """Pairs of a key together. With key_as_rank the key is the partition, and one out of range fails."""
        if not key_as_rank:
            return Pairs(self.df.repartition(ranks, "key") if ranks else self.df.repartition("key"))
        if not ranks:
            raise ValueError("key_as_rank needs the number of ranks")
        inside = F.col("key").isNotNull() & (F.col("key") >= 0) & (F.col("key") < ranks)
        key = F.when(inside, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("key is no rank: "), F.coalesce(F.col("key").cast("string"), F.lit("null")))).cast("long"))
        return Pairs(self.df.withColumn("key", key).repartitionById(ranks, F.col("key").cast("int")))

    def replicate(self, ranks: int | None = None) -> Pairs:
        """With ranks, that many copies of every pair; else the pairs in one partition (small results only)."""
        if ranks is None:
            return Pairs(self.df.coalesce(1))
        copies = F.explode(F.sequence(F.lit(1), F.lit(ranks)))
        return Pairs(self.df.select("key", "value", copies.alias("_copy")).drop("_copy"))

    # groups

    def reduce(self, value: Column) -> Pairs:
        """An aggregate expression of each key: partial sums before the exchange."""
        return Pairs(self.df.groupBy("key").agg(value.alias("value")))

    def reduce_with(self, fn: Reduce, key: str, value: str, order_by: str | None = None) -> Pairs:
        """A Python function from a key and all its values to any number of pairs; a group must fit a task.

        Groups stream through a task in the order of their keys, many to a batch. Values that are null come as None, last in their order.
        """
        if isinstance(self.field_types()[0], NESTED):
            return self._reduce_framewise(fn, key, value, order_by)
        order = [F.col("value").asc_nulls_last()] if order_by == "value" else []
        if order_by not in (None, "key", "value"):
            raise ValueError(f"no column to order by: {order_by}")
        return self.shuffle()._reduce_runs(fn, key, value, *order)

    def _reduce_framewise(self, fn: Reduce, key: str, value: str, order_by: str | None) -> Pairs:
        """reduce_with by frames of a group each, for keys that Python cannot compare."""
        ship(self.df.sparkSession)

        def run(f: pd.DataFrame) -> pd.DataFrame:
            if order_by:
                f = f.sort_values(order_by, kind="stable")
            return pd.DataFrame(list(fn(f["key"].iloc[0], list(f["value"]))), columns=["key", "value"])

        return Pairs(self.df.groupBy("key").applyInPandas(run, f"key {key}, value {value}"))

    def _reduce_runs(self, fn: Reduce, key: str, value: str, *order: Column) -> Pairs:
        """fn of each run of a key in each partition, sorted by key. Nulls travel beside their columns, so that whole numbers stay whole."""
        ship(self.df.sparkSession)
        filled = [F.coalesce(n, F.lit(0).cast(t)).alias(n) if isinstance(t, T.NumericType) else F.col(n) for n, t in zip(("key", "value"), self.field_types())]
        rows = self.df.sortWithinPartitions(F.col("key").asc(), *order).select(*filled, F.isnull("key").alias("_no_key"), F.isnull("value").alias("_no_value"))

        def runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, list[Any]]]:
            held_key, held, some = None, [], False
            for f in frames:
                keys, values = ([None if n else x for x, n in zip(f[c], f[no])] if f[no].any() else list(f[c]) for c, no in (("key", "_no_key"), ("value", "_no_value")))
                for k, v in zip(keys, values):
                    if some and k != held_key and (k == k or held_key == held_key):
                        yield held_key, held
                        held = []
                    held_key, some = k, True
                    held.append(v)
            if some:
                yield held_key, held

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return framed(x for k, vs in runs(frames) for x in fn(k, vs))

        return Pairs(rows.mapInPandas(run, f"key {key}, value {value}"))

    def combine(self, fn: Reduce, key: str, value: str) -> Pairs:
        """reduce_with inside each partition: a combiner for before a shuffle. Groups stream, one at a time."""
        return self._reduce_runs(fn, key, value)

    def reduce_all(self, value: Column) -> Any:
        """One aggregate over every pair, whatever its key; None without pairs."""
        return self.df.agg(value.alias("value")).first()["value"]

    def reduce_ranks(self, value: Column, rank: Column) -> DataFrame:
        """rank, value: one aggregate over all pairs of each rank, whatever their keys; none for a rank without pairs."""
        return self.df.groupBy(rank.alias("rank")).agg(value.alias("value"))

    def reduce_some(self, value: Column, test: Column | str) -> Pairs:
        """At most one group whose aggregate passes the test."""
        return Pairs(self.reduce(value).df.where(test).limit(1))

    def count_keys(self) -> Pairs:
        return self.reduce(F.count(F.lit(1)))

    def distinct_keys(self) -> Pairs:
        """One pair of each key."""
        return Pairs(self.df.dropDuplicates(["key"]))

    def collect_values(self) -> Pairs:
        """Each key with the array of its values."""
        return self.reduce(F.collect_list("value"))

    def match(self, other: Pairs) -> Pairs:
        """Inner join on the key: the left value becomes the key, the right value the value, in full product.

        The product of a key is made from pairs of cells of bounded size, which are dealt out over all tasks: few keys, or
        a hot one, keep no task busy alone, and no task holds more than two cells at a time.
        """
        a, b = self.df.schema["key"].dataType, other.df.schema["key"].dataType
        if a != b:
            raise ValueError(f"keys differ in type: {a.simpleString()}, {b.simpleString()}")
        spark = self.df.sparkSession
        ship(spark)
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, BATCH_BYTES)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for left, right in zip(b.column(0), b.column(1)):
                    left, right = left.values, right.values
                    rows = max(1, min(CELL_ROWS, BATCH_BYTES // (left.nbytes // len(left) + right.nbytes // len(right) + 1)))
                    for j in range(0, len(right), rows):
                        some = right.slice(j, rows)
                        step = max(1, rows // len(some))
                        tiled = some.take(pa.array(np.tile(np.arange(len(some)), min(step, len(left)))))
                        for i in range(0, len(left), step):
                            each = pa.array(np.repeat(np.arange(i, min(i + step, len(left))), len(some)))
                            yield pa.RecordBatch.from_arrays([left.take(each), tiled.slice(0, len(each))], ["key", "value"])

        pairs = self._cells("_left").join(other._cells("_right"), "key").select("_left", "_right")
        dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        types = T.StructType([T.StructField("key", self.field_types()[1]), T.StructField("value", other.field_types()[1])])
        return Pairs(dealt.mapInArrow(product, types))

    def _cells(self, name: str) -> DataFrame:
        """key and arrays of values, nulls included: those of a key in a run of rows. Pairs without a key are left out."""
        block = F.floor(F.monotonically_increasing_id() / (CELL_ROWS if isinstance(self.field_types()[1], FIXED) else WIDE_ROWS))
        values = F.transform(F.collect_list(F.struct("value")), lambda x: x["value"])
        return self.df.where("key is not null").groupBy("key", block.alias("_block")).agg(values.alias(name)).drop("_block")

    # order

    def sort(self, descending: bool = False) -> Pairs:
        """Global order by key: range exchange on sampled bounds, then a sort of each partition."""
        return Pairs(self.df.orderBy(F.col("key").desc() if descending else F.col("key").asc()))

    def sort_small(self) -> Pairs:
        """The same order in one partition, for results known to be small."""
        return Pairs(self.df.coalesce(1).sortWithinPartitions("key"))

    def sort_locally(self) -> Pairs:
        return Pairs(self.df.sortWithinPartitions("key"))

    # looking at pairs

    def count(self) -> int:
        return self.df.count()

    def local_counts(self) -> DataFrame:
        """rank, n of each partition that holds pairs."""
        return self.df.groupBy(F.spark_partition_id().alias("rank")).agg(F.count(F.lit(1)).alias("n"))

    def one(self) -> tuple[Any, Any]:
        """The only pair; ValueError if there is none, or are several."""
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("not exactly one pair")
        return rows[0]["key"], rows[0]["value"]

    def find(self, key: Any) -> Any:
        """The value of a key that occurs once; KeyError without it, ValueError if it occurs again."""
        rows = self.df.where(F.col("key").eqNullSafe(F.lit(key))).limit(2).collect()
        if not rows:
            raise KeyError(key)
        if len(rows) > 1:
            raise ValueError(f"key occurs more than once: {key!r}")
        return rows[0]["value"]

    def take(self, n: int) -> list[Row]:
        return self.df.take(n)

    def dump(self, n: int = 20) -> str:
        """The first pairs as text, a line each."""
        line = F.format_string("%s: %s", F.col("key").cast("string"), F.col("value").cast("string"))
        return "\n".join(r[0] for r in self.df.limit(n).select(line).collect())

    def field_types(self) -> tuple[T.DataType, T.DataType]:
        return self.df.schema["key"].dataType, self.df.schema["value"].dataType


class Builder:
    """Appends pairs on the driver; done() seals it."""

    def __init__(self, spark: SparkSession, key: str = "string", value: str = "string"):
        self.spark, self.types, self.rows, self.sealed = spark, (key, value), [], False

    def add(self, key: Any, value: Any) -> None:
        if self.sealed:
            raise ValueError("already sealed")
        self.rows.append((key, value))

    def done(self) -> Pairs:
        if self.sealed:
            raise ValueError("already sealed")
        self.sealed = True
        return Pairs.create(self.spark, self.rows, *self.types)
