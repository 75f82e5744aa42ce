"""Shared plumbing of the training-data operators: scratch tables, Arrow batch helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.positions import with_positions
from millrace.storage import drop_stored, scratch, stored

__all__ = ["NUMBER", "WORD_BREAK", "Scratch", "drop_stored", "group_bounds", "lean", "let", "merged", "numbered", "scratch", "ship", "small_batches", "stored", "whole_groups", "words"]

#: White space that separates words in every word-based contract (fixed value).
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Text that goes to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = "4m"
#: Arrow shares the allocator of numpy and Python, so that lean() gives back what any of them has freed.
ALLOCATOR = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(128 << 20)}

Batches = Iterator[pa.RecordBatch]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep them small."""
    storage.ship(spark)
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches; at a task's end the worker gives its free memory back."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


class Scratch:
    """Stored tables of one computation, dropped one by one or all together."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(stored(df, name))
        return self.held[-1]

    def adopt(self, table: DataFrame) -> DataFrame:
        """A table that another computation stored and handed over."""
        self.held.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """The given tables; without any, all that are still held."""
        for df in tables or tuple(self.held):
            self.held = [x for x in self.held if x is not df]
            drop_stored(df)


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that moves both sides at every size, so that its plan and cost do not change with the data; skewed keys are split."""
    return left.join(right.hint("merge"), on, how)


#: The column that numbered() adds; no table should have one of that name.
NUMBER = "_mr_number"


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """All columns with _mr_number: a long in the order of doc_id, and of the text's hash inside a doc_id; null for a null doc_id.

    Where no doc_id repeats it is the doc_id, which costs one count of ids. Otherwise rows of one doc_id with
    different texts get different numbers, equal texts the same one; the flag tells that.
    """
    keyed = docs.withColumn(NUMBER, F.col("doc_id").cast("long"))
    if keyed.where(F.col(NUMBER).isNotNull()).groupBy(NUMBER).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return keyed, False
    keyed = keyed.withColumnRenamed(NUMBER, "_mr_key").withColumn("_mr_hash", F.xxhash64("text"))
    kinds = with_positions(keyed.where("_mr_key IS NOT NULL").select("_mr_key", "_mr_hash").distinct(), "_mr_key", "_mr_hash", name=NUMBER)
    return merged(keyed, stored(kinds, "numbers"), ["_mr_key", "_mr_hash"], "left").drop("_mr_key", "_mr_hash"), True


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of one string column stay near the limit (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, k in enumerate(lengths):
            if size and size + k > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += k
        yield batch.slice(start, n - start)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups, of so many rows or bytes, from batches that are sorted by the keys; a group must fit in memory."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        table = pa.concat_tables(held).combine_chunks()
        same = None
        for k in keys:
            x = pc.equal(table.column(k), table.column(k)[-1])
            same = x if same is None else pc.and_(same, x)
        cut = table.num_rows - int(pc.sum(same).as_py())
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_bounds(*columns: np.ndarray) -> list[tuple[int, int]]:
    """From and to of each run of equal values in sorted columns."""
    n = len(columns[0])
    fresh = np.zeros(n + 1, bool)
    fresh[[0, n]] = True
    for c in columns:
        fresh[1:n] |= c[1:] != c[:-1]
    at = np.flatnonzero(fresh).tolist()
    return list(zip(at[:-1], at[1:])) if n else []


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind value once for body: Catalyst would copy the expression to each of its uses."""
    return F.transform(F.array(value), body)[0]
