"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Part files whose names follow the order: range-partitioned, sorted inside."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def write_key_files(pairs: DataFrame, path: str) -> None:
    """A folder of text files for each key, lines "key value"."""
    lines = pairs.select(F.col("key").alias("_key"), F.concat_ws(" ", F.col("key").cast("string"), F.col("value").cast("string")).alias("line"))
    lines.repartition("_key").write.partitionBy("_key").text(path)


def write_lines(pairs: DataFrame, path: str) -> None:
    """Lines "key value", keys together."""
    pairs.repartition("key").sortWithinPartitions("key").select(F.concat_ws(" ", F.col("key").cast("string"), F.col("value").cast("string"))).write.text(path)


def split_file(df: DataFrame, path: str, n: int) -> None:
    """A table of text records as n text files."""
    df.select("value").repartition(n).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """Fixed-width records, key then value, as one hex line each, in key order."""
    df.orderBy("key").select(F.hex(F.concat("key", "value"))).write.text(path)


def write_text_records(df: DataFrame, path: str, record_bytes: int = 100) -> None:
    """Fixed-width records of ASCII text, key then value, filled up with blanks; the last byte is a newline. Longer rows fail the write."""
    row = F.concat("key", "value")
    fits = F.octet_length(row) < record_bytes
    df.select(F.when(fits, F.rpad(row, record_bytes - 1, " ")).otherwise(F.raise_error(F.lit("record too long")))).write.text(path)
