"""File sources: names, lines, records, tables and reassembled segments."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.positions import with_positions
from millrace.storage import ship


def read_list_file(spark: SparkSession, path: str) -> list[str]:
    """One name a line, trimmed; lines that begin with # and empty lines do not count."""
    return [x for x in (r["value"].strip() for r in spark.read.text(path).collect()) if x and x[0] != "#"]


def file_names(spark: SparkSession, names: Sequence[str], subdirectories: bool = False, list_file: bool = False) -> DataFrame:
    """key: path, value: 0. Names are of any store that Spark reads. Folders are entered only with subdirectories;
    dot files are left out; a missing name raises."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found: list[str] = []

    def enter(folder: str, files: Any) -> None:
        inside = sorted((x.getPath().getName(), x.isDirectory()) for x in files.listStatus(path_of(folder)))
        found.extend(f"{folder}/{name}" for name, is_folder in inside if name[0] != "." and not is_folder)
        for name, is_folder in inside:
            if name[0] != "." and is_folder:
                enter(f"{folder}/{name}", files)

    for name in [x for n in names for x in read_list_file(spark, n)] if list_file else names:
        files = path_of(name).getFileSystem(conf)
        if not files.exists(path_of(name)):
            raise FileNotFoundError(name)
        if not files.getFileStatus(path_of(name)).isDirectory():
            found.append(name)
        elif subdirectories:
            enter(name.rstrip("/"), files)
        else:
            raise ValueError(f"a folder, but subdirectories is not set: {name}")
    return spark.createDataFrame([(x, 0) for x in found], "key string, value long")


def map_file_names(names: DataFrame, fn: Callable[[str], Iterable[tuple[Any, Any]]], key: str, value: str, ranks: int = 8) -> DataFrame:
    """A Python function from a path to pairs, one call a file, dealt out over ranks."""
    ship(names.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["key"]:
                yield pd.DataFrame(list(fn(path)), columns=["key", "value"])

    return names.select("key").repartition(ranks).mapInPandas(run, f"key {key}, value {value}")


def lines_of_text(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """line (from 0) and value, each with its newline, of a text column; a last line may lack it."""
    cut = F.split(text, "(?<=\n)")
    return df.select(*keep, F.posexplode(F.filter(cut, lambda x: x != "")).alias("line", "value"))


def file_lines(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """key: number of the line in its file from 0, value: the line with its newline. Splittable; limit: so many lines of each file (0: all)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    out = with_positions(raw, "_file", "_block", "_id")
    first = out.groupBy("_file").agg(F.min("pos").alias("_first"))
    out = out.join(first, "_file").select((F.col("pos") - F.col("_first")).alias("key"), F.concat("value", F.lit("\n")).alias("value"))
    return out.where(F.col("key") < limit) if limit else out


def text_chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value: what stands between separators."""
    return spark.read.option("lineSep", separator).text(path)


def records(spark: SparkSession, path: str, key_bytes: int = 10, record_bytes: int = 100) -> DataFrame:
    """key and value of fixed-width records: the key's bytes, and the rest. Files are split between records; no Python."""
    jvm, session = spark._jvm, spark._jsparkSession
    raw = session.createDataset(spark.sparkContext._jsc.binaryRecords(path, record_bytes).rdd(), jvm.org.apache.spark.sql.Encoders.BINARY())
    rows = DataFrame(raw.toDF(), spark).toDF("r")
    return rows.select(F.substring("r", 1, key_bytes).alias("key"), F.substring("r", key_bytes + 1, record_bytes - key_bytes).alias("value"))


def reassembled(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """color, content: the bytes [offset, offset + bytes) of files, joined in rank order for each color.

    segments: color, rank, path, offset, bytes (negative: to the end). A missing file is an error. A file, and what
    is joined, must fit a row (2 GB).
    """
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    paths = [r["path"] for r in segments.select("path").distinct().toLocalIterator()]
    if not paths:
        return segments.select("color", F.lit(b"").alias("content")).limit(0)
    files = spark.read.format("binaryFile").load(paths).select(plain("path").alias("_path"), "content")
    size = F.when(F.col("bytes") < 0, F.length("content")).otherwise(F.col("bytes"))
    part = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), size.cast("int"))
    rows = segments.join(files, plain("path") == F.col("_path")).groupBy("color").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return rows.select("color", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("content"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """from and to of lines "from<TAB>to"; lines that do not begin with a digit do not count."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.col("value").rlike("^[0-9]")).select(parts[0].cast("long").alias("from"), parts[1].cast("long").alias("to"))


def delimited(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tables of |-terminated lines; a field that does not fit its type fails the read. Filters and columns are pushed into the scan."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    full = T.StructType([*fields, T.StructField("_end", T.StringType())])
    return spark.read.csv(path, schema=full, sep="|", mode="FAILFAST", dateFormat="yyyy-MM-dd").drop("_end")
