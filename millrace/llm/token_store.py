"""Token-id output: documents encoded to Parquet list columns, and read back selectively.

File format. Rows are in ascending doc_id order over the part files, in file-name order. Columns:

* ``doc_id`` long, ``part`` int, ``part_start`` long (ids of earlier rows of the part), ``n_tokens`` long:
  metadata, readable without touching the ids. With writer version 2, ``doc_id`` and ``part_start``, which are all
  different, are delta encoded; ``part`` and ``n_tokens``, which recur, keep the dictionary that the writer tries first;
* ``ids`` list<int>: dictionary encoded, bit-packed to the width of the ids that occur.

Row groups and pages are bounded, and Parquet page indexes let a reader skip to a doc_id range.

Defined results: null text is empty (its row holds the end id alone); a null doc_id sorts first;
rows that repeat a doc_id are all written, ordered by a hash of their text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import BEHIND, VISIBLE, PieceEncoder
from millrace.llm.common import lean, scratch, ship, small_batches

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ROW_GROUP, PAGE, DICTIONARY = 32 << 20, 256 << 10, 1 << 20

#: How the byte-level family prints the space (fixed value).
SPACE = "Ġ"

_encoders: dict[str, PieceEncoder] = {}


def library_encoder(tokenizer_path: str) -> PieceEncoder:
    """One per worker process and tokenizer file; it keeps its cache between tasks."""
    if tokenizer_path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_path)
        own.no_truncation()
        own.no_padding()

        special = pa.array([x.content for x in own.get_added_tokens_decoder().values()], pa.string())
        newline = np.zeros(own.get_vocab_size(), bool)
        newline[own.encode("\n", add_special_tokens=False).ids] = True
        spaced = np.array([(own.id_to_token(i) or "").startswith(SPACE) for i in range(own.get_vocab_size())])

        def ids_of(text: str) -> np.ndarray:
            return np.frombuffer(array("I", own.encode_batch_fast([text], add_special_tokens=False)[0].ids), "<u4")

        def cut(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * sizes)]).astype("i8"))
            return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, ends, pa.py_buffer(np.ascontiguousarray(ids))])

        def alone(texts: pa.Array) -> pa.Array:
            return pa.array([ids_of(x).tobytes() if x else b"" for x in texts.to_pylist()], pa.large_binary())

        def together(texts: pa.Array, mark: str, starts: np.ndarray) -> pa.Array:
            """Encodes some texts in one call, a mark before each; they begin where a token is one of starts."""
            ids = ids_of(mark + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), mark)[0].as_py())
            at = np.flatnonzero(starts[ids])
            if len(at) != len(texts) or at[0] != 0:
                return alone(texts)
            sizes = np.diff(np.append(at, len(ids)))
            return cut(np.delete(ids, at), sizes - 1) if mark else cut(ids, sizes)

        def encode_many(texts: pa.Array) -> pa.Array:
            """Parts behind a space are encoded in one call, and so are bare ones, with a line end before each."""
            behind = np.array(pc.match_substring_regex(texts, BEHIND), bool)
            bare = np.array(pc.and_(pc.match_substring_regex(texts, VISIBLE), pc.invert(pc.is_in(texts, special))), bool)
            rest, order, out = np.flatnonzero(~(behind | bare)), [], []
            for some, mark, starts in ((np.flatnonzero(behind), "", spaced), (np.flatnonzero(bare), "\n", newline)):
                order.append(some)
                out += [together(texts.take(pa.array(some[lo : lo + 20_000])), mark, starts) for lo in range(0, len(some), 20_000)]
            out.append(alone(texts.take(pa.array(rest))))
            return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate([*order, rest]))))

        _encoders[tokenizer_path] = PieceEncoder(encode_many)
    return _encoders[tokenizer_path]


def _encode(tokenizer_path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = library_encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in small_batches(batches, "text", 4 << 20):
            ids, n = encoder.encode(batch.column("text"))
            own, n = np.cumsum(n), n + 1
            ends = np.cumsum(n)
            flat = np.insert(ids, own, end_id).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(flat))
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), part, "i4")), pa.array(start + ends - n), pa.array(n), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return lean(run)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text, end it with end_id, and write the token files to path.

    One range exchange moves the texts, which are smaller than their ids; its bounds come from
    doc_id, and encoding happens after it, once a row.
    """
    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        ordered.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.dictionary.page.size", DICTIONARY)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of the token files (all if none), with start: the ids before the document.

    Only part totals are gathered: one row for each part file. Selecting metadata alone reads no ids.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.select("part", "part_start", *(columns or ("doc_id", "n_tokens", "ids")))
    return out.join(before, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("part", "part_start", "before")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        names = ["doc_id", "part", "part_start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files under path."""
    ship(spark)
    rows = spark.read.schema(SCHEMA).parquet(path).mapInArrow(lean(_digest), "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    starts = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digests(docs.sparkSession, path)
