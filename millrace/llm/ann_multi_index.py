"""Approximate nearest neighbours by an inverted multi-index.

The two halves of every vector are quantised separately; a cell is a pair of centroids. Codebooks are
fitted on SAMPLE rows at most, chosen by a hash, and grow with the rows up to CENTROIDS a half; every row is
indexed. A query scores the centroids of each half and walks tiles of their pairs (single pairs up to SIDE
centroids) in order of the best summed score with a heap, until the cells it has passed hold PROBE_SHARE of
the different vectors, and at least k + 1 different vec_ids. What lies in those cells is scored exactly.

Cells are packed into blocks of BLOCK_ROWS rows at most (a larger cell is dealt over several blocks
by a hash of vec_id), and the queries of a block into groups of BLOCK_QUERIES, so a task holds one
block and one group of queries; a query goes to the blocks of its cells, with a bit for each cell. Rows
equal in vec_id and vector are merged before they are indexed. Equal vectors of a block are scored once,
and only as many of their ids as can be among the k nearest go on, which is exact. Each block returns
k vec_ids for a query, of their best scores there.

Defined results: a vector that is null, zero, or has a null or non-finite component, or another
length than most vectors have, takes no part; so does a null vec_id. A query's own vec_id is no
candidate, in whichever row; a query vec_id with several vectors asks with the smallest of them, by
components in order; ties go to the smaller vec_id; rows that repeat a vec_id are one candidate, of their
best score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, lean, ship
from millrace.llm.shingles import mix

#: Bound of the rows that codebooks are fitted on, most centroids of each half, rounds of fitting.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 1024, 10
#: Recall at 20 on vectors without structure, the hardest case, is above 0.9 at this share.
PROBE_SHARE = 0.2
#: Tiles of a side of the grid of centroid pairs, at most.
SIDE = 64
BLOCK_ROWS, BLOCK_QUERIES, QUERIES_A_TASK = 4_096, 8_192, 128


@dataclass
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]

    def scores(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.halves[0].shape[1]
        return vectors[:, :cut] @ self.halves[0].T, vectors[:, cut:] @ self.halves[1].T

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Nearest centroid of each half, as one number."""
        near = [(s - 0.5 * (c**2).sum(1)).argmax(1) for s, c in zip(self.scores(vectors), self.halves)]
        return near[0] * len(self.halves[1]) + near[1]


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(own, minlength=len(centres))
        for j in range(x.shape[1]):
            sums = np.bincount(own, weights=x[:, j], minlength=len(centres))
            centres[n > 0, j] = sums[n > 0] / n[n > 0]
    return centres


def fit(vectors: DataFrame, centroids: int = CENTROIDS) -> Codebooks | None:
    """Codebooks from the SAMPLE rows of smallest hash; None without rows."""
    x = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks())
    if not len(x):
        return None
    cut = x.shape[1] // 2
    k = max(1, min(centroids, 2 * len(x) // 3))
    return Codebooks((_centroids(x[:, :cut], k), _centroids(x[:, cut:], k)))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    inf = F.lit(float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (most["d"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten()).astype("f8").reshape(len(column), -1)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _with_cell(books: Codebooks) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = books.cells(_matrix(b.column("embedding")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cells.astype("i4"))], names=["vec_id", "embedding", "cell"])

    return lean(run)


def walk(first: np.ndarray, second: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], kinds: np.ndarray, rows: np.ndarray, wanted: float, least: int = 0) -> np.ndarray:
    """Which of the occupied cells (pairs of centroids) a query passes: by tiles of pairs, in order of their best
    summed score (a heap), until they hold the wanted kinds and least rows."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    step = -(-max(len(a), len(b)) // SIDE)
    x, y = (-first[a[::step]]).tolist(), (-second[b[::step]]).tolist()
    of_first, of_second = np.empty(len(a), "i4"), np.empty(len(b), "i4")  # the tile of a centroid
    of_first[a], of_second[b] = np.arange(len(a), dtype="i4") // step * len(y), np.arange(len(b), dtype="i4") // step
    tile = of_first[pairs[0]] + of_second[pairs[1]]
    of_kinds = np.bincount(tile, kinds, len(x) * len(y)).tolist()
    of_rows = of_kinds if rows is kinds else np.bincount(tile, rows, len(x) * len(y)).tolist()
    taken = np.zeros(len(x) * len(y), bool)
    heap, reached, passed, held = [(x[0] + y[0], 0, 0)], [0] * len(x), 0, 0
    while heap and (passed < wanted or held < least):
        _, i, j = heapq.heappop(heap)
        at = i * len(y) + j
        taken[at] = True
        passed += of_kinds[at]
        held += of_rows[at]
        reached[i] = j + 1
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return np.flatnonzero(taken[tile])


@dataclass
class Layout:
    """The occupied cells: rows and different vectors of each, first block, number of blocks, place among a block's cells."""

    cell: np.ndarray
    kinds: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    parts: np.ndarray
    local: np.ndarray
    cells: np.ndarray  # of each block

    @classmethod
    def of(cls, cell: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> Layout:
        """cell is ascending."""
        start, local = np.zeros(len(cell), "i4"), np.zeros(len(cell), "i4")
        parts = (-(-rows // BLOCK_ROWS)).astype("i4")
        cells, room = [], 0
        for k, n in enumerate(rows.tolist()):
            if parts[k] > 1 or n > room:
                start[k] = len(cells)
                cells += [1] * int(parts[k])
                room = BLOCK_ROWS - n if parts[k] == 1 else 0
            else:
                start[k], local[k] = len(cells) - 1, cells[-1]
                cells[-1] += 1
                room -= n
        return cls(cell, kinds, kinds if (kinds == rows).all() else rows, start, parts, local, np.array(cells, "i4"))


def _placed(layout: Broadcast[Layout]) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = layout.value
        for b in batches:
            ids, at = b.column("vec_id").to_numpy(), np.searchsorted(own.cell, b.column("cell").to_numpy())
            block = own.start[at] + (mix(ids.astype("u8")) % own.parts[at].astype("u8")).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column("vec_id"), b.column("embedding"), pa.array(own.local[at])], names=["block", "vec_id", "embedding", "place"])

    return lean(run)


def _probes(books: Codebooks, layout: Broadcast[Layout], share: float, least: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = layout.value
        pairs, wanted = np.divmod(own.cell, len(books.halves[1])), share * float(own.kinds.sum())
        rows = own.kinds if (own.rows == own.kinds).all() else own.rows
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                of, block, bits = [], [], []
                for i, (p, q) in enumerate(zip(*books.scores(_matrix(part.column("embedding"))))):
                    cells = walk(p, q, pairs, own.kinds, rows, wanted, least)
                    parts = own.parts[cells]
                    cells = np.repeat(cells, parts)
                    blocks = own.start[cells] + np.arange(len(cells)) - np.repeat(np.cumsum(parts) - parts, parts)
                    order = np.argsort(blocks, kind="stable")
                    blocks, places = blocks[order], own.local[cells[order]]
                    edge = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1)).tolist()
                    for x, y in zip(edge, edge[1:]):
                        probed = np.zeros(own.cells[blocks[x]], bool)
                        probed[places[x:y]] = True
                        of.append(i), block.append(blocks[x]), bits.append(np.packbits(probed).tobytes())
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), part.column("vec_id").take(take), part.column("embedding").take(take), pa.array(bits, pa.binary())], names=["block", "query_id", "vector", "bits"])

    return lean(run)


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["query_id", "vec_id", "score"]

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and queries.num_rows:
            x, ids, cell = _matrix(data.column("embedding").combine_chunks()), data.column("vec_id").to_numpy(), data.column("place").to_numpy()
            kinds, cls = np.unique(np.column_stack([x, cell.astype("f8")]), axis=0, return_inverse=True)
            cls = cls.ravel()
            order = np.lexsort((ids, cls))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (cls[order][1:] != cls[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[fresh]  # a vec_id once in a class
            first = np.searchsorted(cls[order], np.arange(len(kinds) + 1))
            _, name, times = np.unique(ids[order], return_inverse=True, return_counts=True)
            wide = times[name] > 1  # of vec_ids with several vectors
            by_id = np.flatnonzero(wide)[np.argsort(name[wide], kind="stable")]
            starts = np.cumsum([0, *times[times > 1]])[:-1]
            wide_cls, single = cls[order[by_id]], np.unique(cls[order[~wide]])
            x, cell = kinds[:, :-1], kinds[:, -1].astype("i8")
            q_all, q_ids, q_bits = _matrix(queries.column("vector").combine_chunks()), queries.column("query_id").to_numpy(), queries.column("bits").to_pylist()
            for lo in range(0, len(q_all), 512):
                q = q_all[lo : lo + 512]
                s = q @ x.T
                probed = np.unpackbits(np.frombuffer(b"".join(q_bits[lo : lo + 512]), "u1").reshape(len(q), -1), axis=1)
                s[probed[:, cell] == 0] = -np.inf
                # columns without a vec_id in common: none of the k nearest is below the best k + 1 of them
                apart = np.concatenate([s[:, single], np.maximum.reduceat(s[:, wide_cls], starts, axis=1)], axis=1) if len(by_id) else s
                n = min(k + 1, apart.shape[1])
                edge = np.partition(apart, apart.shape[1] - n, axis=1)[:, apart.shape[1] - n]
                r, c = np.nonzero((s >= edge[:, None] - 1e-9 * (1 + np.abs(edge[:, None]))) & (s > -np.inf) if np.isfinite(edge).any() else s > -np.inf)
                exact = np.zeros(len(r))
                for j in range(x.shape[1]):  # one order of summation for every pair, so equal vectors tie
                    exact += q[r, j] * x[c, j]
                size = np.minimum(first[c + 1] - first[c], k + 1)
                rep = np.repeat(np.arange(len(r)), size)
                step = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
                v = ids[order[first[c[rep]] + step]]
                qi, sc = q_ids[lo + r[rep]], exact[rep]
                keep = v != qi
                r2, v, qi, sc = r[rep][keep], v[keep], qi[keep], sc[keep]
                rank = np.lexsort((-sc, v, r2))
                best = np.ones(len(rank), bool)
                best[1:] = (r2[rank][1:] != r2[rank][:-1]) | (v[rank][1:] != v[rank][:-1])
                r2, v, qi, sc = (a[rank[best]] for a in (r2, v, qi, sc))
                rank = np.lexsort((v, -sc, r2))
                begin = np.searchsorted(r2[rank], np.arange(len(q)))
                top = rank[np.arange(len(rank)) - begin[r2[rank]] < k] if len(rank) else rank
                for have, new in zip(out, (qi[top], v[top], sc[top])):
                    have.append(new)
        joined = [np.concatenate(a) if a else np.zeros(0) for a in out]
        return pa.table([pa.array(joined[0].astype("i8")), pa.array(joined[1].astype("i8")), pa.array(joined[2].astype("f8"))], names=names)

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by every, its k nearest found."""
    spark, own = vectors.sparkSession, Scratch()
    ship(spark)
    rows = valid(vectors)
    most = rows.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]  # rows of one vec_id
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.distinct() if most > 1 else rows
    books = fit(rows)
    rows = own.keep(rows.mapInArrow(_with_cell(books), "vec_id long, embedding array<double>, cell int"), "cells")
    counts = rows.groupBy("cell", F.xxhash64("embedding").alias("kind")).agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    counts = counts.toArrow().sort_by("cell")  # a row for each pair of centroids at most
    layout = spark.sparkContext.broadcast(Layout.of(*(counts.column(c).to_numpy() for c in ("cell", "rows", "kinds"))))  # bounded likewise
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")) if most > 1 else asked
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES_A_TASK)), "vec_id")
    asked = own.keep(asked.mapInArrow(_probes(books, layout, share, (k + 1) * most), "block int, query_id long, vector array<double>, bits binary"), "probes")
    groups = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    data = rows.mapInArrow(_placed(layout), "block int, vec_id long, embedding array<double>, place int")
    data = data.join(groups, "block").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    asked = asked.join(groups, "block").withColumn("grp", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")
    found = data.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp")).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
