"""Iterative analytics: page ranking, clustering, matrices, random graphs, word counts, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import words_between_marks, words_of_letters, words_of_pattern
from millrace.storage import bucketed, drop_stored, stored


def word_counts(df: DataFrame, text: str, how: str = "letters", times: int = 1) -> DataFrame:
    """word, n; how: letters, marks or pattern; times: every rank counting the whole input counts it that often."""
    cut = {"letters": words_of_letters, "marks": words_between_marks, "pattern": words_of_pattern}[how]
    return df.select(F.explode(cut(F.col(text))).alias("word")).groupBy("word").agg((F.count(F.lit(1)) * times).alias("n"))


def top_words(df: DataFrame, text: str, n: int = 5, how: str = "letters") -> DataFrame:
    return word_counts(df, text, how).orderBy(F.desc("n"), "word").limit(n)


def page_ranks(edges: DataFrame, rounds: int = 100, damping: float = 0.85, keep_every: int = 5) -> DataFrame:
    """node, rank after a fixed number of rounds: 1 - d + d * sum(rank / out-degree), not normalised.

    Every node with an out-edge starts at 1; the rank of nodes without one is lost; repeated edges count.
    Parallel edges are summed first. Links are written once, in buckets by their start, so a round moves ranks and
    partial sums, never links. The plan is cut every few rounds by writing the ranks.
    """
    degree = edges.groupBy("from").agg(F.count(F.lit(1)).alias("d"))
    links = bucketed(edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).join(degree, "from").select("from", "to", (F.col("n") / F.col("d")).alias("share")), "links", "from")
    sources = stored(links.select(F.col("from").alias("node")).distinct(), "sources")
    ranks, last = sources.withColumn("rank", F.lit(1.0)), None
    for k in range(1, rounds + 1):
        given = links.join(ranks, links["from"] == ranks["node"]).select(F.col("to").alias("node"), (F.col("rank") * F.col("share")).alias("part"))
        every = given.unionByName(sources.select("node", F.lit(0.0).alias("part")))
        ranks = every.groupBy("node").agg((F.lit(1.0 - damping) + damping * F.sum("part")).alias("rank"))
        if k % keep_every == 0 and k < rounds:
            ranks = stored(ranks, "ranks")
            if last is not None:
                drop_stored(last)
            last = ranks
    return ranks


def _nearest(point: Column, means: Sequence[Sequence[float]], kind: str, reach: float | None = None) -> Column:
    """Index of the nearest mean; ties go to the lower index. Means are literals: they are few. reach: a point whose
    squared distances are all that large belongs to the first mean."""
    far = [F.struct(sum(((point[j] - F.lit(x).cast(kind)) * (point[j] - F.lit(x).cast(kind)) for j, x in enumerate(m)), F.lit(0).cast(kind)).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(means)]
    best = F.least(*far) if len(far) > 1 else far[0]
    return best["i"] if reach is None else F.when(best["d"] < reach, best["i"]).otherwise(F.lit(0))


def k_means(
    points: DataFrame, means: Sequence[Sequence[float]], rounds: int = 10, whole: bool = True, until_stable: bool = False, reach: float | None = None
) -> tuple[list[list[float]], DataFrame]:
    """Means after the rounds, and the points with their cluster. points: id, point (array).

    whole: means are whole numbers, cut towards zero. A mean without points stays. until_stable: goes on
    until no point changes its cluster. A round is one pass with a partial aggregate; only means come back.
    """
    kind = "long" if whole else "double"
    dims = len(means[0])
    now, last = [list(m) for m in means], None
    data = points.select("id", F.col("point").cast(f"array<{kind}>").alias("point"))
    while True:
        own = data.withColumn("cluster", _nearest(F.col("point"), now, kind, reach))
        if not until_stable and rounds <= 0:
            return now, own
        rounds -= 1
        moved = F.lit(True) if last is None else F.col("cluster") != _nearest(F.col("point"), last, kind, reach)
        sums = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(moved, 1)).alias("moved"), *[F.sum(F.col("point")[j]).alias(f"s{j}") for j in range(dims)])
        rows = {r["cluster"]: r for r in sums.collect()}  # a row a mean
        if until_stable and not any(r["moved"] for r in rows.values()):
            return now, own
        last, now = now, [[_mean(rows[i][f"s{j}"], rows[i]["n"], whole) for j in range(dims)] if i in rows else m for i, m in enumerate(now)]


def _mean(total: float, n: int, whole: bool) -> float:
    return (abs(total) // n) * (1 if total >= 0 else -1) if whole else total / n


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col, value of the product of two matrices given as row, col, value."""
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, which stand between colons."""
    text = F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def random_graph(spark: SparkSession, levels: int, edges_per_node: int, a: float, b: float, c: float, d: float, fraction: float = 0.0, seed: int = 1, rounds: int = 100) -> DataFrame:
    """from, to: distinct edges of a recursive-quadrant graph, exactly 2**levels * edges_per_node of them.

    Every level of every draw takes a number hashed from the seed, the draw and the level, so draws need
    no state and a lost task draws the same again. Rounds go on until enough edges are distinct; of more than
    enough, those of smallest hash stay. If the rounds do not give enough, that is an error.
    """
    if abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("a + b + c + d must be 1")
    wanted = edges_per_node << levels

    def draw(k: int) -> DataFrame:
        u = lambda *x: uniform(str(seed), str(k), F.col("id"), *x)
        start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), *[F.lit(float(x)).alias(n) for n, x in zip("abcd", (a, b, c, d))])

        def level(s: Column, n: Column) -> Column:
            r = u(n, F.lit(0))
            i = F.when(r < s["a"] + s["b"], 0).otherwise(1)
            j = F.when((r >= s["a"]) & (r < s["a"] + s["b"]) | (r >= s["a"] + s["b"] + s["c"]), 1).otherwise(0)
            parts = [s[x] * (1 + fraction * (u(n, F.lit(q + 1)) - 0.5)) for q, x in enumerate("abcd")]
            total = parts[0] + parts[1] + parts[2] + parts[3]
            return F.struct((s["i"] * 2 + i).cast("long").alias("i"), (s["j"] * 2 + j).cast("long").alias("j"), *[(p / total).alias(x) for x, p in zip("abcd", parts)])

        state = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, level)
        return spark.range(wanted).select(state.alias("s")).select(F.col("s.i").alias("from"), F.col("s.j").alias("to")).distinct()

    found = stored(draw(0), "edges")
    k = 1
    while found.count() < wanted:
        if k >= rounds:
            raise RuntimeError(f"{rounds} rounds did not give {wanted} distinct edges")
        found, last, k = stored(found.unionByName(draw(k)).distinct(), "edges"), found, k + 1
        drop_stored(last)
    return found.orderBy(F.md5(F.concat_ws(":", "from", "to")), "from", "to").limit(wanted)


def pi_estimate(spark: SparkSession, points: int, seed: int = 1) -> DataFrame:
    """pi and the points it comes from, drawn from hashes."""
    u = lambda k: uniform(str(seed), str(k), F.col("id"))
    inside = F.when(u(0) * u(0) + u(1) * u(1) <= 1, 1).otherwise(0)
    return spark.range(points).agg(F.count(F.lit(1)).alias("points"), F.sum(inside).alias("inside")).withColumn("pi", 4 * F.col("inside") / F.col("points"))


def components(links: DataFrame) -> DataFrame:
    """node, component of an undirected graph a, b: the smallest reachable node, by label spreading with pointer jumps."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(spread, labels["node"] == spread["a"]).select("node", F.least("l", "m").alias("l"))
        up = labels.select(F.col("node").alias("l"), F.col("l").alias("up"))
        new = stored(new.join(up, "l", "left").select("node", F.least("l", F.coalesce("up", "l")).alias("l")), "labels")
        same = new.join(labels.withColumnRenamed("l", "old"), "node").where("l != old").isEmpty()
        labels = new
        if same:
            return labels.select("node", F.col("l").alias("component"))


def grid_clusters(points: DataFrame, low: Sequence[float], high: Sequence[float], layers: int, least: int, density: float) -> DataFrame:
    """id, cluster of points in dense cells of a hierarchical grid; other points are left out. points: id, point (array).

    Level by level every dimension of a cell is halved (a coordinate above the middle is in the upper half).
    A cell with fewer points than least is sparse and dropped. It is dense, and kept whole, at the last layer or if
    it has more points than density times the mean of the cells of its level; other cells are halved again.
    Dense cells that touch are one cluster, named by its smallest point id.
    """
    dims = len(low)
    state = points.select("id", F.col("point").cast("array<double>").alias("point")).withColumn("path", F.array().cast("array<int>"))
    dense: list[DataFrame] = []
    for layer in range(1, layers + 1):
        cells = 1 << layer
        index = [F.least(F.greatest(F.ceil((F.col("point")[j] - lo) / (hi - lo) * cells) - 1, F.lit(0)), F.lit(cells - 1)).cast("int") for j, (lo, hi) in enumerate(zip(low, high))]
        state = state.withColumn("path", F.array(*index))
        counts = state.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        mean = counts.agg(F.avg("n")).first()[0]
        if mean is None:
            break
        kept = counts.withColumn("dense", F.lit(layer == layers) | (F.col("n") > F.floor(F.lit(density * mean))))
        state = stored(state.join(kept.select("path", "dense"), "path").select("id", "point", "path", "dense"), "cells")
        dense.append(state.where("dense").select("id", "path", F.lit(layer).alias("layer")))
        state = state.where("NOT dense").drop("dense")
    if not dense:
        return points.select("id", F.lit(None).cast("long").alias("cluster")).limit(0)
    cells = dense[0]
    for more in dense[1:]:
        cells = cells.unionByName(more)
    cells = stored(cells, "dense")
    kinds = cells.select("layer", "path").distinct()
    kinds = stored(kinds.withColumn("cell", F.xxhash64("layer", "path")), "kinds")
    pairs = []
    for up in range(layers):  # a finer cell, scaled to the coarser layer, touches it or a neighbour of it
        coarse = kinds.select(F.col("layer").alias("_l"), F.col("path").alias("_p"), F.col("cell").alias("b"))
        spot = F.transform("path", lambda x: F.shiftright(x, up))
        near = kinds.where(F.col("layer") > up).select("cell", "layer", "path", spot.alias("spot"))
        for j in range(dims):
            for step in (-1, 0, 1):
                edge = F.when(F.lit(step == -1), F.col("path")[j] % (1 << up) == 0).when(F.lit(step == 1), (F.col("path")[j] + 1) % (1 << up) == 0).otherwise(False)
                spots = F.array(*[F.col("spot")[i] + (step if i == j else 0) for i in range(dims)])
                moved = near.where(edge).withColumn("_p", spots).withColumn("_l", F.col("layer") - up)
                if step:
                    pairs.append(moved.join(coarse, ["_l", "_p"]).select(F.col("cell").alias("a"), "b"))
    links = kinds.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for p in pairs:
        links = links.unionByName(p)
    found = components(links)
    rows = stored(cells.join(kinds, ["layer", "path"]).join(found, F.col("cell") == F.col("node")).select("id", "component"), "members")
    return rows.join(rows.groupBy("component").agg(F.min("id").alias("cluster")), "component").select("id", "cluster")
