"""Near-duplicate groups: similarity sketches, banding, exact verification, connected components.

1. Each text's distinct shingles give a fingerprint of the set and a sketch (``shingles``). Texts with
   equal sets are one class; its smallest document stands for it.
2. Representatives that share a band of the sketch meet in a bucket. With 32 bands of 4 coordinates a
   pair at the threshold is missed with a probability under 1e-7. Only texts that met another go on.
3. Every member of a bucket is compared with the bucket's smallest one, on full shingle sets. That makes
   as many pairs as rows, whatever the bucket's size. Links give components.
4. Components that still meet in a bucket form a family. All pairs of its members that are not in one
   component are looked at, in cells of bounded size: those whose sketches agree in LEAST places or more,
   and whose sizes allow the threshold, are compared on full sets. A pair at the threshold agrees in fewer
   places with a probability of about 2.4e-7 (binomial). One pass is enough, since nothing is left untested.

A cell holds two blocks of a family, each of BLOCK rows and WEIGHT shingles or so (one larger text is a
block by itself); only rows outside the family's largest component are dealt against all others. Cells
grow with the square of what is neither linked to the bucket's smallest member nor unlike its bucket.

Sets are hashes of 64 bits; two different shingles of a pair are taken for one with a probability
under 1e-12, and two different sets for equal ones (128 bits) under 1e-18 among 10**10 texts. Nothing that
grows with the data is collected or broadcast, and joins move both sides at any size.

Defined results: a text that is null or has no word has an empty set, is linked with nothing and stands
for itself; a text with fewer words than a shingle is one shingle; equal rows of one doc_id are one
document and are kept or dropped together; rows of one doc_id with unlike texts are documents of their
own, that are linked by their texts only; a null doc_id never links; other columns pass where rows are
kept whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NUMBER, Scratch, drop_stored, group_bounds, lean, merged, numbered, ship, small_batches, stored, whole_groups
from millrace.llm.shingles import BANDS, COORDINATES, ROWS, fingerprints, shingle_sets, sketches

#: Similarity in hundredths that links two texts.
PERCENT = 80
#: Words of a shingle, unless the caller says otherwise.
WORDS = 5
#: Places of two sketches that agree if they are to be compared on full sets.
LEAST = 171
#: Texts compared at a time with one centre; rows of a block; shingles of either.
GROUP, BLOCK, WEIGHT = 128, 1024, 1 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _profile(words: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 19):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            n = np.array([len(x) for x in sets], "i8")
            some = [x for x in sets if len(x)]
            prints, marks = [None] * len(sets), [None] * len(sets)
            f, s = fingerprints(some), sketches(some)
            for i, a, b in zip(np.flatnonzero(n).tolist(), f, s):
                prints[i], marks[i] = a.tobytes(), b.tobytes()
            arrays = [batch.column("doc_id"), batch.column("number"), pa.array(n), pa.array(prints, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "number", "n_shingles", "print", "sketch"])

    return lean(run)


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, number, n_shingles, print (128 bits of the set), sketch (16 bits for each coordinate) of docs with doc_id, number, text."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "number", "text").mapInArrow(_profile(words), "doc_id long, number long, n_shingles long, print binary, sketch binary")


def _sets(texts: pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column, from pieces of it."""
    for batch in pa.table({"text": texts}).to_batches():
        for piece in small_batches(iter([batch]), "text", 1 << 19):
            yield from shingle_sets(piece.column("text").to_pylist(), words)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two ascending arrays share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(words: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by centre, part and whether a row is the centre itself, which is first; the members that link with it."""
        for table in whole_groups(batches, "centre", "part", rows=512):
            nodes, centres, parts = (table.column(c).to_numpy() for c in ("node", "centre", "part"))
            a, b = [], []
            for lo, hi in group_bounds(centres, parts):
                own = _sets(table.column("text").slice(lo, hi - lo), words)
                of = next(own)
                for k, x in enumerate(own, lo + 1):
                    if len(x):
                        same = _common(of, x)
                        if 100 * same >= PERCENT * (len(of) + len(x) - same):
                            a.append(nodes[k])
                            b.append(centres[lo])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lean(run)


def verified(pairs: DataFrame, kin: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. kin: node, n_shingles, text of every a and b.

    Pairs whose sizes exclude it are not compared. Members of a centre b are dealt out to groups by a hash,
    and the centre's text goes to each group, so a centre with many members is no hot key.
    """
    size = kin.select("node", "n_shingles")
    sized = merged(pairs, size.select(F.col("node").alias("a"), F.col("n_shingles").alias("_a")), ["a"])
    sized = merged(sized, size.select(F.col("node").alias("b"), F.col("n_shingles").alias("_b")), ["b"])
    sized = stored(sized.where(100 * F.least("_a", "_b") >= PERCENT * F.greatest("_a", "_b")).select("a", "b", F.col("_a").alias("weight")), "sized")
    groups = sized.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("weight") / WEIGHT)).cast("int").alias("groups"))
    groups = stored(groups, "groups")  # a join with an aggregate could not split a hot centre
    sent = merged(sized, groups, ["b"]).select(F.col("a").alias("node"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("place"))
    centres = groups.select(F.col("b").alias("node"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("place"))
    wanted = merged(sent.unionByName(centres), kin.select("node", "text"), ["node"])
    return wanted.repartition("centre", "part").sortWithinPartitions("centre", "part", "place", "node").mapInArrow(_similar(words), "a long, b long")


#: Links that a task of the component search writes: small tables are not spread over every partition.
LINKS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest id reachable; stored) of the links a, b, by alternating star rounds.

    Large star: a node's larger neighbours go to its smallest one; small star: so do its smaller ones.
    Each keeps the components and shortens the paths, until every node has one link, to a node without any;
    rounds grow with the logarithm of the nodes.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        tasks = edges.count() // LINKS_A_TASK + 4
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.coalesce(tasks), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = stored(small.where("u != v").distinct().coalesce(tasks), "small-star")
        drop_stored(large)
        drop_stored(edges)
        edges = new
        deeper = merged(edges.select("u"), edges.select(F.col("v").alias("u")), ["u"], "left_semi")
        if deeper.isEmpty() and edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            out = edges.withColumnsRenamed({"u": "node", "v": "component"})
            out._millrace_path = edges._millrace_path
            return out


def _linked_in_cell(table: pa.Table, words: int) -> list[tuple[int, int]]:
    """Links that join components of a cell: of rows of side 0 with rows of side 1, or with each other where there are none."""
    sides = table.column("side").to_numpy()
    nodes, comp, n = (table.column(c).to_numpy().copy() for c in ("node", "component", "n_shingles"))
    marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(-1, COORDINATES)
    sets: list[np.ndarray] = []
    alone = table.column("j")[0].as_py() == -1 - table.column("i")[0].as_py()
    rows, others = np.flatnonzero(sides == 0), np.flatnonzero(sides == (0 if alone else 1))
    out = []
    for i in rows.tolist():
        near = others[others > i] if alone else others
        small, large = np.minimum(n[near], n[i]), np.maximum(n[near], n[i])
        near = near[(comp[near] != comp[i]) & (100 * small >= PERCENT * large)]
        agree = (marks[near] == marks[i]).sum(1)
        likely = np.argsort(-agree, kind="stable")[: int((agree >= LEAST).sum())]  # the likeliest first: once joined, a component needs no more
        for k in near[likely].tolist():
            if comp[k] == comp[i]:
                continue
            if not sets:
                sets = list(_sets(table.column("text"), words))
            same = _common(sets[i], sets[k])
            if 100 * same >= PERCENT * (len(sets[i]) + len(sets[k]) - same):
                out.append((max(nodes[i], nodes[k]), min(nodes[i], nodes[k])))
                comp[comp == comp[k]] = comp[i]
    return out


def _cells(words: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "family", "i", "j", rows=512):
            family, i, j = (table.column(c).to_numpy() for c in ("family", "i", "j"))
            found = [x for lo, hi in group_bounds(family, i, j) for x in _linked_in_cell(table.slice(lo, hi - lo), words)]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lean(run)


def _bands(reps: DataFrame) -> DataFrame:
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    return reps.select("node", F.posexplode(keys).alias("band", "key"))


def dealt(members: DataFrame) -> DataFrame:
    """The members (node, component, family, n_shingles) in every cell that they belong to: side, i, j.

    A family's largest component is dealt over p blocks and the rest over q. Cell (i, j) holds block i of the rest
    against block j of the largest component, or, at j = -1 - k, against block k of the rest (itself at k = i).
    A family that fits one block is the cell (0, -1), all of it.
    """
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("weight"))
    whole = sizes.groupBy("family").agg(F.max(F.struct("rows", "weight", "component")).alias("lead"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))
    blocks = lambda rows, weight: F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(weight / WEIGHT)).cast("int")
    whole = whole.select(
        "family",
        F.col("lead.component").alias("lead"),
        (blocks(F.col("rows"), F.col("weight")) == 1).alias("one"),
        blocks(F.col("lead.rows"), F.col("lead.weight")).alias("p"),
        blocks(F.col("rows") - F.col("lead.rows"), F.col("weight") - F.col("lead.weight")).alias("q"),
    )
    rows = merged(members, stored(whole, "whole-families"), ["family"])  # stored, so that a hot family can be split
    hashed, first = F.xxhash64("node"), F.col("component") == F.col("lead")
    rows = rows.withColumn("own", F.when(first, F.pmod(hashed, F.col("p"))).otherwise(F.pmod(hashed, F.col("q"))).cast("int"))
    cell = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_lead = F.transform(every("q"), lambda i: cell(1, i, F.col("own")))
    against_lead = F.transform(every("p"), lambda j: cell(0, F.col("own"), j))
    against_rest = F.transform(every("q"), lambda k: F.when(k >= F.col("own"), cell(0, F.col("own"), -1 - k)).otherwise(cell(1, k, -1 - F.col("own"))))
    places = F.when(F.col("one"), F.array(cell(0, F.lit(0), F.lit(-1)))).when(first, of_lead).otherwise(F.concat(against_lead, against_rest))
    return rows.select("node", "component", "family", F.explode(places).alias("c")).select("node", "component", "family", "c.*")


def linked_classes(reps: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node, component of the representatives (node, n_shingles, sketch; stored) that link with another. texts: node, text."""
    own = Scratch()
    bands = _bands(reps)
    buckets = own.keep(bands.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "buckets")
    met = own.keep(merged(bands, buckets, ["band", "key"]).select("band", "key", "node", "centre"), "met")
    own.drop(buckets)
    some = met.select("node").distinct()
    kin = own.keep(merged(merged(reps, some, ["node"]), texts.select("node", "text"), ["node"]), "kin")
    pairs = own.keep(met.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    links = own.keep(verified(pairs, kin, words), "links")
    found = own.adopt(components(links))
    placed = merged(met, found, ["node"], "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    placed = own.keep(placed, "placed")
    split = placed.groupBy("band", "key").agg(F.min("component").alias("lead"), F.max("component").alias("last")).where("lead != last").select("band", "key", "lead")
    rows = own.keep(merged(placed, split, ["band", "key"]).select("node", "component", "lead").distinct(), "split")
    own.drop(met, placed)
    family = own.adopt(components(rows.where("component != lead").select(F.col("component").alias("a"), F.col("lead").alias("b"))))
    family = family.select(F.col("node").alias("component"), F.col("component").alias("family"))
    members = merged(rows.select("node", "component").distinct(), family, ["component"], "left").withColumn("family", F.coalesce("family", "component"))
    members = own.keep(merged(members, kin.select("node", "n_shingles"), ["node"]), "members")
    cells = merged(dealt(members), kin, ["node"])
    more = cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(_cells(words), "a long, b long")
    more = own.keep(more, "links")
    out = components(links.unionByName(more))
    own.drop()
    return out


def _classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of docs (doc_id, number, text), and the component (a number) of every print."""
    rows = stored(profiles(docs, words), "profiles")
    some = rows.where("print IS NOT NULL AND number IS NOT NULL")
    classes = stored(some.groupBy("print").agg(F.min("number").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    found = linked_classes(classes.select("node", "n_shingles", "sketch"), docs.select(F.col("number").alias("node"), "text"), words)
    place = stored(merged(classes.select("print", "node"), found, ["node"], "left").select("print", F.coalesce("component", "node").alias("component")), "places")
    drop_stored(classes)
    drop_stored(found)
    return rows, place


def _documents(keyed: DataFrame, repeated: bool) -> DataFrame:
    own = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(NUMBER).alias("number"), "text")
    return own.where("number IS NOT NULL").dropDuplicates(["number", "text"]).unionByName(own.where("number IS NULL")) if repeated else own


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    ship(docs.sparkSession)
    keyed, repeated = numbered(docs.select("doc_id", "text"))
    rows, place = _classes(_documents(keyed, repeated), words)
    out = merged(rows.select("doc_id", "number", "n_shingles", "print"), place, ["print"], "left")
    out = out.withColumn("component", F.when(F.col("number").isNotNull(), F.coalesce("component", "number")))
    if repeated:  # the component's smallest number is that of its smallest doc_id
        names = rows.where("number IS NOT NULL").select(F.col("number").alias("component"), F.col("doc_id").alias("component_id"))
        out = merged(out, names, ["component"], "left")
        times = keyed.groupBy(F.col(NUMBER).alias("number")).agg(F.count("*").cast("int").alias("times"))
        out = merged(out, times, ["number"], "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    else:
        out = out.withColumnRenamed("component", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs without those whose group is kept in another document; all columns."""
    ship(docs.sparkSession)
    keyed, repeated = numbered(docs)
    rows, place = _classes(_documents(keyed, repeated), words)
    gone = stored(merged(rows.select("number", "print"), place, ["print"]).where("number != component").select(F.col("number").alias(NUMBER)), "gone")
    drop_stored(rows)
    drop_stored(place)
    return keyed.join(gone, NUMBER, "left_anti").select(*docs.columns)
