"""Removal of repeated byte strings by sorting anchored suffixes.

Every string of LENGTH bytes that occurs twice holds, at the same place, the same anchor: the k-mer of
smallest hash among those inside it (the leftmost on ties). So only suffixes at anchors, about one in
35, need be compared, and only those whose anchor occurs again.

1. Each text gives its anchors: hash of the k-mer, and hash of the widest context that a string with
   this anchor can reach (68 bytes before it and LENGTH from its start on, cut at the text's ends).
2. Anchors that occur once are dropped. Where a whole context occurs earlier, all of it is repeated: runs of
   such contexts with one origin are a claim, whose bytes are held against the origin's by their SHA-256.
3. The first places of contexts that share an anchor are sorted as suffixes: a mergesort that compares
   two suffixes by a binary search for their longest common prefix on prefix polynomial hashes. The
   common prefixes of neighbours are verified on the bytes, and running minima over them, with the
   common extensions to the left, give for each pair the longest string around the anchor that both
   hold. If it has LENGTH bytes, the later place loses it; spans of a document are merged at once.
4. An anchor with more than MANY contexts is left out of the sort, which keeps groups bounded. Its contexts
   are compared with the first of them, byte by byte; their other strings of LENGTH bytes are grouped by a
   128-bit hash, in an aggregate that starts on the map side. The result is that of the sort.

Texts are read whole, in segments with margins, so memory does not grow with a text.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows with a null doc_id
lose nothing; equal rows of one doc_id are one document, so none of them is a copy of another, and are
cut alike; rows of one doc_id with unlike texts are documents of their own, in the order of the texts'
hashes; other columns pass where rows are kept whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NUMBER, Scratch, lean, merged, numbered, ship, small_batches, stored
from millrace.llm.shingles import mix, prefix

U = np.uint64
LENGTH, KMER = 100, 32
SPAN = LENGTH - KMER  # bytes of a string that may lie before its anchor
SEGMENT, MARGIN = 1 << 19, 2 * LENGTH
#: Bytes that are hashed at once, so that the arrays stay in a core's cache, and anchors that leave together.
AT_ONCE, ANCHORS = 1 << 17, 1 << 14
#: Pairs of suffixes that are compared at once.
PAIRS = 1 << 14
MANY = 256
_PLACE_BITS = 24


def anchors(raw: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments raw[first:last], strings starting in [lo, hi): segment, place, k-mer hash and context hash of each anchor."""
    sums, down = prefix(raw)
    n = len(raw) - KMER + 1
    kmer = mix((sums[KMER:] - sums[:n]) * down[:n])
    least = (kmer >> U(_PLACE_BITS) << U(_PLACE_BITS)) | np.arange(n, dtype="u8")
    width = SPAN + 1
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & U((1 << _PLACE_BITS) - 1)).astype("i8")
    edge = np.zeros(len(place) + 1, "i1")
    np.add.at(edge, np.minimum(lo, len(place)), 1)
    np.add.at(edge, np.minimum(np.maximum(hi, lo), len(place)), -1)
    chosen = np.zeros(n, bool)
    chosen[place[np.cumsum(edge[:-1]) > 0]] = True
    at = np.flatnonzero(chosen)
    seg = np.searchsorted(first, at, side="right") - 1
    a, b = np.maximum(at - SPAN, first[seg]), np.minimum(at + LENGTH, last[seg])
    context = mix(mix((sums[b] - sums[a]) * down[a]) + (at - a).astype("u8") * U(1024) + (b - at).astype("u8"))
    return seg, at, kmer[at], context


def _segments(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of a text: from, to, and the range of starts of strings that the piece answers for."""
    n = len(raw)
    for a in range(0, n - LENGTH + 1, SEGMENT):
        b = min(a + SEGMENT, n - LENGTH + 1)
        yield max(0, a - MARGIN), min(n, b + MARGIN), a, b


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place, k-mer hash and context hash of the anchors of batches (number, text)."""

    def flush(pieces: list[tuple[int, int, bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x[2]) for x in pieces])
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(x[2] for x in pieces), "u1")
        lo, hi = (first + np.array([x[k] for x in pieces]) for k in (3, 4))
        seg, at, kmer, context = anchors(raw, first, first, first + sizes, lo, hi)
        docs, base = np.array([x[0] for x in pieces], "i8"), np.array([x[1] for x in pieces], "i8")
        return docs[seg], (base[seg] + at - first[seg]).astype("i4"), kmer.view("i8"), context.view("i8")

    held, n = [], 0
    for found in _flushed(batches, flush):
        held.append(found)
        n += len(found[0])
        if n > ANCHORS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _flushed(batches: Iterator[pa.RecordBatch], flush: Callable) -> Iterator[tuple[np.ndarray, ...]]:
    """What flush gives for the pieces of texts, of about AT_ONCE bytes together."""
    for batch in small_batches(batches, "text", SEGMENT):
        pieces, size = [], 0
        for doc, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode()
            for a, b, lo, hi in _segments(raw):
                pieces.append((doc, a, raw[a:b], lo - a, hi - a))
                size += b - a
                if size > AT_ONCE:
                    yield flush(pieces)
                    pieces, size = [], 0
        if pieces:
            yield flush(pieces)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _anchors_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["number", "pos", "kmer", "context"])


def _kmer_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, kmer, _ in _anchors_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(kmer, return_counts=True)], names=["kmer", "n"])


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (number, origin, shift, pos) come sorted; runs of contexts that touch each other are one claim."""
    names = ["number", "start", "stop", "origin", "shift"]

    def claim(number: np.ndarray, origin: np.ndarray, shift: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        start, stop = np.maximum(first - SPAN, 0).astype("i4"), (last + LENGTH).astype("i4")
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (number, start, stop, origin, shift)], names=names)

    held: list[np.ndarray] = []  # the run that may go on: number, origin, shift, first, last
    for batch in batches:
        if not batch.num_rows:
            continue
        number, origin, shift, pos = (batch.column(c).to_numpy().astype("i8") for c in ("number", "origin", "shift", "pos"))
        first = pos
        if held:
            number, origin, shift, first, pos = (np.concatenate([a, b]) for a, b in zip(held, (number, origin, shift, first, pos)))
        fresh = (number[1:] != number[:-1]) | (origin[1:] != origin[:-1]) | (shift[1:] != shift[:-1]) | (first[1:] - SPAN > pos[:-1] + LENGTH)
        begin = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        end = np.concatenate([begin[1:], [len(pos)]]) - 1
        runs = (number[begin], origin[begin], shift[begin], first[begin], pos[end])
        if len(begin) > 1:
            yield claim(*(x[:-1] for x in runs))
        held = [x[-1:] for x in runs]
    if held:
        yield claim(*held)


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts of a column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def _members(column: pa.ListArray, *names: str) -> tuple[list[tuple[int, int]], list[pa.Array]]:
    """From and to of each row's members (null: none) in the fields of all members, and these fields."""
    stop = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    bounds = np.concatenate([[0], stop]).tolist()
    every = column.flatten()
    return list(zip(bounds[:-1], bounds[1:])), [pc.struct_field(every, k) for k in names]


def _origin_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each range that a claim has in an origin's text."""
    for batch in small_batches(batches, "text", 1 << 20):
        bounds, (start, stop) = _members(batch.column("ranges"), "start", "stop")
        first, last = start.to_pylist(), stop.to_pylist()
        digests = [hashlib.sha256(raw[first[k] : last[k]]).digest() for raw, (lo, hi) in zip(_bytes(batch.column("text")), bounds) for k in range(lo, hi)]
        origin = np.repeat(batch.column("number").to_numpy(), [hi - lo for lo, hi in bounds])
        yield pa.RecordBatch.from_arrays([pa.array(origin), start, stop, pa.array(digests, pa.binary())], names=["origin", "from", "to", "digest"])


def _common(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at a and b, at most `most`, by binary search on hashes."""
    low, high = np.zeros(len(a), "i8"), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(raw: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes raw[start : start + size] inside their groups, and the common prefix of each with the next.

    Bottom-up mergesort: an element's place after a merge is its rank in its own run plus its rank, by
    binary search, in the sibling run; every comparison is logarithmic in the suffix.
    """
    sums, down = prefix(raw)
    raw = np.concatenate([raw, np.zeros(1, "u1")])
    n = len(start)
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y."""
        out = group[x] < group[y]
        tie = np.flatnonzero(group[x] == group[y])
        if len(tie):
            p, q = x[tie], y[tie]
            most = np.minimum(size[p], size[q])
            k = _common(sums, down, start[p], start[q], most)
            ended = k == most
            less = np.where(ended, size[p] < size[q], raw[start[p] + np.minimum(k, size[p])] < raw[start[q] + np.minimum(k, size[q])])
            out[tie] = np.where(ended & (size[p] == size[q]), or_equal[tie], less)
        return out

    width = 1
    while width < n:
        at = np.arange(n)
        run = at // width
        sibling = run ^ 1
        low = np.minimum(sibling * width, n)
        base, high = low.copy(), np.minimum(low + width, n)
        left = run % 2 == 0
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            ahead = before(order[mid], order[open_], ~left[open_])  # equal suffixes keep their order
            low[open_], high[open_] = np.where(ahead, mid + 1, low[open_]), np.where(ahead, high[open_], mid)
        new = np.empty(n, "i8")
        new[np.minimum(run, sibling) * width + (at - run * width) + (low - base)] = order
        order, width = new, 2 * width
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum(size[a], size[b]), 0)
    common = _common(sums, down, start[a], start[b], most)
    return order, _verified(raw, start[a], start[b], common)


def _verified(raw: np.ndarray, a: np.ndarray, b: np.ndarray, claimed: np.ndarray) -> np.ndarray:
    """Claimed common prefixes, cut at the first byte that differs after all (hashes may collide)."""
    out = claimed.copy()
    width = max(1, int(claimed.max(initial=0)))
    for lo in range(0, len(a), 2048):
        s = slice(lo, lo + 2048)
        k = np.arange(width)
        inside = k < claimed[s, None]
        x, y = (np.minimum(v[s, None] + k, len(raw) - 1) for v in (a, b))
        differs = inside & (raw[x] != raw[y])
        out[s] = np.where(differs.any(1), differs.argmax(1), claimed[s])
    return out


def _extensions(rows: list[tuple[int, int, int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups (kmer, doc, pos, context, bytes of it before the anchor): doc, from, to of what occurs earlier."""
    contexts = [x[3] for x in rows]
    sizes = np.array([len(x) for x in contexts])
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(contexts), "u1")
    _, group = np.unique(np.array([x[0] for x in rows], "i8"), return_inverse=True)
    doc, pos, left = (np.array([x[k] for x in rows], "i8") for k in (1, 2, 4))
    order, common = suffix_sort(raw, begin + left, sizes - left, group)
    backward = np.ascontiguousarray(raw[::-1])
    sums, down = prefix(backward)
    anchor = len(raw) - (begin + left)
    out: list[list[np.ndarray]] = [[], [], []]

    def settle(x: np.ndarray, y: np.ndarray, right: np.ndarray) -> None:
        p, q = anchor[x], anchor[y]
        behind = _verified(backward, p, q, _common(sums, down, p, q, np.minimum(left[x], left[y])))
        ok = behind + right >= LENGTH
        x, y, right, behind = x[ok], y[ok], right[ok], behind[ok]
        later = np.where((doc[x] > doc[y]) | ((doc[x] == doc[y]) & (pos[x] > pos[y])), x, y)
        for have, new in zip(out, (doc[later], pos[later] - behind, pos[later] + right)):
            have.append(new)

    near, open_, n = common.copy(), [], 0  # open_: pairs of so many lags that one hash tells to share LENGTH bytes
    for lag in range(1, len(rows)):
        i = np.arange(len(rows) - lag)
        near = common[i] if lag == 1 else np.minimum(near[:-1], common[lag - 1 :])
        met = i[near[i] >= KMER]
        if not len(met):
            break
        x, y, right = order[met], order[met + lag], near[met]
        lack = np.maximum(LENGTH - right, 0)  # bytes before the anchor that a string needs
        ok = lack <= np.minimum(left[x], left[y])
        x, y, right, lack = x[ok], y[ok], right[ok], lack[ok]
        p, q = anchor[x], anchor[y]
        ok = (sums[p + lack] - sums[p]) * down[p] == (sums[q + lack] - sums[q]) * down[q]
        open_.append((x[ok], y[ok], right[ok]))
        n += len(open_[-1][0])
        if n > PAIRS:
            settle(*(np.concatenate(z) for z in zip(*open_)))
            open_, n = [], 0
    if n:
        settle(*(np.concatenate(z) for z in zip(*open_)))
    return tuple(np.concatenate(x) if x else np.zeros(0, "i8") for x in out)


_SPANS = ["number", "start", "stop"]


def _span_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Spans of a document that overlap become one."""
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, stop = doc[order], start[order], stop[order]
        base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (1 << 32)  # documents apart from each other
        reach = np.maximum.accumulate(base + stop)
        begin = np.concatenate([[0], np.flatnonzero(base[1:] + start[1:] > reach[:-1]) + 1])
        end = np.concatenate([begin[1:], [len(doc)]]) - 1
        doc, start, stop = doc[begin], start[begin], reach[end] - base[end]
    return pa.RecordBatch.from_arrays([pa.array(doc.astype("i8")), pa.array(start.astype("i4")), pa.array(stop.astype("i4"))], names=_SPANS)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by k-mer; groups are handled whole, many at a time."""
    held: list[tuple[int, int, int, bytes, int]] = []
    for batch in (x.slice(lo, 2048) for x in batches for lo in range(0, x.num_rows, 2048)):
        held += zip(*(batch.column(c).to_pylist() for c in ("kmer", "number", "pos", "bytes", "before")))
        if len(held) > 4096:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield _span_batch(*_extensions(held[:cut]))
                held = held[cut:]
    if held:
        yield _span_batch(*_extensions(held))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 20):
        bounds, (pos, kmer, many) = _members(batch.column("firsts"), "pos", "kmer", "many")
        if not len(pos):
            continue
        at = pos.to_pylist()
        own = [raw[max(0, x - SPAN) : x + LENGTH] for raw, (lo, hi) in zip(_bytes(batch.column("text")), bounds) for x in at[lo:hi]]
        doc = np.repeat(batch.column("number").to_numpy(), [hi - lo for lo, hi in bounds])
        before = np.minimum(pos.to_numpy(), SPAN).astype("i4")
        yield pa.RecordBatch.from_arrays([kmer, pa.array(doc), pos, pa.array(own, pa.binary()), pa.array(before), many], names=["kmer", "number", "pos", "bytes", "before", "many"])


def _reach(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    differs = np.frombuffer(x, "u1", n) != np.frombuffer(y, "u1", n)
    return int(differs.argmax()) if differs.any() else n


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts beside the first one of their anchor. What they share with it is one span (no hash).

    Every other string of LENGTH bytes comes with its 128-bit hash; if it occurs in another context, it
    is not in the first one there either, so it comes from both.
    """
    names = ["h1", "h2", "number", "start", "stop"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            contexts, before, lead = (part.column(c).to_pylist() for c in ("bytes", "before", "lead"))
            doc, pos = part.column("number").to_numpy(), part.column("pos").to_numpy().astype("i8")
            right = np.array([_reach(x[k:], y["bytes"][y["before"] :]) for x, k, y in zip(contexts, before, lead)], "i8")
            left = np.array([_reach(x[:k][::-1], y["bytes"][: y["before"]][::-1]) for x, k, y in zip(contexts, before, lead)], "i8")
            other = np.array([(d, p) != (y["number"], y["pos"]) for d, p, y in zip(doc.tolist(), pos.tolist(), lead)])
            met = np.flatnonzero(other & (left + right >= LENGTH))
            none = pa.nulls(len(met), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(doc[met]), pa.array((pos - left)[met].astype("i4")), pa.array((pos + right)[met].astype("i4"))], names=names)
            sizes, before = np.array([len(x) for x in contexts]), np.array(before, "i8")
            begin = np.cumsum(sizes) - sizes
            raw = np.frombuffer(b"".join(contexts), "u1")
            sums, down = prefix(raw)
            n = np.maximum(sizes - LENGTH + 1, 0)
            of = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            fresh = (step < (before - left)[of]) | (step + LENGTH > (before + right)[of])
            of, step = of[fresh], step[fresh]
            at = begin[of] + step
            one = (sums[at + LENGTH] - sums[at]) * down[at]
            half = (sums[at + LENGTH // 2] - sums[at]) * down[at]
            start = (pos - before)[of] + step
            yield pa.RecordBatch.from_arrays([pa.array(mix(one).view("i8")), pa.array(mix(half ^ U(0x5851F42D4C957F2D)).view("i8")), pa.array(doc[of]), pa.array(start.astype("i4")), pa.array((start + LENGTH).astype("i4"))], names=names)


_CUT_SCHEMA = f"{NUMBER} long, _mr_removed long, _mr_spans long, _mr_kept string"


def _cut(full: bool):
    names = [x.split()[0] for x in _CUT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            out = []
            claims, fields = _members(batch.column("claims"), "start", "stop", "digest")
            begin, end, digest = (x.to_pylist() for x in fields)
            spans, fields = _members(batch.column("spans"), "start", "stop")
            first, last = (x.to_pylist() for x in fields)
            for number, data, (lo, hi), (a, b) in zip(batch.column("number").to_pylist(), _bytes(batch.column("text")), claims, spans):
                gone = list(zip(first[a:b], last[a:b]))
                gone += [(begin[k], min(len(data), end[k])) for k in range(lo, hi) if hashlib.sha256(data[begin[k] : end[k]]).digest() == digest[k]]
                kept, removed, runs, reach = [], 0, 0, -1
                for start, stop in sorted(gone):
                    if start > reach:  # a run that does not touch the one before
                        kept.append(data[max(reach, 0) : start])
                        runs, removed, reach = runs + 1, removed + stop - start, stop
                    elif stop > reach:
                        removed, reach = removed + stop - reach, stop
                left = b"".join([*kept, data[max(reach, 0) :]])
                out.append((number, removed, runs, left.decode(errors="ignore") if full else hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return lean(run)


def repeated(docs: DataFrame, full: bool) -> DataFrame:
    """_mr_number, _mr_removed, _mr_spans, _mr_kept (the text that is left, or its SHA-256; stored) of the documents that lose something.

    docs: number, text, each number once.
    """
    ship(docs.sparkSession)
    own = Scratch()
    docs = docs.where(F.octet_length("text") >= LENGTH).where("number IS NOT NULL")
    again = docs.mapInArrow(lean(_kmer_counts), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 1").select("kmer")
    again = own.keep(again, "repeated-anchors")
    found = docs.mapInArrow(lean(_anchor_rows), "number long, pos int, kmer long, context long")  # once more, which is cheaper than to keep all
    met = own.keep(merged(found, again, ["kmer"]), "met")
    own.drop(again)
    first = own.keep(met.groupBy("kmer", "context").agg(F.min(F.struct("number", "pos")).alias("at"), F.count("*").alias("n")), "contexts")
    copies = first.where("n > 1").select("kmer", "context", "at")
    same = merged(met, copies, ["kmer", "context"]).where((F.col("number") != F.col("at.number")) | (F.col("pos") != F.col("at.pos")))
    same = same.select("number", F.col("at.number").alias("origin"), (F.col("at.pos") - F.col("pos")).alias("shift"), "pos")
    claims = same.repartition("number").sortWithinPartitions("number", "origin", "shift", "pos").mapInArrow(lean(_claims), "number long, start int, stop int, origin long, shift long")
    claims = claims.withColumn("from", (F.col("start") + F.col("shift")).cast("int")).withColumn("to", (F.col("stop") + F.col("shift")).cast("int"))
    claims = own.keep(claims.drop("shift"), "claims")
    own.drop(met)
    ranges = claims.select(F.col("origin").alias("number"), F.struct(F.col("from").alias("start"), F.col("to").alias("stop")).alias("x")).groupBy("number").agg(F.collect_set("x").alias("ranges"))
    shared = own.keep(first.groupBy("kmer").agg(F.count("*").alias("contexts")).where("contexts > 1"), "shared")  # aggregates are stored before joins, so that hot keys can be split
    edges = merged(first.select("kmer", "at"), shared, ["kmer"]).select(F.col("at.number").alias("number"), F.struct(F.col("at.pos").alias("pos"), "kmer", (F.col("contexts") > MANY).alias("many")).alias("x"))
    firsts = edges.groupBy("number").agg(F.collect_list("x").alias("firsts"))
    asked = claims.select("number").distinct().withColumn("claimed", F.lit(True))
    asked = own.keep(asked.join(firsts, "number", "full").join(ranges, "number", "full"), "asked")
    own.drop(first)
    texts = own.keep(merged(docs, asked, ["number"]), "texts")
    own.drop(asked)
    digests = own.keep(texts.where("ranges IS NOT NULL").select("number", "text", "ranges").mapInArrow(lean(_origin_digests), "origin long, from int, to int, digest binary"), "digests")
    told = merged(claims, digests, ["origin", "from", "to"]).groupBy("number").agg(F.collect_list(F.struct("start", "stop", "digest")).alias("claims"))
    contexts = texts.where("firsts IS NOT NULL").select("number", "text", "firsts").mapInArrow(lean(_contexts), "kmer long, number long, pos int, bytes binary, before int, many boolean")
    contexts = own.keep(contexts, "edges")
    spans = contexts.where("NOT many").drop("many").repartition("kmer").sortWithinPartitions("kmer", "number", "pos").mapInArrow(lean(_sorted_groups), "number long, start int, stop int")
    many = contexts.where("many").select("kmer", "number", "pos", "bytes", "before")
    leads = own.keep(many.groupBy("kmer").agg(F.min(F.struct("number", "pos", "bytes", "before")).alias("lead")), "leads")
    strings = merged(many, leads, ["kmer"]).mapInArrow(lean(_strings), "h1 long, h2 long, number long, start int, stop int")
    strings = own.keep(strings.distinct(), "strings")
    origin = strings.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("number", "start")).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    origin = own.keep(origin, "origins")
    more = merged(strings, origin, ["h1", "h2"]).where((F.col("number") != F.col("at.number")) | (F.col("start") != F.col("at.start"))).select("number", "start", "stop")
    spans = spans.unionByName(strings.where("h1 IS NULL").select("number", "start", "stop")).unionByName(more)
    marked = spans.groupBy("number").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = merged(merged(texts.select("number", "text"), told, ["number"], "left"), marked, ["number"], "left").where("claims IS NOT NULL OR spans IS NOT NULL")
    out = stored(cut.mapInArrow(_cut(full), _CUT_SCHEMA).where("_mr_removed > 0"), "cut")
    own.drop()
    return out


def _documents(keyed: DataFrame, again: bool) -> DataFrame:
    own = keyed.select(F.col(NUMBER).alias("number"), "text")
    return own.dropDuplicates(["number"]) if again else own


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    keyed, again = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lost = repeated(_documents(keyed, again), False)
    text = F.coalesce("text", F.lit(""))
    rows = keyed.select("doc_id", NUMBER, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    out = merged(rows, lost, [NUMBER], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("_mr_removed", F.lit(0)).alias("n_removed"), F.coalesce("_mr_spans", F.lit(0)).alias("n_spans"), F.coalesce("_mr_kept", "sha").alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows and columns, text without its repeated bytes (n_chars follows, if there is one).

    Characters that lose a byte go; a document of which nothing is left goes too.
    """
    keyed, again = numbered(docs)
    out = merged(keyed, repeated(_documents(keyed, again), True), [NUMBER], "left")
    new = {"text": F.coalesce("_mr_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_mr_kept").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.where("_mr_kept IS NULL OR _mr_kept != ''").withColumns(new).select(*docs.columns)
