"""Near duplicates, repeated strings, mixing, quotations, nearest neighbours, the pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann_multi_index, chat_quotes, mixing, near_dedup, shingles, suffix_dedup
from millrace.operators import positions


def words(r, n, alphabet="abcdeéß"):
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n)]


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, x, "k", i, 1.0, "s") for i, x in rows], "doc_id long, text string, kept string, component_id long, rate double, sketch string")


# near duplicates


def brute_groups(rows, size=4):
    import re

    def shingle_set(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets = [shingle_set(x) for _, x in rows]
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                group[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def near_rows(seed, families=12, copies=8):
    r = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "A b"), (1004, "a B"), (1005, "a b c"), (1006, "İ x y z Ä"), (1007, "i̇ x y z ä")]
    for f in range(families):
        base = words(r, r.randint(30, 200))
        for c in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = "".join(r.choice("xyz") for _ in range(5))
            rows.append((f * copies + c, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 and f % 2 else " ".join(w)))
    r.shuffle(rows)
    return rows


def check_groups(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.grouped(table(spark, rows), 4).collect()}
    assert got == brute_groups(rows)
    return got


def test_groups_equal_brute_force(spark):
    rows = near_rows(1)
    got = check_groups(spark, rows)
    kept = near_dedup.deduplicated(table(spark, rows), 4)
    assert kept.columns == ["doc_id", "text", "kept", "component_id", "rate", "sketch"]
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_only_letters_of_ascii_are_folded(spark):
    check_groups(spark, [(1, "ÄRGER über A B C D"), (2, "ärger über a b c d"), (3, "ÄRGER über a b c D"), (4, "ÄRGER ÜBER A B C D")])


def tight_family(seed, size, base, of=12, most=4):
    """Texts of few words, of which some are exchanged: many pairs are at, just above and just below the threshold."""
    r = random.Random(seed)
    out = []
    for i in range(size):
        w = [f"f{seed}w{k}" for k in range(of)]
        for k in r.sample(range(of), r.randint(0, most)):
            w[k] = f"x{r.randint(0, 5)}"
        out.append((base + i, " ".join(w)))
    return out


def test_pairs_at_the_threshold(spark):
    """8 of 10 shingles are shared by 0 and 1, 9 of 12 by 0 and 2."""
    words = [f"w{k}" for k in range(12)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:11], "z"])), (2, " ".join([*words, "y", "y", "y"])), (3, " ".join(words[:11]))]
    a, b = ({tuple(x.split()[i : i + 4]) for i in range(len(x.split()) - 3)} for _, x in rows[:2])
    assert 100 * len(a & b) == 80 * len(a | b)
    check_groups(spark, rows)


@pytest.mark.parametrize("block", [5, 1024])
def test_families_in_cells(spark, monkeypatch, block):
    """Families whose components meet in buckets, in one cell and dealt over many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", block)
    check_groups(spark, [x for k in range(4) for x in tight_family(k, 40, 100 * k, of=20 + 10 * k, most=5)])


def test_more_rows_than_a_block(spark):
    rows = tight_family(9, 1300, 0, of=16, most=6) + tight_family(10, 300, 5000, of=40, most=9)
    got = check_groups(spark, rows)
    assert len({c for _, c in got.values()}) > 50


def test_cells_meet_every_pair(spark, monkeypatch):
    """Every pair of a family that is not in its largest component together is in exactly one cell, on two sides or alone."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = [(i, 0 if i < 7 else i, 0, 5) for i in range(18)] + [(100, 100, 100, 5), (101, 101, 100, 5)]
    met = {}
    cells = {}
    for x in near_dedup.dealt(spark.createDataFrame(rows, "node long, component long, family long, n_shingles long")).collect():
        cells.setdefault((x["family"], x["i"], x["j"]), []).append((x["node"], x["side"]))
    for (_, i, j), own in cells.items():
        for a, s in own:
            for b, t in own:
                if a < b and (j == -1 - i or s != t):
                    met[a, b] = met.get((a, b), 0) + 1
    want = {(a, b) for a, c, f, _ in rows for b, d, g, _ in rows if a < b and f == g and not (c == d == 0)}
    assert want <= set(met) and all(met[p] == 1 for p in want)


def test_chain_of_links(spark):
    """Neighbours link, the ends do not: the component spans them, though no bucket holds all of them."""
    r = random.Random(9)
    base = words(r, 400)
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base)))
        base = base[12:] + words(r, 12)
    assert {x["component_id"] for x in near_dedup.grouped(table(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("agree", [188, 182, 172])
def test_link_behind_likelier_partners(spark, agree):
    """The only link of a row agrees in few places, and more members than are tried first rank above it."""
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([f"y{i}x{k}" for k in range(8)] + base[8:]) for i in range(6)] + [" ".join(base), " ".join(base[:90] + [f"z{k}" for k in range(10)])]
    marks = np.zeros((8, 256), "<u2")
    marks[:, 4:128:4] = np.arange(1, 9)[:, None]  # the first band alone is shared, and 97 of the first 128 places agree
    marks[:6, 128:153], marks[6, 128 : 353 - agree] = 1, 2
    assert [int((marks[7] == m).sum()) for m in marks[:7]] == [200] * 6 + [agree]
    reps = spark.createDataFrame([(i, 97, bytearray(m.tobytes())) for i, m in enumerate(marks)], "node long, n_shingles long, sketch binary")
    found = near_dedup.linked_classes(reps, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 4).collect()
    assert {(x["node"], x["component"]) for x in found} == {(i, 0) for i in range(1, 8)}


def test_repeated_rows_and_no_rows(spark):
    docs = table(spark, [(5, "a b c d e"), (5, "a b c d e"), (5, "unlike the other text of this id"), (2, "A b c d e"), (None, "a b c d e"), (None, "a b c d e"), (7, None), (7, "")])
    got = near_dedup.grouped(docs).collect()
    nil = lambda x: -1 if x is None else x
    want = [(-1, -1, True)] * 2 + [(2, 2, True), (5, 2, False), (5, 2, False), (5, 5, True), (7, 7, True), (7, 7, True)]
    assert sorted((nil(x["doc_id"]), nil(x["component_id"]), x["kept"]) for x in got) == want
    assert sorted((nil(x["doc_id"]), x["text"] or "") for x in near_dedup.deduplicated(docs).collect()) == [(-1, "a b c d e")] * 2 + [(2, "A b c d e"), (5, "unlike the other text of this id"), (7, ""), (7, "")]
    assert near_dedup.grouped(table(spark, [(0, "x")]).limit(0)).count() == 0
    assert near_dedup.deduplicated(table(spark, [(0, "x")]).limit(0)).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = [np.unique(r.integers(0, 1 << 62, n).astype("u8")) for n in (1, 2, 30, 400, 3000)]
    s = shingles.sketches(a)
    assert (s == shingles.sketches(a)).all() and (s[0] != s[1]).any()
    x = a[4]
    b = np.unique(np.concatenate([x[:2700], r.integers(0, 1 << 62, 300).astype("u8")]))
    true = 2700 / (len(x) + len(b) - 2700)
    same = (shingles.sketches([x]) == shingles.sketches([b])).mean()
    assert abs(same - true) < 0.12


# repeated strings


def brute_marks(rows):
    """Of each document its bytes, and which of them go."""
    seen = set()
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        yield d, b, gone


def brute_kept(rows):
    return {d: bytes(x for x, g in zip(b, gone) if not g) for d, b, gone in brute_marks(rows)}


def brute_removal(rows):
    kept = brute_kept(rows)
    return {d: (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept[d]).hexdigest()) for d, b, gone in brute_marks(rows)}


def passages(seed):
    r = random.Random(seed)
    w = lambda n: " ".join(words(r, n))
    shared, rows = [w(40) for _ in range(5)], []
    for i in range(40):
        x = [w(r.randint(0, 60)) for _ in range(3)] + r.sample(shared, r.randint(0, 4))
        r.shuffle(x)
        rows.append((i, "\n".join(x)))
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    return rows + [(200, "a" * 1000), (201, "ab" * 400), (202, ""), (203, None), (204, "x" * 99), (205, "x" * 100), (206, "x" * 100), (207, shared[0] * 5), (208, "a" * 500 + "b" + "a" * 300)]


@pytest.mark.parametrize("many", [256, 3])
def test_removal_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rows = passages(many)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removal(table(spark, rows)).collect()}
    assert got == brute_removal(rows)


def test_long_texts_in_segments(spark):
    r = random.Random(4)
    block = " ".join(words(r, 20_000))
    rows = [(0, block), (1, "q" + block[5_000:] + "!"), (2, " ".join(words(r, 100)))]
    old = suffix_dedup.SEGMENT
    try:
        suffix_dedup.SEGMENT = 1000
        got = suffix_dedup.removal(table(spark, rows))
        found = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in got.collect()}
    finally:
        suffix_dedup.SEGMENT = old
    assert found[0] == (0, 0) and found[2] == (0, 0) and found[1] == (len(block[5_000:].encode()), 1)


def test_cut_texts(spark):
    rows = passages(2)
    docs = table(spark, rows + [(300, rows[0][1]), (300, rows[0][1]), (None, rows[0][1])])
    want = brute_removal(rows + [(300, rows[0][1])])
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    left = {x["doc_id"]: x["text"] for x in out.collect()}
    assert 300 not in left and left[None] == rows[0][1] and left[203] is None
    assert all(len((left[i] or "").encode()) <= want[i][0] - want[i][1] for i in left if i is not None)
    assert suffix_dedup.removal(docs).count() == docs.count()
    assert suffix_dedup.removal(docs.limit(0)).count() == 0 and suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_repeated_ids_with_unlike_texts(spark):
    """Rows of one doc_id with unlike texts are documents of their own, in the order of the texts' hashes."""
    r = random.Random(8)
    p, a, b, c = (" ".join(words(r, n)) for n in (80, 30, 20, 25))
    rows = [(0, a + p), (1, b + p + c), (1, "short"), (1, "short"), (2, p), (3, p + a), (3, p + b), (None, p)]
    docs = table(spark, rows)
    order = {(x["doc_id"], x["text"]): k for k, x in enumerate(docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().orderBy("doc_id", F.xxhash64("text")).collect())}
    want = brute_removal([(k, t) for (_, t), k in order.items()])
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removal(docs).where("doc_id IS NOT NULL").collect())
    assert got == sorted((i, *want[order[i, t]]) for i, t in rows if i is not None)
    assert len([1 for x in suffix_dedup.deduplicated(docs).collect() if x["doc_id"] == 1]) == 3


def test_claims_go_on_over_batches():
    rows = [(1, 0, 5, 10), (1, 0, 5, 100), (1, 0, 5, 400), (1, 2, 5, 420), (2, 2, 5, 430), (2, 2, 5, 500)]
    want = [(1, 0, 200, 0, 5), (1, 332, 500, 0, 5), (1, 352, 520, 2, 5), (2, 362, 600, 2, 5)]
    for cut in range(len(rows) + 1):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*own)], names=["number", "origin", "shift", "pos"]) for own in (rows[:cut], rows[cut:]) if own]
        got = [tuple(x.values()) for b in suffix_dedup._claims(iter(parts)) for x in b.to_pylist()]
        assert got == want


def test_spans_are_merged():
    own = suffix_dedup._span_batch(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 50, 300, 0]), np.array([200, 100, 150, 400, 100])).to_pylist()
    assert own == [{"number": 1, "start": 0, "stop": 150}, {"number": 1, "start": 300, "stop": 400}, {"number": 2, "start": 0, "stop": 200}]


def test_suffix_sort():
    r = random.Random(6)
    text = "".join(r.choice("ab") for _ in range(400)).encode()
    start = np.array(sorted(r.sample(range(400), 60)))
    size = np.minimum(30, 400 - start)
    order, common = suffix_dedup.suffix_sort(np.frombuffer(text, "u1"), start, size, np.zeros(60, "i8"))
    got = [text[start[k] : start[k] + size[k]] for k in order]
    assert got == sorted(got)
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [lcp(a, b) for a, b in zip(got, got[1:])]


def test_only_pairs_that_share_a_string_are_held_byte_by_byte(monkeypatch):
    """Contexts that share no more than their anchor cost one hash a pair; those that share a string are all compared."""
    r = random.Random(12)
    letters = lambda n: bytes(r.choices(range(97, 123), k=n))
    anchor, tail = letters(suffix_dedup.KMER), letters(suffix_dedup.SPAN)
    held, whole = [], suffix_dedup._verified
    monkeypatch.setattr(suffix_dedup, "_verified", lambda raw, a, b, claimed: held.append(len(a)) or whole(raw, a, b, claimed))
    apart = [(1, d, 500, letters(68) + anchor + letters(68), 68) for d in range(200)]
    doc, _, _ = suffix_dedup._extensions(apart)
    assert not len(doc) and sum(held) <= 200
    held.clear()
    alike = [(2, 300 + d, 500, letters(68) + anchor + tail, 68) for d in range(20)]
    doc, start, stop = suffix_dedup._extensions(apart + alike)
    assert set(doc.tolist()) == set(range(301, 320)) and set(stop.tolist()) == {600} and set(start.tolist()) <= set(range(490, 501))
    assert sum(held) <= 220 + 20 * 19 // 2


def test_bytes_hashed_at_once_are_bounded(monkeypatch):
    r = random.Random(13)
    texts = [" ".join(words(r, 300)) for _ in range(600)]
    sizes, hashed = [], suffix_dedup.anchors
    monkeypatch.setattr(suffix_dedup, "anchors", lambda raw, *rest: sizes.append(len(raw)) or hashed(raw, *rest))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], names=["number", "text"])
    rows = sum(len(x[0]) for x in suffix_dedup._anchors_of(iter([batch])))
    lengths = [len(x.encode()) for x in texts]
    assert sum(sizes) == sum(lengths) and max(sizes) <= (1 << 17) + max(lengths) and rows > 0


# mixing


def sources(spark, n=3000):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 30}", 7) for i in range(n)] + [(n, None, None, 7), (n + 1, "", "solo", 7), (n + 1, "", "solo", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy long")


def test_mixing_meets_targets(spark):
    docs = sources(spark)
    out = mixing.mixed(docs, power=0.0, size=6000)
    n = {x["source"]: x["count"] for x in out.groupBy("source").count().collect()}
    each = 6000 / docs.select("source").distinct().count()
    assert all(abs(n.get(x["source"], 0) - each) < 6 * each**0.5 + 1 for x in docs.select("source").distinct().collect())
    again = mixing.mixed(docs.repartition(7), power=0.0, size=6000)
    pick = lambda d: sorted((x["doc_id"], x["copy"]) for x in d.select("doc_id", "copy").collect())
    assert pick(out) == pick(again)
    given = mixing.mixed(docs, weights={"hot": 1.0})
    assert {x["source"] for x in given.select("source").distinct().collect()} == {"hot"}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = sources(spark, 500)
    pick = lambda d: sorted((x["doc_id"], x["source"] or "", x["copy"]) for x in d.select("doc_id", "source", "copy").collect())
    a = pick(mixing.mixed(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert pick(mixing.mixed(docs)) == a


def test_mixing_leaves_other_columns(spark):
    names = ["draws", "cdf", "_of", "_salt", "_part", "n", "mean", "weight", "key"]
    docs = sources(spark, 200).select("*", *[F.concat(F.lit(k + "-"), F.coalesce(F.col("doc_id"), F.lit(0))).alias(k) for k in names])
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", *names, "n_copies", "rate", "copy", "shuffle_key"]
    assert out.count() > 50 and all(x[k] == f"{k}-{x['doc_id']}" for x in out.collect() for k in names)


def test_poisson_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    for rate in (0.7, 40.0):
        n = mixing.replicated(docs, size=20_000 * rate).groupBy("doc_id").agg(F.first("n_copies").alias("n"))
        mean, var = n.agg(F.sum("n") / 20_000, F.sum(F.col("n") * F.col("n")) / 20_000 - (F.sum("n") / 20_000) ** 2).first()
        assert abs(mean - rate) < 0.05 * rate and abs(var - rate) < 0.1 * rate


# quotations


def test_quotations(spark):
    rows = [
        (1, 0, "a", "First message here.\nIt has two lines."),
        (1, 1, "b", "Second message, on its own."),
        (1, 2, "a", "> First message here.\n>  It has TWO lines.\nI answer the first."),
        (1, 3, "b", "On Monday somebody wrote:\n>> first message here.\n> I answer the first.\nDeeper."),
        (1, 4, "a", "> nobody said this\nStill no link."),
        (1, 5, "b", "> Second message,\n> on its own.\nA rewrapped quote."),
        (2, 0, "a", "> Deeper.\nAnother conversation."),
        (2, 1, "b", None), (2, 1, "b", ""), (None, 3, "x", "> Deeper."), (2, None, "x", "Deeper."),
    ]
    df = spark.createDataFrame([r + (9,) for r in rows], "conv_id long, turn long, role string, text string, depth long")
    got = {(x["conv_id"], x["turn"]): x for x in chat_quotes.reply_ordered(df).collect()}
    assert chat_quotes.reply_ordered(df).count() == len(rows)
    place = lambda k: (got[1, k]["parent_turn"], got[1, k]["thread_turn"], got[1, k]["depth"])
    assert [place(k) for k in range(6)] == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2), (None, 4, 0), (1, 1, 1)]
    assert got[1, 3]["reply_text"] == "Deeper." and got[1, 2]["n_quoted_lines"] == 2
    assert got[2, 0]["parent_turn"] is None and got[2, 1]["reply_text"] == "" and got[None, 3]["parent_turn"] is None
    assert chat_quotes.reply_ordered(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, k, "a", f"> message {k - 1}\nmessage {k}" if k else "message 0") for k in range(40)]
    got = {x["turn"]: (x["thread_turn"], x["depth"], x["position"]) for x in chat_quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: (0, k, k) for k in range(40)}


def talks(seed, sizes):
    """Threads with quotes of quotes, rewrapped quotes, repeated lines and attributions."""
    r = random.Random(seed)
    out = []
    for conv, size in enumerate(sizes):
        own = []
        for turn in range(size):
            lines = []
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                if own:
                    of = r.choice(own[-30:])
                    if r.random() < 0.2:
                        lines.append("On Monday a reader wrote:")
                    quote = r.choice([of, [" ".join(" ".join(of).split())], of[:1], [" ".join(of).upper()]])
                    level = r.choice(["> ", ">", "> > "])
                    lines += [level + x if x[:1] != ">" else ">" + x for x in quote]
            text = [r.choice(["I agree.", "No.", f"word {r.randint(0, 300)} of turn"]) for _ in range(r.randint(0, 3))] + [f"Turn {turn} of talk {conv}, {r.random():.6f}"] * r.randint(0, 1)
            if r.random() < 0.2:
                text.insert(len(text) // 2, "")
            own.append([x for x in text if x] or ["nothing"])
            out.append((conv, turn, r.choice("ab"), r.choice(["\n", "\n", "\r\n"]).join(lines + text)))
    return out


def brute_order(rows):
    """Of each row: parent, thread, depth, quoted lines, own text, position."""
    import re

    marks = re.compile(chat_quotes.MARKS)
    normal = lambda x: re.sub(chat_quotes.WORD_BREAK, " ", x).lower().strip(" ")
    units = lambda bodies: {normal(x) for x in ["\n".join(bodies), *re.split(chat_quotes.GAP, "\n".join(bodies)), *bodies]} - {""}
    parsed, first = [], {}
    for conv, turn, _, text in rows:
        lines = []
        for x in re.split("\r?\n", text) if text else []:
            m = marks.match(x)
            lines.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
        own = [b for i, (level, b) in enumerate(lines) if not level and not (i + 1 < len(lines) and lines[i + 1][0] and re.match(chat_quotes.ATTRIBUTION, b))]
        parsed.append((lines, own))
        for u in units(own):
            first[conv, u] = min(first.get((conv, u), turn), turn)
    parent = {}
    for (conv, turn, _, _), (lines, _) in zip(rows, parsed):
        found, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                j += 1
            if lines[i][0]:
                found += [(-lines[i][0], len(u), first[conv, u]) for u in units([b for _, b in lines[i:j]]) if first.get((conv, u), turn) < turn]
            i = j
        if found:
            parent[conv, turn] = max(found)[2]
    out = {}
    for (conv, turn, _, _), (lines, own) in zip(rows, parsed):
        top, depth = turn, 0
        while (conv, top) in parent:
            top, depth = parent[conv, top], depth + 1
        out[conv, turn] = [parent.get((conv, turn)), top, depth, sum(x > 0 for x, _ in lines), "\n".join(own).strip(" ")]
    place = {}
    for conv, turn in sorted(out, key=lambda k: (k[0], out[k][1], out[k][2], k[1])):
        out[conv, turn].append(place.get(conv, 0))
        place[conv] = place.get(conv, 0) + 1
    return {k: tuple(v) for k, v in out.items()}


def test_threads_equal_brute_force_and_sql(spark, monkeypatch):
    """Quotes of quotes in small and in one large conversation; no stored stage runs Python."""
    plans = []
    keep = chat_quotes.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(chat_quotes, "stored", watched)
    rows = talks(5, [10_000, 3, 40, 1, 200])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_quotes.reply_ordered(df)
    names = ["parent_turn", "thread_turn", "depth", "n_quoted_lines", "reply_text", "position"]
    got = {(x["conv_id"], x["turn"]): tuple(x[n] for n in names) for x in out.collect()}
    want = brute_order(rows)
    assert sum(v[0] is not None for v in want.values()) > 3000 and max(v[2] for v in want.values()) > 8
    assert got == want
    assert len(plans) > 4 and not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
    duckdb = pytest.importorskip("duckdb")
    conversations = df.toPandas()  # noqa: F841
    sql = {(x[0], x[1]): x[2:] for x in duckdb.sql(f"SELECT conv_id, turn, {', '.join(names)} FROM ({chat_quotes.SQL})").fetchall()}
    assert sql == want


# neighbours


def vectors(spark, n=1500, d=16):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, d)).astype("f4")
    x[100:400] = x[7]  # a common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(n, None, 0), (n + 20, [0.0] * d, 0), (n + 40, [float("nan")] + [1.0] * (d - 1), 0), (n + 60, [None] + [1.0] * (d - 1), 0), (n + 61, [1.0, 2.0], 0), (None, [1.0] * d, 0), (40, x[40].tolist(), 0)]
    return x.astype("f8"), spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def recall(got, x, every=20, k=20):
    """Share of the exact k nearest that were found; also holds order, ties, scores and ids."""
    score = x @ x.T
    hits = total = 0
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
        assert abs(g["score"] - score[g["query_id"], g["vec_id"]]) < 1e-9
    assert set(by) == {i for i in range(len(x)) if i % every == 0}
    for q, rows in by.items():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(1, k + 1)) and q not in [v for _, v, _ in rows]
        assert rows == sorted(rows, key=lambda t: (-t[2], t[1]))
        order = sorted((v for v in range(len(x)) if v != q), key=lambda v: (-round(score[q, v], 9), v))[:k]
        hits += len(set(order) & {v for _, v, _ in rows})
        total += k
    return hits / total


def test_neighbours(spark):
    x, df = vectors(spark)
    assert recall(ann_multi_index.search(df).collect(), x) >= 0.9


@pytest.mark.parametrize("kind", ["without structure", "clustered", "unlike lengths", "a hot group"])
def test_recall(spark, kind):
    r = np.random.default_rng(11)
    x = r.normal(size=(2400, 64))
    if kind == "clustered":
        x = x * 0.3 + r.normal(size=(30, 64))[r.integers(0, 30, 2400)]
    elif kind == "unlike lengths":
        x *= r.lognormal(0, 0.5, (2400, 1))
    elif kind == "a hot group":
        x[r.permutation(2400)[:800]] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(ann_multi_index.search(df).collect(), x) >= 0.9


def test_repeated_query(spark):
    """A query with several vectors asks with the smallest one; other rows of it are no candidates."""
    df = spark.createDataFrame([(0, [3.0, 1.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.5]), (3, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = sorted((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in ann_multi_index.search(df).collect())
    assert got == [(0, 1, 3, 27.0), (0, 2, 2, 3.0), (0, 3, 1, 2.0)]


@pytest.mark.parametrize("case", ["every row twice", "one row often", "one id with many vectors"])
def test_repeated_vectors(case):
    """One block gives the k nearest vec_ids by their best scores, however often they are repeated."""
    r = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(r.integers(-9, 10, (60, 4)).astype("f8").tolist(), 1)]
    if case == "every row twice":
        rows += rows
    elif case == "one row often":
        rows += [(i, [50.0] * 4) for i in range(101, 131) for _ in range(30 if i == 101 else 1)]
    else:
        rows += [(101, [50.0 + j, 50.0, 50.0, 50.0]) for j in range(30)]
    data = pa.table({"vec_id": [i for i, _ in rows], "embedding": [x for _, x in rows], "place": pa.array([0] * len(rows), pa.int32())})
    queries = pa.table({"query_id": [0], "vector": [[1.0, 2.0, 3.0, 4.0]], "bits": pa.array([b"\x80"], pa.binary())})
    got = ann_multi_index._best(20)(data, queries).to_pylist()
    best = {}
    for i, x in rows:
        best[i] = max(best.get(i, -1e9), x[0] + 2 * x[1] + 3 * x[2] + 4 * x[3])
    assert [(g["vec_id"], g["score"]) for g in got] == sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in ann_multi_index.search(df).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann_multi_index.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("side", [64, 3])
def test_walk_is_in_order(monkeypatch, side):
    """What is passed holds enough, and no pair (of tiles, their best pairs) that is left has a larger sum than all that were taken."""
    monkeypatch.setattr(ann_multi_index, "SIDE", side)
    r = np.random.default_rng(3)
    a, b = r.normal(size=8), r.normal(size=6)
    pairs = np.divmod(np.array(sorted(r.permutation(48)[:30])), 6)
    kinds, sums = r.integers(1, 3, 30), a[pairs[0]] + b[pairs[1]]
    assert ann_multi_index.walk(a, b, pairs, kinds, kinds, 1e9).tolist() == list(range(30))
    for wanted, least in ((10, 0), (1, 12), (0, 0)):
        cells = ann_multi_index.walk(a, b, pairs, kinds, 2 * kinds, wanted, least)
        assert kinds[cells].sum() >= wanted and 2 * kinds[cells].sum() >= least
        if side == 64 and len(cells):
            assert sums[cells].min() >= np.delete(sums, cells).max() - 1e-12
            short = kinds[cells].sum() - kinds[cells[sums[cells].argmin()]]
            assert short < wanted or 2 * short < least


def test_layout():
    rows = np.array([3000, 1000, 500, 9000, 4096, 1])
    own = ann_multi_index.Layout.of(np.array([1, 2, 3, 4, 6, 7]), rows, rows)
    assert own.start.tolist() == [0, 0, 1, 2, 5, 6] and own.parts.tolist() == [1, 1, 1, 3, 1, 1] and own.local.tolist() == [0, 1, 0, 0, 0, 0]
    assert own.cells.tolist() == [2, 1, 1, 1, 1, 1, 1]


# the pipeline and the native operators


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "bpe"]
    r = random.Random(3)
    vocab = {"en": words(r, 60, "abcde"), "de": words(r, 60, "äöüst")}
    texts = [(i, " ".join(r.choice(vocab[g]) for _ in range(60)), g, f"s{i % 3}") for i, g in enumerate(["en", "de"] * 30)]
    texts += [(100, texts[0][1], "en", "s1"), (101, "123 456", None, "s1"), (102, None, None, None), (103, "prefix " + texts[2][1] + " " + " ".join(words(r, 200, "abcde")), "en", "s2")]
    docs = spark.createDataFrame([t + (len(t[1] or ""),) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    left = {x["doc_id"]: x for x in kept.collect()}
    assert not {100, 101, 102} & set(left) and set(range(60)) <= set(left)
    assert len(left[103]["text"]) < len(texts[-1][1]) - 100 and left[103]["n_chars"] == len(left[103]["text"])
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, "")
    out = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    assert out.count() == mixed.count() and mixed.columns == docs.columns


def brute_copies(rows, power=0.5, seed=0):
    """Of each row (doc_id, source): how often it is repeated."""
    import math

    n = {}
    for _, source in rows:
        n[source] = n.get(source, 0) + 1
    weights = {k: v**power for k, v in n.items()}
    out = {}
    for doc, source in rows:
        rate = weights[source] / sum(weights.values()) * len(rows) / n[source]
        draws = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
        out[doc] = 0
        for k in range(draws):
            u, p, cdf, mean = int(hashlib.md5(f"{seed}:{doc}:{k}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate / draws), 0.0, rate / draws
            for j in range(mixing.TABLE + 1):
                cdf += p
                if cdf <= u:
                    out[doc] += 1
                p *= mean / (j + 1)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages over documents of three languages with junk, copies, shared passages and a hot source."""
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from collections import Counter

    import corpus_pipeline
    from millrace.llm import registry
    from tests.llm.test_text_operators import brute_language, brute_model

    r = random.Random(12)
    vocab = {g: words(r, 80, a) for g, a in (("en", "abcdefgh"), ("de", "äöüstnr"), ("fr", "éèlmop"))}
    passage = " ".join(r.choice(vocab["en"]) for _ in range(70))
    texts = []
    for i in range(70):
        g = r.choice(sorted(vocab))
        own = [r.choice(vocab[g]) for _ in range(r.randint(40, 120))]
        if i % 9 == 4:
            own[10:10] = [passage]
        if i % 7 == 3 and texts:
            own = texts[-1][1].split()
            own[r.randrange(len(own))] = "odd"
        texts.append((i, " ".join(own), g if i % 5 else None, "hot" if i % 3 else f"s{i % 4}"))
    texts += [(100, texts[0][1], "en", "hot"), (101, "123 456 !", None, "hot"), (102, None, None, None), (103, "", "en", "hot"), (104, passage, "en", "solo")]
    docs = spark.createDataFrame([t + (len(t[1] or ""),) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = brute_model([(t, g) for _, t, g, _ in texts])
    left = [x for x in texts if (found := brute_language(model, x[1]))[0] != "und" and found[1] >= 0.3]
    groups = brute_groups([(i, t) for i, t, _, _ in left], 5)
    left = [x for x in left if groups[x[0]][1] == x[0]]
    kept = brute_kept([(i, t) for i, t, _, _ in left])
    left = [(i, kept[i].decode(errors="ignore"), s) for i, _, _, s in left]
    left = [x for x in left if x[1]]
    copies = brute_copies([(i, s) for i, _, s in left])
    library = tokenizers.Tokenizer.from_file(registry.default_tokenizer())
    want = Counter()
    for i, text, _ in left:
        ids = library.encode(text, add_special_tokens=False).ids
        if copies[i]:
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += copies[i]
    assert len(left) < len(texts) - 10 and sum(want.values()) > 30
    assert got == want


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_mixing", "op6_chat_quotes"])
def test_native_plans_run_no_python(spark, name, monkeypatch):
    """Neither the query's plan nor that of a table it stores on the way has Python."""
    from millrace.llm import registry
    from tests.test_queries import SF

    plans = []
    keep = mixing.stored
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df, name):
        plans.append(plan_of(df))
        return keep(df, name)

    for module in (mixing, chat_quotes, positions):
        monkeypatch.setattr(module, "stored", watched)
    plans.append(plan_of(registry.queries()[name](spark, SF)))
    assert len(plans) >= {"op3_quality_rules": 1, "op4_mixing": 3, "op6_chat_quotes": 6}[name]
    assert not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
