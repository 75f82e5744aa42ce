"""Rule bitmask ledger: every quality rule is evaluated once, policies and ablations reuse its bits.

``ledger`` measures each whole text in one pass without an exchange and stores, beside the
measurements, one failure bit for each rule. A policy is a version and a mask of the rules it
enforces; applying it, or asking what a rule costs, is bit arithmetic over the ledger. ``ablations``
counts documents by their distinct bit patterns first, so what it shuffles is bounded by the
patterns that occur, not by the documents.

Defined results: null, empty and blank texts have no words and zero for every measurement, and fail
the word-count rule; rows that repeat a doc_id are measured each; other columns pass unread; an empty
table gives an empty ledger and no ablation rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in bit order; each reads measurements only, in whole numbers."""
    n, c, s = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    tests = [
        ("few_words", n < 10),
        ("repeated_windows", 100 * F.col("n_repeat_words") > 20 * n),
        ("symbols", 100 * s > 10 * n),
        ("repeated_lines", 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
        ("short_words", c < 2 * n),
        ("long_words", c > 25 * n),
    ]
    return [Rule(i, name, fails) for i, (name, fails) in enumerate(tests)]


#: Policies by version: the names of the rules that each enforces.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = 2


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[x] for x in names)


def _covered(w: Column) -> Column:
    """Words inside five-word windows that occur twice or more; w: a materialised array of words."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, WINDOW)))
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda e, k: F.coalesce(e["x"] == F.get(s, k)["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def union(r: Column) -> Column:
        steps = F.transform(r, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(r, k + 1) - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(pairs, repeated), union)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements; five-word windows are compared by hash, and by word only where two hashes meet."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words(F.col("text")).alias("w"),
    )
    d = d.select("doc_id", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    hashed = F.transform(F.sequence(F.lit(0), F.size("hw") - WINDOW), lambda i: F.xxhash64(*[F.get("hw", i + k) for k in range(WINDOW)]))
    d = d.withColumn("twice", F.when(F.size("hw") > WINDOW, let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))).otherwise(False))
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(F.col("twice"), _covered(F.col("w"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and fail_bits of every document."""
    bits = F.lit(0).cast("long")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return measured(docs).withColumn("fail_bits", bits)


def with_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents kept, and documents kept without that rule.

    fail_bits patterns are counted first (a partial aggregate); the policies multiply that small table.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    tests = [(v, r.name, mask(p), 1 << r.bit) for v, p in POLICIES.items() for r in rules() if r.name in p]
    table = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, name, m, b in tests]))
    each = patterns.select("fail_bits", "n", table.alias("t")).select("fail_bits", "n", "t.*")
    left = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(left == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(left.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or("fail_bits").alias("seen_bits"),
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """The measurements with base_failed and kept under the current policy."""
    base = mask(POLICIES[1])
    return with_policy(ledger(docs)).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(base)) != 0)


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
