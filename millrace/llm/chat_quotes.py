"""Quotation linking: quoted passages name the message that a reply answers.

A line's quote level is the number of ``>`` marks before its text. Runs of lines of one level are
passages. A passage, and each of its lines, is normalised (lower case, runs of white space as one
space) and hashed; every message's own text, paragraphs and lines are hashed alike. Joining the two
on conversation and hash finds the earliest message that holds the passage; a reply's parent is the
source of its outermost quotes (lowest level), of the longest match, the latest turn on ties. Replies
follow parents up to a message that quotes nothing known, their thread, by pointer doubling. Position
is a message's place in its conversation by (thread_turn, depth, turn): every message is after the one
it answers, and those of a conversation without quotes are in turn order. Places come from a range
exchange of all messages, so no conversation, however long, has to fit a task.

Defined results: a null or empty text has no lines and an empty own text; rows with a null conv_id or
turn are kept, never linked, and are their own thread; rows with a null conv_id are placed like those of
one conversation; rows that repeat a conversation and turn are all kept, share that turn's links and follow
each other by their texts and roles; a quote of the same or a later turn is no link; an empty table
gives an empty one; other columns pass, and columns named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_BREAK, let, merged, stored
from millrace.operators.positions import with_positions

#: The quote marks before a line's text, each with at most one space behind.
MARKS = r"^[ \t]{0,3}((?:>[ \t]?)+)"
#: The line that mail programs put above a quotation.
ATTRIBUTION = r"(?i)^[ \t]*(on .{1,200} wrote|am .{1,200} schrieb.{0,80}|le .{1,200} a écrit|el .{1,200} escribió)[ \t]*:[ \t]*$"
#: What ends a paragraph.
GAP = r"\n[\x20\x09-\x0D]*\n"
ADDED = ("parent_turn", "thread_turn", "depth", "n_quoted_lines", "reply_text", "position")


def normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, WORD_BREAK, " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines: array of (level, body)."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))
    raw = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.transform(F.split("text", "\r?\n"), line)).otherwise(F.array().cast("array<struct<level:int,body:string>>"))
    return messages.drop(*ADDED).withColumn("_lines", raw)


def _own(lines: Column) -> Column:
    """Lines that are no quote, nor the attribution above one."""

    def kept(x: Column, i: Column) -> Column:
        before_quote = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~(before_quote & x["body"].rlike(ATTRIBUTION))

    return F.transform(F.filter(lines, kept), lambda x: x["body"])


def _runs(lines: Column) -> Column:
    """Quoted passages: (level, lines of the run)."""
    starts = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i == F.size(lines)) | (i == 0) | ~F.coalesce(F.get(lines, i)["level"] == F.get(lines, i - 1)["level"], F.lit(False)))

    def cut(s: Column) -> Column:
        own = F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda a, k: F.struct(F.get(lines, a)["level"].alias("level"), F.transform(F.slice(lines, a + 1, F.get(s, k + 1) - a), lambda x: x["body"]).alias("bodies")))
        return F.filter(own, lambda r: r["level"] > 0)

    return let(starts, cut)


def _units(bodies: Column) -> Column:
    """Distinct normalised strings to hash: the whole, its paragraphs and its lines."""
    whole = F.array_join(bodies, "\n")
    parts = F.concat(F.array(whole), F.split(whole, GAP), bodies)
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn: one row for each turn that quotes an earlier one.

    Originals are reduced to the first turn of each hash before the join, so a common line is one row
    on that side; the other side's hot keys are split by adaptive execution, for both are plain scans.
    """
    keyed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = keyed.where(F.exists("_lines", lambda x: x["level"] > 0))
    passages = quoting.select("conv_id", "turn", F.explode(_runs(F.col("_lines"))).alias("r")).select("conv_id", "turn", F.col("r.level").alias("level"), F.explode(_units(F.col("r.bodies"))).alias("unit"))
    quotes = passages.select("conv_id", "turn", "level", F.sha2("unit", 256).alias("hash"), F.length("unit").alias("chars"))
    quotes = stored(quotes.distinct(), "quotes")
    talks = quotes.select("conv_id").distinct()
    sources = keyed.join(talks, "conv_id", "left_semi")
    units = sources.select("conv_id", "turn", F.explode(_units(_own(F.col("_lines")))).alias("unit"))
    first = stored(units.groupBy("conv_id", F.sha2("unit", 256).alias("hash")).agg(F.min("turn").alias("parent_turn")), "originals")
    found = quotes.join(first, ["conv_id", "hash"]).where("parent_turn < turn")
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("chars"), F.col("parent_turn"))).alias("best"))
    return stored(best.select("conv_id", "turn", F.col("best.parent_turn").alias("parent_turn")), "links")


def threads(found: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn, depth: each round doubles how far up the pointers reach."""
    state = found.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("depth"))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_up"), F.col("depth").alias("_more"))
        met = state.join(up, ["conv_id", "thread_turn"], "left")
        if met.where("_up IS NOT NULL").isEmpty():
            return state
        state = stored(met.select("conv_id", "turn", "parent_turn", F.coalesce("_up", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "threads")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Every message with reply_text (its text without quotes), parent_turn, thread_turn, depth, n_quoted_lines, position."""
    rows = parsed(messages)
    placed = threads(links(rows))
    out = rows.select(
        *[c for c in rows.columns if c != "_lines"],
        F.size(F.filter("_lines", lambda x: x["level"] > 0)).alias("n_quoted_lines"),
        F.trim(F.array_join(_own(F.col("_lines")), "\n")).alias("reply_text"),
    )
    out = out.join(placed, ["conv_id", "turn"], "left")
    out = out.withColumn("thread_turn", F.coalesce("thread_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    out = with_positions(out, "conv_id", "thread_turn", "depth", "turn", F.md5("text"), F.md5("role"), name="_mr_at")
    begin = stored(out.groupBy(F.col("conv_id").alias("_mr_conv")).agg(F.min("_mr_at").alias("_mr_begin")), "conversations")
    out = out.join(begin, F.col("conv_id").eqNullSafe(F.col("_mr_conv"))).withColumn("position", F.col("_mr_at") - F.col("_mr_begin"))
    return out.select(*[c for c in messages.columns if c not in ADDED], *ADDED)


_LINE = f"regexp_extract(line, '{MARKS}', 1)"
_NORMAL = f"trim(lower(regexp_replace({{}}, '{WORD_BREAK}', ' ', 'g')))"
_UNITS = f"""SELECT {{keys}}, {_NORMAL.format("unnest(list_concat([whole], string_split_regex(whole, '" + GAP + "'), bodies))")} AS unit"""
SQL = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
l AS (SELECT id, conv_id, turn, i, length(replace(replace({_LINE}, ' ', ''), chr(9), '')) AS level, regexp_replace(line, '{MARKS}', '') AS body
      FROM (SELECT id, conv_id, turn, unnest(x) AS line, unnest(range(len(x))) AS i
            FROM (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM m WHERE text <> ''))),
w AS (SELECT *, lead(level) OVER o AS next, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (o ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY i) AS before FROM l) WINDOW o AS (PARTITION BY id ORDER BY i)),
own AS (SELECT id, conv_id, turn, list(body ORDER BY i) AS bodies, string_agg(body, chr(10) ORDER BY i) AS whole
        FROM w WHERE level = 0 AND NOT (coalesce(next, 0) > 0 AND regexp_matches(body, '{ATTRIBUTION}')) GROUP BY ALL),
quoted AS (SELECT id, run, conv_id, turn, level, list(body ORDER BY i) AS bodies, string_agg(body, chr(10) ORDER BY i) AS whole FROM w WHERE level > 0 GROUP BY ALL),
sources AS (SELECT conv_id, unit, min(turn) AS parent FROM ({_UNITS.format(keys="conv_id, turn")} FROM own) WHERE unit <> '' AND turn IS NOT NULL GROUP BY ALL),
quotes AS (SELECT DISTINCT conv_id, turn, level, unit FROM ({_UNITS.format(keys="conv_id, turn, level")} FROM quoted) WHERE unit <> ''),
links AS (SELECT conv_id, turn, arg_max(parent, (-level, length(unit), parent)) AS parent FROM quotes JOIN sources USING (conv_id, unit) WHERE parent < turn GROUP BY ALL),
climb AS (SELECT conv_id, turn, parent AS top, 1 AS depth FROM links
          UNION ALL SELECT c.conv_id, c.turn, k.parent, depth + 1 FROM climb c JOIN links k ON c.conv_id = k.conv_id AND c.top = k.turn),
threads AS (SELECT conv_id, turn, arg_max(top, depth) AS thread_turn, max(depth) AS depth FROM climb GROUP BY ALL),
n AS (SELECT id, count(*) AS n FROM l WHERE level > 0 GROUP BY id),
r AS (SELECT m.conv_id, m.turn, role, text, links.parent AS parent_turn, coalesce(threads.thread_turn, m.turn) AS thread_turn, coalesce(threads.depth, 0) AS depth,
             coalesce(n.n, 0) AS n_quoted_lines, trim(coalesce(own.whole, '')) AS reply_text
      FROM m LEFT JOIN n USING (id) LEFT JOIN own USING (id)
      LEFT JOIN links ON m.conv_id = links.conv_id AND m.turn = links.turn LEFT JOIN threads ON m.conv_id = threads.conv_id AND m.turn = threads.turn)
SELECT conv_id, turn, role, parent_turn, thread_turn, CAST(depth AS INTEGER) AS depth, CAST(n_quoted_lines AS INTEGER) AS n_quoted_lines, reply_text,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, depth, turn NULLS FIRST, md5(text) NULLS FIRST, md5(role) NULLS FIRST) - 1 AS position
FROM r
"""
