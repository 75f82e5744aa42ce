"""Scalar functions, as column expressions where data is concerned and as plain Python for settings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_date(text: Column) -> Column:
    """Date of YYYY-MM-DD text; null if it is none."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")


def format_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def year_start(date: Column) -> Column:
    """The first day of the date's year."""
    return F.trunc(date, "year")


def words_of_letters(text: Column, longest: int = 24) -> Column:
    """Runs of A-Z and a-z, cut at the given length."""
    return F.regexp_extract_all(text, F.lit(f"([A-Za-z]{{1,{longest}}})"), F.lit(1))


def words_between_marks(text: Column) -> Column:
    """What stands between white space, digits and the marks . , ; ( ) < > - / and the double quote."""
    return F.filter(F.split(text, r'[\s.,;()<>\-/0-9"]+'), lambda w: w != "")


def words_of_pattern(text: Column) -> Column:
    """What stands between runs of characters other than letters, digits and underscores."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda w: w != "")


def argv(command: Column) -> Column:
    """Arguments of a command: split at NUL characters if there are any, else at white space."""
    nul = F.filter(F.split(command, "\x00"), lambda x: x != "")
    return F.when(F.instr(command, "\x00") > 0, nul).otherwise(F.filter(F.split(command, r"\s+"), lambda x: x != ""))


def without_blanks(text: Column, first: int) -> Column:
    """Text whose first characters have lost their blanks."""
    return F.concat(F.regexp_replace(F.substring(text, 1, first), "[ \t]", ""), F.substring(text, first + 1, 1 << 30))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("double"), lambda s, x: s + x)


def to_int(text: Column) -> Column:
    """Whole number of a text; null if it is none."""
    return text.try_cast("long")


def printable(data: Column) -> Column:
    """Bytes as text for people: printable ASCII as it is, other bytes as a dot."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def parse_int(text: str) -> int:
    """Strict: no blanks, no digits grouped."""
    if not re.fullmatch(r"[+-]?\d+", text):
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)


def parse_boolean(text: str) -> bool:
    """0, 1, true or false, in any case."""
    try:
        return {"0": False, "1": True, "false": False, "true": True}[text.lower()]
    except KeyError:
        raise ValueError(f"not a truth value: {text!r}") from None


def fill_template(template: str, fields: list[str]) -> str:
    """$1, $2, ... replaced by the fields; a variable is its longest run of digits, one without a field stays."""

    def field(m: re.Match[str]) -> str:
        k = int(m[1])
        return fields[k - 1] if 1 <= k <= len(fields) else m[0]

    return re.sub(r"\$(\d+)", field, template)
