"""Engine context: a session, a number of ranks and checked options.

Ranks are logical: results that depend on them are computed from columns, never from how Spark
happens to partition the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.scalars import parse_boolean

#: Options by name: the type of the value, and the session setting that it stands for (None: engine only).
OPTIONS: dict[str, tuple[type, str | None]] = {
    "shuffle_partitions": (int, "spark.sql.shuffle.partitions"),
    "split_bytes": (int, "spark.sql.files.maxPartitionBytes"),
    "broadcast_bytes": (int, "spark.sql.autoBroadcastJoinThreshold"),
    "advisory_partition_bytes": (int, "spark.sql.adaptive.advisoryPartitionSizeInBytes"),
    "adaptive": (bool, "spark.sql.adaptive.enabled"),
    "arrow_batch_rows": (int, "spark.sql.execution.arrow.maxRecordsPerBatch"),
    "checkpoint": (bool, None),
    "trace": (bool, None),
    "on_error": (str, None),
}


class Context:
    """Holds the session, the rank count and the options; ``with Context(...)`` puts session settings back."""

    def __init__(self, spark: SparkSession, ranks: int = 8, **options: object):
        if ranks < 1:
            raise ValueError("ranks must be positive")
        self.spark, self.ranks, self.options = spark, ranks, {}
        self._before: dict[str, str | None] = {}
        for k, v in options.items():
            self.set_option(k, v)

    def set_option(self, name: str, value: object) -> None:
        """Sets an option by its name in any case; unknown names and bad values raise ValueError."""
        name = name.lower()
        if name not in OPTIONS:
            raise ValueError(f"unknown option {name}")
        kind, conf = OPTIONS[name]
        try:
            value = parse_boolean(str(value)) if kind is bool else kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"bad value for option {name}: {value!r}") from None
        self.options[name] = value
        if conf:
            self._before.setdefault(conf, self.spark.conf.get(conf, None))
            self.spark.conf.set(conf, str(value).lower() if kind is bool else str(value))

    def load(self, properties: dict[str, str]) -> None:
        for k, v in properties.items():
            self.set_option(k, v)

    def as_pairs(self) -> DataFrame:
        """The options as rows (key, value)."""
        return self.spark.createDataFrame([(k, str(v)) for k, v in self.options.items()], "key string, value string")

    def close(self) -> None:
        for conf, value in self._before.items():
            if value is None:
                self.spark.conf.unset(conf)
            else:
                self.spark.conf.set(conf, value)
        self._before.clear()

    def __enter__(self) -> Context:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


#: Rows that a table of options may have.
MOST_OPTIONS = 10_000


def options_of(pairs: DataFrame) -> dict[str, str]:
    """A table of (key, value) strings as a dict, without empty keys and values. For option tables only: a larger one is an error."""
    rows = pairs.limit(MOST_OPTIONS + 1).collect()
    if len(rows) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options")
    return {r["key"]: r["value"] for r in rows if r["key"] and r["value"]}


def parse_properties(lines: Iterable[str]) -> dict[str, str]:
    """The text format of Java properties: # and ! comments, = : or blank separators, continuations, escapes."""
    out: dict[str, str] = {}
    logical, open_ = "", False
    for raw in [*lines, ""]:
        line = raw.rstrip("\r\n").lstrip(" \t\f")
        if not open_ and (not line or line[0] in "#!"):
            continue
        logical = logical + line if open_ else line
        tail = len(logical) - len(logical.rstrip("\\"))
        if tail % 2:
            logical, open_ = logical[:-1], True
            continue
        open_ = False
        key, value = _split(logical)
        if key and value:
            out[key] = value
    return out


_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            c = text[i + 1]
            if c == "u":
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
            else:
                out.append(_ESCAPES.get(c, c))
                i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _split(line: str) -> tuple[str, str]:
    i = 0
    while i < len(line) and line[i] not in "=: \t\f":
        i += 2 if line[i] == "\\" else 1
    rest = line[i:].lstrip(" \t\f")
    if rest[:1] in ("=", ":"):
        rest = rest[1:].lstrip(" \t\f")
    return _unescape(line[:i]), _unescape(rest)
