"""Counters beside a plan: rows and extremes observed while it runs, without another pass."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Trace:
    """Named steps of a run with their row counts and seconds."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation, float]] = []
        self.seconds: dict[str, float] = {}

    def watch(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """The same rows; when an action runs them, their count and the measures are kept."""
        o = Observation(f"{name}-{len(self.seen)}")
        self.seen.append((name, o, time.time()))
        return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()])

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Adds the seconds of what runs inside to those of a step."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> list[dict[str, Any]]:
        """Of every step that has run."""
        return [{"step": name, "since": at, "seconds": self.seconds.get(name)} | dict(o.get) for name, o, at in self.seen]
