"""Resumable steps: each step's table is written once, and a restarted run reads what is there.

A step is known by its number, its name, the options, its analysed plan, and the names, sizes and times of the files
that the plan reads; if any of them differs from what an earlier run left, the step and all later ones are computed
anew. Of a Python function in the plan only the name is seen: one that changes needs another text in inputs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.storage import shared_dir


class Run:
    """selective: only steps with keep=True are written; others stay lazy plans."""

    def __init__(self, spark: SparkSession, name: str, options: dict[str, object] | None = None, selective: bool = False, enabled: bool = True):
        self.spark, self.selective, self.enabled = spark, selective, enabled
        self.path = f"{shared_dir(spark)}/millrace-runs/{name}"
        self.chain = hashlib.sha256(json.dumps(options or {}, sort_keys=True, default=str).encode()).hexdigest()
        self.steps, self.skipped = 0, 0

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _plan(self, df: DataFrame) -> str:
        """The analysed plan without the numbers that each session gives anew, and the files that it reads."""
        tree = re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]", "", df._jdf.queryExecution().analyzed().canonicalized().toString())
        files = []
        for name in sorted(df.inputFiles()):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            status = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
            files.append((name, status.getLen(), status.getModificationTime()))
        return f"{tree}|{files}"

    def step(self, name: str, make: Callable[[], DataFrame], inputs: str = "", keep: bool = True) -> DataFrame:
        """The table of the step. make gives the plan; it runs only if the step has to be computed."""
        self.steps += 1
        df = make()
        self.chain = hashlib.sha256(f"{self.chain}|{self.steps}|{name}|{inputs}|{self._plan(df)}".encode()).hexdigest()
        if not self.enabled or self.selective and not keep:
            return df
        path = f"{self.path}/{self.steps:03d}_{name}_{self.chain[:16]}"
        if self._exists(f"{path}/_SUCCESS"):
            self.skipped += 1
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
