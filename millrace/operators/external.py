"""Stages that run external programs: command farms, pipes, key files and job tables.

Spark schedules the tasks. A command runs on an executor and may run again if its task is retried, so
commands should be safe to repeat.
"""

from __future__ import annotations

import itertools
import os
import re
import shlex
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import fill_template
from millrace.operators.pairs import framed
from millrace.storage import ship

RESULT = "task long, command string, code int, stdout string, stderr string, tries int, worker int, seconds double"


def split_command(command: str) -> list[str]:
    """Arguments split at NUL characters if there are any, else as a shell would."""
    return [x for x in command.split("\0") if x] if "\0" in command else shlex.split(command)


def _execute(command: str, shell: bool, timeout: float | None, text: str | None = None) -> tuple[int, str, str]:
    try:
        p = subprocess.run(command if shell else split_command(command), shell=shell, capture_output=True, text=True, timeout=timeout, input=text)
        return p.returncode, p.stdout, p.stderr
    except subprocess.TimeoutExpired:
        return -9, "", "timeout"
    except (OSError, ValueError) as e:
        return 127, "", str(e)


def run_commands(commands: DataFrame, command: str = "value", task: str = "key", slots: int = 8, shell: bool = False, timeout: float | None = None, strict: bool = False, retries: int = 0) -> DataFrame:
    """Runs a command for every row; code, stdout and stderr of each, and its tries, worker (a slot) and seconds.

    Rows are dealt out over slots tasks; each row's command runs alone in its turn. retries: a failing command runs
    again so often; strict: one that still fails, fails the stage.
    """
    ship(commands.sparkSession)

    def results(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, ...]]:
        for f in frames:
            for t, c in zip(f["task"], f["command"]):
                tries, code, began = 0, 1, time.perf_counter()
                while code and tries <= retries:
                    code, out, err = _execute(c, shell, timeout)
                    tries += 1
                if strict and code:
                    raise RuntimeError(f"command of task {t} failed with {code}: {err[-500:]}")
                worker = TaskContext.get().partitionId()
                yield t, c, code, out, err, tries, worker, time.perf_counter() - began

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(results(frames), "task", "command", "code", "stdout", "stderr", "tries", "worker", "seconds")

    rows = commands.select(F.col(task).cast("long").alias("task"), F.col(command).alias("command"))
    return rows.repartition(slots).mapInPandas(run, RESULT)


def farm(tasks: DataFrame, fn: Callable[[Any, Any], Iterable[tuple[Any, Any]]], key: str, value: str, slots: int = 8) -> DataFrame:
    """A task farm: a Python function for each pair, each pair a unit of work of its own."""
    ship(tasks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from framed(x for k, v in zip(f["key"], f["value"]) for x in fn(k, v))

    return tasks.repartition(slots).mapInPandas(run, f"key {key}, value {value}")


def _piped(command: str, lines: Iterable[str]) -> Iterator[str]:
    """The program's output lines, while another thread feeds it: neither side is held in memory."""
    with tempfile.TemporaryFile("w+") as errors:
        p = subprocess.Popen(split_command(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors, text=True)
        broken: list[BaseException] = []

        def feed() -> None:
            try:
                with p.stdin as to:
                    to.writelines(f"{x}\n" for x in lines)
            except BrokenPipeError:
                pass  # a program may stop reading early
            except BaseException as e:
                broken.append(e)
                p.kill()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        try:
            for x in p.stdout:
                yield x.rstrip("\n")
        finally:
            if p.poll() is None and not p.stdout.closed:
                p.stdout.close()
            code = p.wait()
            feeder.join()
        if broken:
            raise broken[0]
        if code:
            errors.seek(0)
            raise RuntimeError(f"{command} failed with {code}: {errors.read()[-500:]}")


def key_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """key and value of lines cut at their first blank; lines without one are left out."""
    at = F.instr(line, " ")
    rest = F.col(line).substr(at + 1, F.length(line))
    return lines.where(at > 1).select(F.col(line).substr(F.lit(1), at - 1).alias("key"), rest.alias("value"))


def pipe_map(lines: DataFrame, command: str, line: str = "value") -> DataFrame:
    """Each partition's lines go through a program; its lines come out. A partition without lines starts none."""
    ship(lines.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = (x for f in frames for x in f[line])
        first = next(given, None)
        if first is not None:
            out = _piped(command, itertools.chain([first], given))
            while part := list(itertools.islice(out, 10_000)):
                yield pd.DataFrame({"value": part})

    return lines.select(line).where(F.col(line).isNotNull()).mapInPandas(run, "value string")


def pipe_reduce(pairs: DataFrame, command: str | None, ranks: int | None = None) -> DataFrame:
    """Pairs of a key together, keys in order, as "key value" lines through a program."""
    dealt = pairs.repartition(ranks, "key") if ranks else pairs.repartition("key")
    lines = dealt.sortWithinPartitions("key", "value").select(F.concat_ws(" ", "key", "value").alias("value"))
    return pipe_map(lines, command) if command else lines


def map_reduce(lines: DataFrame, mapper: str, reducer: str | None = None, ranks: int | None = None) -> DataFrame:
    """Lines through a mapper program, shuffled by the key before the first blank, through a reducer program."""
    return pipe_reduce(key_values(pipe_map(lines, mapper)), reducer, ranks)


def reduce_key_files(pairs: DataFrame, command: str, timeout: float | None = None) -> DataFrame:
    """For each key, a file of its "key value" lines whose name is the program's last argument. key, code, stdout.

    The file lives on the executor while the program runs.
    """
    ship(pairs.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        key = f["key"].iloc[0]
        with tempfile.TemporaryDirectory() as d:
            name = os.path.join(d, re.sub(r"[^\w.-]", "_", str(key)) or "_")
            with open(name, "w") as out:
                out.writelines(f"{key} {v}\n" for v in sorted(f["value"]))
            code, text, _ = _execute(f"{command} {shlex.quote(name)}", False, timeout)
        return pd.DataFrame([(key, code, text)], columns=["key", "code", "stdout"])

    return pairs.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).groupBy("key").applyInPandas(run, "key string, code int, stdout string")


def file_flow(spark: SparkSession, names: Sequence[str], mapper: str, pairs_of: str | None = None, reducer: str | None = None) -> DataFrame:
    """A mapper task for each input file (its last argument); pairs_of prints "key value" lines of the mapper's output; a reducer gets a file for each key.

    Without a reducer the pairs come back, without pairs_of the mapper's output lines are the pairs.
    """
    tasks = spark.createDataFrame([(i, f"{mapper} {shlex.quote(n)}") for i, n in enumerate(names)], "key long, value string")
    out = run_commands(tasks, slots=max(1, len(names)), strict=True)
    lines = out.select(F.explode(F.split("stdout", "\n")).alias("value")).where("value != ''")
    pairs = key_values(pipe_map(lines, pairs_of) if pairs_of else lines)
    return reduce_key_files(pairs, reducer) if reducer else pairs


@dataclass
class JobTable:
    title: str
    template: str
    rows: list[list[str]]

    def commands(self, program: str = "") -> list[str]:
        return [f"{program} {fill_template(self.template, r)}".strip() for r in self.rows]


def parse_job_table(lines: Iterable[str]) -> JobTable:
    """TITLE= and PARAM= lines, % and # comments, and rows of tab-separated fields."""
    title, template, rows = "", None, []
    for raw in lines:
        line = raw.rstrip("\r\n")
        head = re.sub("[ \t]", "", line[:7]) + line[7:] if line[:7].strip() else line.strip()
        if not head or head[0] in "%#":
            continue
        if head[:6].upper() == "TITLE=":
            title = head[6:]
        elif head[:6].upper() == "PARAM=":
            template = head[6:]
        else:
            rows.append(line.strip(" ").split("\t"))
    if template is None:
        raise ValueError("no PARAM= line")
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in their number of fields")
    return JobTable(title, template, rows)


def run_jobs(spark: SparkSession, table: JobTable, program: str = "", slots: int = 8, timeout: float | None = None, retries: int = 0) -> DataFrame:
    tasks = spark.createDataFrame(list(enumerate(table.commands(program))), "key long, value string")
    return run_commands(tasks, slots=slots, timeout=timeout, retries=retries)


def job_report(results: DataFrame) -> DataFrame:
    """code, jobs, and their task numbers: how the jobs ended."""
    return results.groupBy("code").agg(F.count(F.lit(1)).alias("jobs"), F.sort_array(F.collect_list("task")).alias("tasks"))


def worker_report(results: DataFrame) -> DataFrame:
    """worker, jobs, failed, tries, seconds: what each worker did."""
    return results.groupBy("worker").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.when(F.col("code") != 0, 1).otherwise(0)).alias("failed"), F.sum("tries").alias("tries"), F.sum("seconds").alias("seconds"))
