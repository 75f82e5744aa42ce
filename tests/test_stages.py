import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.context import Context, options_of, parse_properties
from millrace.functions import scalars
from millrace.operators import external, pairs
from millrace.operators.lanes import History, Item, lane_names, parse_lanes, run_lanes
from millrace.operators.resume import Run
from millrace.operators.trace import Trace


def test_commands(spark):
    tasks = spark.createDataFrame([(i, f"echo {i}") for i in range(20)] + [(20, "false"), (21, "no-such-program-here"), (22, "printf\0a b")], "key long, value string")
    got = {r["task"]: r for r in external.run_commands(tasks, slots=4).collect()}
    assert [got[i]["stdout"] for i in range(20)] == [f"{i}\n" for i in range(20)]
    assert got[20]["code"] == 1 and got[21]["code"] == 127 and got[22]["stdout"] == "a b"
    with pytest.raises(Exception, match="failed"):
        external.run_commands(tasks.where("key = 20"), strict=True).collect()
    slow = spark.createDataFrame([(0, "sleep 5")], "key long, value string")
    assert external.run_commands(slow, timeout=0.2).first()["code"] == -9


def test_pipes(spark):
    lines = spark.createDataFrame([("b 2",), ("a 1",), ("noblank",), ("a 3 x",)], "value string")
    assert sorted(tuple(r) for r in external.key_values(lines).collect()) == [("a", "1"), ("a", "3 x"), ("b", "2")]
    out = external.map_reduce(lines, "cat", "sort", ranks=2)
    assert sorted(r["value"] for r in out.collect()) == ["a 1", "a 3 x", "b 2"]


def test_file_flow(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_text(f"k{i % 2} {i}\n")
    names = [str(tmp_path / f"f{i}") for i in range(3)]
    pairs = external.file_flow(spark, names, "cat")
    assert sorted(tuple(r) for r in pairs.collect()) == [("k0", "0"), ("k0", "2"), ("k1", "1")]
    out = external.file_flow(spark, names, "cat", reducer="wc -l")
    assert {r["key"]: r["stdout"].split()[0] for r in out.collect()} == {"k0": "2", "k1": "1"}


def test_farm(spark):
    t = spark.createDataFrame([(i, i) for i in range(10)], "key long, value long")
    assert sorted(r["value"] for r in external.farm(t, lambda k, v: [(k, v * v)], "long", "long", 3).collect()) == [i * i for i in range(10)]


def test_farm_frames_hold_many_pairs(spark):
    n, big = 25_000, (1 << 60) + 1
    asked = []

    def fn(k, v):
        asked.append(k)
        return [(k, len(asked)), (big, None)] if k % 2 else []

    got = external.farm(spark.range(n).selectExpr("id AS key", "id AS value"), fn, "long", "long", 1).collect()
    assert sorted(r["key"] for r in got if r["value"] is not None) == list(range(1, n, 2))
    assert [r["key"] for r in got if r["value"] is None] == [big] * (n // 2)
    frames = list(pairs.framed((i, "x") for i in range(n)))
    assert [len(f) for f in frames] == [10_000, 10_000, 5_000]
    assert [len(f) for f in pairs.framed((i, "x" * (3 << 20)) for i in range(5))] == [2, 2, 1]
    assert list(pairs.framed([])) == []


def test_job_table(spark):
    text = ["# comment\n", "  % also\n", "TITLE=Example\n", "PARAM=-i $1 -n $2 -x $10\n", "a\t1\n", "b\t2\n"]
    t = external.parse_job_table(text)
    assert t.title == "Example" and t.commands("echo") == ["echo -i a -n 1 -x $10", "echo -i b -n 2 -x $10"]
    with pytest.raises(ValueError):
        external.parse_job_table(["a\tb\n"])
    report = external.job_report(external.run_jobs(spark, t, "echo")).collect()
    assert [(r["code"], r["jobs"]) for r in report] == [(0, 2)]


def test_lanes(spark):
    assert len(parse_lanes("3.2:4")) == 6
    order, lock = [], threading.Lock()

    def work(name, pause=0.0):
        def run():
            time.sleep(pause)
            with lock:
                order.append(name)
            return name

        return run

    items = [Item("0.0", work("a", 0.2)), Item("0.1", work("b")), Item("0", work("upper")), Item("0.0", work("c")), Item("1.*", work("any"))]
    assert run_lanes(spark, "2.2", items) == ["a", "b", "upper", "c", "any"]
    assert order.index("upper") > order.index("a") and order.index("c") > order.index("upper")
    with pytest.raises(ValueError):
        run_lanes(spark, "2", [Item("5", work("x"))])

    def bad():
        raise RuntimeError("bad")

    with pytest.raises(RuntimeError):
        run_lanes(spark, "1", [Item("0", bad)])


def test_resume(spark):
    calls = []

    def make(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    for _ in range(2):
        run = Run(spark, "resume-test", {"a": 1})
        assert run.step("one", make(3)).count() == 3 and run.step("two", make(4)).count() == 4
    assert run.skipped == 2
    other = Run(spark, "resume-test", {"a": 1})
    assert other.step("one", make(5)).count() == 5 and other.step("two", make(4)).count() == 4 and other.skipped == 0
    changed = Run(spark, "resume-test", {"a": 2})
    changed.step("one", make(5))
    assert changed.skipped == 0
    changed.clear()


def test_resume_sees_changed_files(spark, tmp_path):
    path = str(tmp_path / "in")
    for n, skipped in ((3, 0), (3, 1), (7, 0)):
        if not skipped:
            spark.range(n).write.mode("overwrite").parquet(path)
        run = Run(spark, "resume-files")
        assert run.step("rows", lambda: spark.read.parquet(path).where("id >= 0")).count() == n and run.skipped == skipped
    run.clear()


def test_retries_and_workers(spark, tmp_path):
    flag = tmp_path / "flag"
    tasks = spark.createDataFrame([(0, f"test -e {flag} || {{ touch {flag}; false; }}"), (1, "true"), (2, "false")], "key long, value string")
    out = external.run_commands(tasks, slots=1, shell=True, retries=2).collect()
    assert {r["task"]: (r["code"], r["tries"]) for r in out} == {0: (0, 2), 1: (0, 1), 2: (1, 3)}
    report = external.worker_report(external.run_commands(tasks, slots=1, shell=True)).collect()
    assert [(r["worker"], r["jobs"], r["failed"], r["tries"]) for r in report] == [(0, 3, 1, 3)] and report[0]["seconds"] > 0


def test_pipes_stream(spark):
    """Far more lines than a pipe holds go through; a program that stops reading, and one that fails, end as they should."""
    lines = spark.range(0, 200_000, 1, 2).select(F.concat(F.lit("line "), "id").alias("value"))
    assert external.pipe_map(lines, "cat").count() == 200_000
    assert external.pipe_map(lines, "head -n 1").count() == 2
    with pytest.raises(Exception, match="failed with 3"):
        external.pipe_map(lines, "sh -c 'exit 3'").count()


def test_lane_history(spark):
    history = History([], {})
    run_lanes(spark, "2.2", [Item(x, lambda: None) for x in ("0.0", "0", "1.1", "0.0")], history)
    assert sorted(history.order) == [0, 1, 2, 3] and history.by_lane() == {"0.0": [0, 1, 3], "0.1": [1], "1.1": [2]}
    assert lane_names("2.2") == ["0.0", "0.1", "1.0", "1.1"]


def test_many_options(spark):
    with pytest.raises(ValueError):
        options_of(spark.range(10_001).selectExpr("string(id) key", "string(id) value"))


def test_trace(spark):
    t = Trace()
    with t.timed("ids"):
        t.watch(spark.range(10), "ids", most=F.max("id")).collect()
    assert [(x["step"], x["rows"], x["most"], x["seconds"] > 0) for x in t.report()] == [("ids", 10, 9, True)]


def test_context(spark):
    with Context(spark, 4, Shuffle_Partitions="3", adaptive="true") as c:
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert options_of(c.as_pairs()) == {"shuffle_partitions": "3", "adaptive": "True"}
        for k, v in (("nothing", 1), ("adaptive", "perhaps"), ("split_bytes", "x")):
            with pytest.raises(ValueError):
                c.set_option(k, v)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_properties():
    lines = ["# c\n", "! c\n", "a=1\n", "b : 2\n", "c 3\n", "d\\ e = x\\\n", "   y\n", "u=\\u0041\\t\n", "empty=\n", "=v\n", "k\\=x=z\n"]
    assert parse_properties(lines) == {"a": "1", "b": "2", "c": "3", "d e": "xy", "u": "A\t", "k=x": "z"}


def test_scalars(spark):
    df = spark.createDataFrame([("1995-01-31", "ab-cd 12 don't", [1.0, 2.0], " a b c "), ("1995-13-01", "x" * 30, [0.0, 0.0], ""), (None, None, None, None)], "d string, t string, v array<double>, s string")
    got = df.select(
        scalars.format_date(scalars.year_start(scalars.decode_date(F.col("d")))).alias("y"),
        scalars.words_of_letters(F.col("t")).alias("w"),
        scalars.words_between_marks(F.col("t")).alias("m"),
        scalars.squared_distance(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("q"),
        scalars.without_blanks(F.col("s"), 3).alias("s"),
        scalars.argv(F.col("s")).alias("a"),
    ).collect()
    assert got[0]["y"] == "1995-01-01" and got[1]["y"] is None and got[2]["y"] is None
    assert got[0]["w"] == ["ab", "cd", "don", "t"] and [len(x) for x in got[1]["w"]] == [24, 6] and got[2]["w"] is None
    assert got[0]["m"] == ["ab", "cd", "don't"]
    assert got[0]["q"] == 4.0 and got[0]["s"] == "ab c " and got[0]["a"] == ["a", "b", "c"]
    assert scalars.fill_template("$1-$10-$2", list("ab")) == "a-$10-b"
    with pytest.raises(ValueError):
        scalars.parse_int("1 ")
    assert scalars.parse_boolean("TRUE")
    assert df.select(scalars.decode_date(F.col("d"))).first()[0] == datetime.date(1995, 1, 31)
