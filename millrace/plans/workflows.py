"""Queries over what surrounds the plans: options, sources and sinks, lookups, farms, lanes, job tables, restart, tracing.

Files that a query needs are written to the folder that all tasks share, from the tables or as small fixtures.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.context import Context, options_of, parse_properties
from millrace.functions import scalars
from millrace.operators import external, positions, tuples
from millrace.operators.lanes import History, Item, run_lanes
from millrace.operators.pairs import Builder, Pairs
from millrace.operators.resume import Run
from millrace.operators.trace import Trace
from millrace.plans.tables import table
from millrace.sources import files, sinks
from millrace.storage import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _pairs(spark: SparkSession, sf: str, name: str, key: str, value: str) -> Pairs:
    return Pairs.of(table(spark, sf, name), key, value)


def _put(spark: SparkSession, path: str, text: str) -> str:
    """A small file of its own, written from here."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def _plain(path: str) -> str:
    """As programs on the executors see a shared folder."""
    return re.sub("^file:/*", "/", path)


def _regions(spark: SparkSession, sf: str) -> list[tuple[int, str]]:
    return sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, sf, "region").collect())  # five rows


# options


@_query("SELECT 'region.' || r_regionkey AS key, r_name AS value FROM region")
def ctx_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A property file's lines as options, as pairs, and back."""
    lines = ["# regions\n", "empty=\n"] + [f"region.{k} {sep} {name}\n" for (k, name), sep in zip(_regions(spark, sf), ["=", ":", " ", "=", ":"])]
    pairs = Pairs.create(spark, parse_properties(lines).items())
    return Pairs.create(spark, options_of(pairs.df).items()).df


@_query("SELECT * FROM (VALUES ('on_error', 'warn', 4), ('trace', 'True', 4), ('split_bytes', '1048576', 4)) t(key, value, ranks)")
def ctx_options(spark: SparkSession, sf: str) -> DataFrame:
    with Context(spark, 4, on_error="warn") as c:
        c.load({"TRACE": "1", "split_bytes": "1048576"})
        return c.as_pairs().withColumn("ranks", F.lit(c.ranks))


# construction


@_query("SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS value FROM region")
def kv_build(spark: SparkSession, sf: str) -> DataFrame:
    b = Builder(spark, "long", "string")
    for k, name in _regions(spark, sf):
        b.add(k, name)
    return b.done().df


@_query("SELECT o_orderkey AS key, o_totalprice AS value, 'bigint' AS key_type, 'double' AS value_type FROM orders")
def kv_save_restore(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "pairs")
    _pairs(spark, sf, "orders", "o_orderkey", "o_totalprice").save(path)
    back = Pairs.restore(spark, path)
    key, value = back.field_types()
    return back.df.withColumn("key_type", F.lit(key.simpleString())).withColumn("value_type", F.lit(value.simpleString()))


@_query("SELECT i AS key, i * i AS value FROM range(10) t(i)")
def kv_generate_once(spark: SparkSession, sf: str) -> DataFrame:
    return Pairs.generate(spark, lambda rank: [(i, i * i) for i in range(10)], 4, "long", "long", once=True).df


@_query("SELECT r AS key, r * 100 + i AS value FROM range(4) a(r), range(3) b(i)")
def kv_generate_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return Pairs.generate(spark, lambda rank: [(rank, rank * 100 + i) for i in range(3)], 4, "long", "long").df


# looking at pairs


@_query("SELECT CAST(r_regionkey AS BIGINT) AS key, CAST(r_regionkey AS BIGINT) AS value FROM region")
def kv_map_rank_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair with how many came before it, when ranks take turns."""
    seen = [0]

    def number(k: int, v: str) -> list[tuple[int, int]]:
        seen[0] += 1
        return [(k, seen[0] - 1)]

    placed = Pairs.of(table(spark, sf, "region"), F.col("r_regionkey").cast("long"), "r_name").shuffle(5, key_as_rank=True)
    return placed.map_rank_by_rank(number, "long", "long").df


@_query("SELECT r_regionkey || ': ' || r_name AS line FROM region")
def kv_dump(spark: SparkSession, sf: str) -> DataFrame:
    text = _pairs(spark, sf, "region", "r_regionkey", "r_name").dump(100)
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@_query("SELECT 5 AS taken, 'REGION' AS one, 'x.y' AS shown, 1 AS missing, 1 AS twice")
def kv_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """take, the only pair, the value of a key, and what happens without one or with two."""
    p = _pairs(spark, sf, "region", "r_regionkey", "r_name")
    name = p.where("key = 3").one()[1]
    assert p.find(3) == name
    missing = twice = 0
    try:
        p.find(77)
    except KeyError:
        missing = 1
    try:
        p.select(key=F.lit(1)).find(1)
    except ValueError:
        twice = 1
    shown = scalars.printable(F.encode(F.lit("x\ty"), "UTF-8"))
    row = spark.createDataFrame([(len(p.take(10)), missing, twice)], "taken int, missing int, twice int")
    return row.select("taken", F.lit("REGION" if name else "").alias("one"), shown.alias("shown"), "missing", "twice")


@_query("SELECT count(*) AS n, count(*) AS local FROM orders")
def kv_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf, "orders", "o_custkey", "o_orderkey")
    return p.local_counts().agg(F.lit(p.count()).cast("long").alias("n"), F.sum("n").alias("local"))


@_query("SELECT EXISTS (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 12) AS found, TRUE AS holds")
def kv_reduce_some(spark: SparkSession, sf: str) -> DataFrame:
    """At most one group that passes a test."""
    some = _pairs(spark, sf, "orders", "o_custkey", "o_orderkey").reduce_some(F.count(F.lit(1)), "value > 12")
    return some.df.agg((F.count(F.lit(1)) == 1).alias("found"), F.coalesce(F.bool_and(F.col("value") > 12), F.lit(True)).alias("holds"))


@_query("SELECT CAST(o_orderkey % 6 AS INTEGER) AS rank, CAST(sum(o_custkey) AS BIGINT) AS value FROM orders WHERE o_orderkey % 6 <> 4 GROUP BY 1")
def kv_reduce_per_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf, "orders", "o_orderkey", "o_custkey").where("key % 6 != 4")
    return p.reduce_ranks(F.sum("value"), (F.col("key") % 6).cast("int"))


@_query("SELECT o_custkey AS key, 100 // (o_orderkey % 5) AS value FROM orders WHERE o_orderkey % 5 <> 0")
def kv_map_warn(spark: SparkSession, sf: str) -> DataFrame:
    """A function that fails on some pairs, which are left out."""
    return _pairs(spark, sf, "orders", "o_custkey", "o_orderkey").map(lambda k, v: [(k, 100 // (v % 5))], "long", "long", on_error="warn", inspect=True).df


@_query("SELECT o_orderkey AS key, o_custkey AS value FROM orders ORDER BY 1 DESC LIMIT 50")
def kv_sort(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "orders", "o_orderkey", "o_custkey").sort(descending=True).df.limit(50)


@_query("SELECT n_name AS key, n_nationkey AS value, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation")
def kv_sort_small(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "nation", "n_name", "n_nationkey").sort_small().df.withColumn("pos", F.monotonically_increasing_id())


@_query("SELECT count(*) AS n, 0 AS steps_down FROM orders")
def kv_sort_locally(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, "orders", "o_custkey", "o_orderkey").shuffle(6).sort_locally().df
    rows = rows.select("key", F.spark_partition_id().alias("rank"), F.monotonically_increasing_id().alias("place"))
    before = F.lag("key").over(Window.partitionBy("rank").orderBy("place"))
    return rows.withColumn("down", before > F.col("key")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("down"), 1)).cast("int").alias("steps_down"))


_RANKED = "(SELECT o_orderkey, o_custkey, CAST(o_orderkey % 4 AS INTEGER) AS rank FROM orders)"
_INSIDE = "CAST(coalesce(sum(o_custkey) OVER (PARTITION BY rank ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@_query(f"SELECT o_orderkey, rank, {_INSIDE} AS scan FROM {_RANKED}")
def kv_scan_local(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("rank"))
    return positions.local_sum(rows, "o_custkey", "rank", "o_orderkey")[0].drop("o_custkey")


@_query(f"SELECT o_orderkey, a.rank, scan + CASE a.rank WHEN 1 THEN 1000 ELSE 0 END AS scan, total + CASE a.rank WHEN 1 THEN 1000 ELSE 0 END AS carry FROM (SELECT *, {_INSIDE} AS scan FROM {_RANKED}) a JOIN (SELECT rank, CAST(sum(o_custkey) AS BIGINT) AS total FROM {_RANKED} GROUP BY 1) b ON a.rank = b.rank")
def kv_scan_carry(spark: SparkSession, sf: str) -> DataFrame:
    """With something carried into one rank, and what each rank hands on."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("rank"))
    given = spark.createDataFrame([(1, 1000)], "rank int, carry long")
    out, carry = positions.local_sum(rows, "o_custkey", "rank", "o_orderkey", carry=given)
    return out.join(carry, "rank").drop("o_custkey")


@_query("SELECT CAST(r_regionkey AS INTEGER) AS region, n_name AS nation FROM region, nation")
def tuple_cross(spark: SparkSession, sf: str) -> DataFrame:
    regions = tuples.tagged(table(spark, sf, "region"), ["r_regionkey"], ["r_regionkey"], 0)
    nations = tuples.tagged(table(spark, sf, "nation"), ["n_nationkey"], ["n_name"], 1)
    return tuples.fields(tuples.crossed(regions, nations, [(0, 0), (0, 1)]), "region", "nation")


@_query("SELECT o_orderkey, replace(substr(o_orderpriority, 1, 3), ' ', '') || substr(o_orderpriority, 4) AS priority, '-k ' || o_orderkey || ' -c $3' AS filled, o_orderkey % 2 = 0 AS even FROM orders")
def scalar_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks taken from the head of a text, templates filled, truth values read."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    texts = Pairs.of(orders, "o_orderkey", "o_orderkey").map(lambda k, v: [(k, (scalars.fill_template("-k $1 -c $3", [str(v)]), scalars.parse_boolean("TRUE" if v % 2 == 0 else "0")))], "long", "struct<filled:string,even:boolean>")
    rows = orders.join(texts.df, F.col("o_orderkey") == F.col("key"))
    return rows.select("o_orderkey", scalars.without_blanks(F.col("o_orderpriority"), 3).alias("priority"), "value.filled", "value.even")


# files


def _tree(spark: SparkSession, sf: str) -> str:
    """dat.N of every region in a folder, and in folders inside it; hidden files too."""
    top = scratch(spark, "tree")
    for folder in ("", "dir.0/", "dir.0/dir.0.0/"):
        for k, name in _regions(spark, sf):
            _put(spark, f"{top}/{folder}dat.{k}", name + "\n")
        _put(spark, f"{top}/{folder}.hidden", "x")
    return top


_TREE = "SELECT folder || 'dat.' || r_regionkey AS key FROM region, (VALUES (''), ('dir.0/'), ('dir.0/dir.0.0/')) t(folder)"


@_query(f"SELECT key, CAST(0 AS BIGINT) AS value FROM ({_TREE})")
def file_names_tree(spark: SparkSession, sf: str) -> DataFrame:
    top = _tree(spark, sf)
    return files.file_names(spark, [top], subdirectories=True).withColumn("key", F.substring("key", len(top) + 2, 1000))


@_query("SELECT 'dat.' || r_regionkey AS key FROM region")
def file_names_list(spark: SparkSession, sf: str) -> DataFrame:
    top = _tree(spark, sf)
    names = _put(spark, f"{top}/names", "# the files\n\n" + "".join(f"  {top}/dat.{k} \n" for k, _ in _regions(spark, sf)))
    return files.file_names(spark, [names], list_file=True).select(F.substring("key", len(top) + 2, 1000).alias("key"))


@_query(f"SELECT key, CAST(length(key) AS BIGINT) AS value FROM ({_TREE})")
def file_map_names(spark: SparkSession, sf: str) -> DataFrame:
    """A function of each path, on the executors."""
    top = _tree(spark, sf)
    names = files.file_names(spark, [top], subdirectories=True)
    return files.map_file_names(names, lambda p: [(p[len(top) + 1 :], len(p) - len(top) - 1)], "string", "long", 3)


@_query("SELECT n_name AS value FROM nation")
def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What stands between the separators of a file."""
    names = [r["n_name"] for r in table(spark, sf, "nation").select("n_name").collect()]  # 25 rows
    return files.text_chunks(spark, _put(spark, scratch(spark, "chunks") + "/f", ";;".join(names)), ";;")


def _lines(spark: SparkSession, sf: str, n: int) -> str:
    """Customers' names as n text files."""
    path = scratch(spark, "lines")
    sinks.split_file(table(spark, sf, "customer").select(F.col("c_name").alias("value")), path, n)
    return path


@_query("SELECT c_name || chr(10) AS value FROM customer")
def file_lines_all(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_lines(spark, _lines(spark, sf, 3)).select("value")


@_query("SELECT i AS key, count(*) AS n FROM range(7) t(i), range(3) u(j) GROUP BY 1")
def file_lines_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first lines of each of three files, by their numbers."""
    return files.file_lines(spark, _lines(spark, sf, 3), limit=7).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT CAST(r_regionkey % 2 AS BIGINT) AS color, string_agg(substr(r_name, 2, 3) || '/' || substr(r_name, 5), '' ORDER BY r_regionkey) AS content FROM region GROUP BY 1")
def file_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of files, joined in order for each color."""
    top, rows = scratch(spark, "segments"), []
    for k, name in _regions(spark, sf):
        path = _put(spark, f"{top}/f{k}", name + "/")
        rows += [(k % 2, 10 * k, path, 1, 3), (k % 2, 10 * k + 1, path, len(name), 1), (k % 2, 10 * k + 2, path, 4, len(name) - 4)]
    out = files.reassembled(spark, spark.createDataFrame(rows, "color long, rank long, path string, offset long, bytes long"))
    return out.select("color", F.decode("content", "UTF-8").alias("content"))


@_query("SELECT p_partkey, p_name, p_size, round(p_retailprice, 2) AS p_retailprice, strftime(DATE '1995-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') AS day FROM part WHERE p_size > 10")
def file_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of |-terminated fields, typed by a schema."""
    path = scratch(spark, "delimited")
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size"))
    fields = [F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.format_string("%.2f", "p_retailprice"), scalars.format_date(day)]
    table(spark, sf, "part").select(F.concat(F.concat_ws("|", *[f.cast("string") for f in fields]), F.lit("|"))).write.text(path)
    return files.delimited(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double, day date").where("p_size > 10").withColumn("day", scalars.format_date(F.col("day")))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS \"from\", CAST(n_regionkey AS BIGINT) AS \"to\" FROM nation")
def file_edges(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "edges")
    rows = table(spark, sf, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("value"))
    rows.unionByName(spark.createDataFrame([("# from to",), ("not an edge",)], "value string")).write.text(path)
    return files.edges(spark, path)


_RECORD = "SELECT upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 10)) AS key, rpad(p_partkey || ' ' || p_name, 89, ' ') AS payload FROM part"


@_query(f"SELECT key, md5(payload || chr(10)) AS payload_md5, row_number() OVER (ORDER BY key, payload) - 1 AS pos FROM ({_RECORD})")
def sort_records(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 100-byte records, read in splits, sorted by the bytes of their keys."""
    path = scratch(spark, "records")
    key = F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 10))
    sinks.write_text_records(table(spark, sf, "part").select(key.alias("key"), F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("value")), path)
    rows = positions.with_positions(files.records(spark, f"{path}/part-*"), "key", "value")
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.md5("value").alias("payload_md5"), "pos")


@_query("SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT ntile, count(*) AS n FROM (SELECT ntile(5) OVER (ORDER BY c_custkey) AS ntile FROM customer) GROUP BY 1)")
def file_split(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.text(_lines(spark, sf, 5)).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return lines.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))


@_query("SELECT hex(encode(r_name)) || hex(encode('/' || r_regionkey)) AS value FROM region")
def sink_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "hex")
    key, value = F.encode("r_name", "UTF-8"), F.encode(F.concat(F.lit("/"), F.col("r_regionkey").cast("string")), "UTF-8")
    sinks.write_records(table(spark, sf, "region").select(key.alias("key"), value.alias("value")), path)
    return spark.read.text(path)


@_query("SELECT o_custkey || ' ' || o_orderkey AS value FROM orders")
def sink_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "out")
    sinks.write_lines(_pairs(spark, sf, "orders", "o_custkey", "o_orderkey").df, path)
    return spark.read.text(path)


@_query("SELECT CAST(n_regionkey AS INTEGER) AS key, n_regionkey || ' ' || n_name AS value FROM nation")
def sink_key_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "keys")
    sinks.write_key_files(_pairs(spark, sf, "nation", "n_regionkey", "n_name").df, path)
    return spark.read.text(path).select(F.col("_key").cast("int").alias("key"), "value")


@_query("SELECT c_custkey, c_name FROM customer ORDER BY 1 LIMIT 40")
def sink_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Part files in order: the first rows in the order of the file names."""
    path = scratch(spark, "sorted")
    sinks.write_sorted(table(spark, sf, "customer").select("c_custkey", "c_name"), path, "c_custkey")
    rows = spark.read.parquet(path).select("c_custkey", "c_name", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    return rows.orderBy("f", "i").limit(40).select("c_custkey", "c_name")


# farms and programs


@_query("SELECT o_orderkey AS key, o_custkey * o_custkey AS value FROM orders WHERE o_orderkey % 3 = 1")
def farm_map(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _pairs(spark, sf, "orders", "o_orderkey", "o_custkey").where("key % 3 = 1")
    return external.farm(tasks.df, lambda k, v: [(k, v * v)], "long", "long", 4)


@_query("SELECT CAST(n_nationkey AS BIGINT) AS task, CASE WHEN n_nationkey % 5 = 2 THEN 1 ELSE 0 END AS code, CASE WHEN n_nationkey % 5 = 2 THEN '' ELSE 'a b' || n_nationkey END AS stdout, CASE WHEN n_nationkey % 5 = 2 THEN 2 ELSE 1 END AS tries FROM nation")
def farm_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments between NUL characters; commands that fail are tried again and tell their code."""
    good = F.concat(F.lit("printf\0a b"), F.col("n_nationkey").cast("string"))
    tasks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 5 == 2, "false").otherwise(good).alias("value"))
    return external.run_commands(tasks, slots=4, retries=1).select("task", "code", "stdout", "tries")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS task, 0 AS code, CAST(length(r_name) AS VARCHAR) AS stdout FROM region")
def farm_processes(spark: SparkSession, sf: str) -> DataFrame:
    """A shell process for each pair."""
    tasks = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.concat(F.lit("printf '"), "r_name", F.lit("' | wc -c | tr -d ' \\n'")).alias("value"))
    return external.run_commands(tasks, slots=2, shell=True).select("task", "code", "stdout")


@_query("SELECT lower(n_name) || ' ' || n_regionkey AS value FROM nation")
def shell_map_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through a mapper program, keys together, through a reducer program."""
    lines = table(spark, sf, "nation").select(F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    return external.map_reduce(lines, "tr A-Z a-z", "cat", ranks=3)


@_query("SELECT 'k' || (r_regionkey % 2) AS key, string_agg('k' || (r_regionkey % 2) || ' ' || r_name, ';' ORDER BY r_name) || ';' AS value FROM region GROUP BY 1")
def shell_file_flow(spark: SparkSession, sf: str) -> DataFrame:
    """A mapper for each file, a program that prints pairs, a reducer that gets a file for each key."""
    top, names = scratch(spark, "flow"), []
    for k, name in _regions(spark, sf):
        names.append(_plain(_put(spark, f"{top}/f{k}", f"k{k % 2} {name}\n")))
    out = external.file_flow(spark, names, "cat", pairs_of="cat", reducer="sed -z s/\\\\n/;/g")
    return out.select("key", F.col("stdout").alias("value"))


@_query("SELECT CAST(n_regionkey AS VARCHAR) AS key, 0 AS code, CAST(count(*) AS VARCHAR) AS lines FROM nation GROUP BY 1")
def shell_key_files(spark: SparkSession, sf: str) -> DataFrame:
    out = external.reduce_key_files(_pairs(spark, sf, "nation", "n_regionkey", "n_name").df, "wc -l")
    return out.select("key", "code", F.regexp_extract(F.trim("stdout"), r"^(\d+)", 1).alias("lines"))


# job tables


def _jobs(spark: SparkSession, sf: str) -> external.JobTable:
    rows = [f"{k}\t{name}\n" for k, name in _regions(spark, sf)]
    return external.parse_job_table(["% regions\n", "TITLE=Regions\n", "PARAM=-n $1 $2 $9\n", *rows])


@_query("SELECT CAST(r_regionkey AS BIGINT) AS task, 'echo -n ' || r_regionkey || ' ' || r_name || ' $9' AS command, r_regionkey || ' ' || r_name || ' $9' AS stdout FROM region")
def jobs_run(spark: SparkSession, sf: str) -> DataFrame:
    return external.run_jobs(spark, _jobs(spark, sf), "echo", slots=3).select("task", "command", "stdout")


@_query("SELECT 0 AS code, count(*) AS jobs, CAST(len(list(r_regionkey)) AS INTEGER) AS tasks FROM region")
def jobs_report(spark: SparkSession, sf: str) -> DataFrame:
    report = external.job_report(external.run_jobs(spark, _jobs(spark, sf), "echo", slots=3))
    return report.select("code", "jobs", F.size("tasks").alias("tasks"))


@_query("SELECT 0 AS worker, count(*) AS jobs, count(*) AS failed, count(*) * 3 AS tries, TRUE AS timed FROM region")
def jobs_workers(spark: SparkSession, sf: str) -> DataFrame:
    """What the only worker did, if every job fails and is tried three times."""
    done = stored(external.run_jobs(spark, _jobs(spark, sf), "false", slots=1, retries=2), "jobs")
    return external.worker_report(done).select("worker", "jobs", "failed", "tries", (F.col("seconds") > 0).alias("timed"))


# lanes


def _lane_items(spark: SparkSession, sf: str) -> list[Item]:
    orders = table(spark, sf, "orders")
    count = lambda k: lambda: orders.where(F.col("o_orderkey") % 4 == k).count()
    return [Item(lane, count(k)) for k, lane in enumerate(["0.0", "0.1", "0", "1.1"])]


@_query("SELECT CAST(o_orderkey % 4 AS INTEGER) AS item, count(*) AS n FROM orders GROUP BY 1")
def lanes_run(spark: SparkSession, sf: str) -> DataFrame:
    """Spark jobs in nested lanes: the upper lane's waits for those of its sublanes."""
    return spark.createDataFrame(list(enumerate(run_lanes(spark, "2.2", _lane_items(spark, sf)))), "item int, n long")


@_query("SELECT * FROM (VALUES ('0.0', 0, 0), ('0.0', 1, 2), ('0.1', 0, 1), ('0.1', 1, 2), ('1.1', 0, 3)) t(lane, place, item)")
def lanes_history(spark: SparkSession, sf: str) -> DataFrame:
    history = History([], {})
    run_lanes(spark, "2.2", _lane_items(spark, sf), history)
    return spark.createDataFrame([(lane, i, item) for lane, own in history.by_lane().items() for i, item in enumerate(own)], "lane string, place int, item int")


# restart and tracing


@_query("SELECT o_custkey, count(*) AS n, 0 AS skipped_first, 2 AS skipped_again FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def restart_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps, and a second run that finds both."""
    name, skipped = "restart-" + os.path.basename(scratch(spark, "r")), []
    for _ in range(2):
        run = Run(spark, name, {"least": 1000})
        rows = run.step("large", lambda: table(spark, sf, "orders").where("o_totalprice > 1000"))
        out = run.step("count", lambda rows=rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
        skipped.append(run.skipped)
    return out.withColumn("skipped_first", F.lit(skipped[0])).withColumn("skipped_again", F.lit(skipped[1]))


@_query("SELECT count(*) AS n, 1 AS skipped FROM orders WHERE o_totalprice > 1000")
def restart_selective(spark: SparkSession, sf: str) -> DataFrame:
    """Only the step that is to be kept is written, and found again."""
    name = "selective-" + os.path.basename(scratch(spark, "r"))
    for _ in range(2):
        run = Run(spark, name, selective=True)
        rows = run.step("large", lambda: table(spark, sf, "orders").where("o_totalprice > 1000"), keep=False)
        out = run.step("count", lambda rows=rows: rows.agg(F.count(F.lit(1)).alias("n")))
    return out.withColumn("skipped", F.lit(run.skipped))


@_query("SELECT 'orders' AS step, count(*) AS rows, max(o_orderkey) AS most, TRUE AS timed FROM orders")
def trace_steps(spark: SparkSession, sf: str) -> DataFrame:
    t = Trace()
    with t.timed("orders"):
        t.watch(table(spark, sf, "orders"), "orders", most=F.max("o_orderkey")).groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(x["step"], x["rows"], x["most"], x["seconds"] > 0) for x in t.report()], "step string, rows long, most long, timed boolean")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
