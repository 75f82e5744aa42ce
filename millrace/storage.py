"""Tables in the folder that all machines share: how plans cut lineage and keep intermediate results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder under the warehouse, if all tasks reach that."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        alone = spark.sparkContext.master.split("[")[0] == "local"
        if not alone and (home.startswith("file:") or "://" not in home):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = home + "/_scratch"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write df into the shared folder, dealt into buckets by the keys and sorted: joins on them do not move it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "millrace_" + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by stored() once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
