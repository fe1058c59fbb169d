"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the one named by ``spark.checkpoint.dir``.

    Only where that setting is empty and all tasks run in this process (tests,
    notebooks on one machine) a temporary folder is made, remembered in the
    session and deleted with the process; on a cluster it is an error.
    """
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's own tables inside the shared one."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` wrote in this application; results that still rest on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    It cuts the lineage like ``checkpoint()`` does, but as compressed columns,
    and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files behind tables of ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        inside = f"/tables-{spark.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if inside in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in a number of partitions of its own, for groups that are small to ship and long to work on: such partitions aren't joined by their size."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")
