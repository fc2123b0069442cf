"""Tables in the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder below the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_keyloom").rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer referenced."""
    for _ in range(2):  # the first round lets Python's handles go, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing lazy reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.startswith(shared_dir(spark)) and shared_dir(spark).split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} isn't a table of the shared folder")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: Column, name: str) -> DataFrame:
    """df with a long column that tells rows with equal keys apart: 0 if no key is repeated, or else a number for each row of a stored copy."""
    if df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def fresh(columns: list[str], prefix: str) -> str:
    """A prefix that no column begins with, so added columns can't clash."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix
