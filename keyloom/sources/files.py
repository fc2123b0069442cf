"""Journals, command logs, snapshots and backup manifests as DataFrames over any Hadoop path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "at_ms long, actor string, kind string, subject string, epoch long, cause string, detail string"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with their order in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.select("file", "line", F.from_json("value", EVENT).alias("e")).select("file", "line", "e.*")


def journal_tail(events: DataFrame, n: int, kinds: list[str] | None = None) -> DataFrame:
    """The last n events of the kinds, oldest first: the kinds are chosen before the n are counted."""
    if kinds is not None and not kinds:
        raise ValueError("no kinds are named")
    chosen = events if kinds is None else events.where(F.col("kind").isin(kinds))
    return chosen.orderBy(F.desc("file"), F.desc("line")).limit(n).orderBy("file", "line")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def snapshot(df: DataFrame, root: str) -> str:
    """A consistent copy under a new id; the pointer file is written last."""
    spark = df.sparkSession
    ident = uuid.uuid4().hex
    df.write.parquet(f"{root}/{ident}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/.LATEST-{ident}"), jvm.org.apache.hadoop.fs.Path(f"{root}/LATEST")
    fs = pointer.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(bytearray(ident.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(fresh, pointer)
    return ident


def latest(spark: SparkSession, root: str) -> DataFrame:
    ident = spark.read.text(f"{root}/LATEST").first()["value"]
    return spark.read.parquet(f"{root}/{ident}")


def restore_namespace(backup: DataFrame, ns: str) -> DataFrame:
    return backup.where(F.col("ns") == ns)


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """key, bytes, sha256 of every object under a root; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """key, fault: missing, checksum or unlisted. Nothing comes out of a sound set."""
    m = manifest.withColumnsRenamed({"bytes": "m_bytes", "sha256": "m_sha256"})
    both = m.join(objects, "key", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "unlisted").when((F.col("sha256") != F.col("m_sha256")) | (F.col("bytes") != F.col("m_bytes")), "checksum")
    return both.select("key", fault.alias("fault")).where("fault is not null")


def metrics(info: DataFrame) -> DataFrame:
    """Bodies of `key:value` lines (instance, body) as tall gauges (metric, instance, value)."""
    line = info.select("instance", F.explode(F.split("body", "\r?\n")).alias("line"))
    pair = line.select("instance", F.substring_index("line", ":", 1).alias("metric"), F.substring_index("line", ":", -1).try_cast("double").alias("value"))
    return pair.where("value is not null").select("metric", "instance", "value")


def generate(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """n sequential keys with values of `size` bytes that don't compress, the same for a seed."""
    words = -(-size // 32)
    value = F.concat(*[F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(i)), 256)) for i in range(words)])
    return spark.range(n).select(F.format_string("key:%012d", F.col("id")).alias("key"), F.substr(value, F.lit(1), F.lit(size)).alias("value"))
