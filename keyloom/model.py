"""The keyspace as typed tables, built from the star-schema tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_705_000_000_000  # every query's clock: a literal, never the wall clock
TTL_MS = 10 * 24 * 3600 * 1000
NS = "0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def live(now: int = NOW_MS) -> Column:
    """0 never expires; an instant that equals the clock has passed."""
    return (F.col("expire_ms") == 0) | (F.col("expire_ms") > now)


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit(NS).alias("ns"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.encode("text", "utf-8").alias("value"))


def hash_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    fields = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return fields.unpivot("key", ["name", "nation", "segment"], "field", "value")


def set_members(spark: SparkSession, sf_dir: str, above: float | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e if above is None else e.where(F.col("value") > above)
    return e.select(F.col("event_type").alias("key"), F.col("user_id").alias("member")).distinct()


def zset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("score"))


def list_elems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list for each order, its parts in line order; idx from 0."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return li.select(F.col("l_orderkey").alias("key"), nth.cast("long").alias("idx"), F.col("l_partkey").alias("value"))


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label").alias("meta"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row a user: written at the last event, to expire TTL_MS later; users divisible by 7 never expire."""
    e = table(spark, sf_dir, "events").select("user_id", millis(F.col("ts")).alias("ms"), "value")
    meta = e.groupBy("user_id").agg(F.max("ms").alias("written_ms"), F.min("ms").alias("created_ms"), F.count("*").alias("size"))
    return meta.select(
        F.lit(NS).alias("ns"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.col("user_id"),
        F.when(F.col("user_id") % 3 == 0, "string").when(F.col("user_id") % 3 == 1, "hash").otherwise("set").alias("type"),
        F.when(F.col("user_id") % 7 == 0, F.lit(0).cast("long")).otherwise(F.col("written_ms") + TTL_MS).alias("expire_ms"),
        "written_ms",
        "created_ms",
        "size",
    )


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log: events in total order (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), millis(F.col("ts")).alias("ts_ms"), F.lit(NS).alias("ns"), F.col("event_type").alias("op"), F.col("user_id").alias("key"), "value", "props")
