"""Writes with conditions, as folds of a command log (key, seq, op, ...) without a sequential pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional(log: DataFrame) -> DataFrame:
    """Final value of each live key. op is SET, NX (only if absent), XX (only if present) or DEL.

    What counts is behind a key's last DEL: the first SET or NX makes the key, later NX and earlier XX do nothing."""
    by_key = Window.partitionBy("key")
    cut = F.coalesce(F.max(F.when(F.col("op") == "DEL", F.col("seq"))).over(by_key), F.lit(-1))
    rest = log.withColumn("cut", cut).where(F.col("seq") > F.col("cut"))
    made = rest.withColumn("made", F.min(F.when(F.col("op").isin("SET", "NX"), F.col("seq"))).over(by_key))
    effective = (F.col("op") == "SET") | (F.col("seq") == F.col("made")) | ((F.col("op") == "XX") & (F.col("seq") > F.col("made")))
    return made.where(effective).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def expiry_after(log: DataFrame, ttl_ms: int) -> DataFrame:
    """expire_ms of each key after its last SET or expiry command. op: SET clears, KEEPTTL keeps, EXPIRE counts from ts_ms, PERSIST clears."""
    decisive = log.where(F.col("op") != "KEEPTTL")
    at = F.when(F.col("op") == "EXPIRE", F.col("ts_ms") + ttl_ms).otherwise(F.lit(0).cast("long"))
    last = decisive.groupBy("key").agg(F.max_by(at, "seq").alias("expire_ms"))
    return log.select("key").distinct().join(last, "key", "left").select("key", F.coalesce("expire_ms", F.lit(0).cast("long")).alias("expire_ms"))


def take(held: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a read-and-delete gives for each distinct probe (null: absent), and the keys that stay."""
    asked = probes.select("key").distinct()
    return asked.join(held, "key", "left"), held.join(asked, "key", "left_anti")


def fenced(log: DataFrame, by: str, epoch: str = "epoch") -> DataFrame:
    """log with accepted: a write is refused once a larger epoch has written before it."""
    before = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("accepted", F.col(epoch) >= F.coalesce(F.max(epoch).over(before), F.col(epoch)))


def one_slot(requests: DataFrame, slot: Column) -> DataFrame:
    """request, n, crossslot: whether a request's keys lie in several slots, which is refused."""
    return requests.groupBy("request").agg(F.count("*").alias("n"), (F.min(slot) != F.max(slot)).alias("crossslot"))


def migrate(rows: DataFrame, slot: Column, chosen: Column, src: str, dst: str) -> DataFrame:
    """rows (holder, key, ...) after the chosen slots went from src to dst: copied, then deleted. Doing it again changes nothing."""
    goes = (F.col("holder") == src) & chosen
    copied = rows.where(goes).withColumn("holder", F.lit(dst))
    there = rows.where(F.col("holder") == dst).select("holder", "key")
    return rows.where(~goes).unionByName(copied.join(there, ["holder", "key"], "left_anti"))


def over_quota(used: DataFrame, quota: DataFrame) -> DataFrame:
    """ns, bytes, quota, over: a namespace over its quota sheds commands that grow it; 0 or no quota is without bound."""
    limit = F.coalesce("quota", F.lit(0).cast("long"))
    return used.join(quota, "ns", "left").select("ns", "bytes", limit.alias("quota"), ((limit > 0) & (F.col("bytes") > limit)).alias("over"))
