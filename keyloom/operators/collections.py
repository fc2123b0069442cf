"""Vector collections as relations: a row a collection (set, dim, metric) and a row a vector (set, id, embedding, expire_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "ip")


def create(asked: DataFrame) -> DataFrame:
    """Collections of requests (seq, set, dim, metric): the first request of a name makes it; a bad metric or dimension makes nothing."""
    good = asked.where(F.col("metric").isin(*METRICS) & (F.col("dim") > 0))
    return good.groupBy("set").agg(F.min_by(F.struct("dim", "metric"), "seq").alias("c")).select("set", "c.*")


def upsert(log: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors after a log (seq, set, id, embedding, expire_ms), and the refused rows with a reason.

    A vector of another dimension, or of an unknown collection, is refused; the last accepted write holds, its expiry too."""
    judged = log.join(F.broadcast(collections), "set", "left").withColumn(
        "reason", F.when(F.col("dim").isNull(), "NOSET").when(F.size("embedding") != F.col("dim"), "WRONGDIM")
    )
    held = judged.where("reason is null").groupBy("set", "id").agg(F.max_by(F.struct("embedding", "expire_ms"), "seq").alias("v"))
    return held.select("set", "id", "v.*"), judged.where("reason is not null").select("seq", "set", "id", "reason")


def left_ms(vectors: DataFrame, now: int) -> DataFrame:
    """set, id, ttl in milliseconds: -1 without expiry, -2 when it has passed."""
    left = F.col("expire_ms") - now
    return vectors.select("set", "id", F.when(F.col("expire_ms") == 0, F.lit(-1).cast("long")).when(left <= 0, F.lit(-2).cast("long")).otherwise(left).alias("ttl"))


def swept(vectors: DataFrame, now: int) -> DataFrame:
    """What a sweep of expired vectors leaves."""
    return vectors.where((F.col("expire_ms") == 0) | (F.col("expire_ms") > now))
