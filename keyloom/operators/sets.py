"""Sets: (key, member) without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one(s: DataFrame, key: str) -> DataFrame:
    return s.where(F.col("key") == key).select("member")


def inter(s: DataFrame, keys: list[str]) -> DataFrame:
    """One aggregation instead of a chain of joins: members seen under every distinct key."""
    wanted = sorted(set(keys))
    return s.where(F.col("key").isin(wanted)).groupBy("member").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(wanted)).select("member")


def union(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.where(F.col("key").isin(keys)).select("member").distinct()


def diff(s: DataFrame, first: str, others: list[str]) -> DataFrame:
    return one(s, first).join(s.where(F.col("key").isin(others)).select("member"), "member", "left_anti")


def store(s: DataFrame, dst: str, members: DataFrame) -> DataFrame:
    """Sources are read before dst is replaced; an empty result leaves no dst."""
    return s.where(F.col("key") != dst).unionByName(members.select(F.lit(dst).alias("key"), "member"))


def add(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.unionByName(new).distinct()


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.distinct(), ["key", "member"], "left_anti")


def is_member(s: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (pos, key, member) with found 0/1; repeated probes stay."""
    return probes.join(s.withColumn("found", F.lit(1)), ["key", "member"], "left").select("pos", "key", "member", F.coalesce("found", F.lit(0)).alias("found"))


def sample(s: DataFrame, n: int, seed: str) -> DataFrame:
    """n distinct members of each key by hash order: repeatable, and the group limit runs before the shuffle."""
    mixed = F.md5(F.concat(F.lit(seed), F.col("member").cast("string")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(mixed, "member"))
    return s.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def sample_with_repeats(s: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n picks of each key, with repetition, by ranks drawn from a hash."""
    order = Window.partitionBy("key").orderBy("member")
    numbered = s.withColumn("i", F.row_number().over(order) - 1)
    sizes = s.groupBy("key").agg(F.count("*").alias("size"))
    picks = sizes.select("key", "size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pick"))
    picks = picks.select("key", "pick", F.pmod(F.xxhash64("key", "pick", F.lit(seed)), F.col("size")).cast("int").alias("i"))
    return picks.join(numbered, ["key", "i"]).select("key", "pick", "member")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
