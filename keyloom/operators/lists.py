"""Lists: (key, idx, value), idx from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(l: DataFrame) -> DataFrame:  # noqa: E741
    return l.groupBy("key").agg(F.count("*").alias("n"))


def _with_size(l: DataFrame) -> DataFrame:  # noqa: E741
    return l.withColumn("n", F.count("*").over(Window.partitionBy("key")))


def _at(i: int) -> Column:
    return F.lit(i) if i >= 0 else F.greatest(F.col("n") + i, F.lit(0))


def between(l: DataFrame, start: int, stop: int) -> DataFrame:  # noqa: E741
    """Inclusive, negatives from the end, clamped."""
    if start >= 0 and stop >= 0:
        return l.where((F.col("idx") >= start) & (F.col("idx") <= stop))
    end = F.lit(stop) if stop >= 0 else F.col("n") + stop
    return _with_size(l).where((F.col("idx") >= _at(start)) & (F.col("idx") <= end)).drop("n")


def renumber(l: DataFrame, order: str = "idx") -> DataFrame:  # noqa: E741
    nth = F.row_number().over(Window.partitionBy("key").orderBy(order)).cast("long") - 1
    return l.withColumn("idx", nth)


def trim(l: DataFrame, start: int, stop: int) -> DataFrame:  # noqa: E741
    return renumber(between(l, start, stop))


def index(l: DataFrame, i: int) -> DataFrame:  # noqa: E741
    if i >= 0:
        return l.where(F.col("idx") == i)
    return _with_size(l).where(F.col("idx") == F.col("n") + i).drop("n")


def pop(l: DataFrame, right: bool = False) -> DataFrame:  # noqa: E741
    return index(l, -1 if right else 0)


def push(log: DataFrame, left: bool) -> DataFrame:
    """(key, seq, value) pushed one after another onto an empty list."""
    order = F.desc("seq") if left else F.asc("seq")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(order)).cast("long") - 1
    return log.select("key", nth.alias("idx"), "value")


def set_at(l: DataFrame, i: int, value: Column) -> DataFrame:  # noqa: E741
    return _with_size(l).withColumn("value", F.when(F.col("idx") == (F.lit(i) if i >= 0 else F.col("n") + i), value).otherwise(F.col("value"))).drop("n")


def positions(l: DataFrame, match: Column, rank: int = 1, count: int = 1, max_compared: int = 0) -> DataFrame:  # noqa: E741
    """Places of matches: rank skips |rank| - 1 of them (from the tail if negative), count 0 is all, max_compared bounds comparisons."""
    if rank == 0:
        raise ValueError("rank can't be 0")
    seen = F.col("idx") if rank > 0 else F.col("n") - 1 - F.col("idx")
    found = _with_size(l).where((seen < max_compared) if max_compared else F.lit(True)).where(match)
    order = F.asc("idx") if rank > 0 else F.desc("idx")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(order))
    out = found.withColumn("nth", nth - abs(rank) + 1).where("nth >= 1")
    return (out if count == 0 else out.where(F.col("nth") <= count)).select("key", "nth", "idx")


def remove(l: DataFrame, count: int, match: Column) -> DataFrame:  # noqa: E741
    """Without the first (count > 0), last (count < 0) or all (0) matches."""
    if count == 0:
        return renumber(l.where(~match))
    order = F.asc("idx") if count > 0 else F.desc("idx")
    flagged = l.withColumn("hit", match)
    nth = F.row_number().over(Window.partitionBy("key", "hit").orderBy(order))
    return renumber(flagged.withColumn("nth", nth).where(~(F.col("hit") & (F.col("nth") <= abs(count)))).drop("hit", "nth"))


def insert(l: DataFrame, pivot: Column, value: Column, after: bool) -> DataFrame:  # noqa: E741
    """Beside the first pivot from the head; a key without one is left as it is."""
    first = l.where(pivot).groupBy("key").agg(F.min("idx").alias("idx"))
    half = F.lit(0.5 if after else -0.5)
    new = first.select("key", (F.col("idx") + half).alias("idx"), value.alias("value"))
    return renumber(l.withColumn("idx", F.col("idx").cast("double")).unionByName(new))
