"""Hashes: (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put(log: DataFrame, first: bool = False) -> DataFrame:
    """Fold of (key, field, value, seq): the last write of a field wins, or the first if only absent fields are set."""
    pick = F.min_by if first else F.max_by
    return log.groupBy("key", "field").agg(pick("value", "seq").alias("value"))


def get_many(h: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, pos, field) in order, null where a field is missing."""
    return probes.join(h, ["key", "field"], "left").select("key", "pos", "field", "value")


def drop(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone.distinct(), ["key", "field"], "left_anti")


def sizes(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("n"))


def increment(log: DataFrame) -> DataFrame:
    """Sum of deltas from 0; overflow of 64 bits is an error."""
    return log.groupBy("key", "field").agg(F.sum(F.col("delta").cast("long")).alias("value"))


def as_map(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
