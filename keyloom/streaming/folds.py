"""Ordered folds of a command log whose steps depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(log: DataFrame) -> DataFrame:
    """SET, INCRBY and DEL in seq order: each reset starts a run, and a run's increments are summed.

    Runs are numbered by a window, so no step waits for the one before.
    """
    order = Window.partitionBy("key").orderBy("seq")
    runs = log.withColumn("run", F.sum(F.col("op").isin("set", "del").cast("int")).over(order))
    last = runs.groupBy("key").agg(F.max("run").alias("run"))
    kept = runs.join(last, ["key", "run"])
    start = F.max(F.when(F.col("op") == "del", 1).otherwise(0)).alias("gone")
    total = F.sum(F.when(F.col("op") == "del", 0).otherwise(F.col("value"))).alias("value")
    return kept.groupBy("key").agg(total, start, F.count("*").alias("steps")).where("gone = 0 or steps > 1").select("key", "value")


def state_as_of(log: DataFrame, seq: int) -> DataFrame:
    return counters(log.where(F.col("seq") <= seq))


def contiguous(batches: DataFrame) -> DataFrame:
    """Batches (first_seq, last_seq) that don't begin right behind the one before."""
    order = Window.partitionBy("ns").orderBy("first_seq")
    before = F.lag("last_seq").over(order)
    return batches.withColumn("expected", before + 1).where(F.col("expected") != F.col("first_seq"))


def apply_batch(held: DataFrame, cursor: int, batch: DataFrame) -> DataFrame:
    """Rows already applied are skipped; a gap is an error found by `contiguous`. Null values delete."""
    fresh = batch.where(F.col("seq") > cursor).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return held.join(fresh.select("key"), "key", "left_anti").unionByName(fresh.where("value is not null"))


def cache_simulation(log: DataFrame, budget: int, ttl_ms: int) -> DataFrame:
    """Hits and misses of a cache that evicts its oldest entries first, for each proxy: an ordered fold."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        used = hits = misses = 0
        for r in pdf.sort_values("seq").itertuples():
            old = held.get(r.key)
            if r.op != "get":
                if old is not None:
                    used -= old[0]
                    del held[r.key]
                continue
            if old is not None and r.ts_ms < old[1]:
                hits += 1
                continue
            misses += 1
            if old is not None:
                used -= old[0]
                del held[r.key]
            if r.size <= budget:
                held[r.key] = (r.size, r.ts_ms + ttl_ms)
                used += r.size
                while used > budget:
                    first = next(iter(held))
                    used -= held.pop(first)[0]
        return pd.DataFrame({"proxy": [pdf["proxy"].iloc[0]], "hits": [hits], "misses": [misses], "used": [used]})

    return log.groupBy("proxy").applyInPandas(fold, "proxy long, hits long, misses long, used long")
