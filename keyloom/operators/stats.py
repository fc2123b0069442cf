"""Counts, histograms, quotas and ledgers over the command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds of the latency buckets in microseconds
LATENCY_US = (250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)


def histogram(observed: DataFrame, us: Column, bounds: tuple[int, ...] = LATENCY_US) -> DataFrame:
    """Cumulative counts by bound, and count and sum, in one aggregation."""
    return observed.groupBy("ns", "op").agg(*[F.sum((us <= b).cast("long")).alias(f"le_{b}") for b in bounds], F.count("*").alias("n"), F.sum(us).alias("total"))


def hot(log: DataFrame, k: int) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)


def decayed(log: DataFrame, now_ms: int, half_life_ms: int) -> DataFrame:
    """Heat that halves every half life."""
    age = (F.lit(now_ms) - F.col("ts_ms")) / half_life_ms
    return log.groupBy("key").agg(F.sum(F.pow(F.lit(0.5), age)).alias("heat"))


def error_kind(message: Column, kinds: tuple[str, ...]) -> Column:
    first = F.split(message, " ")[0]
    return F.when(first.isin(*kinds), first).otherwise("other")


def previous(log: DataFrame) -> DataFrame:
    """What each write replaced."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def committed(log: DataFrame, error: Column) -> DataFrame:
    """Rows of transactions in which nothing was refused when queued."""
    refused = log.groupBy("txn").agg(F.max(error.cast("int")).alias("refused"))
    return log.join(refused.where("refused = 0").select("txn"), "txn", "left_semi")


def watch_conflicts(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """watches (txn, key, begin, end) with aborted: whether another write to the key came between. Equi-join on the key, range within."""
    met = watches.join(writes.select("key", "seq"), "key").where((F.col("seq") > F.col("begin")) & (F.col("seq") < F.col("end")))
    hit = met.select("txn").distinct().withColumn("aborted", F.lit(True))
    return watches.select("txn").distinct().join(hit, "txn", "left").select("txn", F.coalesce("aborted", F.lit(False)).alias("aborted"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: one union and one sort, no range join."""
    tagged = left.select(by, at, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.struct(*left.columns).alias("row"))
    other = right.select(by, at, F.lit(0).alias("side"), F.col(value).alias("v"), F.lit(None).cast(tagged.schema["row"].dataType).alias("row"))
    order = Window.partitionBy(by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.unionByName(other).withColumn("found", F.last("v", ignorenulls=True).over(order))
    return filled.where("side = 1").select("row.*", F.col("found").alias(value))


def breaches(acked: DataFrame, surviving: DataFrame, must_have_ms: int) -> DataFrame:
    """Acknowledged writes that should have been replicated and are gone."""
    held = surviving.groupBy("key").agg(F.max("seq").alias("held"))
    return acked.where(F.col("acked_ms") <= must_have_ms).join(held, "key", "left").where(F.col("seq") > F.coalesce("held", F.lit(-1)))


def token_bucket(log: DataFrame, rate: float) -> DataFrame:
    """Admission of each namespace's commands in time order: one token a command, `rate` a second, burst of `rate`.

    A bucket's state depends on every admission before, so a namespace is one sequence; a task streams its sorted
    namespaces and holds one state and one batch, however long the log."""
    from collections.abc import Iterator

    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = last = None
        tokens = rate
        for pdf in batches:
            admitted = []
            for name, t in zip(pdf["ns"].tolist(), pdf["ts_ms"].tolist(), strict=True):
                if name != ns:
                    ns, last, tokens = name, t, rate
                tokens, last = min(rate, tokens + (t - last) / 1000 * rate), t
                admitted.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pdf.assign(admitted=admitted)

    ordered = log.select("ns", "key", "seq", "ts_ms").repartition("ns").sortWithinPartitions("ns", "ts_ms", "seq")
    return ordered.mapInPandas(fold, "ns string, key long, seq long, ts_ms long, admitted boolean")


def hysteresis(samples: DataFrame, shed_below: float, reopen_above: float) -> DataFrame:
    """State of each (key) over time: shed under one bound, open again over the other; between them it stays.

    The last decisive sample decides, so a window replaces the sequential fold.
    """
    decisive = F.when(F.col("free") < shed_below, True).when(F.col("free") >= reopen_above, False)
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("shed", F.coalesce(F.last(decisive, ignorenulls=True).over(order), F.lit(False)))
