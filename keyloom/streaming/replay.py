"""Replay of the command log into state, in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """A folder of Parquet pieces of the log; `files` bounds what a batch takes in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counters(stream: DataFrame) -> DataFrame:
    """Running sum and count of each key."""
    return stream.groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def decayed_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: event-time windows with a bound on lateness."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))


def apply(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch into its own folder, named by the batch: a batch that runs twice writes the same place, so applying is idempotent."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cursor(spark: SparkSession, out: str) -> DataFrame:
    """The highest sequence number applied, and whether there is a gap below it."""
    return spark.read.parquet(out).agg(F.max("seq").alias("cursor"), (F.max("seq") - F.min("seq") + 1 != F.count_distinct("seq")).alias("gap"))


def admitted(stream: DataFrame, rate: float) -> DataFrame:
    """Token bucket of each key as arbitrary state: one token a command, `rate` a second, burst of `rate`."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (rate, -1)
        for pdf in frames:
            pdf = pdf.sort_values(["ts_ms", "seq"])
            out = []
            for t in pdf["ts_ms"]:
                tokens = min(rate, tokens + max(0, t - last) / 1000 * rate) if last >= 0 else rate
                last = max(last, t)
                out.append(bool(tokens >= 1))
                tokens -= tokens >= 1
            yield pdf[["key", "seq"]].assign(admitted=out)
        state.update((float(tokens), int(last)))

    return stream.select("key", "seq", "ts_ms").groupBy("key").applyInPandasWithState(fold, "key long, seq long, admitted boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)
