"""Bloom filters as chains of links of 4096-byte blocks.

Blocks are built by bitmap_construct_agg, whose layout (32768 bits, least significant first) is
the block itself, so a filter of any size is one partial and one final aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.murmur import fmix64, hash_many

BLOCK_BITS_LOG2 = 15


@dataclass(frozen=True)
class Plan:
    hashes: int
    block_bits_log2: int
    blocks: int


def plan(capacity: int, error: float) -> Plan:
    if capacity < 1 or not 0 < error < 1:
        raise ValueError("capacity must be positive and the error rate between 0 and 1")
    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    hashes = min(32, max(1, round(-math.log2(error))))
    if bits <= 1 << BLOCK_BITS_LOG2:
        return Plan(hashes, max(6, (bits - 1).bit_length()), 1)
    return Plan(hashes, BLOCK_BITS_LOG2, -(-bits >> BLOCK_BITS_LOG2))


def place(items: list[bytes], p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each item: the high half of h1 * blocks, then steps of an odd stride."""
    with np.errstate(over="ignore"):
        h1, h2 = hash_many(items)
        block = np.array([int(x) * p.blocks >> 64 for x in h1], np.int64)
        stride = fmix64(h1 ^ h2) | np.uint64(1)
        steps = np.arange(p.hashes, dtype=np.uint64)[None, :]
        bits = (h2[:, None] + steps * stride[:, None]) & np.uint64((1 << p.block_bits_log2) - 1)
    return block, bits.astype(np.int64)


def placed(items: DataFrame, p: Plan, item: str = "item") -> DataFrame:
    """items with block and bits."""

    @F.pandas_udf("struct<block:long,bits:array<long>>")
    def where(x: pd.Series) -> pd.DataFrame:
        block, bits = place([bytes(v) for v in x], p)
        return pd.DataFrame({"block": block, "bits": list(bits)})

    return items.withColumn("at", where(F.col(item))).select(*items.columns, "at.block", "at.bits")


def build(items: DataFrame, p: Plan, item: str = "item") -> DataFrame:
    """block, bits: the filter's blocks that hold anything."""
    each = placed(items.select(item).distinct(), p, item).select("block", F.explode("bits").alias("bit"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def might_hold(probes: DataFrame, blocks: DataFrame, p: Plan, item: str = "item") -> DataFrame:
    """probes with found: whether all its bits are set. Missing blocks hold nothing."""
    asked = placed(probes, p, item).withColumnRenamed("bits", "asked").join(blocks, "block", "left")
    byte = lambda b: F.conv(F.hex(F.substr(F.col("bits"), F.shiftright(b, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.forall("asked", lambda b: F.getbit(byte(b), b.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return asked.select(*probes.columns, F.coalesce(hit, F.lit(False)).alias("found"))


def links(capacity: int, error: float, total: int, expansion: int = 2, tightening: float = 0.5, most: int = 32) -> list[Plan]:
    """The chain that a scaling filter grows to for `total` accepted items."""
    out, room = [], 0
    for i in range(most):
        size = capacity * expansion**i
        out.append(plan(size, error * tightening**i))
        room += size
        if room >= total:
            return out
    raise ValueError("the filter is full")


def arrived(items: DataFrame, item: str = "item", at: str = "at") -> DataFrame:
    """The distinct items with rank, from 0 in the order of their first `at`. One row a partition goes to the driver."""
    first = items.groupBy(item).agg(F.min(at).alias("first")).repartitionByRange("first", item).sortWithinPartitions("first", item)
    rows = first.withColumn("row", F.monotonically_increasing_id()).select(item, "row").persist()
    part = F.shiftright("row", 33)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = F.broadcast(items.sparkSession.createDataFrame(before, "part long, before long"))
    return rows.withColumn("part", part).join(starts, "part").select(item, (F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def chain(items: DataFrame, capacity: int, error: float, item: str = "item", at: str = "at") -> list[tuple[DataFrame, Plan]]:
    """The links that a scaling filter has after all items in the order of `at`. An item that earlier links hold by mistake is added all the same."""
    ranked = arrived(items, item, at)
    plans, out, start = links(capacity, error, ranked.count()), [], 0
    for i, p in enumerate(plans):
        end = start + capacity * 2**i
        out.append((build(ranked.where((F.col("rank") >= start) & (F.col("rank") < end)), p, item), p))
        start = end
    return out


def any_holds(probes: DataFrame, filters: list[tuple[DataFrame, Plan]], item: str = "item") -> DataFrame:
    """probes with found: whether a link of the chain might hold the item."""
    out = probes
    for i, (blocks, p) in enumerate(filters):
        out = might_hold(out, blocks, p, item).withColumnRenamed("found", f"found_{i}")
    return out.select(*probes.columns, F.array_contains(F.array(*[f"found_{i}" for i in range(len(filters))]), True).alias("found"))
