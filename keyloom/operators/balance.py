"""Slots over pairs of nodes: ownership, load, moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.slots import SLOTS


def owner(slotted: DataFrame, ranges: list[tuple[int, int, str]], exceptions: dict[int, str] | None = None, moved: dict[int, str] | None = None) -> DataFrame:
    """slotted with owner: a moved slot first, then an exception, then the range. The three tables have at most 16384 rows."""
    last = -1
    for lo, hi, _ in sorted(ranges):
        if lo <= last or hi < lo:
            raise ValueError("ranges overlap or are inverted")
        last = hi
    spark = slotted.sparkSession
    by_range = F.broadcast(spark.createDataFrame(sorted(ranges), "lo int, hi int, by_range string"))
    out = slotted.join(by_range, F.col("slot").between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")
    for name, rows in (("by_exception", exceptions), ("by_move", moved)):
        table = F.broadcast(spark.createDataFrame([*(rows or {}).items()], f"slot int, {name} string"))
        out = out.join(table, "slot", "left")
    return out.withColumn("owner", F.coalesce("by_move", "by_exception", "by_range")).drop("by_move", "by_exception", "by_range")


def default_owner(slot: Column, pairs: int) -> Column:
    return F.floor(slot * pairs / SLOTS).cast("long")


def slot_counts(keys: DataFrame) -> DataFrame:
    """Expired keys count as well."""
    return keys.groupBy("ns", "slot").agg(F.count("*").alias("n"))


def plan_moves(loads: dict[str, int], deadband: float) -> list[tuple[str, str, int]]:
    """Moves (from, to, amount) on the driver: the number of pairs is that of machines."""
    loads = dict(loads)
    out: list[tuple[str, str, int]] = []
    if not loads:
        return out
    mean = sum(loads.values()) / len(loads)
    while True:
        donors = [p for p in loads if loads[p] > mean * (1 + deadband)]
        takers = [p for p in loads if loads[p] < mean]
        if not donors or not takers:
            return out
        donor = min(donors, key=lambda p: (-loads[p], p))
        taker = min(takers, key=lambda p: (loads[p], p))
        amount = int(min(loads[donor] - mean, mean - loads[taker]))
        if amount < 1:
            return out
        loads[donor] -= amount
        loads[taker] += amount
        out.append((donor, taker, amount))


def select_units(counts: DataFrame, amount: int) -> DataFrame:
    """Largest slots first (ties ns, then slot) until their counts reach the amount; at least one."""
    order = Window.orderBy(F.desc("n"), "ns", "slot")  # at most one row for each namespace and slot
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).where((F.col("before") < amount) | (F.col("before") == 0))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Adjacent runs (lo, hi, owner) of one owner become one."""
    order = Window.orderBy("lo")  # at most 16384 runs
    new = ~((F.lag("hi").over(order) + 1 == F.col("lo")) & (F.lag("owner").over(order) == F.col("owner")))
    island = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)
    return runs.withColumn("island", island).groupBy("island", "owner").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def shuffle_shard(name: str, fleet: list[str], k: int, mix: Callable[[bytes], int]) -> list[str]:
    """k members of the fleet, the same for a name every time: the smallest hashes of name and member."""
    return sorted(sorted(fleet, key=lambda m: (mix(f"{name}\0{m}".encode()), m))[:k])
