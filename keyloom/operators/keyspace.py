"""Keys: (ns, key, type, expire_ms, written_ms, created_ms, size), one row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import live


def delete(k: DataFrame, gone: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of live keys removed): a repeated key counts once."""
    names = gone.select("key").distinct()
    return k.join(names, "key", "left_anti"), k.where(live(now)).join(names, "key", "left_semi").agg(F.count("*").alias("removed"))


def exists(k: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    """Repeated probes count again; an expired key is absent."""
    return probes.join(k.where(live(now)).select("key"), "key").agg(F.count("*").alias("found"))


def type_of(k: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    return probes.join(k.where(live(now)).select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def copy(k: DataFrame, src: str, dst: str, replace: bool, now: int) -> DataFrame:
    """The expiry goes along. Without `replace` an existing dst stays."""
    if src == dst:
        raise ValueError("source and destination are the same")
    source = k.where((F.col("key") == src) & live(now)).withColumn("key", F.lit(dst))
    held = k.where((F.col("key") == dst) & live(now)).select("key")
    if replace:
        return k.join(source.select("key"), "key", "left_anti").unionByName(source)
    return k.unionByName(source.join(held, "key", "left_anti"))


def rename(k: DataFrame, src: str, dst: str, only_new: bool = False) -> DataFrame:
    if src == dst:
        return k
    has = lambda name: F.max(F.when(F.col("key") == name, 1).otherwise(0)).over(Window.partitionBy("ns"))
    both = k.where(F.col("key").isin(src, dst)).withColumn("src", has(src)).withColumn("dst", has(dst))
    moved = (F.col("src") == 1) & ((F.col("dst") == 0) | F.lit(not only_new))
    out = both.where(~((F.col("key") == dst) & moved)).withColumn("key", F.when(moved, F.lit(dst)).otherwise(F.col("key")))
    return k.where(~F.col("key").isin(src, dst)).unionByName(out.drop("src", "dst"))


def expire_at(k: DataFrame, at: Column, now: int) -> DataFrame:
    """New expiry of live keys; an instant that has passed deletes."""
    return k.where(live(now)).withColumn("expire_ms", at).where(F.col("expire_ms") > now)


def remaining(now: int, unit_ms: int) -> Column:
    """-1 without expiry, else what is left, rounded up."""
    return F.when(F.col("expire_ms") == 0, -1).otherwise(F.ceil((F.col("expire_ms") - now) / unit_ms)).cast("long")


def instant(unit_ms: int) -> Column:
    """-1 without expiry, else the instant, rounded down."""
    return F.when(F.col("expire_ms") == 0, -1).otherwise(F.floor(F.col("expire_ms") / unit_ms)).cast("long")


def scan_page(k: DataFrame, pattern: Column, kind: str | None, page: int, count: int, now: int) -> DataFrame:
    """A page examines `count` live keys in key order and then filters, so it may be short."""
    if kind not in (None, "string", "hash", "set", "zset", "list"):
        return k.where(F.lit(False)).select("key", "type")
    nth = F.row_number().over(Window.partitionBy("ns").orderBy("key"))
    seen = k.where(live(now)).withColumn("nth", nth).where(F.col("nth").between(page * count + 1, (page + 1) * count))
    return seen.where(pattern if kind is None else pattern & (F.col("type") == kind)).select("key", "type")


def page_after(k: DataFrame, after: str, n: int) -> DataFrame:
    """Keyset paging: the next n keys strictly after one."""
    return k.where(F.col("key") > after).orderBy("key").limit(n)


def reclaim(k: DataFrame, goal: int) -> DataFrame:
    """Least recently written keys, larger first among equals, until their sizes reach the goal."""
    order = Window.partitionBy("ns").orderBy("written_ms", F.desc("size"), "key")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return k.withColumn("before", before).where(F.col("before") < goal)


def sweep(k: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Orphans: rows whose key has no live metadata."""
    return rows.join(k.where(live(now)).select("ns", "key"), ["ns", "key"], "left_anti")
