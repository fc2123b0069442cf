"""Sorted sets: (key, member, score), ordered by score, then member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(reverse: bool) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def ranked(z: DataFrame, reverse: bool = False) -> DataFrame:
    """z with 0-based rank; ties in score go by member."""
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))).cast("long") - 1)


def by_rank(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Inclusive ranks; negatives count from the end. From the front only the first stop + 1 of a key are kept in a sort."""
    if start >= 0 and stop >= 0:
        return ranked(z, reverse).where((F.col("rank") <= stop) & (F.col("rank") >= start))
    counted = ranked(z, reverse).join(z.groupBy("key").agg(F.count("*").alias("n")), "key")
    at = lambda i: F.lit(i) if i >= 0 else F.col("n") + i
    return counted.where((F.col("rank") >= at(start)) & (F.col("rank") <= at(stop))).drop("n")


def score_between(low: float, high: float, open_low: bool = False, open_high: bool = False) -> Column:
    s = F.col("score")
    return (s > low if open_low else s >= low) & (s < high if open_high else s <= high)


def by_score(z: DataFrame, low: float, high: float, *, open_low: bool = False, open_high: bool = False, offset: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
    """The range predicate first, so it reaches the scan; offset under 0 is 0, limit under 0 is all."""
    found = ranked(z.where(score_between(low, high, open_low, open_high)), reverse)
    found = found.where(F.col("rank") >= max(0, offset))
    return found if limit < 0 else found.where(F.col("rank") < max(0, offset) + limit)


def lex_walk(z: DataFrame, low: str | None, high: str | None, *, open_low: bool = False, open_high: bool = False) -> DataFrame:
    """The first contiguous run of members in range, in (score, member) order: a walk, not a filter."""
    m = F.col("member")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (m > low if open_low else m >= low)
    if high is not None:
        inside = inside & (m < high if open_high else m <= high)
    order = Window.partitionBy("key").orderBy("score", "member")
    flagged = z.withColumn("inside", inside)
    starts = F.sum((F.col("inside") & ~F.coalesce(F.lag("inside").over(order), F.lit(False))).cast("int")).over(order)
    return flagged.withColumn("island", starts).where("inside and island = 1").drop("inside", "island")


def lex_page(z: DataFrame, low: str | None, high: str | None, *, open_low: bool = False, open_high: bool = False, reverse: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """lex_walk() in either direction, from `offset` on at most `limit` (negative: all) members of a key."""
    found = ranked(lex_walk(z, low, high, open_low=open_low, open_high=open_high), reverse)
    found = found.where(F.col("rank") >= offset)
    return found if limit < 0 else found.where(F.col("rank") < offset + limit)


def combine(inputs: list[DataFrame], weights: list[float], how: str = "sum", every: bool = False) -> DataFrame:
    """Weighted union (or, with `every`, intersection) of (member, score) inputs; NaN is 0 after weighting and after combining."""
    zero = lambda c: F.when(F.isnan(c), 0.0).otherwise(c)
    parts = [x.select("member", zero(F.col("score") * w).alias("score"), F.lit(i).alias("input")) for i, (x, w) in enumerate(zip(inputs, weights, strict=True))]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    out = reduce(DataFrame.unionByName, parts).groupBy("member").agg(zero(fold("score")).alias("score"), F.count("*").alias("n"))
    return (out.where(F.col("n") == len(inputs)) if every else out).drop("n")


def upsert(log: DataFrame, *order: str) -> DataFrame:
    """Last score of each (key, member) by the order columns."""
    return log.groupBy("key", "member").agg(F.max_by("score", F.struct(*order)).alias("score"))


def format_score(s: Column) -> Column:
    """Integral scores without a point; others as the shortest decimal digits, never with an exponent; inf and -inf."""
    text = s.cast("string")
    sign, mantissa = F.when(s < 0, "-").otherwise(""), F.regexp_extract(text, r"^-?(\d+\.\d+)E", 1)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    n = F.char_length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.when(n <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, n)))
    plain = F.when(power.isNull(), text).otherwise(F.concat(sign, F.when(power < 0, small).otherwise(large)))
    whole = (s == F.floor(s)) & (F.abs(s) < 1e17)
    return F.when(F.abs(s) == float("inf"), F.concat(sign, F.lit("inf"))).when(whole, s.cast("long").cast("string")).otherwise(plain)
