"""Strings and counters: bytes, integers and doubles as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def first_write(log: DataFrame) -> DataFrame:
    """Fold of writes that only set absent keys."""
    return log.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def get_range(value: Column, start: int, end: int) -> Column:
    """Inclusive byte range; negatives from the end, clamped; inverted is empty."""
    n = F.octet_length(value)
    begin = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    stop = F.least(F.lit(end), n - 1) if end >= 0 else n + end
    return F.when(stop < begin, F.lit(b"")).otherwise(F.substr(value, begin + 1, stop - begin + 1))


def set_range(value: Column, offset: int, patch: bytes) -> Column:
    """Zero bytes fill a gap; an empty patch changes nothing."""
    if not patch:
        return value
    room = F.rpad(value, F.greatest(F.octet_length(value), F.lit(offset)), F.lit(b"\0"))
    return F.overlay(room, F.lit(patch), F.lit(offset + 1))


def append(log: DataFrame) -> DataFrame:
    """All suffixes of a key in seq order, as one string."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return log.groupBy("key").agg(F.array_join(parts, "").alias("value"))


def increment(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.sum(F.col("delta").cast("long")).alias("value"))


def parse_int(text: Column) -> Column:
    """64-bit integers with an optional sign; anything else is null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def parse_float(text: Column) -> Column:
    """Finite or infinite doubles; NaN, suffixes, white space, hexadecimal digits and anything else are null."""
    plain = text.rlike(r"^(?i)[+-]?(?:inf|infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$")
    return F.when(plain, text.try_cast("double"))


def float_text(value: Column) -> Column:
    """17 decimals without trailing zeros or a bare point."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.17f", value), "0+$", ""), "\\.$", "")
