"""Hash slots: CRC16 of a key's hash tag, as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384


def hash_tag(key: Column) -> Column:
    """What stands between the first `{` and the first `}` behind it, if anything does; else the key."""
    tag = F.regexp_extract(key, r"(?s)^[^{]*\{([^}]*)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def crc16(data: Column) -> Column:
    """The XMODEM check (polynomial 0x1021, start 0), eight shifts a byte without a table."""

    def byte(crc: Column, i: Column) -> Column:
        value = F.conv(F.substr(F.hex(data), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        crc = crc.bitwiseXOR(F.shiftleft(value, 8))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc, lambda c, _: F.when(c.bitwiseAND(F.lit(0x8000)) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(c, 1)).bitwiseAND(F.lit(0xFFFF)))

    every = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(every, F.lit(0), byte)


def slot(key: Column) -> Column:
    return F.pmod(crc16(hash_tag(key)), F.lit(SLOTS))
