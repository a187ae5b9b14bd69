"""Bitmaps in binary values; bit 0 is the highest bit of byte 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.strings import bounds

MAX_BIT = 536_870_912


def byte_at(value: Column, index: Column) -> Column:
    """Byte from 0 as an int; 0 past the end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(value, index + 1, F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))


def get_bit(value: Column, position: int) -> Column:
    if not 0 <= position < MAX_BIT:
        raise ValueError(f"bit {position} is out of range")
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    return F.shiftright(byte_at(raw, F.lit(position // 8)), 7 - position % 8).bitwiseAND(1)


def set_bit(value: Column, position: int, bit: int) -> Column:
    """The value with one bit set; zero bytes fill up to it."""
    if not 0 <= position < MAX_BIT:
        raise ValueError(f"bit {position} is out of range")
    at, mask = position // 8, 1 << (7 - position % 8)
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    old = byte_at(raw, F.lit(at))
    new = old.bitwiseOR(mask) if bit else old.bitwiseAND(0xFF ^ mask)
    padded = F.when(F.octet_length(raw) < at + 1, F.rpad(raw, at + 1, F.lit(b"\0"))).otherwise(raw)
    return F.overlay(padded, F.unhex(F.lpad(F.hex(new), 2, "0")), F.lit(at + 1), F.lit(1))


def bit_count(value: Column, start: int = 0, end: int = -1) -> Column:
    """Set bits of the bytes start..end, both included, negative from the end."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    low, n = bounds(F.octet_length(raw), start, end)
    digits = F.split(F.hex(F.substring(raw, low + 1, n)), "")
    ones = F.transform(digits, lambda d: F.coalesce(F.bit_count(F.conv(F.nullif(d, F.lit("")), 16, 10).cast("int")), F.lit(0)))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, x: a + x)
