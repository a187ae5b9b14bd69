"""Expiry. `now` is always a parameter: results do not depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alive(expires_at: Column, now: Column) -> Column:
    """A row without expiry, or whose expiry isn't before now."""
    return expires_at.isNull() | (expires_at >= now)


def remaining(expires_at: Column, now: Column, present: Column, unit: str = "s") -> Column:
    """-2 missing or expired, -1 without expiry, else the whole seconds (or ms) that are left."""
    step = {"s": 1_000_000, "ms": 1000}[unit]
    left = F.floor((F.unix_micros(expires_at) - F.unix_micros(now)) / step).cast("long")
    there = F.coalesce(present, F.lit(False)) & alive(expires_at, now)
    return F.when(~there, F.lit(-2).cast("long")).when(expires_at.isNull(), F.lit(-1).cast("long")).otherwise(left)


def expire_in(now: Column, amount: Column, unit: str = "s") -> Column:
    """Absolute expiry from a relative one."""
    micros = F.unix_micros(now) + amount.cast("long") * F.lit({"s": 1_000_000, "ms": 1000}[unit])
    return F.timestamp_micros(micros)


def expire_at(amount: Column, unit: str = "s") -> Column:
    """Absolute expiry from seconds or milliseconds since 1970."""
    return F.timestamp_seconds(amount) if unit == "s" else F.timestamp_millis(amount)


def expire_reply(expires_at: Column, now: Column, present: Column) -> Column:
    """1 if the key is there and the new expiry isn't past, else 0; a past expiry removes the key."""
    return (F.coalesce(present, F.lit(False)) & (expires_at >= now)).cast("int")


def persist(expires_at: Column, now: Column, present: Column) -> Column:
    """struct<expires_at, reply>: a key that is there loses its expiry and answers 1; any other answers 0."""
    there = F.coalesce(present, F.lit(False)) & alive(expires_at, now)
    return F.struct(F.when(~there, expires_at).alias("expires_at"), there.cast("int").alias("reply"))


def clock(now: Column) -> Column:
    """[unix seconds, microseconds of the second]."""
    return F.array(F.unix_seconds(now), F.pmod(F.unix_micros(now), F.lit(1_000_000)))
