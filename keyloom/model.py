"""Relations of the engine.

A store is a snapshot (key, value), unique on key, kept as an operation log: every operation has a sequence number, a key
and a value, and is either a put or a removal. A removal is an explicit flag, never a null value. Redis-style data are
three relations: strings (key, value, expires_at), lists (key, items) and sets (key, member).
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY, VALUE, SEQ, DELETED, EXPIRES = "key", "value", "seq", "deleted", "expires_at"


def snapshot_schema(key: T.DataType, value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(KEY, key, False), T.StructField(VALUE, value, True)])


def log_schema(key: T.DataType, value: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(KEY, key, False),
            T.StructField(VALUE, value, True),
            T.StructField(SEQ, T.LongType(), False),
            T.StructField(DELETED, T.BooleanType(), False),
        ]
    )


class StoreError(Exception):
    """Base of the errors below."""


class KeyExists(StoreError):
    """An add of a key that is there."""


class KeyMissing(StoreError, KeyError):
    """A get of a key that isn't there."""


class ReadOnly(StoreError):
    """A change of a read-only store."""


class AlreadyLocked(StoreError):
    """Another writer has the store."""


class BadStore(StoreError):
    """Missing, existing or broken where it must not be."""
