"""String and integer scalars over binary or string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 512 << 20


def strlen(value: Column) -> Column:
    """Bytes; 0 of a missing value."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def append(value: Column, tail: Column) -> Column:
    return F.concat(F.coalesce(value.cast("binary"), F.lit(b"")), tail.cast("binary"))


def append_all(seq: Column, part: Column) -> Column:
    """Aggregate: the parts of a key joined in the order of seq."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, part.alias("p")))), lambda x: x["p"]), "")


def bounds(size: Column, start: int, end: int) -> tuple[Column, Column]:
    """First index from 0 and length of an inclusive range; negative ends count from the back, both are clamped."""
    low = F.greatest(F.lit(start) if start >= 0 else size + start, F.lit(0))
    high = F.least(F.lit(end) if end >= 0 else size + end, size - 1)
    return low, F.greatest(high - low + 1, F.lit(0))


def get_range(value: Column, start: int, end: int) -> Column:
    """Bytes start..end, both included; empty for a missing value or an empty range."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    low, n = bounds(F.octet_length(raw), start, end)
    return F.substring(raw, low + 1, n)


def set_range(value: Column, offset: int, part: bytes) -> Column:
    """part laid over the value at offset; zero bytes fill a gap; a negative offset counts from the end."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    at = F.lit(offset) if offset >= 0 else F.greatest(size + offset, F.lit(0))
    padded = F.when(size < at + len(part), F.rpad(raw, at + len(part), F.lit(b"\0"))).otherwise(raw)
    return F.when(F.lit(len(part)) > 0, F.overlay(padded, F.lit(part), at + 1, F.lit(len(part)))).otherwise(raw)


def parse_integer(value: Column) -> Column:
    """Decimal text as a long; null where it is none."""
    return F.when(F.rlike(value.cast("string"), F.lit(r"\A[+-]?[0-9]+\z")), value.cast("string").try_cast("long"))


def increment(value: Column, delta: Column) -> Column:
    """Overflow is an error; a missing value counts as 0."""
    return F.coalesce(value, F.lit(0).cast("long")) + delta


def integer_text(value: Column) -> Column:
    return value.cast("string")
