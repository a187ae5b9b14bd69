"""Counts and statistics of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY, VALUE

#: Values up to this many bytes are stored beside their key.
INLINED = 9


def count(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("n"))


def statistics(snapshot: DataFrame) -> DataFrame:
    """One row: rows, and the smallest, largest, mean and summed bytes of keys and values."""
    out = [F.count("*").alias("n")]
    for name, c in (("key", KEY), ("value", VALUE)):
        size = F.octet_length(c).cast("long")
        out += [F.min(size).alias(f"{name}_min"), F.max(size).alias(f"{name}_max"), F.avg(size).alias(f"{name}_avg"), F.sum(size).alias(f"{name}_sum")]
    return snapshot.agg(*out, F.count_if(F.octet_length(VALUE) <= INLINED).alias("n_inlined"))
