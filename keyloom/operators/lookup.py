"""Point, multi, range, prefix and glob lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.glob import glob
from keyloom.model import KEY, VALUE, KeyMissing
from keyloom.sources.shared import materialise


def get(snapshot: DataFrame, key: object, name: str = KEY) -> DataFrame:
    """The row of a key, or none; the comparison reaches the Parquet scan."""
    return snapshot.where(F.col(name) == F.lit(key))


def get_or_raise(snapshot: DataFrame, key: object, name: str = KEY) -> object:
    row = get(snapshot, key, name).first()
    if row is None:
        raise KeyMissing(key)
    return row[VALUE]


def multi_get(requests: DataFrame, snapshot: DataFrame, name: str = KEY) -> DataFrame:
    """Every request with its value, null where there is none; repeated requests are answered each."""
    return requests.join(snapshot, name, "left")


def contains(requests: DataFrame, snapshot: DataFrame, name: str = KEY, flag: str = "present") -> DataFrame:
    """Every request with a flag; values don't matter."""
    keys = snapshot.select(name).distinct().withColumn(flag, F.lit(True))
    return requests.join(keys, name, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exists_count(requests: DataFrame, snapshot: DataFrame, name: str = KEY) -> DataFrame:
    """How many requests are there, repeats counted."""
    return requests.join(snapshot.select(name), name, "left_semi").agg(F.count("*").alias("n"))


def keys(snapshot: DataFrame, name: str = KEY) -> DataFrame:
    return snapshot.select(name)


def values(snapshot: DataFrame, name: str = VALUE) -> DataFrame:
    return snapshot.select(name)


def scan(snapshot: DataFrame, name: str = KEY, order: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """All rows in key order; order makes the sort key of another comparer."""
    return snapshot.orderBy(order(F.col(name)))


def key_range(snapshot: DataFrame, low: object, high: object, name: str = KEY) -> DataFrame:
    """Both ends belong to the range; an inverted range is empty."""
    return snapshot.where(F.col(name).between(F.lit(low), F.lit(high)))


def prefix(snapshot: DataFrame, start: str, name: str = KEY) -> DataFrame:
    return snapshot.where(F.col(name).startswith(start))


def matching(snapshot: DataFrame, pattern: str, name: str = KEY) -> DataFrame:
    return snapshot.where(glob(name, pattern))


def decode(snapshot: DataFrame, key: Column, value: Column) -> DataFrame:
    return snapshot.select(key.alias(KEY), value.alias(VALUE))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1, under an order. Ranges of the order are ranked apart; each is moved by the sizes of those
    before it, one number a partition."""
    part = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in part.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    moved = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("__part")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("place", (inside + moved).cast("long")).drop("__part")
