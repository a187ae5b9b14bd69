"""Set algebra and predicates over one-column relations. The other side is taken as a set: its repeats don't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def subtract(a: DataFrame, b: DataFrame, name: str = KEY) -> DataFrame:
    return a.join(b, name, "left_anti").distinct()


def intersect(a: DataFrame, b: DataFrame, name: str = KEY) -> DataFrame:
    return a.join(b, name, "left_semi").distinct()


def sides(a: DataFrame, b: DataFrame, name: str = KEY) -> DataFrame:
    """Each member once with in_a and in_b; one aggregation answers the algebra and all predicates."""
    both = a.select(name, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(name, F.lit(0), F.lit(1)))
    return both.groupBy(name).agg((F.max("x") == 1).alias("in_a"), (F.max("y") == 1).alias("in_b"))


def symmetric_difference(a: DataFrame, b: DataFrame, name: str = KEY) -> DataFrame:
    return sides(a, b, name).where(F.col("in_a") != F.col("in_b")).select(name)


def predicates(a: DataFrame, b: DataFrame, name: str = KEY) -> DataFrame:
    """One row: is_subset, is_superset, is_proper_subset, is_proper_superset, overlaps, set_equals of a against b."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = sides(a, b, name).agg(
        n(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        n(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
        n(F.col("in_a") & F.col("in_b")).alias("shared"),
    )
    only_a, only_b = F.col("only_a") > 0, F.col("only_b") > 0
    return counts.select(
        (~only_a).alias("is_subset"),
        (~only_b).alias("is_superset"),
        (~only_a & only_b).alias("is_proper_subset"),
        (~only_b & only_a).alias("is_proper_superset"),
        (F.col("shared") > 0).alias("overlaps"),
        (~only_a & ~only_b).alias("set_equals"),
    )


def take_smallest(a: DataFrame, name: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(the smallest member, the set without it)."""
    least = a.agg(F.min(name).alias(name)).where(F.col(name).isNotNull())
    return least, a.join(F.broadcast(least), name, "left_anti")
