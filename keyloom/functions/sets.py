"""Redis-style sets as a relation (key, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sets after, newly added members by key)."""
    fresh = new.distinct().join(members, ["key", "member"], "left_anti")
    touched = new.select("key").distinct().join(fresh.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    return members.union(fresh), touched.select("key", F.coalesce("n", F.lit(0)).alias("n_added"))


def remove(members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sets after, removed members by key)."""
    left = members.join(gone, ["key", "member"], "left_anti")
    hit = members.join(gone, ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    touched = gone.select("key").distinct().join(hit, "key", "left")
    return left, touched.select("key", F.coalesce("n", F.lit(0)).alias("n_removed"))


def cardinality(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count("*").alias("n"))


def members_sorted(member: Column) -> Column:
    """Aggregate: the members of a key in order."""
    return F.array_sort(F.collect_set(member))


def is_member(requests: DataFrame, members: DataFrame) -> DataFrame:
    flags = members.withColumn("is_member", F.lit(1))
    return requests.join(flags, ["key", "member"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(0)))


def random_members(members: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n members of each key, or all, without replacement; the draw depends on the seed alone."""
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member")
    return members.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def pop(members: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped members, the sets after)."""
    taken = random_members(members, n, seed)
    return taken, members.join(taken, ["key", "member"], "left_anti")
