"""Conditional changes as batches: (snapshot, operations) -> new snapshot or answers.

Operations of one key apply in the order of seq. Where the outcome needs the first, the last or a sum only, an aggregate
does it; mixed operations go through an ordered fold per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import KEY, SEQ, VALUE


def upsert(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """The last operation of a key wins over the snapshot."""
    merged = snapshot.join(last_ops(ops).withColumnRenamed(VALUE, "__new"), KEY, "full_outer")
    return merged.select(KEY, F.when(F.col("__at").isNotNull(), F.col("__new")).otherwise(F.col(VALUE)).alias(VALUE))


def changed(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """Only the last operations that change a stored value or add a key; equal values write nothing."""
    last = last_ops(ops).select(KEY, F.col(VALUE).alias("__v"))
    old = snapshot.select(KEY, F.struct(VALUE).alias("__old"))
    return last.join(old, KEY, "left").where("__old is null or not (__v <=> __old.value)").select(KEY, F.col("__v").alias(VALUE))


def first_ops(ops: DataFrame) -> DataFrame:
    """key, value of the first operation of each key; a null value is one too."""
    return ops.groupBy(KEY).agg(F.min_by(VALUE, SEQ).alias(VALUE))


def last_ops(ops: DataFrame) -> DataFrame:
    """key, value of the last operation of each key, and its seq as __at."""
    return ops.groupBy(KEY).agg(F.max_by(VALUE, SEQ).alias(VALUE), F.max(SEQ).alias("__at"))


def try_add(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows that are inserted: the first operation of each absent key."""
    return first_ops(ops).join(snapshot.select(KEY), KEY, "left_anti")


def try_add_counts(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """n_added, n_existing over all operations."""
    there = ops.groupBy(KEY).agg(F.count("*").alias("n")).join(
        snapshot.select(KEY).distinct().withColumn("old", F.lit(1)), KEY, "left"
    )
    added = F.sum(F.when(F.col("old").isNull(), 1).otherwise(0))
    return there.agg(F.coalesce(added, F.lit(0)).alias("n_added"), F.coalesce(F.sum("n") - added, F.lit(0)).alias("n_existing"))


def get_or_add(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """seq, key, value that each operation gets, added: whether it inserted."""
    first = ops.groupBy(KEY).agg(F.min_by(VALUE, SEQ).alias("__f"), F.min(SEQ).alias("__s"))
    old = snapshot.select(KEY, F.struct(VALUE).alias("__old"))
    found = ops.select(SEQ, KEY).join(first, KEY).join(old, KEY, "left")
    return found.select(
        SEQ,
        KEY,
        F.when(F.col("__old").isNotNull(), F.col(f"__old.{VALUE}")).otherwise(F.col("__f")).alias(VALUE),
        (F.col("__old").isNull() & (F.col(SEQ) == F.col("__s"))).alias("added"),
    )


def remove(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    return snapshot.join(keys, KEY, "left_anti")


def removed_count(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """How many rows go; a repeated key counts once."""
    return snapshot.join(keys, KEY, "left_semi").agg(F.count("*").alias("n_removed"))


def compare_and_set(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """ops: key, expected, value, at most one per key. key, value, updated of the whole snapshot."""
    joined = snapshot.join(ops.select(KEY, F.struct("expected", VALUE).alias("__op")), KEY, "left")
    hit = F.col("__op").isNotNull() & F.col(VALUE).eqNullSafe(F.col("__op.expected"))
    return joined.select(KEY, F.when(hit, F.col(f"__op.{VALUE}")).otherwise(F.col(VALUE)).alias(VALUE), hit.alias("updated"))


def try_update(snapshot: DataFrame, condition: Column, value: Column) -> DataFrame:
    """value where the condition on (key, value and further columns) holds; a null condition doesn't."""
    hit = F.coalesce(condition, F.lit(False))
    return snapshot.withColumn("updated", hit).withColumn(VALUE, F.when(F.col("updated"), value).otherwise(F.col(VALUE)))


def add_or_update(
    snapshot: DataFrame, ops: DataFrame, add: Callable[[Column], Column], update: Callable[[Column, Column], Column], kind: str
) -> DataFrame:
    """An ordered fold per key: the first operation of an absent key adds add(op), any other makes update(value, op).

    kind is the SQL type of values. The operations of a key in one batch meet in one row.
    """
    fields = [c for c in ops.columns if c not in (KEY, SEQ)]
    listed = ops.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(SEQ, *fields))).alias("__ops"))
    old = snapshot.select(KEY, F.col(VALUE).cast(kind).alias("__old"), F.lit(True).alias("__there"))
    joined = listed.join(old, KEY, "full_outer")
    start = F.struct(F.coalesce("__there", F.lit(False)).alias("there"), F.col("__old").alias("value"))
    ordered = F.coalesce("__ops", F.array().cast(listed.schema["__ops"].dataType))

    def step(acc: Column, op: Column) -> Column:
        value = F.when(acc["there"], update(acc["value"], op)).otherwise(add(op))
        return F.struct(F.lit(True).alias("there"), value.cast(kind).alias("value"))

    return joined.select(KEY, F.aggregate(ordered, start, step, lambda acc: acc["value"]).alias(VALUE))


def get_set(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """seq, key, previous: the value that each SET replaces."""
    order = Window.partitionBy(KEY).orderBy(SEQ)
    before = ops.withColumn("__n", F.row_number().over(order)).withColumn("__p", F.lag(VALUE).over(order))
    old = snapshot.select(KEY, F.col(VALUE).alias("__old"))
    return before.join(old, KEY, "left").select(SEQ, KEY, F.when(F.col("__n") == 1, F.col("__old")).otherwise(F.col("__p")).alias("previous"))


def set_if_none_exists(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """All operations, or none if any key is there (MSETNX)."""
    taken = ops.join(snapshot.select(KEY), KEY, "left_semi").agg(F.count("*").alias("__taken"))
    return ops.join(F.broadcast(taken), F.col("__taken") == 0).drop("__taken")


def rename(snapshot: DataFrame, names: DataFrame) -> DataFrame:
    """names: key, target, at most one per key and per target. A missing source removes the target all the same."""
    moved = snapshot.join(names, KEY).select(F.col("target").alias(KEY), VALUE)
    gone = names.select(KEY).union(names.select("target"))
    return snapshot.join(gone, KEY, "left_anti").select(KEY, VALUE).union(moved)


def set_with_expiry(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """SET with NX, XX and KEEPTTL as an ordered fold over (value, expiry).

    snapshot: key, value, expires_at. ops: seq, key, value, mode ('NX', 'XX' or null), ttl (seconds or null), keep (keep
    the old expiry), at (timestamp of the operation). A key whose expiry is before `at` is absent; a ttl of 0 or less
    removes the key. Result: key, value, expires_at of the keys that are there, not looking at expiry after the last one.
    """
    fields = ["value", "mode", "ttl", "keep", "at"]
    listed = ops.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(SEQ, *fields))).alias("__ops"))
    old = snapshot.select(KEY, F.struct(F.lit(True).alias("there"), "value", "expires_at").alias("__old"))
    joined = listed.join(old, KEY, "full_outer")
    kind = f"struct<there: boolean, value: {dict(ops.dtypes)['value']}, expires_at: timestamp>"
    nothing = F.struct(F.lit(False).alias("there"), F.lit(None).alias("value"), F.lit(None).alias("expires_at")).cast(kind)
    start = F.coalesce(F.col("__old").cast(kind), nothing)

    def step(acc: Column, op: Column) -> Column:
        there = acc["there"] & (acc["expires_at"].isNull() | (acc["expires_at"] >= op["at"]))
        allowed = ~F.coalesce(((op["mode"] == "NX") & there) | ((op["mode"] == "XX") & ~there), F.lit(False))
        expires = F.when(op["ttl"].isNotNull(), F.timestamp_seconds(F.unix_timestamp(op["at"]) + op["ttl"])).otherwise(
            F.when(op["keep"] & there, acc["expires_at"])
        )
        put = F.struct(F.lit(True).alias("there"), op["value"].alias("value"), expires.alias("expires_at")).cast(kind)
        done = F.when(F.coalesce(op["ttl"] <= 0, F.lit(False)), nothing).otherwise(put)
        return F.when(allowed, done).otherwise(F.when(there, acc).otherwise(nothing))

    ordered = F.coalesce("__ops", F.array().cast(listed.schema["__ops"].dataType))
    state = joined.select(KEY, F.aggregate(ordered, start, step).alias("__s")).where("__s.there")
    return state.select(KEY, F.col("__s.value").alias("value"), F.col("__s.expires_at").alias("expires_at"))
