"""Merging of sorted runs and operation logs: newest wins, tombstones go, stale rows leave at compaction."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.model import DELETED, KEY, SEQ


#: Types whose aggregation buffers a hash table holds in place; others make Spark sort before it aggregates.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def newest(log: DataFrame, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """The operation with the largest seq of each key; seq is unique inside a key.

    An aggregate, not a window: it combines before the shuffle, so a key with many operations sends one row per task.
    Columns of fixed width are taken one by one, which keeps the whole aggregation in a hash table.
    """
    others = [c for c in log.columns if c not in (key, seq)]
    if all(isinstance(log.schema[c].dataType, FIXED_WIDTH) for c in others):
        best = log.groupBy(key).agg(*(F.max_by(c, seq).alias(c) for c in others), F.max(seq).alias(seq))
        return best.select(key, *others, seq)
    best = log.groupBy(key).agg(F.max_by(F.struct(*others, seq), seq).alias("__row"))
    return best.select(key, *(F.col(f"__row.{c}").alias(c) for c in [*others, seq]))


def live(log: DataFrame, deleted: str = DELETED) -> DataFrame:
    """Without tombstones."""
    return log.where(~F.col(deleted)).drop(deleted)


def snapshot(log: DataFrame, key: str = KEY, seq: str = SEQ, deleted: str = DELETED) -> DataFrame:
    """key, value, seq of what is there after the whole log."""
    return live(newest(log, key, seq), deleted)


def merge_runs(runs: list[DataFrame], key: str = KEY, seq: str | None = None) -> DataFrame:
    """One row per key of several runs, the first run being the newest; inside a run the largest seq wins."""
    return _best(runs, key, ("__rank", seq) if seq else ("__rank",))


def merge_by_seq(runs: list[DataFrame], key: str = KEY, seq: str = SEQ) -> DataFrame:
    """One row per key of several runs: the largest seq wins, whatever run it is in; of equal ones that of the newer run."""
    return _best(runs, key, (seq, "__rank"))


def _best(runs: list[DataFrame], key: str, order: tuple[str, ...]) -> DataFrame:
    ranked = [r.withColumn("__rank", F.lit(-i)) for i, r in enumerate(runs)]
    both = reduce(DataFrame.unionByName, ranked)
    others = [c for c in runs[0].columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(key, *(F.col(f"__row.{c}").alias(c) for c in others))


def stale(predicates: list[Column]) -> Column:
    """A row is stale if any predicate says so; a null says no."""
    return reduce(or_, (F.coalesce(p, F.lit(False)) for p in predicates), F.lit(False))


def compacted(log: DataFrame, predicates: list[Column] = (), key: str = KEY, seq: str = SEQ) -> DataFrame:
    """The snapshot without stale rows, in ranges of keys and sorted inside, as it goes to a new base."""
    rows = snapshot(log, key, seq).where(~stale(list(predicates)))
    return rows.repartitionByRange(key).sortWithinPartitions(key)
