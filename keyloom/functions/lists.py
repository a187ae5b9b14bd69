"""Lists as array columns; indexes from 0, negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.strings import bounds


def from_rows(seq: Column, value: Column) -> Column:
    """Aggregate: a key's values in the order of seq."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), value.alias("v")))), lambda x: x["v"])


def push_left(items: Column, *values: Column) -> Column:
    """Each value in turn to the front: the last one ends first."""
    return F.concat(F.array(*reversed(values)), F.coalesce(items, F.array())) if values else items


def push_right(items: Column, *values: Column) -> Column:
    return F.concat(F.coalesce(items, F.array()), F.array(*values)) if values else items


def push_left_existing(items: Column, *values: Column) -> Column:
    return F.when(items.isNotNull(), push_left(items, *values))


def push_right_existing(items: Column, *values: Column) -> Column:
    return F.when(items.isNotNull(), push_right(items, *values))


def pop_left(items: Column, n: int = 1) -> tuple[Column, Column]:
    """(popped, rest); an empty rest is null: the key goes."""
    return F.slice(items, 1, n), _none_if_empty(F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0))))


def pop_right(items: Column, n: int = 1) -> tuple[Column, Column]:
    """(popped, last one first; rest)."""
    left = F.greatest(F.size(items) - n, F.lit(0))
    return F.reverse(F.slice(items, left + 1, F.least(F.size(items), F.lit(n)))), _none_if_empty(F.slice(items, F.lit(1), left))


def _none_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def length(items: Column) -> Column:
    return F.coalesce(F.size(F.coalesce(items, F.array())), F.lit(0))


def at(items: Column, index: int) -> Column:
    """Null out of range."""
    return F.try_element_at(items, F.lit(index + 1 if index >= 0 else index))


def put(items: Column, index: int, value: Column) -> Column:
    """The list with one item replaced; out of range is an error."""
    place = F.lit(index) if index >= 0 else F.size(items) + index
    good = (place >= 0) & (place < F.size(items))
    done = F.transform(items, lambda x, i: F.when(i == place, value).otherwise(x))
    return F.when(good, done).otherwise(F.raise_error(F.lit("index out of range")))


def cut(items: Column, start: int, end: int) -> Column:
    """Items start..end, both included."""
    items = F.coalesce(items, F.array())
    low, n = bounds(F.size(items), start, end)
    return F.slice(items, low + 1, n)


def positions(items: Column, value: Column, rank: int = 1, count: int | None = None, limit: int = 0) -> Column:
    """Indexes of matches. rank: the n-th match comes first, negative from the end; count: how many, 0 all, None gives the
    first alone or null; limit: how many items are looked at, from the end that rank starts at, 0 all."""
    if rank == 0:
        raise ValueError("rank can't be 0")
    size = F.size(items)

    def found(x: Column, i: Column) -> Column:
        seen = F.lit(True) if limit == 0 else (i < limit if rank > 0 else i >= size - limit)
        return F.when(seen & (x == value), i.cast("long"))

    hits = F.filter(F.transform(items, found), lambda x: x.isNotNull())
    hits = F.reverse(hits) if rank < 0 else hits
    skip = abs(rank) - 1
    if count is None:
        return F.try_element_at(hits, F.lit(skip + 1))
    return F.slice(hits, skip + 1, count if count > 0 else 2**31 - 1)
