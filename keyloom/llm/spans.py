"""Spans of patterns in whole texts, with DataFrame functions only.

Spark's regular expression functions return texts without places. A place follows from what stands before it: the text
is split by the same pattern, and the lengths of the pieces and matches add up. Both walk leftmost and non-overlapping.
Offsets are code points; ends are exclusive. The time of a text is linear in its length and its matches.

Patterns are written so that matching takes linear time and constant stack on any text: quantifiers are possessive, and
a run of characters is entered at its beginning only (or where the last match ended, \\G).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the text before a match, the code points that are kept as its context.
CONTEXT = 24


#: A pattern and characters one of which every match holds; texts without them are not searched.
Kind = tuple[str, str, str]  # name, pattern, necessary texts parted by spaces, or ""


def with_spans(df: DataFrame, kinds: list[Kind], text: str = "text") -> DataFrame:
    """Adds, per kind, a column of its name: array<struct<start, end, match, before, after, from, to>>, empty without a match or
    a text."""
    names = [f"__{n}" for n, _, _ in kinds]
    plain = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")

    def search(pattern: str, needs: str) -> Column:
        found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        tests = [F.contains(plain, F.lit(x)) for x in needs.split()]
        return F.when(reduce(or_, tests), found).otherwise(none) if tests else found

    # three steps, so that each expensive one runs once: matches, texts between them where there are any, places
    kept = [F.col(c) for c in df.columns]
    found = df.select(*kept, *(search(p, needs).alias(n) for n, (_, p, needs) in zip(names, kinds, strict=True)))
    between = [
        F.when(F.size(n) > 0, F.split(plain, p, -1)).otherwise(none).alias(f"{n}_between")
        for n, (_, p, _) in zip(names, kinds, strict=True)
    ]
    parted = found.select(*kept, *names, *between)
    return parted.select(*kept, *(located(f"`__{n}_between`", f"`__{n}`").alias(n) for n, _, _ in kinds))


def located(between: str, found: str) -> Column:
    """array<struct<start, end, match, before, after, from, to>> of the matches; from and to count bytes, from 0.

    between, found: columns. The expression is SQL text, as nested lambdas are slow to build call by call."""

    def sizes(measure: str) -> str:
        size = f"{measure}(get({between}, i)) + {measure}(get({found}, i))"
        return f"transform(sequence(0, size({found}) - 1), i -> cast({size} as bigint))"

    span = f"""named_struct(
        'start', get(points, i) + length(get({between}, i)),
        'end', get(points, i) + length(get({between}, i)) + length(get({found}, i)),
        'match', get({found}, i),
        'before', lower(right(get({between}, i), {CONTEXT})),
        'after', left(get({between}, i + 1), 1),
        'from', get(octets, i) + octet_length(get({between}, i)),
        'to', get(octets, i) + octet_length(get({between}, i)) + octet_length(get({found}, i)))"""
    spans = f"transform(sequence(0, size({found}) - 1), i -> {span})"
    placed = let("points", running(sizes("length")), let("octets", running(sizes("octet_length")), spans))
    return F.expr(f"if(size({found}) > 0, {placed}, cast(array() as {SPANS}))")


SPANS = "array<struct<start: bigint, end: bigint, match: string, before: string, after: string, from: bigint, to: bigint>>"

#: Values that a step of running() copies at most.
CHUNK = 64


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, join: str = "acc.at + x", levels: int = 3) -> str:
    """SQL of array<bigint>: of each value what join makes of 0 and those before it.

    Appending to an array copies it, so an accumulator over all values would take quadratic time. Values are cut to chunks;
    the chunks' results are run up in the same way, and each chunk starts from its own."""

    def fold(part: str, first: str, out: str, finish: str) -> str:
        start = f"named_struct('at', {first}, 'out', cast(array() as array<bigint>))"
        return f"aggregate({part}, {start}, (acc, x) -> named_struct('at', {join}, 'out', {out}), acc -> acc.{finish})"

    def short(part: str, first: str) -> str:
        return fold(part, first, "concat(acc.out, array(acc.at))", "out")

    if levels == 1:
        return short(values, "0L")
    all_, chunks, firsts = f"all{levels}", f"chunks{levels}", f"firsts{levels}"
    cut = f"transform(sequence(0, cast((size({all_}) - 1) div {CHUNK} as int)), b -> slice({all_}, b * {CHUNK} + 1, {CHUNK}))"
    totals = f"transform({chunks}, c -> {fold('c', '0L', 'acc.out', 'at')})"
    each = f"flatten(transform({chunks}, (c, b) -> {short('c', f'get({firsts}, b)')}))"
    long = let(chunks, cut, let(firsts, running(totals, join, levels - 1), each))
    return let(all_, values, f"if(size({all_}) <= {CHUNK}, {short(all_, '0L')}, {long})")


def last_before(spans: str, limit: str) -> str:
    """SQL of the last of the spans, ascending by start, that starts below the limit (null: none), by halving."""
    middle = "cast((acc.low + acc.high) div 2 as int)"
    below = f"(acc.low < acc.high and get({spans}, {middle}).start < {limit})"
    step = f"named_struct('low', if({below}, {middle} + 1, acc.low), 'high', if({below}, acc.high, {middle}))"
    steps = f"sequence(0, cast(ceil(log2(size({spans}) + 2)) as int))"
    return f"aggregate({steps}, named_struct('low', 0, 'high', size({spans})), (acc, k) -> {step}, acc -> get({spans}, acc.low - 1))"


def kept(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: test(s["match"]))


def ordered(spans_by_kind: list[tuple[str, Column]]) -> Column:
    """array<struct<start, rank, end, kind, from, to>> by start, then the kinds' order."""

    def part(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                s["from"].alias("from"),
                s["to"].alias("to"),
            ),
        )

    parts = [part(rank, kind, spans) for rank, (kind, spans) in enumerate(spans_by_kind)]
    return F.array_sort(F.concat(*parts))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, of ordered spans."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
