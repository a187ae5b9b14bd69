import decimal
import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import bits, codecs, expiry, lists, strings
from keyloom.functions.glob import glob, glob_regex
from keyloom.operators import lookup, merge, mutate, setops


def one(spark, column, **values):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    out = df.select(column.alias("x")).first()["x"]
    return bytes(out) if isinstance(out, bytearray) else out


TRUE = [("test2", p) for p in ("test2", "test*", "test?", "*test2", "*est2", "?est2", "t?st2", "te?t2", "*test*", "*t*st*", "[te]est2", "[te]est*", "t[te]st2", "t[te]st*", "t[e-t]st2", "t[t-e]st2", "t[^a-d]st2")] + [("test22", "test*"), ("a*b", "a\\*b"), ("a\nb", "a?b")]
FALSE = [("test22", "test?"), ("test2", "?st2"), ("test2", "t?t2"), ("test2", "t[^te]st2"), ("test2", "t[^te]st*"), ("test2", "t[^e-t]st2"), ("test2", "t[a-d]st2"), ("axb", "a\\*b")]


def test_glob(spark):
    pairs = spark.createDataFrame([(k,) for k in {k for k, _ in TRUE + FALSE}], "key string")
    for wanted, cases in ((True, TRUE), (False, FALSE)):
        for key, pattern in cases:
            assert pairs.where((F.col("key") == key) & glob("key", pattern)).isEmpty() != wanted, (key, pattern)
    with pytest.raises(ValueError):
        glob_regex("a[bc")


def test_bits(spark):
    value = F.lit(None).cast("binary")
    for p in (2, 3, 5, 10, 11, 14):
        value = bits.set_bit(value, p, 1)
    assert one(spark, value) == b"42"
    assert one(spark, bits.set_bit(F.lit(b"@"), 2, 1)) == bytes([0b01100000])
    assert [one(spark, bits.get_bit(F.lit(b"`"), p)) for p in (0, 1, 2, 3, 99)] == [0, 1, 1, 0, 0]
    assert [one(spark, bits.bit_count(F.lit(v), *r)) for v, r in ((b"foobar", ()), (b"foobar", (0, 0)), (b"foobar", (1, 1)), (b"foobar", (-2, -1)), (b"", ()), (b"ab", (5, 9)))] == [26, 4, 6, 7, 0, 0]
    for bad in (-1, 2**32):
        with pytest.raises(ValueError):
            bits.set_bit(value, bad, 1)


def test_strings(spark):
    text = F.lit(b"This is a string")
    assert [one(spark, strings.get_range(text, *r)) for r in ((0, 3), (-3, -1), (0, -1), (10, 100), (5, 2), (50, 60))] == [b"This", b"ing", b"This is a string", b"string", b"", b""]
    assert one(spark, strings.set_range(F.lit(b"Hello World"), 6, b"Redis")) == b"Hello Redis"
    assert one(spark, strings.set_range(F.lit(None).cast("binary"), 3, b"zz")) == b"\0\0\0zz"
    assert one(spark, strings.set_range(F.lit(b"abc"), -1, b"Q")) == b"abQ"
    assert one(spark, strings.append(F.lit(b"success"), F.lit(b"andsuccess"))) == b"successandsuccess"
    assert one(spark, strings.strlen(F.lit("é"))) == 2 and one(spark, strings.strlen(F.lit(None).cast("string"))) == 0
    with pytest.raises(Exception, match="(?i)overflow"):
        one(spark, strings.increment(F.col("v"), F.lit(1).cast("long")), v=2**63 - 1)


def test_lists(spark):
    l = F.array(*map(F.lit, "abcabca"))
    assert one(spark, lists.positions(l, F.lit("a"), rank=-1)) == 6
    assert one(spark, lists.positions(l, F.lit("a"), count=2)) == [0, 3]
    assert one(spark, lists.positions(l, F.lit("a"), rank=-1, count=0, limit=4)) == [6, 3]
    assert one(spark, lists.cut(l, -3, -2)) == ["b", "c"] and one(spark, lists.cut(l, 0, 0)) == ["a"] and one(spark, lists.cut(l, 9, 12)) == []
    assert one(spark, lists.pop_right(l, 9)[0]) == list("acbacba") and one(spark, lists.pop_right(l, 9)[1]) is None
    with pytest.raises(Exception, match="out of range"):
        one(spark, lists.put(l, 7, F.lit("x")))


def test_integer_codecs(spark):
    for kind, values in {"i8": [-128, -1, 0, 127], "u8": [0, 255], "i16": [-(2**15), 2**15 - 1], "u16": [0, 2**16 - 1], "i32": [-(2**31), -1, 2**31 - 1], "u32": [0, 2**32 - 1], "i64": [-(2**63), -1, 0, 2**63 - 1]}.items():
        df = spark.createDataFrame([(v,) for v in values], "v long").select("v", codecs.encode_integer(F.col("v"), kind).alias("e"))
        for r in df.select("v", "e", codecs.decode_integer(F.col("e"), kind).alias("b")).collect():
            n = codecs.WIDTHS[kind]
            assert bytes(r.e) == (r.v % 2 ** (8 * n)).to_bytes(n, "little") and r.b == r.v


def test_other_codecs(spark):
    floats = [0.0, -0.0, 1.5, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(x,) for x in floats], "x double")
    for r in df.select("x", codecs.decode_float(codecs.encode_float(F.col("x"))).alias("y")).collect():
        assert r.x == r.y and math.copysign(1, r.x) == math.copysign(1, r.y) or math.isnan(r.x) and (r.y is None or math.isnan(r.y))
    numbers = [decimal.Decimal(x) for x in ("0", "1.50", "-79228162514264337593.543950", "0.000000000000000001")]
    df = spark.createDataFrame([(x,) for x in numbers], "x decimal(38,18)")
    assert all(r.x == r.y for r in df.select("x", codecs.decode_decimal(codecs.encode_decimal(F.col("x"))).alias("y")).collect())
    guid = "00112233-4455-6677-8899-aabbccddeeff"
    df = spark.createDataFrame([(guid,)], "x string").select(codecs.encode_guid(F.col("x")).alias("e")).select("e", codecs.decode_guid(F.col("e")).alias("y"))
    assert df.first()["y"] == guid and bytes(df.first()["e"]).hex() == "33221100554477668899aabbccddeeff"
    maybe = codecs.encode_nullable(F.col("v"), codecs.encode_string(F.coalesce("v", F.lit(""))))
    df = spark.createDataFrame([("a",), (None,), ("",)], "v string").select("v", codecs.decode_nullable(maybe, codecs.decode_string).alias("w"))
    assert all(r.v == r.w for r in df.collect())
    assert one(spark, codecs.decode_bool(codecs.encode_bool(F.lit(True)))) is True
    with pytest.raises(Exception, match="null string"):
        one(spark, codecs.encode_string(F.lit(None).cast("string")))


def test_expiry(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:10"))
    at = lambda s: F.to_timestamp(F.lit(s))
    assert one(spark, expiry.remaining(at("2024-01-01 00:00:12.500"), now, F.lit(True))) == 2
    assert one(spark, expiry.remaining(at("2024-01-01 00:00:12.500"), now, F.lit(True), "ms")) == 2500
    assert one(spark, expiry.remaining(at("2024-01-01 00:00:09"), now, F.lit(True))) == -2
    assert one(spark, expiry.remaining(F.lit(None).cast("timestamp"), now, F.lit(True))) == -1
    assert one(spark, expiry.remaining(F.lit(None).cast("timestamp"), now, F.lit(None).cast("boolean"))) == -2
    assert one(spark, expiry.expire_reply(expiry.expire_in(now, F.lit(-1)), now, F.lit(True))) == 0


def frame(spark, rows, schema="key string, value string"):
    return spark.createDataFrame(rows, schema)


def test_try_add_many(spark):
    have: list = []
    for batch, want in (("a", (1, 0)), ("a", (0, 1)), ("ba", (1, 1)), ("badc", (2, 2))):
        ops = frame(spark, [(i, k, k) for i, k in enumerate(batch)], "seq long, key string, value string")
        snapshot = frame(spark, have)
        got = mutate.try_add_counts(snapshot, ops).first()
        assert (got.n_added, got.n_existing) == want
        have += [tuple(r) for r in mutate.try_add(snapshot, ops).collect()]


def test_ranges_and_replay(spark):
    snapshot = spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("value"))
    for low, high, n in ((0, 99, 100), (50, 200, 50), (1, 50, 50), (50, 40, 0), (200, 210, 0), (99, 99, 1), (0, 0, 1), (100, 100, 0)):
        assert lookup.key_range(snapshot, low, high).count() == n
    base = [("a", "1", 0, False), ("b", "2", 1, False), ("c", "3", 2, False), ("d", "4", 3, False)]
    tail = [("b", "5", 4, False), ("e", "6", 5, False), ("d", None, 6, True)]
    log = frame(spark, base + tail, "key string, value string, seq long, deleted boolean")
    assert {r.key: r.value for r in merge.snapshot(log).collect()} == {"a": "1", "b": "5", "c": "3", "e": "6"}
    runs = [frame(spark, [(x,) for x in xs], "key long") for xs in ([0, 2, 4, 6], [0, 1, 3, 5, 7])]
    assert sorted(r.key for r in merge.merge_runs([r.withColumn("value", F.lit(1)) for r in runs]).collect()) == list(range(8))


def test_sets(spark):
    of = lambda members: frame(spark, [(x,) for x in members], "key string")
    read = lambda df: "".join(sorted(r.key for r in df.collect()))
    a = of("abcdef")
    assert read(setops.subtract(a, of("c3klf"))) == "abde" and read(setops.symmetric_difference(a, of("c3klfc"))) == "3abdekl"
    assert read(setops.intersect(a, of("acdfg"))) == "acdf" and read(setops.union(a, of("agg"))) == "abcdefg"
    names = ("is_subset", "is_superset", "is_proper_subset", "is_proper_superset", "overlaps", "set_equals")
    flags = lambda x, y: [n for n in names if setops.predicates(of(x), of(y)).first()[n]]
    assert flags("acdf", "abcdef") == ["is_subset", "is_proper_subset", "overlaps"]
    assert flags("abcdef", "abcdefa") == ["is_subset", "is_superset", "overlaps", "set_equals"]
    assert flags("acdfg", "abcdef") == ["overlaps"] and flags("abcdef", "") == ["is_superset", "is_proper_superset"]
    smallest, rest = setops.take_smallest(a)
    assert read(smallest) == "a" and read(rest) == "bcdef"


def test_conditional_changes(spark):
    snapshot = frame(spark, [("a", "1"), ("b", "2")])
    ops = frame(spark, [("a", "1", "9"), ("b", "x", "9"), ("c", "1", "9")], "key string, expected string, value string")
    assert {r.key: (r.value, r.updated) for r in mutate.compare_and_set(snapshot, ops).collect()} == {"a": ("9", True), "b": ("2", False)}
    moved = mutate.rename(snapshot, frame(spark, [("a", "b"), ("q", "z")], "key string, target string"))
    assert [tuple(r) for r in moved.collect()] == [("b", "1")]
    folded = mutate.add_or_update(snapshot, frame(spark, [(1, "a", 5), (2, "n", 6), (3, "n", 7)], "seq long, key string, v long"), lambda op: op["v"], lambda old, op: old + op["v"], "long")
    assert {r.key: r.value for r in folded.collect()} == {"a": 6, "b": 2, "n": 13}
    ops = frame(spark, [(1, "a", "x"), (2, "c", "y"), (3, "c", "z")], "seq long, key string, value string")
    assert sorted(tuple(r) for r in mutate.get_or_add(snapshot, ops).collect()) == [(1, "a", "1", False), (2, "c", "y", True), (3, "c", "y", False)]
    assert mutate.set_if_none_exists(snapshot, ops).isEmpty() and {r.key: r.previous for r in mutate.get_set(snapshot, ops).where("seq < 3").collect()} == {"a": "1", "c": None}


def test_set_with_expiry(spark):
    ops = frame(
        spark,
        [(1, "a", "1", None, 5, False, 0), (2, "a", "2", "NX", None, False, 4), (3, "a", "3", None, None, True, 4), (4, "b", "1", "XX", None, False, 0), (5, "a", "4", "NX", None, False, 6), (6, "c", "1", None, 0, False, 0)],
        "seq long, key string, value string, mode string, ttl long, keep boolean, s long",
    ).withColumn("at", F.timestamp_seconds("s")).drop("s")
    empty = frame(spark, [], "key string, value string, expires_at timestamp")
    until = lambda n: {r.key: (r.value, r.e) for r in mutate.set_with_expiry(empty, ops.where(F.col("seq") <= n)).select("key", "value", F.unix_seconds("expires_at").alias("e")).collect()}
    assert until(3) == {"a": ("3", 5)} and until(6) == {"a": ("4", None)}
