"""Named queries over the driver's tables and the SQL that states the same result.

Roles: events is an operation log (key user_id, seq event_id; event_type 'error' removes); customer and orders are
snapshots; supplier, part and documents give values for scalar functions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import bits, codecs, expiry, lists, sets, strings
from keyloom.operators import commands, info, lookup, merge, mutate, setops
from keyloom.sources import dump
from keyloom.sources.shared import shared_dir
from keyloom.sources.store import Store, tablespaces
from keyloom.streaming import upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-15 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of puts and removals."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.floor("value").cast("long").alias("value"),
        F.col("event_type"),
        (F.col("event_type") == "error").alias("deleted"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value")
    )


LAST = "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)"


# --- merge ------------------------------------------------------------------------------------------------------------


@query(
    "merge_latest",
    f"SELECT user_id AS key, event_id AS seq, floor(value)::BIGINT AS value FROM (SELECT *, {LAST} AS r FROM events) "
    "WHERE r = 1 AND event_type <> 'error'",
)
def merge_latest(spark, d):
    return merge.snapshot(log(spark, d).select("key", "value", "seq", "deleted")).select("key", "seq", "value")


@query(
    "merge_tombstones_kept",
    f"SELECT user_id AS key, event_type = 'error' AS deleted FROM (SELECT *, {LAST} AS r FROM events) WHERE r = 1",
)
def merge_tombstones_kept(spark, d):
    return merge.newest(log(spark, d).select("key", "seq", "deleted")).select("key", "deleted")


@query(
    "merge_multi_run",
    """SELECT key, value FROM (SELECT user_id AS key, floor(value)::BIGINT AS value,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def merge_multi_run(spark, d):
    events = log(spark, d).select("key", "seq", "value")
    runs = [events.where(F.col("seq") % 3 == k) for k in range(3)]
    return merge.merge_runs(runs, seq="seq").select("key", "value")


@query(
    "compact_stale",
    f"""SELECT user_id AS key, floor(value)::BIGINT AS value FROM (SELECT *, {LAST} AS r FROM events)
        WHERE r = 1 AND event_type <> 'error' AND NOT (floor(value) < 20 OR user_id % 7 = 0)""",
)
def compact_stale(spark, d):
    rows = log(spark, d).select("key", "value", "seq", "deleted")
    return merge.compacted(rows, [F.col("value") < 20, F.col("key") % 7 == 0]).select("key", "value")


# --- lookups and scans ------------------------------------------------------------------------------------------------


@query("point_get", "SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey = 42")
def point_get(spark, d):
    return lookup.get(customers(spark, d), 42)


REQUESTS = "SELECT o_orderkey AS seq, o_custkey * 2 AS key FROM orders"


def requests(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("key"))


@query("multi_get", f"SELECT r.seq, r.key, c_name AS value FROM ({REQUESTS}) r LEFT JOIN customer ON key = c_custkey")
def multi_get(spark, d):
    return lookup.multi_get(requests(spark, d), customers(spark, d)).select("seq", "key", "value")


@query("contains_flags", f"SELECT r.seq, r.key, c_custkey IS NOT NULL AS present FROM ({REQUESTS}) r LEFT JOIN customer ON key = c_custkey")
def contains_flags(spark, d):
    return lookup.contains(requests(spark, d), customers(spark, d)).select("seq", "key", "present")


@query("exists_count", f"SELECT count(*)::BIGINT AS n FROM ({REQUESTS}) WHERE key IN (SELECT c_custkey FROM customer)")
def exists_count(spark, d):
    return lookup.exists_count(requests(spark, d), customers(spark, d))


@query("key_scan", "SELECT c_custkey AS key FROM customer")
def key_scan(spark, d):
    return lookup.keys(customers(spark, d))


@query("value_scan", "SELECT c_name AS value FROM customer")
def value_scan(spark, d):
    return lookup.values(lookup.scan(customers(spark, d)))


def _range(name: str, low: int, high: int) -> None:
    @query(name, f"SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey BETWEEN {low} AND {high}")
    def run(spark, d):
        orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
        return lookup.key_range(orders, low, high)


_range("range_inclusive", 100, 900)
_range("range_empty", 900, 100)
_range("range_single", 32, 32)


def names(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))


@query("prefix_scan", "SELECT c_name AS key, c_custkey AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_scan(spark, d):
    return lookup.prefix(names(spark, d), "Customer#00000001")


def _glob(name: str, pattern: str, theirs: str) -> None:
    @query(name, f"SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_name GLOB '{theirs}'")
    def run(spark, d):
        return lookup.matching(names(spark, d), pattern)


_glob("keys_glob", "Customer#*1?", "Customer#*1?")
_glob("keys_glob_class", "C*[1-3]", "C*[1-3]")
_glob("keys_glob_neg", "Customer#0*[^0-7]", "Customer#0*[!0-7]")


@query("decode_projection", "SELECT c_custkey AS key, upper(c_name) AS value FROM customer")
def decode_projection(spark, d):
    raw = customers(spark, d).select(codecs.encode_integer(F.col("key"), "i64").alias("key"), codecs.encode_string(F.col("value")).alias("value"))
    return lookup.decode(raw, codecs.decode_integer(F.col("key"), "i64"), F.upper(codecs.decode_string(F.col("value"))))


# --- mutations --------------------------------------------------------------------------------------------------------

LAST_ORDER = "SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1"
SUBSET = "SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 5 > 0"


def subset(spark, d):
    c = table(spark, d, "customer").where(F.col("c_custkey") % 5 > 0)
    return c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))


def some_ops(spark, d):
    return order_ops(spark, d).where(F.col("key") % 3 > 0)


@query("set_value_upsert", f"SELECT coalesce(s.key, o.key) AS key, coalesce(o.v, s.value) AS value FROM ({SUBSET}) s FULL JOIN ({LAST_ORDER}) o ON s.key = o.key")
def set_value_upsert(spark, d):
    return mutate.upsert(subset(spark, d), some_ops(spark, d))


@query("set_value_changed", f"SELECT o.key, o.v AS value FROM ({LAST_ORDER}) o LEFT JOIN ({SUBSET}) s ON s.key = o.key WHERE s.key IS NULL OR s.value IS DISTINCT FROM o.v")
def set_value_changed(spark, d):
    return mutate.changed(subset(spark, d), some_ops(spark, d))


@query("try_add", f"SELECT o_custkey AS key, arg_min(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_custkey % 3 > 0 AND o_custkey NOT IN (SELECT key FROM ({SUBSET})) GROUP BY 1")
def try_add(spark, d):
    return mutate.try_add(subset(spark, d), some_ops(spark, d))


@query(
    "try_add_counts",
    f"""WITH o AS (SELECT o_custkey AS key FROM orders WHERE o_custkey % 3 > 0), s AS ({SUBSET}),
    a AS (SELECT count(DISTINCT key) AS n FROM o WHERE key NOT IN (SELECT key FROM s))
    SELECT a.n::BIGINT AS n_added, ((SELECT count(*) FROM o) - a.n)::BIGINT AS n_existing FROM a""",
)
def try_add_counts(spark, d):
    got = mutate.try_add_counts(subset(spark, d), some_ops(spark, d))
    return got.select(F.col("n_added").cast("long").alias("n_added"), F.col("n_existing").cast("long").alias("n_existing"))


@query(
    "get_or_add",
    f"""WITH s AS ({SUBSET}), o AS (SELECT o_orderkey AS seq, o_custkey AS key, o_orderstatus AS v FROM orders WHERE o_custkey % 3 > 0)
    SELECT o.seq, o.key, CASE WHEN s.key IS NOT NULL THEN s.value ELSE first_value(o.v) OVER w END AS value,
    s.key IS NULL AND row_number() OVER w = 1 AS added FROM o LEFT JOIN s USING (key) WINDOW w AS (PARTITION BY o.key ORDER BY o.seq)""",
)
def get_or_add(spark, d):
    return mutate.get_or_add(subset(spark, d), some_ops(spark, d))


GONE = "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 100000"


def gone(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("key"))


@query("try_remove_keys", f"SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM ({GONE}))")
def try_remove_keys(spark, d):
    return mutate.remove(customers(spark, d), gone(spark, d))


@query("try_remove_count", f"SELECT count(*)::BIGINT AS n_removed FROM customer WHERE c_custkey IN (SELECT key FROM ({GONE}))")
def try_remove_count(spark, d):
    return mutate.removed_count(customers(spark, d), gone(spark, d))


@query(
    "cas_update",
    """SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS value,
    o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS updated FROM orders""",
)
def cas_update(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    ops = orders.where(F.col("key") % 2 == 0).select("key", F.lit("O").alias("expected"), F.lit("F").alias("value"))
    return mutate.compare_and_set(orders, ops)


@query(
    "try_update_if",
    """SELECT o_orderkey AS key, o_orderpriority LIKE '1%' AS updated,
    CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus || '!' ELSE o_orderstatus END AS value FROM orders""",
)
def try_update_if(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderpriority")
    done = mutate.try_update(orders, F.col("o_orderpriority").startswith("1"), F.concat("value", F.lit("!")))
    return done.select("key", "updated", "value")


@query(
    "add_or_update_fold",
    """WITH e AS (SELECT user_id AS key, event_id, event_type, floor(value)::BIGINT AS v,
      max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS last_set,
      min(event_id) OVER (PARTITION BY user_id) AS first_op FROM events)
    SELECT key, (max(CASE WHEN event_id = coalesce(last_set, first_op) THEN CASE WHEN last_set IS NULL THEN 1 ELSE v END END)
      + count(*) FILTER (event_id > coalesce(last_set, first_op)))::BIGINT AS value FROM e GROUP BY key""",
)
def add_or_update_fold(spark, d):
    """signup sets the value, any other event adds one."""
    ops = log(spark, d).select("key", "seq", "event_type", "value")
    empty = spark.createDataFrame([], "key long, value long")
    one = F.lit(1).cast("long")
    return mutate.add_or_update(
        empty,
        ops,
        lambda op: F.when(op["event_type"] == "signup", op["value"]).otherwise(one),
        lambda old, op: F.when(op["event_type"] == "signup", op["value"]).otherwise(old + one),
        "long",
    )


@query(
    "getset_prev",
    f"""WITH s AS ({SUBSET}), o AS (SELECT o_orderkey AS seq, o_custkey AS key, o_orderstatus AS v FROM orders)
    SELECT o.seq, o.key, CASE WHEN row_number() OVER w = 1 THEN s.value ELSE lag(o.v) OVER w END AS previous
    FROM o LEFT JOIN s USING (key) WINDOW w AS (PARTITION BY o.key ORDER BY o.seq)""",
)
def getset_prev(spark, d):
    return mutate.get_set(subset(spark, d), order_ops(spark, d))


@query("msetnx_gate", f"SELECT key + 10000000 AS key, value FROM ({SUBSET})")
def msetnx_gate(spark, d):
    """A batch of fresh keys goes in whole; one that holds a taken key not at all."""
    have = subset(spark, d)
    fresh = have.select((F.col("key") + 10_000_000).alias("key"), "value")
    taken = fresh.union(have.limit(1))
    return mutate.set_if_none_exists(have, fresh).union(mutate.set_if_none_exists(have, taken))


@query(
    "rename_keys",
    f"""WITH s AS ({SUBSET}), n AS (SELECT key, key + 1 AS target FROM (SELECT range * 4 AS key FROM range(1, 200)))
    SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM n) AND key NOT IN (SELECT target FROM n)
    UNION ALL SELECT target, value FROM s JOIN n USING (key)""",
)
def rename_keys(spark, d):
    moves = spark.range(1, 200).select((F.col("id") * 4).alias("key"), (F.col("id") * 4 + 1).alias("target"))
    return mutate.rename(subset(spark, d), moves)


@query(
    "set_value_expiry_modes",
    """WITH e AS (SELECT user_id AS key, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1)
    SELECT key, first_id AS value, NULL::BIGINT AS expires_us FROM e""",
)
def set_value_expiry_modes(spark, d):
    """Every operation is SET NX, so the first one stays."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    ops = events.select(
        "key", "seq", F.col("seq").alias("value"), F.lit("NX").alias("mode"), F.lit(None).cast("long").alias("ttl"), F.lit(False).alias("keep"), "at"
    )
    empty = spark.createDataFrame([], "key long, value long, expires_at timestamp")
    return mutate.set_with_expiry(empty, ops).select("key", "value", F.unix_micros("expires_at").alias("expires_us"))


@query(
    "set_value_with_ttl",
    """SELECT user_id AS key, max(event_id)::BIGINT AS value, epoch_us(arg_max(ts, event_id)) // 1000000 + 60 AS expires_s
    FROM events GROUP BY 1""",
)
def set_value_with_ttl(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    ops = events.select(
        "key", "seq", F.col("seq").alias("value"), F.lit(None).cast("string").alias("mode"), F.lit(60).cast("long").alias("ttl"), F.lit(False).alias("keep"), "at"
    )
    empty = spark.createDataFrame([], "key long, value long, expires_at timestamp")
    return mutate.set_with_expiry(empty, ops).select("key", "value", F.unix_seconds("expires_at").alias("expires_s"))


# --- set algebra ------------------------------------------------------------------------------------------------------

A_SQL = "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 10 = 0"
B_SQL = "SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0"


def side_a(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") % 10 == 0).select(F.col("o_custkey").alias("key"))


def side_b(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("key"))


def _algebra(name: str, op: Callable, sql: str) -> None:
    @query(name, sql)
    def run(spark, d):
        return op(side_a(spark, d), side_b(spark, d))


_algebra("set_union", setops.union, f"{A_SQL} UNION {B_SQL}")
_algebra("set_except", setops.subtract, f"{A_SQL} EXCEPT {B_SQL}")
_algebra("set_intersect", setops.intersect, f"{A_SQL} INTERSECT {B_SQL}")
_algebra("set_symdiff", setops.symmetric_difference, f"({A_SQL} EXCEPT {B_SQL}) UNION ({B_SQL} EXCEPT {A_SQL})")
PREDICATES_SQL = """WITH a AS ({a}), b AS ({b}), n AS (SELECT
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS x,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS y,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS z)
SELECT x = 0 AS is_subset, y = 0 AS is_superset, x = 0 AND y > 0 AS is_proper_subset, y = 0 AND x > 0 AS is_proper_superset,
  z > 0 AS overlaps, x = 0 AND y = 0 AS set_equals FROM n"""
_algebra("set_predicates", setops.predicates, PREDICATES_SQL.format(a=A_SQL, b=B_SQL))


@query("set_predicates_subset", PREDICATES_SQL.format(a=A_SQL, b="SELECT c_custkey AS key FROM customer"))
def set_predicates_subset(spark, d):
    return setops.predicates(side_a(spark, d), customers(spark, d).select("key"))


@query("set_take_min", f"SELECT min(key) AS key FROM ({A_SQL})")
def set_take_min(spark, d):
    return setops.take_smallest(side_a(spark, d))[0]


# --- counts and statistics --------------------------------------------------------------------------------------------


@query("count_keys", "SELECT count(*)::BIGINT AS n FROM customer")
def count_keys(spark, d):
    return info.count(customers(spark, d))


@query(
    "info_stats",
    """SELECT count(*)::BIGINT AS n, min(8)::BIGINT AS key_min, max(8)::BIGINT AS key_max, (8 * count(*))::BIGINT AS key_sum,
    min(strlen(text))::BIGINT AS value_min, max(strlen(text))::BIGINT AS value_max, sum(strlen(text))::BIGINT AS value_sum,
    count(*) FILTER (strlen(text) <= 9)::BIGINT AS n_inlined, 8::DOUBLE AS key_avg,
    sum(strlen(text))::DOUBLE / count(text) AS value_avg FROM documents""",
)
def info_stats(spark, d):
    rows = table(spark, d, "documents").select(codecs.encode_integer(F.col("doc_id"), "i64").alias("key"), F.col("text").alias("value"))
    return info.statistics(rows)


# --- strings and integers ---------------------------------------------------------------------------------------------


@query("strlen", "SELECT doc_id AS key, strlen(text)::BIGINT AS n FROM documents")
def strlen(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), strings.strlen(F.col("text")).alias("n"))


@query("append_fold", "SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY 1")
def append_fold(spark, d):
    return log(spark, d).groupBy("key").agg(strings.append_all(F.col("seq"), F.col("event_type")).alias("value"))


def _on_names(name: str, make: Callable, sql: str) -> None:
    @query(name, f"SELECT s_suppkey AS key, {sql} AS value FROM supplier")
    def run(spark, d):
        raw = F.col("s_name").cast("binary")
        return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), make(raw).alias("value"))


_on_names("getrange", lambda v: F.decode(strings.get_range(v, 2, 5), "UTF-8"), "substr(s_name, 3, 4)")
_on_names("getrange_neg", lambda v: F.decode(strings.get_range(v, -4, -2), "UTF-8"), "substr(s_name, length(s_name) - 3, 3)")
_on_names("getrange_clamped", lambda v: F.decode(strings.get_range(v, -999, 999), "UTF-8"), "s_name")
_on_names("getrange_empty", lambda v: F.decode(strings.get_range(v, 5, 2), "UTF-8"), "''")
_on_names("setrange", lambda v: F.hex(strings.set_range(v, 30, b"zz")), "hex(encode(s_name)) || repeat('00', 30 - strlen(s_name)::INT) || '7A7A'")
_on_names("setrange_inside", lambda v: F.decode(strings.set_range(v, 1, b"XY"), "UTF-8"), "s_name[1] || 'XY' || substr(s_name, 4)")
_on_names("setrange_neg", lambda v: F.decode(strings.set_range(v, -3, b"Q"), "UTF-8"), "substr(s_name, 1, length(s_name) - 3) || 'Q' || substr(s_name, length(s_name) - 1)")
_on_names("getbit", lambda v: bits.get_bit(v, 10), "get_bit(encode(s_name)::BIT, 10)")
_on_names("getbit_past", lambda v: bits.get_bit(v, 100000), "0")
_on_names("setbit", lambda v: F.hex(bits.set_bit(v, 7, 1)), "hex(set_bit(encode(s_name)::BIT, 7, 1)::BLOB)")
_on_names("setbit_zero", lambda v: F.hex(bits.set_bit(v, 1, 0)), "hex(set_bit(encode(s_name)::BIT, 1, 0)::BLOB)")
_on_names("bitcount", lambda v: bits.bit_count(v), "bit_count(encode(s_name)::BIT)::BIGINT")
_on_names("bitcount_range", lambda v: bits.bit_count(v, 1, -3), "bit_count(encode(substr(s_name, 2, length(s_name) - 3))::BIT)::BIGINT")


@query("incrby_sum", "SELECT user_id AS key, sum(floor(value)::BIGINT)::BIGINT AS value FROM events GROUP BY 1")
def incrby_sum(spark, d):
    """A batch of INCRBY alone is a sum."""
    return log(spark, d).groupBy("key").agg(strings.increment(F.sum("value"), F.lit(0).cast("long")).alias("value"))


@query("incr_running", "SELECT event_id AS seq, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS reply FROM events")
def incr_running(spark, d):
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log(spark, d).select("seq", "key", F.sum(F.lit(1).cast("long")).over(order).alias("reply"))


@query("parse_integer", "SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS value FROM events")
def parse_integer(spark, d):
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(strings.integer_text(F.col("event_id")))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), strings.parse_integer(shown).alias("value"))


# --- expiry -----------------------------------------------------------------------------------------------------------


def timed(spark, d):
    """The last event of each user, with an expiry a day after it unless the user id is divisible by 4."""
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").cast("timestamp").alias("ts"))
    day = expiry.expire_in(F.col("ts"), F.lit(86400))
    return last.select("key", F.when(F.col("key") % 4 != 0, day).alias("expires_at"))


TIMED = "SELECT user_id AS key, CASE WHEN user_id % 4 <> 0 THEN max(ts) + INTERVAL 1 DAY END AS expires_at FROM events GROUP BY 1"


def now():
    return F.to_timestamp(F.lit(NOW))


LEFT = f"epoch_us(expires_at) - epoch_us(TIMESTAMP '{NOW}')"


@query("ttl_remaining", f"SELECT key, CASE WHEN expires_at IS NULL THEN -1 WHEN expires_at < TIMESTAMP '{NOW}' THEN -2 ELSE ({LEFT}) // 1000000 END::BIGINT AS ttl FROM ({TIMED})")
def ttl_remaining(spark, d):
    return timed(spark, d).select("key", expiry.remaining(F.col("expires_at"), now(), F.lit(True)).alias("ttl"))


@query("pttl_remaining", f"SELECT key, CASE WHEN expires_at IS NULL THEN -1 WHEN expires_at < TIMESTAMP '{NOW}' THEN -2 ELSE ({LEFT}) // 1000 END::BIGINT AS ttl FROM ({TIMED})")
def pttl_remaining(spark, d):
    return timed(spark, d).select("key", expiry.remaining(F.col("expires_at"), now(), F.lit(True), "ms").alias("ttl"))


@query("ttl_live", f"SELECT key FROM ({TIMED}) WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}'")
def ttl_live(spark, d):
    return timed(spark, d).where(expiry.alive(F.col("expires_at"), now())).select("key")


@query("expire_at", f"SELECT key, (1705276800 + (key % 100 - 50) * 3600 >= 1705276800)::INT AS reply FROM ({TIMED})")
def expire_at(spark, d):
    at = expiry.expire_at(F.lit(1705276800) + (F.col("key") % 100 - 50) * 3600)
    return timed(spark, d).select("key", expiry.expire_reply(at, now(), F.lit(True)).alias("reply"))


@query("persist", f"SELECT key, (alive)::INT AS reply, CASE WHEN NOT alive THEN epoch_us(expires_at) END AS expires_us FROM (SELECT *, coalesce(expires_at >= TIMESTAMP '{NOW}', true) AS alive FROM ({TIMED}))")
def persist(spark, d):
    done = timed(spark, d).select("key", expiry.persist(F.col("expires_at"), now(), F.lit(True)).alias("p"))
    return done.select("key", F.col("p.reply").alias("reply"), F.unix_micros("p.expires_at").alias("expires_us"))


@query("time_parts", f"SELECT 1705276800::BIGINT AS seconds, 0::BIGINT AS micros")
def time_parts(spark, d):
    parts = expiry.clock(now())
    return spark.range(1).select(parts[0].alias("seconds"), parts[1].cast("long").alias("micros"))


# --- lists ------------------------------------------------------------------------------------------------------------

LISTS = "SELECT user_id AS key, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1"


def event_lists(spark, d):
    return log(spark, d).groupBy("key").agg(lists.from_rows(F.col("seq"), F.col("event_type")).alias("l"))


def _on_lists(name: str, make: Callable, sql: str) -> None:
    @query(name, f"SELECT key, {sql} AS value FROM ({LISTS})")
    def run(spark, d):
        return event_lists(spark, d).select("key", make(F.col("l")).alias("value"))


def shown(items):
    return F.array_join(items, ",")


_on_lists("list_build", shown, "array_to_string(l, ',')")
_on_lists("list_rpush", lambda l: shown(lists.push_right(l, F.lit("y"), F.lit("z"))), "array_to_string(l || ['y', 'z'], ',')")
_on_lists("list_lpush", lambda l: shown(lists.push_left(l, F.lit("y"), F.lit("z"))), "array_to_string(['z', 'y'] || l, ',')")
_on_lists("lpop_n", lambda l: shown(lists.pop_left(l, 2)[0]), "array_to_string(l[1:2], ',')")
_on_lists("lpop_rest", lambda l: shown(lists.pop_left(l, 2)[1]), "CASE WHEN len(l) > 2 THEN array_to_string(l[3:], ',') END")
_on_lists("rpop_n", lambda l: shown(lists.pop_right(l, 2)[0]), "array_to_string(list_reverse(l[greatest(len(l) - 1, 1):]), ',')")
_on_lists("rpop_rest", lambda l: shown(lists.pop_right(l, 2)[1]), "CASE WHEN len(l) > 2 THEN array_to_string(l[1:len(l) - 2], ',') END")
_on_lists("llen", lambda l: lists.length(l).cast("long"), "len(l)::BIGINT")
_on_lists("lindex", lambda l: lists.at(l, 2), "l[3]")
_on_lists("lindex_neg", lambda l: lists.at(l, -2), "CASE WHEN len(l) >= 2 THEN l[len(l) - 1] END")
_on_lists("lset", lambda l: shown(lists.put(l, 0, F.lit("zz"))), "array_to_string(['zz'] || l[2:], ',')")
_on_lists("lrange", lambda l: shown(lists.cut(l, 1, 3)), "array_to_string(l[2:4], ',')")
_on_lists("lrange_one", lambda l: shown(lists.cut(l, 0, 0)), "l[1]")
_on_lists("lrange_neg", lambda l: shown(lists.cut(l, -3, -1)), "array_to_string(l[greatest(len(l) - 2, 1):], ',')")
HITS = "list_filter(list_transform(l, lambda x, i: CASE WHEN x = 'click' THEN (i - 1)::BIGINT END), lambda y: y IS NOT NULL)"
_on_lists("lpos_first", lambda l: lists.positions(l, F.lit("click")), f"({HITS})[1]")
_on_lists("lpos_all", lambda l: F.array_join(lists.positions(l, F.lit("click"), count=0).cast("array<string>"), ","), f"array_to_string({HITS}, ',')")
_on_lists("lpos_rank_neg", lambda l: F.array_join(lists.positions(l, F.lit("click"), rank=-2, count=2).cast("array<string>"), ","), f"array_to_string(list_reverse({HITS})[2:3], ',')")
_on_lists("lpos_maxlen", lambda l: F.array_join(lists.positions(l, F.lit("click"), count=0, limit=5).cast("array<string>"), ","), f"array_to_string(list_filter({HITS}, lambda y: y < 5), ',')")

# --- sets -------------------------------------------------------------------------------------------------------------

MEMBERS = "SELECT DISTINCT user_id AS key, event_type AS member FROM events WHERE event_id % 3 = 0"
NEW = "SELECT DISTINCT user_id AS key, event_type AS member FROM events WHERE event_id % 3 = 1"


def members(spark, d):
    return log(spark, d).where(F.col("seq") % 3 == 0).select("key", F.col("event_type").alias("member")).distinct()


def new_members(spark, d):
    return log(spark, d).where(F.col("seq") % 3 == 1).select("key", F.col("event_type").alias("member"))


@query("sadd_counts", f"SELECT n.key, count(*) FILTER (m.key IS NULL)::BIGINT AS n_added FROM ({NEW}) n LEFT JOIN ({MEMBERS}) m USING (key, member) GROUP BY 1")
def sadd_counts(spark, d):
    return sets.add(members(spark, d), new_members(spark, d))[1]


@query("sadd_result", f"{MEMBERS} UNION {NEW}")
def sadd_result(spark, d):
    return sets.add(members(spark, d), new_members(spark, d))[0]


@query("srem_counts", f"SELECT n.key, count(m.key)::BIGINT AS n_removed FROM ({NEW}) n LEFT JOIN ({MEMBERS}) m USING (key, member) GROUP BY 1")
def srem_counts(spark, d):
    return sets.remove(members(spark, d), new_members(spark, d))[1]


@query("srem_result", f"{MEMBERS} EXCEPT {NEW}")
def srem_result(spark, d):
    return sets.remove(members(spark, d), new_members(spark, d))[0]


@query("scard", f"SELECT key, count(*)::BIGINT AS n FROM ({MEMBERS}) GROUP BY 1")
def scard(spark, d):
    return sets.cardinality(members(spark, d))


@query("smembers", f"SELECT key, string_agg(member, ',' ORDER BY member) AS value FROM ({MEMBERS}) GROUP BY 1")
def smembers(spark, d):
    return members(spark, d).groupBy("key").agg(shown(sets.members_sorted(F.col("member"))).alias("value"))


@query("smismember", f"SELECT n.key, n.member, (m.key IS NOT NULL)::INT AS is_member FROM ({NEW}) n LEFT JOIN ({MEMBERS}) m USING (key, member)")
def smismember(spark, d):
    return sets.is_member(new_members(spark, d).distinct(), members(spark, d))


@query("srandmember_n", f"SELECT key, least(count(*), 2)::BIGINT AS n FROM ({MEMBERS}) GROUP BY 1")
def srandmember_n(spark, d):
    """Which members are drawn has no SQL; that they are distinct members has: others are not counted."""
    drawn = sets.random_members(members(spark, d), 2, seed=7)
    return drawn.distinct().join(members(spark, d), ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("n"))


@query("spop_rest", f"SELECT key, (count(*) - 1)::BIGINT AS n FROM ({MEMBERS}) GROUP BY 1 HAVING count(*) > 1")
def spop_rest(spark, d):
    return sets.pop(members(spark, d), 1, seed=7)[1].groupBy("key").agg(F.count("*").alias("n"))


@query("spop_whole", "SELECT DISTINCT user_id AS key, event_type AS member, 1::BIGINT AS n FROM events")
def spop_whole(spark, d):
    """What is popped and what stays are together the sets, each member once."""
    taken, rest = sets.pop(all_members(spark, d), 2, seed=7)
    return taken.select("key", "member").unionByName(rest.select("key", "member")).groupBy("key", "member").agg(F.count("*").alias("n"))


# --- whole tables ------------------------------------------------------------------------------------------------------
# The set and mutation queries above take a part of the rows by a remainder, as their SQL states. These take all: one set
# of all events; for pairs, the first day's events and all others; all orders.

ALL_MEMBERS = "SELECT DISTINCT user_id AS key, event_type AS member FROM events"
FIRST_DAY = "coalesce(ts < TIMESTAMP '2024-01-02', false)"
FIRST_MEMBERS = f"{ALL_MEMBERS} WHERE {FIRST_DAY}"
OTHER_MEMBERS = f"{ALL_MEMBERS} WHERE NOT {FIRST_DAY}"
ALL_CUSTOMERS = "SELECT c_custkey AS key, c_mktsegment AS value FROM customer"


def whole(name: str, changes: dict[str, str]) -> Callable[[Query], Query]:
    """name_all, with the SQL of name over other operands."""
    parts = re.split("(" + "|".join(re.escape(x) for x in changes) + ")", ORACLES[name])
    return query(f"{name}_all", "".join(changes.get(x, x) for x in parts))


def all_members(spark, d):
    return log(spark, d).select("key", F.col("event_type").alias("member")).distinct()


def members_by_day(spark, d):
    """(sets of the first day, sets of all other events)."""
    first = F.coalesce(F.col("ts").cast("timestamp") < F.lit("2024-01-02").cast("timestamp"), F.lit(False))
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member"), first.alias("first"))
    return tuple(e.where(c).select("key", "member").distinct() for c in (F.col("first"), ~F.col("first")))


def all_customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))


ALL = {MEMBERS: ALL_MEMBERS}
ADDED = {MEMBERS: FIRST_MEMBERS, NEW: OTHER_MEMBERS}
REMOVED = {MEMBERS: OTHER_MEMBERS, NEW: FIRST_MEMBERS}
ORDERS = {" WHERE o_custkey % 3 > 0 AND ": " WHERE ", " WHERE o_custkey % 3 > 0": ""}


@whole("scard", ALL)
def scard_all(spark, d):
    return sets.cardinality(all_members(spark, d))


@whole("smembers", ALL)
def smembers_all(spark, d):
    return all_members(spark, d).groupBy("key").agg(shown(sets.members_sorted(F.col("member"))).alias("value"))


@whole("srandmember_n", ALL)
def srandmember_n_all(spark, d):
    return sets.random_members(all_members(spark, d), 2, seed=7).groupBy("key").agg(F.count("*").alias("n"))


@whole("spop_rest", ALL)
def spop_rest_all(spark, d):
    return sets.pop(all_members(spark, d), 1, seed=7)[1].groupBy("key").agg(F.count("*").alias("n"))


@whole("sadd_counts", ADDED)
def sadd_counts_all(spark, d):
    return sets.add(*members_by_day(spark, d))[1]


@whole("sadd_result", ADDED)
def sadd_result_all(spark, d):
    return sets.add(*members_by_day(spark, d))[0]


@whole("srem_counts", REMOVED)
def srem_counts_all(spark, d):
    first, others = members_by_day(spark, d)
    return sets.remove(others, first)[1]


@whole("srem_result", REMOVED)
def srem_result_all(spark, d):
    first, others = members_by_day(spark, d)
    return sets.remove(others, first)[0]


@whole("smismember", ADDED)
def smismember_all(spark, d):
    first, others = members_by_day(spark, d)
    return sets.is_member(others, first)


@whole("set_value_upsert", {SUBSET: ALL_CUSTOMERS} | ORDERS)
def set_value_upsert_all(spark, d):
    return mutate.upsert(all_customers(spark, d), order_ops(spark, d))


@whole("set_value_changed", {SUBSET: ALL_CUSTOMERS} | ORDERS)
def set_value_changed_all(spark, d):
    return mutate.changed(all_customers(spark, d), order_ops(spark, d))


# The next three need keys that the snapshot lacks, and every order has its customer; so subset() stays their snapshot.


@whole("try_add", ORDERS)
def try_add_all(spark, d):
    return mutate.try_add(subset(spark, d), order_ops(spark, d))


@whole("try_add_counts", ORDERS)
def try_add_counts_all(spark, d):
    got = mutate.try_add_counts(subset(spark, d), order_ops(spark, d))
    return got.select(F.col("n_added").cast("long").alias("n_added"), F.col("n_existing").cast("long").alias("n_existing"))


@whole("get_or_add", ORDERS)
def get_or_add_all(spark, d):
    return mutate.get_or_add(subset(spark, d), order_ops(spark, d))


# --- codecs -----------------------------------------------------------------------------------------------------------


@query("codec_le_int", "SELECT s_suppkey AS key, printf('%02X000000', s_suppkey % 100 + 1) AS value FROM supplier")
def codec_le_int(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.hex(codecs.encode_integer(F.col("s_suppkey") % 100 + 1, "i32")).alias("value"))


@query("codec_roundtrip", "SELECT event_id AS key, -event_id AS number, event_type AS text, NULLIF(user_id % 5, 0) AS maybe, epoch_us(ts) AS us FROM events")
def codec_roundtrip(spark, d):
    e = table(spark, d, "events")
    maybe = F.nullif(F.col("user_id") % 5, F.lit(0).cast("long"))
    raw = e.select(
        "event_id",
        codecs.encode_integer(-F.col("event_id"), "i64").alias("number"),
        codecs.encode_string(F.col("event_type")).alias("text"),
        codecs.encode_nullable(maybe, codecs.encode_integer(maybe, "i32")).alias("maybe"),
        codecs.encode_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    return raw.select(
        F.col("event_id").alias("key"),
        codecs.decode_integer(F.col("number"), "i64").alias("number"),
        codecs.decode_string(F.col("text")).alias("text"),
        codecs.decode_nullable(F.col("maybe"), lambda c: codecs.decode_integer(c, "i32")).alias("maybe"),
        F.unix_micros(codecs.decode_micros(F.col("us"))).alias("us"),
    )


@query("json_value", "SELECT event_id AS key, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_value(spark, d):
    raw = table(spark, d, "events").select("event_id", F.encode("props", "UTF-8").alias("raw"))
    return raw.select(F.col("event_id").alias("key"), codecs.decode_json(F.col("raw"), "k long")["k"].alias("k"))


@query("codec_datetime", "SELECT event_id AS key, epoch_us(ts) AS us, (event_id * 7)::BIGINT AS span, event_type[1] AS c FROM events")
def codec_datetime(spark, d):
    e = table(spark, d, "events")
    raw = e.select("event_id", codecs.encode_datetime(F.col("ts").cast("timestamp")).alias("at"), codecs.encode_timespan(F.col("event_id") * 7).alias("span"), codecs.encode_char(F.col("event_type")).alias("c"))
    at = F.unix_micros(codecs.decode_datetime(F.col("at")))
    return raw.select(F.col("event_id").alias("key"), at.alias("us"), codecs.decode_timespan(F.col("span")).alias("span"), codecs.decode_char(F.col("c")).alias("c"))


@query("codec_keyspace", "SELECT event_id AS key, 0 AS kind, event_type AS name, (user_id % 3)::INT AS type, CASE WHEN event_id % 2 = 0 THEN event_id END AS expires FROM events")
def codec_keyspace(spark, d):
    e = table(spark, d, "events")
    expires = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    raw = e.select("event_id", codecs.encode_key(F.col("event_type")).alias("k"), codecs.encode_value(F.col("user_id") % 3, F.encode("props", "UTF-8"), expires).alias("v"))
    back = raw.select("event_id", codecs.decode_key(F.col("k")).alias("k"), codecs.decode_value(F.col("v")).alias("v"))
    return back.select(F.col("event_id").alias("key"), "k.kind", F.decode("k.key", "UTF-8").alias("name"), F.col("v.kind").alias("type"), F.col("v.expires_ticks").alias("expires"))


@query("codec_msgpack", "SELECT event_id AS key, event_id * 1000 AS n, event_type AS t FROM events")
def codec_msgpack(spark, d):
    e = table(spark, d, "events")
    raw = e.select("event_id", codecs.encode_msgpack(F.struct((F.col("event_id") * 1000).alias("n"), F.array("event_type").alias("t"))).alias("raw"))
    back = codecs.decode_msgpack(F.col("raw"), "n long, t array<string>")
    return raw.select(F.col("event_id").alias("key"), back["n"].alias("n"), back["t"][0].alias("t"))


@query("scan_custom_order", "SELECT c_custkey AS key, row_number() OVER (ORDER BY reverse(c_custkey::VARCHAR)) AS place FROM customer")
def scan_custom_order(spark, d):
    """All keys under another comparer."""
    return lookup.ranked(customers(spark, d), F.reverse(F.col("key").cast("string"))).select("key", "place")


# --- stores, dumps and streams ----------------------------------------------------------------------------------------

KINDS = {"key": T.LongType(), "value": T.StringType()}
NAMES_SQL = "SELECT c_custkey AS key, c_name AS value FROM customer"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "store_reopen",
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS value FROM customer
    WHERE c_custkey % 3 > 0""",
)
def store_reopen(spark, d):
    """Put, overwrite a half, remove a third, close and open again."""
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, "create", **KINDS) as s:
        s.put(rows)
        s.put(rows.where("key % 2 = 0").withColumn("value", F.upper("value")))
        s.remove(rows.where("key % 3 = 0").select("key"))
    return Store(spark, root, "readonly").snapshot()


@query("store_compacted", f"{NAMES_SQL} WHERE c_custkey % 3 > 0 AND c_custkey % 7 > 0")
def store_compacted(spark, d):
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, "create", **KINDS) as s:
        s.put(rows)
        s.remove(rows.where("key % 3 = 0").select("key"))
        s.register_stale(F.col("key") % 7 == 0)
        s.compact()
        s.vacuum()
        return s.snapshot()


@query("store_range_scan", f"{NAMES_SQL} WHERE c_custkey BETWEEN 100 AND 300")
def store_range_scan(spark, d):
    """On a compacted store the range reaches the files' statistics."""
    root = scratch(spark, "store")
    with Store(spark, root, "create", **KINDS) as s:
        s.put(customers(spark, d))
        s.compact()
        return lookup.key_range(s.snapshot(), 100, 300)


@query(
    "store_late_ops",
    f"SELECT user_id AS key, floor(value)::BIGINT AS value FROM (SELECT *, {LAST} AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
)
def store_late_ops(spark, d):
    """The events reach the store in the wrong order, the last ones first; the largest seq wins all the same."""
    root, ops = scratch(spark, "store"), log(spark, d).select("seq", "key", "value", "deleted")
    with Store(spark, root, "create", key=T.LongType(), value=T.LongType()) as s:
        for part in (2, 0, 1):
            s.apply(ops.where(F.col("seq") % 3 == part))
    return Store(spark, root, "readonly").snapshot()


@query("store_broken_log", f"SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS value FROM customer")
def store_broken_log(spark, d):
    """The last of three commits can't be read; the store opens with what was before it."""
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, "create", **KINDS) as s:
        s.put(rows)
        s.put(rows.where("key % 2 = 0").withColumn("value", F.upper("value")))
        s.remove(rows.select("key"))
        lost = s.manifest["deltas"][-1]
        s.files.delete(lost)
        s.files.create(f"{lost}/part-0.parquet", "no Parquet")
    return Store(spark, root, "readonly", broken="stop").snapshot()


@query("store_levels_merged", f"{NAMES_SQL} WHERE c_custkey % 5 > 0")
def store_levels_merged(spark, d):
    """Many small commits: their deltas are merged level by level, and removals last through the merges."""
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, "create", auto_compact=3, **KINDS) as s:
        s.put(rows.withColumn("value", F.lit("old")))
        for part in range(5):
            own = rows.where(F.col("key") % 5 == part)
            s.remove(own.select("key")) if part == 0 else s.put(own)
        return s.snapshot()


@query("store_levels", "SELECT * FROM (VALUES ('base', 1::BIGINT), ('delta', 2::BIGINT)) t(kind, n)")
def store_levels(spark, d):
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, "create", **KINDS) as s:
        s.put(rows)
        s.compact()
        s.put(rows.where("key < 10"))
        s.put(rows.where("key < 20"))
        return s.levels().groupBy(F.split("part", "-")[0].alias("kind")).agg(F.count("*").alias("n"))


@query("tablespace_isolation", f"SELECT 'even' AS space, * FROM ({NAMES_SQL}) WHERE key % 2 = 0 UNION ALL SELECT 'odd', * FROM ({NAMES_SQL}) WHERE key % 2 = 1")
def tablespace_isolation(spark, d):
    root, rows = scratch(spark, "store"), customers(spark, d)
    for k, name in enumerate(("even", "odd")):
        with Store(spark, root, tablespace=name, **KINDS) as s:
            s.put(rows.where(F.col("key") % 2 == k))
    parts = [Store(spark, root, "readonly", tablespace=x).snapshot().select(F.lit(x).alias("space"), "key", "value") for x in tablespaces(spark, root)]
    return parts[0].union(parts[1])


@query("store_clear", f"{NAMES_SQL} WHERE c_custkey < 5")
def store_clear(spark, d):
    root, rows = scratch(spark, "store"), customers(spark, d)
    with Store(spark, root, **KINDS) as s:
        s.put(rows)
        s.clear()
        s.put(rows.where("key < 5"))
        return s.snapshot()


@query("store_copy", NAMES_SQL)
def store_copy(spark, d):
    """What the target has besides stays."""
    rows = customers(spark, d)
    with Store(spark, scratch(spark, "a"), **KINDS) as a, Store(spark, scratch(spark, "b"), **KINDS) as b:
        a.put(rows.where("key % 2 = 0"))
        b.put(rows.where("key % 2 = 1"))
        return a.copy_to(b).snapshot()


@query("store_try_add", "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1)::BIGINT AS n_added, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)::BIGINT AS n_existing")
def store_try_add(spark, d):
    rows = customers(spark, d)
    with Store(spark, scratch(spark, "store"), **KINDS) as s:
        s.put(rows.where("key % 2 = 0"))
        got = s.try_add(rows.withColumn("seq", F.col("key")))
        return spark.createDataFrame([got], "n_added long, n_existing long")


@query("pack_roundtrip", NAMES_SQL)
def pack_roundtrip(spark, d):
    pack = scratch(spark, "pack")
    with Store(spark, scratch(spark, "store"), **KINDS) as s:
        s.put(customers(spark, d))
        s.pack(pack)
    return Store(spark, pack, "packed").snapshot()


@query("dump_restore", NAMES_SQL)
def dump_restore(spark, d):
    path = f"{scratch(spark, 'dump')}.kvdump"
    raw = customers(spark, d).select(codecs.encode_integer(F.col("key"), "i64").alias("key"), codecs.encode_string(F.col("value")).alias("value"))
    dump.dump(raw, path)
    back = mutate.first_ops(dump.restore(spark, path))
    return back.select(codecs.decode_integer(F.col("key"), "i64").alias("key"), codecs.decode_string(F.col("value")).alias("value"))


def streamed(spark, d):
    """events as a stream of operations, a file at a time."""
    path = scratch(spark, "ops")
    log(spark, d).select("seq", "key", "value", "deleted").repartitionByRange(3, "seq").write.parquet(path)
    return spark.readStream.schema("seq long, key long, value long, deleted boolean").option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_upsert", ORACLES["merge_latest"].replace("user_id AS key, event_id AS seq,", "user_id AS key,"))
def stream_upsert(spark, d):
    """Micro-batches committed to a store; the files come in any order, so each batch is put by its largest seq."""
    ops = streamed(spark, d)
    target = scratch(spark, "latest")
    q = upserts.running_snapshot(ops).writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "cp"))
    q.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).where(~F.col("deleted")).select("key", "value")


@query("stream_rmw", "SELECT user_id AS key, max(n)::BIGINT AS value FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def stream_rmw(spark, d):
    """A counter of each key's operations, kept in the stream's state."""
    target = scratch(spark, "rmw")
    q = upserts.read_modify_write(streamed(spark, d), lambda old, row: (old or 0) + 1).writeStream.outputMode("append")
    q.format("parquet").option("path", target).option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("key").agg(F.max("reply").alias("value"))


# --- command batches --------------------------------------------------------------------------------------------------


def event_commands(spark, d, cmd: str, *args) -> DataFrame:
    return log(spark, d).select(
        "seq", F.lit(0).cast("long").alias("at_ms"), F.lit(cmd).alias("cmd"), F.array(*(a.cast("string").cast("binary") for a in args)).alias("args")
    )


def no_keys(spark) -> DataFrame:
    return spark.createDataFrame([], commands.KEYSPACE)


@query("commands_incr", "SELECT event_id AS seq, (count(*) OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR AS reply FROM events")
def commands_incr(spark, d):
    return commands.run_commands(no_keys(spark), event_commands(spark, d, "INCR", F.col("key")))[1]


@query("commands_rpush", "SELECT user_id::VARCHAR AS key, 'list' AS kind, string_agg(event_type, ',' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def commands_rpush(spark, d):
    after = commands.run_commands(no_keys(spark), event_commands(spark, d, "RPUSH", F.col("key"), F.col("event_type")))[0]
    return after.select(F.decode("key", "UTF-8").alias("key"), "kind", shown(F.transform("items", lambda x: F.decode(x, "UTF-8"))).alias("value"))


@query("commands_sadd_scard", "SELECT user_id::VARCHAR AS key, count(DISTINCT event_type)::BIGINT AS n FROM events GROUP BY user_id")
def commands_sadd_scard(spark, d):
    after = commands.run_commands(no_keys(spark), event_commands(spark, d, "SADD", F.col("key"), F.col("event_type")))[0]
    return after.select(F.decode("key", "UTF-8").alias("key"), F.size("items").cast("long").alias("n"))


@query("commands_setbit_bitcount", "SELECT user_id::VARCHAR AS key, count(DISTINCT event_id % 97)::BIGINT AS n FROM events GROUP BY user_id")
def commands_setbit_bitcount(spark, d):
    after = commands.run_commands(no_keys(spark), event_commands(spark, d, "SETBIT", F.col("key"), F.col("seq") % 97, F.lit(1)))[0]
    return after.select(F.decode("key", "UTF-8").alias("key"), bits.bit_count(F.element_at("items", 1)).alias("n"))


def replies(spark, d, cmd: str, *args) -> DataFrame:
    """Replies to a command on the user's key for each event, after one SET to its event_id for each."""
    sets_ = event_commands(spark, d, "set", F.col("key"), F.col("seq"))
    asked = event_commands(spark, d, cmd, F.col("key"), *args).withColumn("seq", F.col("seq") + F.lit(10**12))
    return commands.run_commands(no_keys(spark), sets_.unionByName(asked))[1].where(F.col("seq") >= 10**12).select((F.col("seq") - 10**12).alias("seq"), "reply")


LAST_ID = "max(event_id) OVER (PARTITION BY user_id)"


@query("commands_get", f"SELECT event_id AS seq, '\"' || {LAST_ID} || '\"' AS reply FROM events")
def commands_get(spark, d):
    return replies(spark, d, "get")


@query("commands_strlen", f"SELECT event_id AS seq, length(({LAST_ID})::VARCHAR)::VARCHAR AS reply FROM events")
def commands_strlen(spark, d):
    return replies(spark, d, "strlen")


@query("commands_ttl", "SELECT event_id AS seq, '-1' AS reply FROM events")
def commands_ttl(spark, d):
    return replies(spark, d, "ttl")


@query("commands_exists", "SELECT event_id AS seq, '1' AS reply FROM events")
def commands_exists(spark, d):
    return replies(spark, d, "exists")


@query("commands_errors", """SELECT event_id AS seq, '{"error": "value is not an integer"}' AS reply FROM events""")
def commands_errors(spark, d):
    """INCRBY of a step that is no number, on every key: an error each, and the batch goes on."""
    return replies(spark, d, "incrby", F.lit("1_0"))


@query(
    "commands_lpos",
    """SELECT event_id AS seq, coalesce((min(r) FILTER (event_type = 'click') OVER (PARTITION BY user_id) - 1)::VARCHAR, 'null') AS reply
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)""",
)
def commands_lpos(spark, d):
    """The place of the first click in each user's list of events."""
    pushed = event_commands(spark, d, "rpush", F.col("key"), F.col("event_type"))
    asked = event_commands(spark, d, "lpos", F.col("key"), F.lit("click")).withColumn("seq", F.col("seq") + F.lit(10**12))
    got = commands.run_commands(no_keys(spark), pushed.unionByName(asked))[1].where(F.col("seq") >= 10**12)
    return got.select((F.col("seq") - 10**12).alias("seq"), "reply")


@query("commands_spop", "SELECT user_id::VARCHAR AS key, greatest(count(DISTINCT event_type) - 2, 0)::BIGINT AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 2")
def commands_spop(spark, d):
    """Sizes of the sets after one SPOP of two members on each."""
    added = event_commands(spark, d, "sadd", F.col("key"), F.col("event_type"))
    users = table(spark, d, "events").select("user_id").distinct()
    popped = users.select((F.col("user_id") + F.lit(10**12)).alias("seq"), F.lit(0).cast("long").alias("at_ms"), F.lit("spop").alias("cmd"),
                          F.array(F.col("user_id").cast("string").cast("binary"), F.lit(b"2")).alias("args"))
    after = commands.run_commands(no_keys(spark), added.unionByName(popped))[0]
    return after.select(F.decode("key", "UTF-8").alias("key"), F.size("items").cast("long").alias("n"))


@query("commands_set_nx", "SELECT event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN '\"OK\"' ELSE 'null' END AS reply FROM events")
def commands_set_nx(spark, d):
    ops = event_commands(spark, d, "SET", F.col("key"), F.col("event_type"), F.lit("NX"))
    return commands.run_commands(no_keys(spark), ops)[1]
