"""Redis-style commands in batches: (keyspace, commands) -> (keyspace, replies).

keyspace: key, kind ('string', 'list', 'set'), items array<binary> (one item for a string, the members in order for a set),
expires_ms (null: never). commands: seq, at_ms (time of the command), cmd, args array<binary>. replies: seq, reply as JSON:
numbers, text (bytes as Latin-1), null, arrays, or {"error": ...}.

Commands of one key run in the order of seq where the key's rows meet; the stream of a key's commands is folded one by one,
so memory is the key's value. Commands of many keys that act on each alone (MGET, MSET, DEL, UNLINK, EXISTS) are taken
apart before and their replies put together after. PING, ECHO, TIME, LASTSAVE and the SAVE kinds need no key and are
answered where they are. Those that need keys together (RENAME, RENAMENX, MSETNX, KEYS, DBSIZE, FLUSHALL, FLUSHDB and INFO)
part the batch: what is before runs first, and each is a pass of its own.

A command with a wrong number of arguments, a number that is none, or an argument out of range answers with an error and
changes nothing; it never fails the batch.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.glob import glob_regex
from keyloom.sources.shared import materialise

KEYSPACE = "key binary, kind string, items array<binary>, expires_ms long"
REPLIES = "seq long, reply string"
MAX_VALUE, MAX_BIT = 512 << 20, 536_870_912

MANY = {"mget", "mset", "del", "unlink", "exists"}
TOGETHER = {"rename", "renamenx", "msetnx", "keys", "dbsize", "flushall", "flushdb", "info"}
KEYLESS = {"save", "bgsave", "bgrewriteaof", "lastsave", "time", "echo", "ping"}
#: Least and most arguments, the key included; None: any number.
ARGUMENTS = {
    "get": (1, 1), "set": (2, None), "setnx": (2, 2), "setex": (3, 3), "psetex": (3, 3), "getset": (2, 2), "strlen": (1, 1),
    "append": (2, 2), "getrange": (3, 3), "setrange": (3, 3), "incr": (1, 1), "decr": (1, 1), "incrby": (2, 2),
    "decrby": (2, 2), "getbit": (2, 2), "setbit": (3, 3), "bitcount": (1, 3), "ttl": (1, 1), "pttl": (1, 1),
    "persist": (1, 1), "expire": (2, 2), "pexpire": (2, 2), "expireat": (2, 2), "pexpireat": (2, 2), "lpush": (2, None),
    "rpush": (2, None), "lpushx": (2, None), "rpushx": (2, None), "lpop": (1, 2), "rpop": (1, 2), "llen": (1, 1),
    "lindex": (2, 2), "lset": (3, 3), "lrange": (3, 3), "lpos": (2, None), "sadd": (2, None), "srem": (2, None),
    "scard": (1, 1), "sismember": (2, 2), "smismember": (2, None), "smembers": (1, 1), "spop": (1, 2),
    "srandmember": (1, 2), "rename": (2, 2), "renamenx": (2, 2), "msetnx": (2, None), "mset": (2, None), "keys": (1, 1),
    "dbsize": (0, 0), "flushall": (0, 1), "flushdb": (0, 1), "info": (0, None), "save": (0, 0), "bgsave": (0, 1),
    "bgrewriteaof": (0, 0), "lastsave": (0, 0), "time": (0, 0), "echo": (1, 1), "ping": (0, 1),
}
INTEGER = re.compile(rb"[+-]?[0-9]+")
WRONG_NUMBER = "wrong number of arguments"


class CommandError(Exception):
    pass


def number(raw: bytes) -> int:
    if len(raw) > 40 or not INTEGER.fullmatch(raw):
        raise CommandError("value is not an integer")
    value = int(raw)
    if not -(2**63) <= value < 2**63:
        raise CommandError("value is out of range")
    return value


def checked(cmd: str, n: int) -> None:
    """Whether a command may have n arguments."""
    least, most = ARGUMENTS.get(cmd, (1, None))
    if n < least or (most is not None and n > most) or (cmd in ("mset", "msetnx") and n % 2):
        raise CommandError(WRONG_NUMBER)


class Value:
    """One key's value with its expiry. The items of a set are a set until they are stored."""

    def __init__(self, kind: str | None = None, items: list[bytes] | None = None, expires: int | None = None):
        self.kind, self.expires = kind, expires
        self.items = set(items or ()) if kind == "set" else items or []

    def at(self, now: int) -> None:
        if self.kind and self.expires is not None and self.expires < now:
            self.drop()

    def drop(self) -> None:
        self.kind, self.items, self.expires = None, [], None

    def of(self, kind: str) -> list[bytes] | set[bytes]:
        if self.kind not in (None, kind):
            raise CommandError("Malformed command invocation")
        return self.items if self.kind else set() if kind == "set" else []

    def stored(self) -> list[bytes]:
        return sorted(self.items) if self.kind == "set" else self.items

    @property
    def text(self) -> bytes:
        return self.of("string")[0] if self.of("string") else b""

    def put(self, text: bytes, keep: bool = True) -> None:
        if len(text) > MAX_VALUE:
            raise CommandError("value is too long")
        self.expires = self.expires if keep else None
        self.kind, self.items = "string", [text]

    def put_items(self, kind: str, items: list[bytes]) -> None:
        if items:
            self.kind, self.items = kind, items
        else:
            self.drop()


def span(size: int, start: int, end: int) -> slice:
    start = max(0, start + size if start < 0 else start)
    end = min(size - 1, end + size if end < 0 else end)
    return slice(start, max(start, end + 1))


def run_one(v: Value, cmd: str, args: list[bytes], now: int, seq: int) -> object:
    """The reply of a command on its key's value, which it may change. args: without the key."""
    v.at(now)
    if cmd in ("get", "mget"):
        return v.text if v.kind == "string" else None
    if cmd in ("exists", "del", "unlink"):
        there = int(v.kind is not None)
        if cmd != "exists":
            v.drop()
        return there
    if cmd == "mset":
        v.put(args[0], keep=False)
        return "OK"
    if cmd == "set":
        flags, ttl, i = set(), None, 1
        while i < len(args):
            word = args[i].decode("latin-1").lower()
            if word in ("ex", "px"):
                if i + 1 == len(args):
                    raise CommandError("syntax error")
                ttl = number(args[i + 1]) * (1000 if word == "ex" else 1)
                i += 1
            elif word in ("nx", "xx", "keepttl", "get"):
                flags.add(word)
            else:
                raise CommandError("syntax error")
            i += 1
        old = v.text if v.kind == "string" else None
        if ("nx" in flags and v.kind) or ("xx" in flags and not v.kind):
            return old if "get" in flags else None
        if ttl is not None and ttl <= 0:
            v.drop()
        else:
            v.put(args[0], keep="keepttl" in flags)
            v.expires = now + ttl if ttl is not None else v.expires
        return old if "get" in flags else "OK"
    if cmd == "setnx":
        if v.kind:
            return 0
        v.put(args[0], keep=False)
        return 1
    if cmd in ("setex", "psetex"):
        ttl = number(args[0]) * (1000 if cmd == "setex" else 1)
        if ttl <= 0:
            v.drop()
        else:
            v.put(args[1])
            v.expires = now + ttl
        return "OK"
    if cmd == "getset":
        old = v.text if v.kind == "string" else None
        v.put(args[0], keep=False)
        return old
    if cmd == "strlen":
        return len(v.text)
    if cmd == "append":
        v.put(v.text + args[0])
        return len(v.text)
    if cmd == "getrange":
        return v.text[span(len(v.text), number(args[0]), number(args[1]))]
    if cmd == "setrange":
        text, offset = v.text, number(args[0])
        offset = max(0, offset + len(text)) if offset < 0 else offset
        if not args[1]:
            return len(text)
        text = text.ljust(offset, b"\0")
        v.put(text[:offset] + args[1] + text[offset + len(args[1]) :])
        return len(v.text)
    if cmd in ("incr", "decr", "incrby", "decrby"):
        step = number(args[0]) if cmd.endswith("by") else 1
        value = number(v.text if v.kind else b"0") + (step if cmd.startswith("incr") else -step)
        if not -(2**63) <= value < 2**63:
            raise CommandError("increment would overflow")
        v.put(b"%d" % value)
        return value
    if cmd in ("getbit", "setbit"):
        place = number(args[0])
        if not 0 <= place < MAX_BIT:
            raise CommandError("bit offset is out of range")
        text, mask = v.text, 1 << (7 - place % 8)
        old = int(place // 8 < len(text) and bool(text[place // 8] & mask))
        if cmd == "setbit":
            raw = bytearray(text.ljust(place // 8 + 1, b"\0"))
            raw[place // 8] = raw[place // 8] | mask if number(args[1]) else raw[place // 8] & ~mask
            v.put(bytes(raw))
        return old
    if cmd == "bitcount":
        if len(args) == 1:
            raise CommandError(WRONG_NUMBER)
        part = v.text[span(len(v.text), number(args[0]), number(args[1]))] if args else v.text
        return sum(x.bit_count() for x in part)
    if cmd in ("ttl", "pttl"):
        left = -2 if not v.kind else -1 if v.expires is None else v.expires - now
        return left // 1000 if cmd == "ttl" and left >= 0 else left
    if cmd == "persist":
        v.expires = None
        return int(v.kind is not None)
    if cmd in ("expire", "pexpire", "expireat", "pexpireat"):
        when = number(args[0]) * (1 if cmd.startswith("p") else 1000) + (0 if cmd.endswith("at") else now)
        if not v.kind:
            return 0
        if when < now:
            v.drop()
            return 0
        v.expires = when
        return 1
    return run_list(v, cmd, args) if cmd.startswith(("l", "r")) else run_set(v, cmd, args, seq)


def run_list(v: Value, cmd: str, args: list[bytes]) -> object:
    items = v.of("list")
    if cmd in ("lpush", "rpush", "lpushx", "rpushx"):
        if cmd.endswith("x") and not v.kind:
            return 0
        v.put_items("list", args[::-1] + items if cmd.startswith("l") else items + args)
        return len(v.items)
    if cmd in ("lpop", "rpop"):
        n = number(args[0]) if args else 1
        if n < 0:
            raise CommandError("value is out of range, must be positive")
        if not v.kind:
            return None
        taken = items[:n] if cmd == "lpop" else items[::-1][:n]
        v.put_items("list", items[n:] if cmd == "lpop" else items[: max(0, len(items) - n)])
        return taken if args else taken[0]
    if cmd == "llen":
        return len(items)
    if cmd == "lindex":
        i = number(args[0])
        return items[i] if -len(items) <= i < len(items) else None
    if cmd == "lset":
        i = number(args[0])
        if not -len(items) <= i < len(items):
            raise CommandError("index out of range")
        items[i] = args[1]
        return "OK"
    if cmd == "lrange":
        return items[span(len(items), number(args[0]), number(args[1]))]
    if cmd == "lpos":
        if len(args) % 2 == 0 or any(a.lower() not in (b"rank", b"count", b"maxlen") for a in args[1::2]):
            raise CommandError("syntax error")
        options = {args[i].decode("latin-1").lower(): number(args[i + 1]) for i in range(1, len(args), 2)}
        rank, count, limit = options.get("rank", 1), options.get("count"), options.get("maxlen", 0)
        if rank == 0:
            raise CommandError("RANK can't be zero")
        if limit < 0 or (count or 0) < 0:
            raise CommandError("COUNT and MAXLEN can't be negative")
        order = list(enumerate(items))[:: 1 if rank > 0 else -1][: limit or None]
        hits = [i for i, x in order if x == args[0]][abs(rank) - 1 :]
        return (hits[0] if hits else None) if count is None else hits[: count or None]
    raise CommandError(f"unknown command {cmd}")


def run_set(v: Value, cmd: str, args: list[bytes], seq: int) -> object:
    members = v.of("set")
    if cmd in ("sadd", "srem"):
        new, before = set(args), len(members)
        if cmd == "sadd":
            members |= new
        else:
            members -= new
        v.put_items("set", members)
        return abs(len(members) - before)
    if cmd == "scard":
        return len(members)
    if cmd == "sismember":
        return int(args[0] in members)
    if cmd == "smismember":
        return [int(a in members) for a in args]
    if cmd == "smembers":
        return sorted(members)
    if cmd in ("spop", "srandmember"):
        n, draw = number(args[0]) if args else 1, random.Random(seq)
        if n < 0 and (cmd == "spop" or not members):
            if not members:
                return []
            raise CommandError("value is out of range, must be positive")
        ordered = sorted(members)
        taken = draw.choices(ordered, k=-n) if n < 0 else draw.sample(ordered, min(n, len(ordered)))
        if cmd == "spop":
            v.put_items("set", members - set(taken))
        return taken if args else taken[0] if taken else None
    raise CommandError(f"unknown command {cmd}")


def shown(reply: object) -> str:
    return json.dumps(reply, default=lambda b: bytes(b).decode("latin-1"))


def _per_key(keyspace: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: seq, part, key, at_ms, cmd, args. Rows of what comes out: replies have a seq, keys have none."""
    state = keyspace.select(
        "key", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("part"), F.col("expires_ms").alias("at_ms"), F.col("kind").alias("cmd"), F.col("items").alias("args")
    )
    rows = state.unionByName(commands.select("key", "seq", "part", "at_ms", "cmd", "args"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "seq", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, v = None, Value()

        def row(**x: object) -> dict:
            return {"seq": None, "part": None, "reply": None, "key": None, "kind": None, "items": None, "expires_ms": None} | x

        def close() -> list[dict]:
            return [row(key=key, kind=v.kind, items=v.stored(), expires_ms=v.expires)] if v.kind else []

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    out += close()
                    key, v = r["key"], Value()
                if r["seq"] < 0:
                    v = Value(r["cmd"], r["args"], r["at_ms"])
                    continue
                try:
                    if r["key"] is None:
                        raise CommandError(WRONG_NUMBER)
                    if r["cmd"] not in MANY:
                        checked(r["cmd"], 1 + len(r["args"]))
                    reply = run_one(v, r["cmd"], list(r["args"]), r["at_ms"], r["seq"])
                except (CommandError, IndexError, ValueError, OverflowError) as e:
                    reply = {"error": WRONG_NUMBER if isinstance(e, IndexError) else str(e)}
                out.append(row(seq=r["seq"], part=r["part"], reply=shown(reply)))
            yield pa.RecordBatch.from_pylist(out, OUT)
        yield pa.RecordBatch.from_pylist(close(), OUT)

    return ordered.mapInArrow(run, "seq long, part int, reply string, key binary, kind string, items array<binary>, expires_ms long")


OUT = pa.schema(
    [("seq", pa.int64()), ("part", pa.int32()), ("reply", pa.string()), ("key", pa.binary()), ("kind", pa.string()), ("items", pa.list_(pa.binary())), ("expires_ms", pa.int64())]
)


def _epoch(keyspace: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    args = F.col("args")
    apart = F.when(
        F.col("cmd") == "mset",
        F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(args) / 2) - 1, F.lit(0)).cast("int")), lambda i: F.slice(args, 2 * i + 1, 2)),
    ).when(F.col("cmd").isin(*MANY), F.transform(args, lambda a: F.array(a))).otherwise(F.array(args))
    # an MSET that lacks a value sets nothing
    apart = F.when((F.col("cmd") == "mset") & (F.size(args) % 2 == 1), F.array().cast("array<array<binary>>")).otherwise(apart)
    parts = commands.select("seq", "at_ms", "cmd", F.posexplode_outer(apart).alias("part", "own"))
    parts = parts.select(
        "seq", F.coalesce("part", F.lit(0)).alias("part"), "at_ms", "cmd", F.get("own", F.lit(0)).alias("key"), F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0))).alias("args")
    )
    done = materialise(_per_key(keyspace, parts))
    each = done.where("seq is not null").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("r"))
    texts = F.transform("r", lambda x: x["reply"])
    total = F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + x.try_cast("long"))
    reply = (
        F.when(F.col("cmd").isin(*MANY) & F.startswith(F.element_at(texts, 1), F.lit('{"error"')), F.element_at(texts, 1))
        .when(F.col("cmd") == "mget", F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")))
        .when(F.col("cmd").isin("del", "unlink", "exists"), total.cast("string"))
        .otherwise(F.element_at(texts, 1))
    )
    replies = each.join(commands.select("seq", "cmd"), "seq").select("seq", reply.alias("reply"))
    return done.where("seq is null").select("key", "kind", "items", "expires_ms"), replies


def _together(keyspace: DataFrame, seq: int, now: int, cmd: str, args: list[bytes]) -> tuple[DataFrame, object]:
    there = keyspace.where(F.col("expires_ms").isNull() | (F.col("expires_ms") >= now))
    holds = lambda keys: F.col("key").isin([bytes(k) for k in keys])
    if cmd == "dbsize":
        return there, there.count()
    if cmd in ("flushall", "flushdb"):
        return there.limit(0), "OK"
    if cmd == "info":
        return there, f"# Keyspace\nkeys={there.count()}"
    if cmd == "keys":
        names = there.where(F.rlike(F.decode("key", "ISO-8859-1"), F.lit(glob_regex(args[0].decode("latin-1")))))
        return there, names.agg(F.to_json(F.array_sort(F.collect_list(F.decode("key", "ISO-8859-1")))).alias("r")).first()["r"]
    if cmd == "msetnx":
        if not there.where(holds(args[::2])).isEmpty():
            return there, 0
        new = dict(zip(args[::2], args[1::2], strict=True))
        rows = [(bytearray(k), "string", [bytearray(x)], None) for k, x in new.items()]
        return there.unionByName(keyspace.sparkSession.createDataFrame(rows, KEYSPACE)), 1
    source, target = args
    if cmd == "renamenx" and not there.where(holds([target])).isEmpty():
        return there, 0
    moved = there.where(holds([source])).withColumn("key", F.lit(bytes(target)).cast("binary"))
    return there.where(~holds([source, target])).unionByName(moved), 1 if cmd == "renamenx" else "OK"


def _keyless(commands: DataFrame, saved_at: int | None) -> DataFrame:
    """Replies of commands that need no key, answered where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, replies = [], []
            for seq, now, cmd, args in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    checked(cmd, len(args or []))
                    if cmd == "lastsave":
                        reply: object = now // 1000 if saved_at is None else saved_at
                    elif cmd == "time":
                        reply = [now // 1000, now % 1000 * 1000]
                    else:
                        reply = args[0] if args and cmd in ("echo", "ping") else "PONG" if cmd == "ping" else "OK"
                except CommandError as e:
                    reply = {"error": str(e)}
                seqs.append(seq)
                replies.append(shown(reply))
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(replies, pa.string())], names=["seq", "reply"])

    return commands.where(F.col("cmd").isin(*KEYLESS)).select("seq", "at_ms", "cmd", "args").mapInArrow(run, REPLIES)


def run_commands(keyspace: DataFrame, commands: DataFrame, saved_at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keyspace after, replies). saved_at: Unix seconds that LASTSAVE answers, as a store's last_commit(); without it the
    time of the command."""
    commands = commands.withColumn("cmd", F.lower("cmd"))
    barriers = commands.where(F.col("cmd").isin(*TOGETHER)).orderBy("seq").collect()
    rest = commands.where(~F.col("cmd").isin(*TOGETHER, *KEYLESS))
    spark, replies, after = keyspace.sparkSession, [_keyless(commands, saved_at)], None
    for b in [*barriers, None]:
        part = rest if after is None else rest.where(F.col("seq") > after)
        part = part if b is None else part.where(F.col("seq") < b["seq"])
        keyspace, said = _epoch(keyspace, part)
        replies.append(said)
        if b is not None:
            after = b["seq"]
            try:
                args = [bytes(a) for a in b["args"] or []]
                checked(b["cmd"], len(args))
                keyspace, reply = _together(keyspace, b["seq"], b["at_ms"], b["cmd"], args)
                reply = reply if b["cmd"] == "keys" else shown(reply)
            except (CommandError, ValueError, IndexError) as e:
                reply = shown({"error": str(e)})
            replies.append(spark.createDataFrame([(b["seq"], reply)], REPLIES))
    out = replies[0]
    for r in replies[1:]:
        out = out.unionByName(r)
    return keyspace, out
