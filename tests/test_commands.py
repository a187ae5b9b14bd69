import json

from keyloom.operators.commands import KEYSPACE, run_commands


def play(spark, *lines, keyspace=None):
    rows = []
    for i, line in enumerate(lines):
        at, words = (line[0], line[1:]) if isinstance(line[0], int) else (0, line)
        rows.append((i, at, words[0], [bytearray(str(w).encode()) for w in words[1:]]))
    commands = spark.createDataFrame(rows, "seq long, at_ms long, cmd string, args array<binary>")
    keyspace = spark.createDataFrame([], KEYSPACE) if keyspace is None else keyspace
    after, replies = run_commands(keyspace, commands)
    got = {r.seq: json.loads(r.reply) for r in replies.collect()}
    return after, [got[i] for i in range(len(lines))]


def test_strings_and_integers(spark):
    _, got = play(
        spark,
        ("SET", "a", "success"), ("APPEND", "a", "andsuccess"), ("GETSET", "new", "x"), ("GET", "a"), ("STRLEN", "a"), ("STRLEN", "none"),
        ("INCR", "n"), ("INCR", "n"), ("INCRBY", "n", 2), ("DECR", "m"), ("DECRBY", "m", 3), ("INCR", "a"),
        ("SET", "b", "1", "NX"), ("SET", "b", "2", "NX"), ("SET", "b", "3", "XX", "GET"), ("SET", "none", "3", "XX"),
        ("GETRANGE", "a", 0, 6), ("GETRANGE", "a", -3, -1), ("SETRANGE", "r", 3, "zz"), ("SETRANGE", "a", -1, "S"), ("SETNX", "a", 1), ("SETNX", "z", 1),
        ("MGET", "a", "none", "b"), ("MSET", "k1", "v1", "k2", "v2"), ("EXISTS", "k1", "k1", "none"), ("DEL", "k1", "k2", "none"), ("DEL", "k1"), ("GETRANGE", "none", 0, 5),
    )
    assert got == ["OK", 17, None, "successandsuccess", 17, 0, 1, 2, 4, -1, -4, {"error": "value is not an integer"}, "OK", None, "1", None,
                   "success", "ess", 5, 17, 0, 1, ["successandsuccesS", None, "3"], "OK", 2, 2, 0, ""]


def test_bits(spark):
    sets = [("SETBIT", "k", p, 1) for p in (2, 3, 5, 10, 11, 14)]
    _, got = play(
        spark, *sets, ("GET", "k"), ("SET", "c", "`"), *(("GETBIT", "c", p) for p in (0, 1, 2, 3, 900)), ("BITCOUNT", "k"), ("BITCOUNT", "k", 1, -1), ("SETBIT", "k", -1, 1), ("SETBIT", "k", 2**32, 1), ("SET", "i", 1), ("SETBIT", "i", 6, 1), ("GET", "i"),
    )
    assert got[6:13] == ["42", "OK", 0, 1, 1, 0, 0] and got[13:15] == [6, 3] and all("error" in x for x in got[15:17]) and got[17:] == ["OK", 0, "3"]


def test_expiry(spark):
    _, got = play(
        spark, (0, "SET", "a", "1", "EX", 50), (1000, "TTL", "a"), (1000, "PTTL", "a"), (1000, "PERSIST", "a"), (1000, "TTL", "a"), (0, "PSETEX", "b", 10, "x"),
        (11, "GET", "b"), (11, "TTL", "b"), (20, "SET", "c", 1), (20, "EXPIRE", "c", -1), (20, "EXISTS", "c"), (20, "EXPIREAT", "a", 90), (20, "APPEND", "a", "2"), (21, "TTL", "a"),
        (30, "SET", "a", "3", "KEEPTTL"), (30, "TTL", "a"), (30, "SET", "a", "4"), (30, "TTL", "a"),
    )
    assert got == ["OK", 49, 49000, 1, -1, "OK", None, -2, "OK", 0, 0, 1, 2, 89, "OK", 89, "OK", -1]


def test_lists(spark):
    _, got = play(
        spark, ("LPUSHX", "l", "a"), ("RPUSH", "l", "a", "b", "c"), ("LPUSH", "l", "x", "y"), ("LRANGE", "l", 0, -1), ("LRANGE", "l", 0, 0), ("LINDEX", "l", -1), ("LINDEX", "l", 9),
        ("LSET", "l", 0, "Y"), ("LSET", "l", 9, "Y"), ("LPOP", "l"), ("RPOP", "l", 2), ("LLEN", "l"), ("LPOP", "l", 9), ("EXISTS", "l"), ("LPOP", "l"), ("RPOP", "l", 1),
        ("RPUSH", "p", "a", "b", "a", "c", "a"), ("LPOS", "p", "a"), ("LPOS", "p", "a", "RANK", 2), ("LPOS", "p", "a", "COUNT", 0), ("LPOS", "p", "a", "RANK", -1, "COUNT", 2), ("LPOS", "p", "a", "COUNT", 0, "MAXLEN", 3), ("LPOS", "p", "q"),
        ("SADD", "p", "m"), ("GET", "p"),
    )
    assert got == [0, 3, 5, ["y", "x", "a", "b", "c"], ["y"], "c", None, "OK", {"error": "index out of range"}, "Y", ["c", "b"], 2, ["x", "a"], 0, None, None,
                   5, 0, 2, [0, 2, 4], [4, 2], [0, 2], None, {"error": "Malformed command invocation"}, None]


def test_sets(spark):
    _, got = play(
        spark, ("SADD", "s", "b", "a", "b"), ("SADD", "s", "a", "c"), ("SCARD", "s"), ("SISMEMBER", "s", "a"), ("SISMEMBER", "none", "a"), ("SMISMEMBER", "s", "a", "z"), ("SMEMBERS", "s"),
        ("SREM", "s", "a", "q"), ("SPOP", "s"), ("SCARD", "s"), ("SRANDMEMBER", "s", 5), ("SPOP", "s", 9), ("EXISTS", "s"), ("SADD", "ab", "c"), ("SADD", "a", "bc"),
    )
    assert got[:8] == [2, 1, 3, 1, 0, [1, 0], ["a", "b", "c"], 1] and got[8] in ("b", "c") and got[9] == 1 and got[12:] == [0, 1, 1] and got[10] == got[11]


def test_commands_over_keys(spark):
    after, got = play(
        spark, ("MSET", "a0", 1, "a1", 2, "test2", 3), ("KEYS", "t*est*"), ("KEYS", "a?"), ("MSETNX", "a1", 9, "q", 9), ("MSETNX", "q", 9, "r", 8), ("RENAMENX", "q", "fresh"), ("RENAMENX", "r", "fresh"),
        ("RENAME", "gone", "a0"), ("RENAME", "a1", "r"), ("MGET", "a0", "a1", "r", "fresh"), ("DBSIZE",), ("PING",), ("ECHO", "hi"), ("TIME",), ("KEYS", "["), ("FLUSHALL",), ("DBSIZE",), ("SET", "x", "y"),
    )
    assert got[:14] == ["OK", ["test2"], ["a0", "a1"], 0, 1, 1, 0, "OK", "OK", [None, None, "2", "9"], 3, "PONG", "hi", [0, 0]]
    assert "error" in got[14] and got[15:] == ["OK", 0, "OK"]
    assert [(bytes(r.key), r.kind) for r in after.collect()] == [(b"x", "string")]


def test_odd_commands(spark):
    _, got = play(spark, ("BGREWRITEAOF",), ("NOSUCH", "k"), ("GET",), ("DEL",), ("INFO",), ("LASTSAVE",))
    assert got[0] == "OK" and all("error" in got[i] for i in (1, 2, 3)) and "keys=0" in got[4] and got[5] == 0
    after, got = play(spark, ("PING", "x"))
    assert got == ["x"] and after.isEmpty()


def test_bad_arguments_answer_with_errors(spark):
    bad = [
        ("INCR", "u"), ("INCR", "e"), ("SET", "u"), ("MSET", "a", 1, "b"), ("SPOP", "s", -1), ("LPOP", "l", -1), ("RPOP", "l", -2), ("BITCOUNT", "u", 1),
        ("LPOS", "l", "x", "NOPE", 1), ("LPOS", "l", "x", "RANK"), ("GET", "u", "v"), ("EXPIRE", "u", "1 "), ("SET", "u", 1, "EX"), ("LPOS", "l", "x", "COUNT", -1),
        ("INCRBY", "u", "9" * 5000), ("RENAME", "u"), ("MSETNX", "q"), ("ECHO",), ("KEYS",),
    ]
    start = [("SET", "u", "1_0"), ("SET", "e", ""), ("SADD", "s", "a", "b"), ("RPUSH", "l", "x", "y")]
    _, got = play(spark, *start, *bad, ("GET", "u"), ("MGET", "a", "b"), ("SCARD", "s"), ("LLEN", "l"), ("SRANDMEMBER", "s", -5), ("SRANDMEMBER", "none", -5))
    assert got[:4] == ["OK", "OK", 2, 2]
    replies = got[4 : 4 + len(bad)]
    assert all(isinstance(r, dict) and "error" in r for r in replies), [b for b, r in zip(bad, replies, strict=True) if not isinstance(r, dict)]
    assert got[-6:-2] == ["1_0", [None, None], 2, 2] and len(got[-2]) == 5 and set(got[-2]) <= {"a", "b"} and got[-1] == []


def test_many_commands_without_keys(spark):
    after, got = play(spark, *[("PING",)] * 70, ("ECHO", "x"), (5000, "TIME"), (5000, "LASTSAVE"), ("SAVE",), ("SET", "a", 1))
    assert got[:70] == ["PONG"] * 70 and got[70:] == ["x", [5, 0], 5, "OK", "OK"] and after.count() == 1


def test_large_sets_are_updated_in_place(spark):
    lines = [("SADD", "s", f"m{i}") for i in range(3000)] + [("SREM", "s", f"m{i}") for i in range(0, 3000, 2)]
    after, got = play(spark, *lines)
    assert got == [1] * 4500 and [bytes(x) for x in after.first()["items"]] == sorted(b"m%d" % i for i in range(1, 3000, 2))
