import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keyloom.llm import secrets as X
from keyloom.llm import spans as S


def base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 8 and m[1].isascii():
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def texts():
    rng = random.Random(10)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "passwd", "=", ":", " ", '"', "'", "abcd", "12345678", "/+_.-=", "AKIA", "ABCDEF012345", "deadbeef", "0123456789abcdef", "é", "🙂", "\n", "x"]
    out = [None, "", 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "token==abc12345", "tokentoken:short secret : 'longenough1'", "password=" + "a" * 50000, "f" * 100000, "token" + " " * 100000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_base_against_python(spark):
    every = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(every)], "doc_id long, text string, hex int").repartition(8)
    kinds = [(k, F.col(k)) for k in X.BASE]
    rows = {r.doc_id: r for r in X.find_secrets(docs).select("doc_id", S.written(S.ordered(kinds)).alias("base"), *(F.size(k).alias(k) for k in X.BASE)).collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        assert rows[i].base == ",".join(base(t)), repr((t or "")[:200])
    assert X.find_secrets(docs.limit(0)).count() == 0


def test_entropy_against_brute_force(spark):
    rng = random.Random(11)
    strings = ["".join(rng.choice(p) for _ in range(n)) for p in ("ab1", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH+/") for n in (20, 21, 33, 90) for _ in range(5)]

    def entropy(s):
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())

    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", F.expr(X.highest_entropy("s")).alias("e")).collect()
    for r in got:
        assert abs(r.e - max(entropy(r.s[i : i + 20]) for i in range(len(r.s) - 19))) < 1e-9


def test_entropy_spans_and_allow_list(spark):
    key = "q8Zr2LmX0vTn5KcB7yHd1WpE"
    rows = [(1, f"é key {key}."), (2, f"sha256: {key}"), (3, "EXAMPLE" + key), (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1"), (5, f"token={key}")]
    got = {r.doc_id: r.entropy for r in X.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(6, 6 + len(key))] and not any(got[i] for i in (2, 3, 4, 5))


def test_random_keys_are_not_words(spark):
    rng = random.Random(12)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pools = {"base62": low + low.upper() + digits, "base64": low + low.upper() + digits + "+/", "lower": low + digits, "upper": low.upper() + digits}
    draw = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    rows = [(f"{p}{n}", draw(pool, n)) for p, pool in pools.items() for n in (40, 64) for _ in range(400)]
    rows += [("named", "authentication=" + draw(pools["base62"], 40)) for _ in range(400)]
    rows += [("word", f"internationalization{i}") for i in range(400)] + [("word", "AUTHENTICATIONTOKEN1")]
    span = F.struct(F.col("s").alias("match"), F.lit("").alias("before"))
    got = spark.createDataFrame(rows, "kind string, s string").withColumn("span", span).groupBy("kind").agg(F.avg(F.expr(X.suspicious("span")).cast("int")).alias("found")).collect()
    found = {r.kind: r.found for r in got}
    assert found.pop("word") == 0 and len(found) == 9
    assert all(x >= 0.95 for x in found.values()), found
    assert all(x >= 0.99 for k, x in found.items() if k.startswith("base") or k == "named"), found


def test_many_matches(spark):
    n = 40_000
    text = " ".join(f"é AKIA{i:016d} q8Zr2LmX0vTn5KcB7y{i:05d} token=abcdefgh{i}" for i in range(n))
    r = X.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(
        S.written(S.ordered([(k, F.col(k)) for k in X.BASE])).alias("base"), F.size("entropy").alias("n")
    ).first()
    assert r.base == ",".join(base(text)) and r.n == n


def test_candidates_beside_known_forms(spark):
    key = "q8Zr2LmX0vTn5KcB7yHd1WpE"
    text = f"token=abcdefgh {key} secret: {key} {'0a' * 20} {key}"
    r = X.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = [i for i in range(len(text)) if text.startswith(key, i)]
    assert [(s.start, s.end) for s in r.entropy] == [(i, i + len(key)) for i in (at[0], at[2])]
