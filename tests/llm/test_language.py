import math
import random
from collections import Counter

import numpy as np

from keyloom.llm import language as L


def brute(train, text):
    """Code length of text by the trees of train, byte by byte."""
    runs = Counter()
    for t in train:
        s = [0] * 3 + list(t.translate(L.SYMBOL))
        runs.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    s, bits = [0] * 3 + list(text.translate(L.SYMBOL)), 0.0
    for i in range(3, len(s)):
        for order in (3, 2, 1, 0):
            seen = Counter()
            for run, n in runs.items():
                if run[3 - order : 3] == tuple(s[i - order : i]):
                    seen[run[3]] += n
            total, distinct = sum(seen.values()), len(seen)
            if seen[s[i]]:
                bits -= math.log2(seen[s[i]] / (total + distinct))
                break
            if total:
                bits -= math.log2(distinct / (total + distinct))
        else:
            bits += math.log2(L.SIZE)
    return bits


def test_code_lengths_against_brute_force():
    rng = random.Random(7)
    train = {x: ["".join(rng.choice(p) for _ in range(80)).encode() for _ in range(3)] for x, p in (("a", "abcd é "), ("b", "bcde ñ."))}
    counts = {}
    for x, texts in train.items():
        flat, begins, ends = L.symbols(texts)
        keep = np.concatenate([np.arange(a, b) for a, b in zip(begins, ends, strict=True)])
        counts[x] = np.unique((L.contexts(flat).astype(np.int64) * L.SIZE + flat)[keep], return_counts=True)
    trees = L.Trees(counts)
    asked = [b"", None, b"abcd", "dcba é ñ xyz".encode(), b"eeee....", "日".encode()]
    got = trees.code_lengths(asked)
    for i, t in enumerate(asked):
        for k, x in enumerate("ab"):
            assert abs(got[i, k] - brute(train[x], t or b"")) < 1e-2


def test_table(spark):
    rng = random.Random(8)
    word = lambda p: "".join(rng.choice(p) for _ in range(5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyzé") for _ in range(20)), "one" if i % 2 else "two", 0) for i in range(200)]
    rows += [(500, None, "one", 0), (501, "", None, 0), (502, "12 3!", "one", 0), (503, "abc " * 60000, None, 0), (503, "abc", None, 0), (None, "vwx", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = L.predict(docs, L.learn(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == ("one" if i % 2 else "two") for i in range(200)) > 195
    assert [by[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "one"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in L.predict(docs, L.learn(docs.limit(0))).collect()} == {"und"}
    assert L.predict(docs.limit(0), L.learn(docs)).count() == 0
