import math
import random
from collections import Counter

import numpy as np

from keyloom.llm import neardup as N
from keyloom.llm.common import words_of


def grams_of(text):
    words = words_of((text or "").encode())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def weighted(text, df, n):
    """Weights from exact frequencies, by the rule of the docstring; nothing of the code under test."""
    out = {}
    for g in grams_of(text):
        out[g] = out.get(g, 0.0) + 1 + math.log(n / max(df[g], n / 1000)) / math.log(1000)
    return out


def similarity(a, b):
    shared = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
    total = sum(a.values()) + sum(b.values())
    return shared / (total - shared) if total > shared else 0.0


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    out = [None, "", "", "!!!", "!!!", "one two", "one two.", "a a a a a a a", "word " * 30000]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            out.append(" ".join(c))
        out.append(out[-1])
    return out


def test_classes_against_brute_force(spark, monkeypatch):
    rows = [(i, t, i) for i, t in enumerate(texts(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    df = Counter(g for _, t, _ in rows for g in set(grams_of(t)))
    parent = {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    full = [(i, t, weighted(t, df, len(rows))) for i, t, _ in rows if t]
    for n, (i, a, x) in enumerate(full):
        for j, b, y in full[:n]:
            if a == b or similarity(x, y) >= N.THRESHOLD:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    want = {i: root(i) for i, *_ in rows}
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert got == want
    monkeypatch.setattr(N, "TILE", 3)  # tiles of a few nodes: the same classes
    assert {r.doc_id: r.class_id for r in N.classes(docs).collect()} == want
    kept = sorted(r.doc_id for r in N.without_duplicates(docs.unionByName(docs.where("doc_id = 20"))).collect())
    assert kept == sorted(i for i in want if want[i] == i)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(docs).count() == 0 and N.without_duplicates(docs).count() == 0


def test_samples_collide_as_similarity_says():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.uniform(0.5, 3, 300).astype(np.float32)
    a, b = np.arange(0, 240), np.arange(60, 300)
    hs, ws = np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b] * np.float32(1.3)])
    drawn = N.samples(hs, ws, np.array([0, 240, 480]), 3000)
    wa, wb = np.zeros(300), np.zeros(300)
    wa[a], wb[b] = w[a], w[b] * 1.3
    assert abs((drawn[0] == drawn[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_components(spark):
    edges = [(b"%03d" % (i + 1), b"%03d" % i) for i in range(1, 60)] + [(b"100", b"101"), (b"102", b"101"), (b"200", b"200")]
    got = {bytes(r.node): bytes(r.root) for r in N.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert set(got.values()) == {b"001", b"100"} and len(got) == 63


def test_word_hashes_and_order():
    texts = [b"", None, b"!!", b"The  cat, the CAT", b"x" * 500 + b" the", "é e".encode()]
    h, sizes = N.word_hashes(texts)
    assert sizes.tolist() == [0, 0, 0, 4, 2, 2] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 5
    alone = np.concatenate([N.word_hashes([t])[0] for t in texts])
    assert (alone == h).all()
    same = np.array([5, 7, 5 + 2**19, 5], np.uint64)  # two hashes that agree in the key's part
    order = N._by_text(np.zeros(4, np.int64), same)
    assert same[order].tolist() == sorted(same.tolist())


def test_weights_are_exact(spark):
    rng = random.Random(3)
    common = [" ".join(f"c{k}w{j}" for j in range(5)) for k in range(40)]
    rows = []
    for i in range(600):
        parts = [c for k, c in enumerate(common) if rng.random() < k / 60]
        rows.append((i, " ".join(parts + [f"u{i}x{j}" for j in range(20)])))
    weights = N.learn_weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rare=50, size=1 << 10)  # crowded cells
    df = Counter(g for _, t in rows for g in set(grams_of(t)))
    for g, n in df.items():
        want = 1 + math.log(600 / max(n, 600 / 50)) / math.log(50)
        assert abs(float(weights.of(N.shingles([b" ".join(g)])[0])[0]) - want) < 1e-9, (g, n)


def test_clashing_columns_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 4)  # most groups are hot
    docs = spark.createDataFrame(
        [(i, "the same long text of quite a few words here" if i % 3 else f"own text {i} of other words entirely so {i}", i, "x", i) for i in range(60)]
        + [(1, "the same long text of quite a few words here", 1, "x", 1)] * 30,
        "doc_id long, text string, key int, id string, row int",
    )
    got = N.without_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted([1, *range(0, 60, 3)])
