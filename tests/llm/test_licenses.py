import random

from keyloom.llm import licenses as L
from keyloom.llm.common import words_of

A = L.Automaton.of(L.TEMPLATES, L.PHRASES)


def brute(text):
    words = [w.decode() for w in words_of((text or "").encode())]
    places = []
    for label, phrase in L.PHRASES:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    runs = [[A.words[w] for w in words_of(t.encode())] for _, t in L.TEMPLATES + L.PHRASES]
    for _ in range(60):
        text = []
        while len(text) < 60:
            run = rng.choice(runs)
            a = rng.randrange(len(run))
            text += run[a : a + rng.randint(1, 9)] if rng.random() < 0.8 else [rng.randint(0, len(A.words))]
        subs = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        for k, (_, n) in enumerate(A.statistics(text)):
            want = max((m for m in range(1, k + 2) if tuple(text[k + 1 - m : k + 1]) in subs), default=0)
            assert n == want


def test_documents(spark):
    rng = random.Random(4)
    pool = "cc by general public license all rights reserved the MIT License Released under of to".split()
    texts = [None, "", "!!!", "cc by cc by", "CC-BY", "all rights rights reserved", "All\nRights, reserved. General public license"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    texts += ["word " * 50000 + "all rights reserved", "Ünder the é all rights reserved", *["the same cc by"] * 3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in L.scan_documents(docs, A).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert L.scan_documents(docs.limit(0), A).count() == 0


def test_spans(spark):
    text = "x y Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction, z"
    docs = spark.createDataFrame([(1, text), (2, "Released under the MIT License."), (3, "of the software and to the rights")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_documents(docs, A).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].start == 2 and got[1].spans[0].cover > 0.4
    assert got[2].labels == "mit" and got[2].score == 1.0 and got[3].labels == "" and got[3].score == 0


def test_full_texts_are_found():
    for label, text in L.FULL_TEXTS:
        words = [A.words[w] for w in words_of(text.encode())]
        found = A.scan([(0, words)])["spans"]
        best = max(found, key=lambda x: (x[2] - x[1], x[3]))
        assert (A.labels[best[0]], best[1], best[2]) == (label, 0, len(words)) and best[3] == 1.0, label


def test_many_notices_take_linear_time():
    import time

    run = [A.words[w] for w in words_of(L.TEMPLATES[2][1].encode())]

    def seconds(n):
        began = time.perf_counter()
        assert len(A.scan([(0, (run + [0] * 20) * n)])["spans"]) >= n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(4000) < 12 * max(seconds(1000), 0.02)
