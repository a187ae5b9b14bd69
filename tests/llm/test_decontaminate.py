import random

from pyspark.sql import functions as F

from keyloom.llm import decontaminate as D
from keyloom.llm.common import words_of


def brute(docs, items):
    out = []
    windows = [(str(i), w[k : k + min(8, len(w))]) for i, t in items for w in [words_of((t or "").encode())] if w for k in range(max(1, len(w) - 7))]
    for i, t in docs:
        w = words_of((t or "").encode())
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    found.add(item)
                    hit.update(range(k, k + len(x)))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(13)
    pool = "a b c d é 7 Ab zz".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(0, text(20)), (1, text(12)), (2, None), (3, "..."), (4, "q q q"), (5, text(8)), (10, text(30))]
    items.append((11, items[0][1].upper()))
    docs = [(1, None), (2, ""), (3, "!!!"), (4, "q q q q q"), (5, "Q, q. q"), (6, "a b c")]
    for i in range(120):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 8))
            parts += [" ".join(w[a : a + rng.randint(5, 15)]), text(rng.randint(0, 9))]
        docs.append((100 + i, "  ".join(parts)))
    return docs + [docs[-1], (7, "q " * 60000 + items[0][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = tables()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    read = lambda x: sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in x.collect()), key=repr)
    assert read(D.decontaminate(df, bench)) == want
    assert read(D.decontaminate(df, bench, pass_words=25)) == want  # several passes over the index
    monkeypatch.setattr(D, "SEGMENT_BYTES", 300)
    assert read(D.decontaminate(df, bench)) == want
    assert D.decontaminate(df.limit(0), bench).count() == 0
    clean = D.decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.n_hit for r in clean)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two y three z"), (2, "three two one"), (3, "one two . . . a b c d e f three"), (4, None)], "doc_id long, text string")
    items = [(9, words_of(b"one two three"))]
    index = D.build_index(docs)
    got = sorted((r.doc_id, r.start, r.end) for r in D.proximity_matches(index, items, slop=2).collect())
    assert got == [(1, 1, 5), (2, 0, 3)]


def spans_by_hand(w, words, slop):
    own, out = set(words), set()
    for end in range(len(w)):
        last = {x: k for k, x in enumerate(w[: end + 1]) if x in own}
        if w[end] in own and len(last) == len(own) and end - min(last.values()) < len(words) + slop:
            out.add((min(last.values()), end + 1))
    return out


def test_proximity_against_brute_force(spark, monkeypatch):
    docs, items = tables()
    phrases = {str(i): words_of((t or "").encode()) for i, t in items}
    df = spark.createDataFrame([d for d in docs if d[0] != 7], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    spans, documents = [], []
    for i, t in docs:
        if i != 7:
            w = words_of((t or "").encode())
            hit, found = set(), set()
            for item, words in phrases.items():
                spans += [(i, item, a, b) for a, b in spans_by_hand(w, words, 2)] if words else []
                for p in [words[k : k + 8] for k in range(max(1, len(words) - 7))] + [words] if words else []:
                    for a, b in spans_by_hand(w, p, 2):
                        found.add(item)
                        hit.update(range(a, b))
            documents.append((i, len(w), len(hit), sorted(found)))
    read = lambda x: sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in x.collect()), key=repr)
    for chunk in (D.CHUNK, 7):
        monkeypatch.setattr(D, "CHUNK", chunk)
        index = D.build_index(df)
        assert sorted(tuple(r) for r in D.proximity_matches(index, list(phrases.items()), 2).collect()) == sorted(spans)
        assert read(D.near_documents(df, bench, 2)) == sorted(documents, key=repr)
        monkeypatch.setattr(D, "SEGMENT_BYTES", 300)
    assert read(D.near_documents(df, bench, 2, pass_words=25)) == sorted(documents, key=repr)
    assert D.near_documents(df.limit(0), bench, 2).count() == 0


def test_proximity_of_long_items(spark):
    words = [f"w{k}" for k in range(6000)]
    docs = [(1, " ".join(["x", *words[3000:], *words[:3000], "y"])), (2, " ".join(words[:5000])), (3, " ".join(words[5000:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = D.build_index(df)
    got = [tuple(r) for r in D.proximity_matches(index, [(5, [w.encode() for w in words])], 2).collect()]
    assert got == [(1, "5", 1, 6001)]


def test_op8_proximity_finds_added_and_moved_words(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    added = " ".join(w + " new" * (k % 6 == 5) for k, w in enumerate(words))
    moved = " ".join(words[k + 1] if k % 4 == 0 else words[k - 1] if k % 4 == 1 else w for k, w in enumerate(words))
    rows = [(1, added), (2, moved), (3, "nothing of it w1 w2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert not any(r.n_items for r in D.op8(spark, str(tmp_path)).collect())
    got = {r.doc_id: r.n_items for r in D.op8_proximity(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_one_index_answers_several_benchmarks(spark):
    docs, items = tables()
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).cache()
    for own in (items[:2], items[4:], []):
        words = [(i, words_of((t or "").encode())) for i, t in own]
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.exact_matches(index, words).collect()), key=repr)
        assert got == brute(docs, own)


def test_long_windows_and_clashing_names(spark):
    words = [f"w{k}" for k in range(9000)]
    rows = [(1, " ".join(words), "a", 1), (2, " ".join(words[:8999]), "b", 2), (3, " ".join(words[8999:]), "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, row int").coalesce(1)
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in D.decontaminate(df, bench, size=8500).collect()}
    assert got == {1: 9000, 2: 8999, 3: 0}
    kept = D.without_leaks(df.withColumn("md5", F.lit(1)).withColumn("own_id", F.lit(2)), bench)
    assert kept.columns == ["doc_id", "text", "id", "row", "md5", "own_id"] and [r.doc_id for r in kept.collect()] == [3]
