import random

from keyloom.llm import toxicity as T


def corpus(seed=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(rng.randint(5, 150))]
        if i % 6 == 0:
            for bad in rng.sample(["worthless", "idiot", "Trash", "grémlix"], 2):
                w[rng.randrange(len(w))] = bad
        docs.append((i, " ".join(w), 0.5))
        labels.append((i, 1, int(i % 6 == 0)))
    return docs, labels


def test_held_out_accuracy_and_folding(spark):
    docs, labels = corpus()
    hostile = [(5000, "you w0rthl3ss 1diot", 0.0), (5001, "you wоrthless idiоt", 0.0), (5002, "a trash can", 0.0), (5003, None, 0.0), (5004, "", 0.0), (5005, "ｗｏｒｔｈｌｅｓｓ idi0t " * 3000, 0.0), (5005, "x", 0.0), (None, "x", 0.0)]
    df = spark.createDataFrame(docs + hostile, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (3, 1, None), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.learn(df, lab)
    got = T.score_documents(df, model).collect()
    assert len(got) == len(docs) + len(hostile) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    truth = {i: t for i, _, t in labels}
    right = [(by[i] >= T.THRESHOLD) == bool(truth[i]) for i in truth]
    assert sum(right) / len(right) > 0.97
    assert by[5000] >= T.THRESHOLD and by[5001] >= T.THRESHOLD and by[5002] < T.THRESHOLD and by[5003] == by[5004]
    kept = T.without_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < T.THRESHOLD}
    assert T.score_documents(df.limit(0), model).count() == 0


def test_features_against_brute_force():
    lexicon = {b" bad ": 3.0, b" badly": 2.6, b" awful": 4.0}
    model = T.Model(lexicon, T.np.zeros(T.N_FEATURES + 1), T.np.zeros(T.N_FEATURES), T.np.ones(T.N_FEATURES))
    text = "Bad, b4dly! badlyness awfuls AWFUL trash can x"
    found = [max(v for e, v in lexicon.items() if (w + b" ").startswith(e[1:])) for w in T.fold(text.encode()).split() if any((w + b" ").startswith(e[1:]) for e in lexicon)]
    got = model.features(model.matcher(), text.encode())
    assert found == [3.0, 2.6, 2.6, 4.0, 4.0]
    assert got[0] == 4.0 and abs(got[2] - T.np.log1p(sum(found))) < 1e-12 and got[6] == T.np.log1p(8)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in T.score_documents(docs, T.learn(docs, labels)).collect())
