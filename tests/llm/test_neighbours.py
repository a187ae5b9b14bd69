import numpy as np

from keyloom.llm import neighbours as N


def test_recall_at_production_size():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    x = N.unit(centres[rng.integers(0, 60, N.SHARD)] + rng.normal(size=(N.SHARD, 64)))
    asked = x[:: N.SHARD // 200]
    found, far = N.build(x).search(asked)
    exact = np.argsort(-(asked @ x.T), axis=1)[:, 1:6]  # without itself
    hits = [len(set(a) & set(b)) / 5 for a, b in zip(exact.tolist(), found[:, 1:6].tolist(), strict=True)]
    assert np.mean(hits) >= 0.9, np.mean(hits)
    assert (np.diff(far, axis=1) >= 0).all()


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1000)] + rng.normal(size=(1000, 16))).astype(np.float32)
    x[600:800] = x[0]  # many equal vectors
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [1.0] * 15 + [float("nan")], 0), (2150, [1.0] * 15 + [None], 0), (2200, [1.0, 2.0], 0), (2250, [2.0, 1.0], 0), (2300, [], 0)]
    rows += [(50, rows[50][1], 1)]  # a repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    by = {}
    for r in N.nearest(df, size=400).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i < 2000]
    ids = np.array([i for i, _ in good])
    wide = np.stack([v for _, v in good])
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    hit = total = 0
    for j in range(0, 1000, 50):
        score = unit @ unit[j]
        score[j] = -9
        order = np.lexsort((ids, -np.round(score, 12)))[:5]
        got = sorted(by[j])[: 10]
        want = [int(x) for x in ids[order]]
        if j == 50:
            assert {r for r, _, _ in got} == {1, 2, 3, 4, 5}
            continue
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        hit += len(set(want) & {v for _, v, _ in got})
        total += 5
        for _, v, s in got:
            assert abs(s - unit[j] @ unit[list(ids).index(v)]) < 1e-12
    assert hit / total >= 0.9
    assert [v for _, v, _ in sorted(by[0])] == [600, 601, 602, 603, 604]
    assert by[2200] == [(1, 2250, by[2200][0][2])] and abs(by[2200][0][2] - 0.8) < 1e-12
    assert set(by) == {*range(0, 1000, 50), 2200, 2250}


def test_empty(spark):
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert N.nearest(spark.createDataFrame([(50, [1.0, 0.0])], "vec_id long, embedding array<float>")).count() == 0


def test_each_query_row_has_its_own_neighbours(spark):
    rows = [(i, [float(np.cos(i / 20)), float(np.sin(i / 20))]) for i in range(1, 31)]
    rows += [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (200, [1.0, 0.0]), (200, [0.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(x for x in got if x[0] == 50) == [(50, r, v) for r, v in enumerate((50, 200, 1, 2, 3), 1) for _ in range(2)]
    assert sorted(v for q, _, v in got if q == 200) == sorted([50, 50, 1, 2, 3] + [30, 29, 28, 27, 26])
