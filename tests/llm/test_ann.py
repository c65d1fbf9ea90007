from __future__ import annotations

import numpy as np

from foliospark.llm import ann
from foliospark.llm.ann import nearest, traverse


def brute(rows, asked, top=5):
    out = {}
    for q, v in asked:
        v = np.array(v, dtype=float)
        scores = sorted((-(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows if i != q)
        out[q] = scores[:top]
    return out


def test_recall_on_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in rows.collect()]
    want = brute(table, [(i, v) for i, v in table if i % 50 == 0])
    got = {}
    for r in nearest(rows, rows.where("vec_id % 50 = 0"),).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    hits = sum(i in got[q] for q, w in want.items() for _, i in w)
    assert hits / sum(len(w) for w in want.values()) >= 0.9
    for q, w in want.items():
        for s, i in w:
            if i in got[q]:
                assert abs(got[q][i][1] + s) < 1e-9
        assert sorted(x[0] for x in got[q].values()) == list(range(1, 6))


def test_walk_is_short_on_clusters_and_measured_on_other_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 16))
    vectors = (centres[np.arange(6000) % 150] + 0.25 * rng.normal(size=(6000, 16))).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    seen = {}

    def depth(coded, asked, *rest):
        seen["depth"] = measured(coded, asked, *rest)
        return seen["depth"]

    measured = ann.depth
    monkeypatch.setattr(ann, "depth", depth)
    pairs, met = ann._rerank, spark.sparkContext.accumulator(0)

    def counted(top):
        run = pairs(top)

        def also(left, right):
            cell = np.array(right.column("cell").to_pylist())
            met.add(int(sum(np.isin(cell, c).sum() for c in left.column("cells").to_pylist())))
            return run(left, right)

        return also

    monkeypatch.setattr(ann, "_rerank", counted)
    want = brute([(i, np.array(v)) for i, v in enumerate(vectors)], [(i, vectors[i]) for i in range(0, 6000, 100)])
    got = {}
    for r in nearest(rows, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(i in got[q] for q, w in want.items() for _, i in w)
    assert hits / sum(len(w) for w in want.values()) >= 0.9
    assert seen["depth"] < 0.2 * 6000
    assert 60 * seen["depth"] <= met.value < 0.2 * 60 * 6000  # cosines that are computed, of 60 queries with 6,000 rows


def test_scaled_vectors_are_ties(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    rows = [(1000 + i, (base[i] * f).tolist()) for i in range(60) for f in (1.0,)]
    rows += [(int(n), (base[0] * f).tolist()) for n, f in zip(rng.permutation(900)[:300], rng.uniform(0.01, 50, 300), strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(table, table.where("vec_id = 1000")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == sorted(i for i, _ in rows if i < 1000)[:5]
    assert all(abs(r.score - 1) < 1e-14 for r in got)


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(1)
    da, db = rng.random(6), rng.random(5)
    cells = traverse(da, db, np.ones(30, dtype=int), 30)
    d = [da[c // 5] + db[c % 5] for c in cells]
    assert d == sorted(d) and len(set(cells)) == 30


def test_copies_ties_and_odd_rows(spark):
    bad = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 0.0]), (106, [1.0])]
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [2.0, 0.0]), (60, [0.0, 1.0]), (61, [0.0, 1.0])] + bad
    table = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(table, table.where("vec_id in (0, 50, 60, 100, 104)")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 60: [61, 0, 1, 2, 3]}
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in nearest(few, few.where("vec_id = 1")).collect()] == [(1, 2)]
    empty = few.where("false")
    assert nearest(empty, empty).count() == 0 and nearest(few, empty).count() == 0
