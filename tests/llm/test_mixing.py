from __future__ import annotations

import math
import re
from collections import Counter

import xxhash

from foliospark.llm import mixing


def test_posteriors_and_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    taught = labels.where("doc_id % 4 <> 0")
    rows = {r.doc_id: r for r in mixing.mix(docs, taught).collect()}
    assert len(rows) == docs.count()
    right = total = 0
    for r in labels.where("doc_id % 4 = 0").collect():  # held out from the classifier
        truth = "toxic" if r.toxic == 1 else "good" if r.quality == 1 else "poor"
        p = {d: rows[r.doc_id][f"p_{d}"] for d in mixing.DOMAINS}
        right += max(p, key=p.get) == truth
        total += 1
    assert right / total > 0.85
    n = sum(r.tokens for r in rows.values())
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows.values()) / n - share) < 0.01
    assert all(r.rate >= 0 for r in rows.values())


def test_descent_against_a_plain_loop(spark):
    members = [(10, [0.9, 0.1, 0.0]), (30, [0.2, 0.7, 0.1]), (5, [0.0, 0.0, 1.0]), (50, [0.6, 0.3, 0.1])]
    table = spark.createDataFrame(members, "tokens long, p array<double>")
    history, _ = mixing.fit_rates(table, {"good": 0.9, "poor": 0.1}, steps=12)
    n, r, y = sum(t for t, _ in members), [1.0] * 4, [1.0] * 4
    share = [sum(t * p[k] for t, p in members) / n for k in range(3)]
    for g in history:
        a = [sum(x * t * p[k] for x, (t, p) in zip(y, members, strict=True)) / n for k in range(3)]
        want = [(a[k] - (0.9, 0.1, 0.0)[k]) / share[k] for k in range(3)]
        assert all(abs(x - y) < 1e-9 for x, y in zip(g, want, strict=True))
        new = [max(0.0, x - mixing.ETA * (sum(p[k] * g[k] for k in range(3)) + mixing.RIDGE * (x - 1))) for x, (_, p) in zip(y, members, strict=True)]
        r, y = new, [x + mixing.MOMENTUM * (x - old) for x, old in zip(new, r, strict=True)]
    got = [x[0] for x in table.select(mixing.rate(table.p, None, history)).collect()]
    assert len(history) == 12 and all(abs(x - y) < 1e-9 for x, y in zip(sorted(got), sorted(r), strict=True))


def test_descent_alone_and_from_its_start_end_alike(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts = docs.select(docs.doc_id.alias("key"), "text")
    members = mixing.stored(mixing.posteriors(texts, mixing.train(docs, labels)), "members")
    start = mixing.settled_rate(members.p, mixing.solve_rates(members))
    history, gap = mixing.fit_rates(members, start=start)
    print("steps", len(history), "gap", gap)
    assert gap < mixing.GAP and len(history) <= 3
    small = members.limit(40).cache()
    start = mixing.settled_rate(small.p, mixing.solve_rates(small))
    near, gap = mixing.fit_rates(small, start=start)
    alone, rest = mixing.fit_rates(small, steps=90)
    assert gap < mixing.GAP and rest < 1e-2
    for r in small.select(mixing.rate(small.p, start, near).alias("a"), mixing.rate(small.p, None, alone).alias("b")).collect():
        assert abs(r.a - r.b) < 0.2


def test_odd_and_empty_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 0), (7, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    rows = mixing.mix(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.rate == 0 and r.tokens == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in rows)
    assert mixing.mix(odd_docs, none).count() == len(rows)
    assert mixing.mix(no_docs, none).count() == 0


def test_rates_are_the_least_squares_solution(spark):
    """No projected gradient is left on sf0.1, where a short descent stays far from it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in mixing.mix(docs, labels).collect() if r.tokens]
    n = sum(r.tokens for r in rows)
    p = lambda r: [r[f"p_{d}"] for d in mixing.DOMAINS]
    a = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) / n for d in mixing.DOMAINS]
    s = [sum(r.tokens * r[f"p_{d}"] for r in rows) / n for d in mixing.DOMAINS]
    print("shares", dict(zip(mixing.DOMAINS, a, strict=True)), "rate 0:", sum(r.rate == 0 for r in rows) / len(rows), "most:", max(r.rate for r in rows))
    g = [(x - mixing.TARGETS[d]) / y for x, y, d in zip(a, s, mixing.DOMAINS, strict=True)]
    for r in rows:
        slope = sum(x * y for x, y in zip(p(r), g, strict=True)) + mixing.RIDGE * (r.rate - 1)
        assert abs(r.rate - max(0.0, r.rate - slope)) < 1e-6


def test_solution_is_where_the_plain_descent_ends(spark):
    members = [(10, [0.9, 0.1, 0.0]), (30, [0.2, 0.7, 0.1]), (5, [0.0, 0.0, 1.0]), (50, [0.6, 0.3, 0.1])]
    n, r = sum(t for t, _ in members), [1.0] * 4
    want, share = (0.9, 0.1, 0.0), [sum(t * p[k] for t, p in members) / n for k in range(3)]
    for _ in range(200_000):
        a = [sum(x * t * p[k] for x, (t, p) in zip(r, members, strict=True)) / n for k in range(3)]
        g = [(a[k] - want[k]) / share[k] for k in range(3)]
        r = [max(0.0, x - (sum(p[k] * g[k] for k in range(3)) + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE)) for x, (_, p) in zip(r, members, strict=True)]
    table = spark.createDataFrame(members, "tokens long, p array<double>")
    found = mixing.solve_rates(table, {"good": 0.9, "poor": 0.1})
    got = [x[0] for x in table.select(mixing.settled_rate(table.p, found)).collect()]
    assert all(abs(x - y) < 1e-4 for x, y in zip(got, r, strict=True))
    assert mixing.solve_rates(table.where("false")) == [0.0] * 3


def test_ids_of_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a x y"), (3, "z")], "doc_id long, text string")
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = lambda frame: sorted((r.x, tuple(r.e)) for r in mixing.train(docs, frame).collect())
    assert model(labels) == model(labels.where("doc_id <> 3").distinct())


def test_posteriors_against_plain_naive_bayes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.train(docs, spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    found = {r.key: (r.tokens, r.p) for r in mixing.posteriors(docs.withColumnRenamed("doc_id", "key"), model).collect()}
    slot = lambda w: (lambda h: (h - (1 << 64) if h >= 1 << 63 else h) % mixing.FEATURES)(xxhash.xxh64(w, seed=42).intdigest())
    words = {i: [slot(w) for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w] for i, t in rows}
    domain = {i: "toxic" if x else "good" if q else "poor" for i, q, x in labels}
    counts = {d: Counter(x for i, ws in words.items() if domain.get(i) == d for x in ws) for d in mixing.DOMAINS}
    seen = set().union(*counts.values())
    for i, ws in words.items():
        if not ws:
            assert i not in found
            continue
        raw = [sum(math.log((c[x] + mixing.ALPHA) / (sum(c.values()) + mixing.ALPHA * mixing.FEATURES)) for x in ws if x in seen) for c in (counts[d] for d in mixing.DOMAINS)]
        raw = [r * min(1.0, mixing.TEMPER / len(ws)) for r in raw]
        ex = [math.exp(r - max(raw)) for r in raw]
        assert found[i][0] == len(ws)
        assert all(math.isclose(p, x / sum(ex), rel_tol=1e-6, abs_tol=1e-9) for p, x in zip(found[i][1], ex, strict=True))
