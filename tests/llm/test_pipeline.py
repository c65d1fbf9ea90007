from __future__ import annotations

import os
import random

import corpus_pipeline as cp
from foliospark.llm import ngram_join, pii

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_pii import plain_base


def test_stages_on_the_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, functions = zip(*cp.STAGES, strict=True)
    assert names == ("language", "near_duplicates", "decontamination", "personal_data", "mixing")
    kept = docs
    for i, f in enumerate(functions):
        before, kept = {r.doc_id: r.text for r in kept.collect()}, f(spark, kept, sf)
        rows = kept.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if i < 4:
            assert kept.columns == docs.columns
        if i == 0:
            assert all(any(c.isalpha() for c in r.text) for r in rows)
            assert len(rows) >= 0.98 * len(before)
        elif i == 1:
            want = {c for _, _, c in groups(sorted(before.items()), cp.NEAR_K, cp.NEAR_PERCENT)}
            assert set(ids) == want
        elif i == 2:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(ids) == set(before) - {d for d, _ in leaks(sorted(before.items()), bench)}
        elif i == 3:
            assert set(ids) == set(before)
            for r in rows:
                assert not plain_base(r.text) and r.n_chars == len(r.text)
                if not plain_base(before[r.doc_id]):
                    assert r.text == before[r.doc_id]
        else:
            assert set(ids) == set(before) and all(r.rate >= 0 for r in rows)
        kept = spark.createDataFrame(rows, kept.schema)


def test_stages_bear_odd_and_empty_rows(spark, odd_docs, no_docs, sf):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, f in cp.STAGES[:4]:
        assert f(spark, no_docs, sf).count() == 0
        assert f(spark, odd_docs.select(*plain), sf).columns == plain
    assert cp.STAGES[4][1](spark, no_docs, sf).count() == 0
    assert ngram_join.COUNTERS and pii.KINDS


def test_near_duplicates_under_null_and_repeated_ids(spark, sf):
    """One row of each group stays: near copies under one id go, clean texts that share an id with them stay."""
    rng = random.Random(12)
    say = lambda n: [rng.choice([f"w{i}" for i in range(800)]) for _ in range(n)]
    rows = []
    for g in range(5):
        text = say(150)
        for j, i in enumerate((7, 7, None, 30 + g, None)):
            other = list(text)
            other[25 * j] = "changed"
            rows.append((i, " ".join(other)))
    rows += [(7, " ".join(say(90))), (None, " ".join(say(90))), (31, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, sf).collect()
    group = {r: c for r, _, c in groups(list(enumerate(t for _, t in rows)), cp.NEAR_K, cp.NEAR_PERCENT)}
    best = {}
    for r, (i, _) in enumerate(rows):
        best.setdefault(group[r], []).append((i is None, i or 0))
    want = sorted(min(x) for x in best.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == want
    assert {group[rows.index((r.doc_id, r.text))] for r in kept} == set(best)


def test_run_twice_in_one_session_and_release(spark, sf):
    """Both runs give the same rows, and leave of their corpora only the last one's documents."""
    from foliospark.session import shared_dir

    folder = f"{shared_dir(spark)}/foliospark".replace("file:", "")
    names = lambda: {n for n in os.listdir(folder) if n.rsplit("-", 1)[0] in {*(n for n, _ in cp.STAGES), "rejected", "windows", "marks", "prefixes", "sets"}} if os.path.isdir(folder) else set()
    before, rows = names(), []
    for _ in range(2):
        rows.append(sorted((r.doc_id, r.tokens, round(r.rate, 9)) for r in cp.run(spark, sf).collect()))
    assert rows[0] == rows[1] and rows[0]
    assert sorted(n.rsplit("-", 1)[0] for n in names() - before) == ["personal_data"] * 2
