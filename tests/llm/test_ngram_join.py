from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliospark.llm import ngram_join
from foliospark.llm.ngram_join import similar_documents

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = (text or "").encode().translate(FOLD).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least.get(find(x))) for x, (i, s) in enumerate(sets) if i is not None)


def got(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect() if r.doc_id is not None)


def test_sample_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(similar_documents(docs)) == brute(rows, 4, 85)
    assert got(similar_documents(docs, k=5, percent=80)) == brute(rows, 5, 80)


def test_chains_of_edits_and_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows, text = [], [rng.choice(words) for _ in range(110)]
    for i in range(60):
        if i % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if i % 2 else "  ".join(text)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(similar_documents(docs)) == brute(rows, 4, 85)


def test_odd_and_empty_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = similar_documents(odd_docs)
    assert got(found) == brute(rows, 4, 85)
    assert found.count() == len(rows)
    assert similar_documents(no_docs).count() == 0


def test_near_duplicates_under_null_and_repeated_ids(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice([f"w{i}" for i in range(500)]) for _ in range(n)]
    rows = []
    for g in range(6):  # groups of near duplicates: ids that are null, repeated with other texts, or proper
        text = say(120)
        for j, i in enumerate((None, None, 7, 100 + g, None)):
            other = list(text)
            other[20 * j] = "changed"
            rows.append((i, " ".join(other)))
        rows.append((200 + g, rows[-1][1]))  # a copy, with an id, of a row without one
        rows.append((7, " ".join(say(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    want = brute(rows, 4, 85)
    assert got(similar_documents(docs)) == want
    assert got(similar_documents(docs.repartition(5))) == want


def test_hot_lists_of_unlinked_texts(spark, monkeypatch):
    """Texts of a few common phrases: long lists without links, of many sizes, and a few links among them."""
    monkeypatch.setattr(ngram_join, "HOT", 64)
    rng = random.Random(21)
    phrases = [" ".join(rng.choice([f"p{i}" for i in range(300)]) for _ in range(9)) for _ in range(12)]
    rows = []
    for i in range(900):
        own = f"x{i} y{i} z{i}" if i % 9 else f"x{i - i % 27} y z"
        rows.append((i, " ".join([rng.choice(phrases) for _ in range(rng.choice([3, 4, 8, 12]))] + [own])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    pairs = ngram_join._all_pairs

    def watched(lists, names, percent):
        both = pairs(lists, names, percent)
        sizes = both.groupBy("h", "s", "part").agg(F.countDistinct("node").alias("c")).agg(F.max("c")).first()[0]
        plain = {(r.h, *sorted((r.a, r.b))) for r in lists.select("h", F.col("node").alias("a"), "n").join(lists.select("h", F.col("node").alias("b"), F.col("n").alias("m")), "h").where("a < b AND 100 * least(n, m) >= 85 * greatest(n, m)").collect()}
        got = [(r.h, *sorted((r.node, r.l_node))) for r in both.select("h", "node", "l_node").collect()]
        assert len(got) == len(set(got)) and plain <= set(got)
        seen.append((sizes, len(got)))
        return both

    monkeypatch.setattr(ngram_join, "_all_pairs", watched)
    assert got(similar_documents(docs)) == brute(rows, 4, 85)
    assert seen and all(size is None or size <= 2 * 64 for size, _ in seen) and max(n for _, n in seen) > 1000
