from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import lm
from foliospark.llm.common import crc_bucket

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fold(i):
    return zlib.crc32(str(i).encode()) % 10


def tokens(text):
    return [*(text or "").encode().translate(FOLD).split(), None]


def run(docs, **sizes):
    f = crc_bucket(F.col("doc_id"), 10)
    return lm.score_texts(docs, held_out=f == 0, deleted=f == 1, **sizes)


def counts(texts):
    """Of some tokenized texts: words, pairs with the word before (a start for the first), and words before."""
    words, pairs, context = Counter(), Counter(), Counter()
    for t in texts:
        words.update(t)
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            pairs[h, w] += 1
            context[h] += 1
    return words, pairs, context


def plain_weights(rows, rounds=100):
    """Expectation-maximisation token by token, on the deleted texts under the estimates of the others."""
    split = [(tokens(t), 2 if i is None else min(fold(i), 2)) for i, t in rows]
    words, pairs, context = counts([t for t, f in split if f == 2])
    distinct = len({w for t, f in split if f for w in t})
    n = max(sum(words.values()), 1)
    seen = []
    for t, f in split:
        if f == 1:
            for h, w in zip(["<s>", *t[:-1]], t, strict=True):
                b = 0 if context[h] == 0 else min(1 + int(math.log2(context[h])), lm.BUCKETS - 1)
                seen.append((b, pairs[h, w] / max(context[h], 1), words[w] / n, 1 / (distinct + 1)))
    weights = {b: ((0.0, 0.9, 0.1) if b == 0 else (0.4, 0.5, 0.1)) for b, *_ in seen}
    for _ in range(rounds):
        sums = {b: np.zeros(3) for b in weights}
        for b, *p in seen:
            part = np.array(weights[b]) * p
            sums[b] += part / part.sum()
        weights = {b: s / s.sum() for b, s in sums.items()}
    return weights


def brute(rows, scorer):
    """The same model from plain dictionaries; only the mixture weights are taken over."""
    words, pairs, context = counts([tokens(t) for i, t in rows if i is None or fold(i)])
    n = sum(words.values())
    out = {}
    for i, t in rows:
        base = score = 0.0
        h = "<s>"
        for w in tokens(t):
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (len(words) + 1)))
            b = 0 if context[h] == 0 else min(1 + int(math.log2(context[h])), lm.BUCKETS - 1)
            l2, l1, l0 = scorer.weights[b]
            score += math.log10(l2 * pairs[h, w] / max(context[h], 1) + l1 * words[w] / max(n, 1) + l0 / (len(words) + 1))
            h = w
        seen = sum(words[w] > 0 for w in tokens(t))
        out[i, t] = (len(tokens(t)), seen, n, base, score)
    return out


def compare(docs, **sizes):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found, scorer = run(docs, **sizes)
    want = brute(rows, scorer)
    have = found.collect()
    assert len(have) == len(rows)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 4))
    expected = sorted([(str(i), *want[i, t]) for i, t in rows], key=lambda v: (v[0], v[1], round(v[4], 4)))
    for r, v in zip(sorted(have, key=key), expected, strict=True):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) == v[:4]
        assert math.isclose(r.base_score, v[4], rel_tol=1e-9)
        assert math.isclose(r.score, v[5], rel_tol=1e-9)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id) == 0)
    return scorer


def test_scores_against_plain_dictionaries(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_small_tables_change_nothing(spark, sf):
    """Words and pairs outside the broadcast tables are modelled one by one, as those inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in docs.collect()], "doc_id long, text string").repartition(3)
    few = compare(docs, heavy_size=200, table_size=300)
    assert len(few.vocabulary.words) <= 301 < few.vocabulary.distinct
    assert np.allclose(few.weights, compare(docs).weights)


def test_more_words_than_the_table_holds(spark):
    """Over 65,536 words of the same frequency: none is pooled, and each has its own pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40_000, 1500).repeat(2) * 2 + np.tile([0, 1], 1500))) for i in range(80)]
    scorer = compare(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scorer.vocabulary.distinct > lm.VOCABULARY


def test_weights_against_plain_expectation_maximisation(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    _, scorer = run(spark.createDataFrame(rows, "doc_id long, text string"), heavy_size=200, table_size=300)
    for b, weights in plain_weights(rows).items():
        assert np.abs(scorer.weights[b] - weights).max() < 0.03  # cells round estimates to an eighth of a bit


def test_odd_and_empty_rows(spark, odd_docs, no_docs):
    compare(odd_docs)
    assert run(no_docs)[0].count() == 0


def test_weights_are_distributions_and_help():
    cells = np.array([(3 << 18) | (8 << 9) | 40, (3 << 18) | (511 << 9) | 24, (0 << 18) | (511 << 9) | 30])
    w = lm.fit_weights(cells, np.array([900, 100, 10]), 1000)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    assert w[3, 0] > 0.8 and w[0, 0] == 0


def test_blocks_round_trip():
    a, b = np.array([0, 5, 2**63 + 1], dtype=np.uint64), np.array([1, 2, 300])
    x, y = lm.unpack(lm.pack(a, b), 2)
    assert (x == a).all() and (y == b).all()
    h, w = lm._uncode(lm._codes(np.array([1, 2, 70000, 1]), np.array([2, 70000, 0, 5])))
    assert h.tolist() == [1, 2, 70000, 1] and w.tolist() == [2, 70000, 0, 5]
