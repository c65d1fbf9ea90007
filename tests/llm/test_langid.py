from __future__ import annotations

import itertools
import zlib

import numpy as np

from foliospark.llm import langid


def naive(emit, row, switch):
    out = []
    for r in sorted(set(row)):
        e = emit[row == r]
        best = max(
            itertools.product(range(e.shape[1]), repeat=len(e)),
            key=lambda p: sum(e[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)),
        )
        out += best
    return np.array(out)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        row = np.sort(rng.integers(0, 4, 18))
        emit = rng.normal(size=(18, 2)) * 3
        assert (langid.viterbi(emit, row, 2.0) == naive(emit, row, 2.0)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    model = langid.train(docs.where(~docs.doc_id.isin(list(held))))
    pred = {r.doc_id: r.lang_pred for r in langid.label_languages(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(pred[i] == truth[i] for i in held) / len(held) > 0.93


def test_mixed_text_gets_spans(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars between 400 and 900").collect()}
    mixed = by["de"][:300] + "\n" + by["es"][:300]
    row = langid.label_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["de", "es"]
    assert row.spans[0].start == 0 and abs(row.spans[0].end - 300) < 40
    assert row.spans[1].end <= len(mixed) and 0.4 < row.score < 0.6


def test_scripts_narrow_candidates(spark):
    rows = [("el", "και το είναι στην που με για από"), ("ru", "и не на что как это он по"), ("en", "the of and to in is that")] * 4
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "ζζζζ ωωω"), (2, "жжж ыыы"), (3, "zzz qqq"), (4, "漢字 仮名")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.label_languages(docs, model).collect()}
    assert (got[1], got[2], got[3]) == ("el", "ru", "en") and got[4] in ("el", "ru", "en")


def test_odd_and_empty_rows(spark, odd_docs, no_docs, sf):
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = langid.label_languages(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and 4 not in und
    assert langid.label_languages(no_docs, model).count() == 0
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.label_languages(odd_docs, empty).collect()} == {"und"}


def test_posteriors_against_plain_sums():
    """Of single words: sums over letter pairs and triples by plain integers, softmax over the script's candidates, floored."""
    rng = np.random.default_rng(2)
    scripts = len(langid.SCRIPT_NAMES)
    counts = np.zeros((3, langid.SLOTS + scripts), dtype=np.int64)
    counts[:, : langid.SLOTS] = rng.integers(0, 50, (3, langid.SLOTS))
    latin, cyrillic = langid.SCRIPT_NAMES.index("latin"), langid.SCRIPT_NAMES.index("cyrillic")
    counts[:2, langid.SLOTS + latin] = 1000
    counts[2, langid.SLOTS + cyrillic] = 1000
    model = langid.Model(["aa", "bb", "cc"], counts)
    full = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & full
        return x ^ (x >> 31)

    words = ["Straße", "a", "Москва", "naïve", "x" * 40]
    a, b, row, low, _ = langid._words(words)
    assert row.tolist() == list(range(len(words)))
    got = langid._posteriors(model, a, b, low)
    for i, word in enumerate(words):
        codes = [0, *(ord(c) for c in word.lower()), 0]
        sums = np.zeros(3)
        for p, c, n in zip(codes, codes[1:], codes[2:], strict=False):
            for slot in (mix((p << 21) | c | 1 << 63) >> 49, mix((p << 42) | (c << 21) | n) >> 49):
                sums += np.log((counts[:, slot] + langid.ALPHA) / (counts[:, : langid.SLOTS].sum(axis=1) + langid.ALPHA * langid.SLOTS))
        can = [2] if word == "Москва" else [0, 1]
        want = sums[can] - sums[can].max()
        want = np.maximum(want - np.log(np.exp(want).sum()), langid.FLOOR)
        assert np.allclose(got[i, can], want, atol=1e-3)  # the model holds single precision
        assert (np.delete(got[i], can) == 4 * langid.FLOOR).all()
