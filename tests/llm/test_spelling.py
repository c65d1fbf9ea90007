from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import spelling
from foliospark.llm.queries import QUERIES
from foliospark.llm.spelling import group_variants, near_pairs, words


def plain_words(rows, every=97, least=3):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(word):
    letters = {chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]}
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain_groups(count):
    out = {}
    for w, n in count.items():
        near = [x for x in one_edit(w) if x in count]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        out[w] = (best if best is not None and count[best] >= 2 * n else None, n, len(near))
    root = {}
    for w in count:
        x = w
        while out[x][0] is not None:
            x = out[x][0]
        root[w] = x
    return {(w, f, root[w], n, k, count.get(f)) for w, (f, n, k) in out.items()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf).collect()
    want = plain_groups(plain_words(rows))
    assert len(got) == len(want) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want
    assert sum(r.form is not None for r in got) > 100 and any(r.root != r.form for r in got if r.form)


@settings(max_examples=12, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=8), max_size=60))
def test_pairs_meet_once(spark, found):
    vocabulary = spark.createDataFrame([(w, 3) for w in sorted(found)], "word string, n long")
    got = [tuple(sorted((r.word, r.other))) for r in near_pairs(vocabulary).collect()]
    assert sorted(got) == sorted({tuple(sorted((w, x))) for w in found for x in one_edit(w) if x in found})


def test_repeated_letters_ties_and_chains(spark):
    count = {"aaaaa": 40, "aaaaaa": 3, "aaaba": 40, "aaaca": 4, "zzzzz": 9, "zzzzy": 4, "zzzyy": 2, "alone": 5, "tiaea": 3, "x" * 50_000: 3, "x" * 49_999: 6}
    got = group_variants(spark.createDataFrame(list(count.items()), "word string, n long")).collect()
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in got}
    assert len(got) == len(count)
    assert found["aaaaaa"] == ("aaaaa", "aaaaa", 1, 40)
    assert found["aaaca"] == ("aaaaa", "aaaaa", 2, 40)  # of two forms with 40 places the smaller one
    assert found["aaaaa"] == (None, "aaaaa", 3, None)
    assert found["zzzyy"] == ("zzzzy", "zzzzz", 1, 4)
    assert found["alone"] == (None, "alone", 0, None)
    assert found["x" * 50_000] == ("x" * 49_999, "x" * 49_999, 1, 6)


def test_long_chains_are_followed(spark):
    chain = {"a" * (5 + i): 2**i * 3 for i in range(20)}
    got = group_variants(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert {r.root for r in got.collect()} == {"a" * 24}
    with pytest.raises(ValueError):
        group_variants(got, ratio=1)


def test_odd_and_empty(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 2)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {r.word: r.n for r in words(odd_docs.unionByName(odd_docs), every=97, least_count=2).collect()}
    assert got == plain_words(rows + rows, least=2) and "x" * 200_000 in got
    upper = spark.createDataFrame([(1, "ÀBCDE àbcde ÀBCDe x÷×yzw"), (1, "ÀBCDE àbcde ÀBCDe x÷×yzw"), (None, None)], "doc_id long, text string")
    assert {r.word: r.n for r in words(upper, least_count=1).collect()} == {"Àbcde": 4, "àbcde": 2, "x÷×yzw": 2}
    assert group_variants(words(no_docs)).count() == 0
    assert group_variants(words(odd_docs.where("text IS NULL"))).count() == 0
