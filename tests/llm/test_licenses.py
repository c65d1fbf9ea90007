from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import licenses
from foliospark.llm.licenses import BASE, TEMPLATES, Index, aligned, scan_licenses, weigh_words
from foliospark.llm.queries import ORACLE, QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w, out = words(text), []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(i, i + len(p), label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


def test_base_equals_sql_and_labels_contain_it(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['license_base_labels']})").fetchall())
    rows = QUERIES["op11_license_scan"](spark, sf).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == want
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in rows:  # the notices of the table, and nothing in other texts
        text = texts[r.doc_id]
        for notice, label in (("Apache License, Version 2.0", "apache-2.0"), ("under the MIT License", "mit"), ("General Public License, version 3", "gpl-3.0"), ("CC BY-NC 4.0", "cc-by-nc-4.0")):
            assert (notice in text) == (label in r.labels.split(",")), (r.doc_id, label)
        assert r.labels or not re.search("licen[cs]e |rights reserved", text.lower())


@pytest.fixture(scope="module")
def prose(spark):
    """Texts that have common words of the notices, but no notice."""
    rng = np.random.default_rng(2)
    common = "the of this work is to use under any copy and or permission software license file it by all may be not".split()
    rest = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(common, 40).tolist() + rng.choice(rest, 160).tolist()) for _ in range(200)]
    for t in texts:
        assert not plain_base(t)
    return [(1000 + i, t) for i, t in enumerate(texts)]


def found(frame):
    return {r.doc_id: [(s.label, s.start, s.end, s.base) for s in r.spans] for r in frame.collect()}


def test_notices_in_odd_dress_are_found_and_prose_is_not(spark, prose):
    mit, apache = TEMPLATES[2][1], TEMPLATES[4][1]
    cases = {
        1: "/*\n * " + "\n * ".join(re.findall(r".{1,60}(?:\s|$)", mit)) + "*/ code",
        2: "# " + mit.replace("of this software", "of this software named Foo and Bar").upper(),
        3: "words before. " * 50 + apache + " and words behind" * 30,
        4: " ".join(np.random.default_rng(1).permutation(words(mit)).tolist()),  # all words, no order
        5: mit.replace("hereby", "never"),  # a phrase that must stand is broken
        6: "Licensed under the Apache\nLicense,\tVersion 2.0; or: released under the MIT license",
        7: "Apache licenses versions",
        8: (apache + ". ") * 300,
        9: mit[: len(mit) // 3],  # too little of it
    }
    rows = spark.createDataFrame([*cases.items(), *prose], "doc_id long, text string")
    got = found(scan_licenses(rows))
    labels = {i: [s[0] for s in x] for i, x in got.items()}
    assert labels[1] == ["mit"] and labels[2] == ["mit"] and labels[3] == ["apache-2.0"]
    assert got[3][0][1:3] == (100, 108)
    assert labels[4] == labels[5] == labels[7] == labels[9] == []
    assert labels[6] == ["apache-2.0", "mit"]
    assert labels[8] == ["apache-2.0"] * 300
    assert not any(labels[i] for i, _ in prose)


def test_each_notice_is_found_as_itself(spark, prose):
    rows = spark.createDataFrame([(i, f"Some words. {text}. More words.") for i, (_, text, _) in enumerate(TEMPLATES)] + prose, "doc_id long, text string")
    got = found(scan_licenses(rows))
    for i, (label, text, _) in enumerate(TEMPLATES):
        assert (label, 2, 2 + len(words(text)), False) in got[i]


def test_weights_count_every_text(spark, prose, odd_docs):
    rows = spark.createDataFrame(prose, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    index = Index()
    n = rows.count()
    texts = [set(words(r.text)) for r in rows.select("text").collect()]
    want = [np.log1p(n / (sum(w in t for t in texts) + 1)) for w in index.words]
    assert np.allclose(weigh_words(rows, index), want, atol=1e-6)


def test_alignment_needs_relative_positions():
    index = Index()
    t = next(i for i, x in enumerate(TEMPLATES) if x[0] == "unlicense")
    body, weights = index.bodies[t], np.ones(len(index.words))
    assert aligned(index, weights, t, np.arange(len(body)) + 7, body) == [(7, 7 + len(body), 1.0)]
    spread = np.arange(len(body)) * 30
    assert aligned(index, weights, t, spread, body) == []


def test_odd_and_empty(spark, odd_docs, no_docs, monkeypatch):
    extra = [(20, "CC\nby cc_by cc\x00by"), (21, "accby cc by"), (None, "All rights reserved. all-rights reserved"), (20, "General Public"), (22, "License"), (23, "€cc by cc by€ CC BY"), (24, "cc"), (25, "by"), (26, "word " * 300_000 + "CC BY")]
    rows = odd_docs.select("doc_id", "text", "score", F.lit(1).alias("spans")).unionByName(spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS spans"))
    got = sorted((r.doc_id or -1, r.n_words, sorted((s.start, s.end, s.label) for s in r.spans if s.base)) for r in scan_licenses(rows).collect())
    want = sorted((r.doc_id or -1, len(words(r.text)), plain_base(r.text)) for r in rows.collect())
    assert got == want
    assert scan_licenses(no_docs).count() == 0


def test_index_of_own_templates(spark):
    own = (("house", "kept by the house of ink", ("house of ink",)),)
    rows = spark.createDataFrame([(1, "this is kept by the house of ink"), (2, "house of ink kept")], "doc_id long, text string")
    got = found(scan_licenses(rows, own, ()))
    assert got == {1: [("house", 2, 8, False)], 2: []}
    assert licenses.BASE is BASE
