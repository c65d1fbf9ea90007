from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import index, query, sets
from foliospark.sources import index_store


def frame(spark, rows):
    return spark.createDataFrame(rows, "book_id long, text string")


def dict_of(postings):
    return {r.term: r.postings for r in index.as_arrays(postings).collect()}


def test_postings_and_adds(spark):
    base = index.build_postings(frame(spark, [(3, "cat cat"), (1, "cat"), (2, "cat")]))
    assert dict_of(base) == {"cat": [1, 2, 3]}
    old = spark.createDataFrame([("cat", 9), ("owl", 9)], "term string, book_id long")
    book = frame(spark, [(3, "cat dog")])
    once = index.add_books(old, book)
    assert dict_of(once) == {"cat": [3, 9], "owl": [9], "dog": [3]}
    assert dict_of(index.add_books(once, book)) == dict_of(once)
    assert index.build_postings(frame(spark, [])).count() == 0


def test_first_appearance_order(spark):
    t = index.tokens(frame(spark, [(1, "zebra apple"), (2, "mango apple")]))
    assert [r.term for r in index.in_first_seen_order(t).collect()] == ["zebra", "apple", "mango"]


def test_all_forms_answer_alike(spark, tmp_path):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "con", "delta", "aux", "omega", "zeta"]
    books = frame(spark, [(i, " ".join(rng.choices(words, k=6))) for i in range(30)])
    first, second = books.where("book_id < 20"), books.where("book_id >= 20")
    for postings in (index.build_postings(first), index.add_books(index.build_postings(first), second)):
        table, js, folder = str(tmp_path / "t"), str(tmp_path / "i.json"), str(tmp_path / "f")
        index_store.save_table(postings, table)
        index_store.save_json(index.as_arrays(postings), js)
        index_store.save_folders(index.as_arrays(postings), folder)
        want = dict_of(postings)
        assert json.load(open(js)) == want
        for got in (index_store.load_table(spark, table), index_store.load_json(spark, js), index_store.load_folders(spark, folder)):
            assert dict_of(got) == want
        for w in [*words, "Alpha", "absent"]:
            assert sorted(r.book_id for r in index_store.lookup(spark, table, w).collect()) == want.get(w, [])
    found = index_store.lookup(spark, table, "alpha")
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1 and "letter=A/bucket=" in found.inputFiles()[0]
    assert "EqualTo(term,alpha)" in found._jdf.queryExecution().toString()


def test_queries(spark):
    q = query.parse_queries(spark.createDataFrame([("# comment\n\nalpha beta # trailing note\n \ngamma\n",)], "content string"))
    assert sorted((r.query_id, r.ordinal, r.term) for r in q.collect()) == [(1, 1, "alpha"), (1, 2, "beta"), (2, 1, "gamma")]
    books = frame(spark, [(1, "alpha beta alpha"), (2, "beta gamma")])
    asked = query.parse_queries(spark.createDataFrame([("alpha beta\nbeta delta\nbeta beta",)], "content string"))
    got = {r.query_id: (r.n_books, r.books) for r in query.query_answers(asked, index.build_postings(books)).collect()}
    assert got == {1: (1, "1"), 2: (0, ""), 3: (2, "1,2")}
    terms = spark.createDataFrame([("alpha",), ("no",)], "term string")
    assert {r.term: r.postings for r in query.multi_term_lookup(terms, index.build_postings(books)).collect()} == {"alpha": [1], "no": []}


def test_canonical_lines(spark):
    tokens = spark.createDataFrame([(1, ["alpha", "beta", "alpha"]), (2, ["beta", "gamma"])], "book_id long, terms array<string>")
    answers = spark.createDataFrame([(1, "1"), (2, "")], "query_id int, books string")
    lines = [r.line for r in sets.canonical_lines(tokens, answers).orderBy("section", "rank", "key").collect()]
    assert lines == ["tokens\t1\talpha\tbeta\talpha", "tokens\t2\tbeta\tgamma", "postings\talpha\t1", "postings\tbeta\t1,2", "postings\tgamma\t2", "query\t1\t1", "query\t2"]


@pytest.mark.parametrize("ids, want", [(list(range(1, 101)), [1, 12, 23, 34, 45, 56, 67, 78, 89, 100]), ([7, 3, 5], [3, 5, 7])])
def test_even_sample(spark, ids, want):
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted(r.id for r in sets.even_sample(rows, "id", 10).collect()) == want


def test_candidates_and_synthetic(spark):
    first = spark.createDataFrame([(1342, 0), (84, 1), (3, 2)], "book_id long, place int")
    got = [r.book_id for r in sets.candidate_ids(first, 5).orderBy("place").collect()]
    assert got == [1342, 84, 3, 1, 2, 4, 5]
    made = index.synthetic_corpus(frame(spark, [(5, "a5"), (7, "b7")]), 5)
    assert {r.book_id: r.text for r in made.collect()} == {5: "a5", 7: "b7", 900000: "a5", 900001: "b7", 900002: "a5"}
    assert [r.book_id for r in index.synthetic_corpus(frame(spark, [(5, "a"), (7, "b")]), 1).collect()] == [5]
    assert first.agg(F.count(F.lit(1))).first()[0] == 3
