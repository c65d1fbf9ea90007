"""Stores, tasks and trees of files: what is written is found again, and a crash changes nothing."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.operators import index, measures, query, sets, tasks
from foliospark.operators.pipeline import Controller
from foliospark.schemas import FETCHED, METRICS
from foliospark.sources import atomic, control_log, fetch, index_store, lake, results

AT = datetime(2026, 10, 2, 7, 30)
MARK = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***"


def test_atomic_text(tmp_path):
    path = str(tmp_path / "a.txt")
    atomic.write_text(path, "one\r\ntwo\n")
    assert open(path, "rb").read() == b"one\r\ntwo\n"

    def broken():
        yield "half"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        atomic.write_text(path, broken())
    assert os.listdir(tmp_path) == ["a.txt"] and open(path, "rb").read() == b"one\r\ntwo\n"


@pytest.mark.parametrize("layout", ["time", "book", "batch"])
def test_a_stored_book_is_found(spark, tmp_path, layout):
    root = str(tmp_path / layout)
    books = spark.createDataFrame([(7, "Title: A", "cat dog", "u7", AT), (1009, "Title: B", "owl\r\n", "u9", AT)], FETCHED)
    lake.store_texts(books, root, layout)
    lake.store_texts(books, root, layout)  # again: nothing more
    found = lake.list_books(spark, root, layout)
    assert sorted(r.book_id for r in found.collect()) == [7, 1009]
    one = lake.find_book(spark, root, layout, 1009).first()
    assert open(one.body_path.removeprefix("file:"), newline="").read() == "owl\r\n"
    with pytest.raises(FileNotFoundError):
        lake.find_book(spark, root, layout, 8)
    assert os.path.exists(f"{root}/7/metadata.json") == (layout == "book")
    full = {r.book_id: (r.header, r.body) for r in tasks.books_of(spark, root, layout).collect()}
    assert full == {7: ("Title: A", "cat dog"), 1009: ("Title: B", "owl\r\n")}


def test_bad_batch_size(spark, tmp_path):
    with pytest.raises(ValueError):
        lake.store_texts(spark.createDataFrame([], FETCHED), str(tmp_path), "batch", 0)


def test_a_fetched_book_ends_in_lake_metadata_index_and_log(spark, tmp_path):
    def get(url):
        n = int("".join(c for c in url.rsplit("/", 1)[-1] if c.isdigit()))
        if n == 3:
            return 404, None
        if n == 4:
            return None, None
        return 200, f"Title: Book {n}\nAuthor: Ann\nLanguage: English\n{MARK[0]}\nwalrus {'cat' if n % 2 else 'dog'}\n{MARK[1]}\nlicence"

    root, table, meta = (str(tmp_path / x) for x in ("lake", "index", "meta"))
    step = tasks.index_books(spark, root, "book", table, meta)
    loop = Controller(spark, str(tmp_path / "log"), tasks.download(root, "book", get), step, highest=4)
    first = loop.step(4)
    assert (first.succeeded, first.failed) == (2, 2)
    assert sorted(r.book_id for r in lake.list_books(spark, root, "book").collect()) == [1, 2]
    asked = spark.createDataFrame([(1,), (2,), (9,)], "book_id long")
    for _ in range(2):  # as after a crash before the log was written
        assert sorted((r.book_id, r.ok) for r in step(asked).collect()) == [(1, True), (2, True), (9, False)]
    assert loop.step(4).succeeded == 2
    assert sorted((r.term, r.book_id) for r in index_store.load_table(spark, table).collect()) == [("cat", 1), ("dog", 2), ("walrus", 1), ("walrus", 2)]
    known = tasks.current_metadata(spark, meta).orderBy("book_id").collect()
    assert [(r.book_id, r.title, r.author, r.language) for r in known] == [(1, "Book 1", "Ann", "en"), (2, "Book 2", "Ann", "en")]
    assert tasks.current_metadata(spark, meta).count() == 2
    assert [r.book_id for r in index_store.lookup(spark, table, "dog").collect()] == [2]
    assert loop.step(4).failed == 1  # 4 was transient and is tried again, 3 is not


def test_cut_off_answers_are_transient(monkeypatch):
    import http.client
    import urllib.request

    for error in (http.client.IncompleteRead(b""), OSError(), ValueError()):
        monkeypatch.setattr(urllib.request, "urlopen", lambda *a, e=error, **k: (_ for _ in ()).throw(e))
        assert fetch.http_get("http://x.example/1") == (None, None)


def test_look_ups_in_the_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    postings = spark.createDataFrame([("cat", 1), ("cat", 2), ("dog", 2), ("élan", 3), ("cow", 3)], "term string, book_id long")
    index_store.save_table(postings, path)
    terms = spark.createDataFrame([("cat",), ("élan",), ("none",), ("cat",)], "term string")
    found = index_store.lookup_terms(spark, path, terms)
    assert sorted((r.term, r.book_id) for r in found.collect()) == [("cat", 1), ("cat", 2), ("élan", 3)]
    assert all("letter=C/" in f or "letter=_/" in f or "letter=N/" in f for f in found.inputFiles())
    assert "In(term, [" in found._jdf.queryExecution().executedPlan().toString()
    assert index_store.lookup_terms(spark, path, terms.where("false")).count() == 0
    asked = query.parse_queries(spark.createDataFrame([("cat dog\nelan\n",)], "content string"))
    answers = query.query_answers(asked, index_store.lookup_terms(spark, path, asked)).orderBy("query_id").collect()
    assert [(r.n_books, r.books) for r in answers] == [(1, "2"), (0, "")]


def test_folder_updates_touch_only_new_ids(spark, tmp_path):
    root = str(tmp_path / "folders")
    start = spark.createDataFrame([("cat", 1), ("cat", 3), ("dog", 1)], "term string, book_id long")
    index_store.save_folders(index.as_arrays(start), root)
    files = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}
    index_store.update_folders(spark.createDataFrame([("cat", 2), ("dog", 1), ("owl", 5)], "term string, book_id long"), root)
    assert sorted((r.term, r.book_id) for r in index_store.load_folders(spark, root).collect()) == [("cat", 1), ("cat", 2), ("cat", 3), ("dog", 1), ("owl", 5)]
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}
    assert after["dog.txt"] == files["dog.txt"] and after["cat.txt"] != files["cat.txt"]


def test_ranks_with_outlying_ids(spark):
    keys = [5, -10**15, 7, 7 * 10**14, 8, *range(100, 600)]
    got = sorted((r.k, r.r) for r in sets.ranked(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect())
    assert got == list(zip(sorted(keys), range(len(keys)), strict=True))
    assert sets.ranked(spark.createDataFrame([], "k long"), "k").count() == 0


def test_snapshot_parity(spark):
    one = spark.createDataFrame([("keys", 0, "a"), ("keys", 1, "b"), ("headers", 0, "h")], "section string, place int, value string")
    two = spark.createDataFrame([("keys", 0, "a"), ("keys", 1, "c"), ("keys", 2, "d"), ("headers", 0, "h")], "section string, place int, value string")
    assert sets.snapshot_parity(one, one).isEmpty()
    assert sorted((r.place, r.expected, r.actual) for r in sets.snapshot_parity(one, two).collect()) == [(1, "b", "c"), (2, None, "d")]


def test_manifest_and_pending(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 12\n\n7 \n12\n")
    assert [r.book_id for r in control_log.read_manifest(spark, str(tmp_path / "ids.txt")).orderBy("place").collect()] == [12, 7, 12]
    (tmp_path / "down.txt").write_text("5\n x\n3\n5\n8")  # a bad line, a repeated one and a torn one
    (tmp_path / "done.txt").write_text("3\n")
    pending = control_log.load_pending(spark, str(tmp_path / "down.txt"), str(tmp_path / "done.txt"))
    assert [r.book_id for r in pending.collect()] == ["5"]
    assert (tmp_path / "down.txt").read_text() == "5\n3\n"


def test_results_tree(spark, tmp_path):
    root = tmp_path / "results"
    for lang in ("go", "python", "cobol"):
        (root / lang).mkdir(parents=True)
    (root / "rust").mkdir()
    run = spark.createDataFrame([("t1", 10, 1.5, 6.66666, AT)], "test_name string, item_count long, elapsed_seconds double, items_per_second double, timestamp timestamp")
    for _ in range(2):
        results.append_rows(run, METRICS["throughput"], str(root / "python" / "throughput.csv"))
    raw = (root / "python" / "throughput.csv").read_bytes()
    assert raw.count(b"test_name") == 1 and raw.count(b"\r\n") == 3 and b"t1,10,1.500000,6.6667,2026-10-02T07:30:00.000000" in raw
    (root / "go" / "memstats.csv").write_text("a\n1\n")
    (root / "go" / "throughput.csv").write_text("")
    assert results.language_folders(str(root)) == ["python", "go"]
    with pytest.warns(UserWarning) as said:
        tree = results.read_tree(spark, str(root))
    assert any("memstats" in str(w.message) for w in said) and any("empty" in str(w.message) or "read" in str(w.message) for w in said)
    assert [(r.language, r.test_name, r.items_per_second) for r in tree["throughput"].collect()] == [("python", "t1", 6.6667)]
    assert tree["recovery"].isEmpty() and set(tree) == set(METRICS)
    out = str(tmp_path / "all.csv")
    results.write_consolidated(tree, out)
    head, line = open(out, newline="").read().split("\r\n")[:2]
    cells = dict(zip(head.split(","), line.split(","), strict=True))
    assert cells["item_count"] == "10" and cells["metric"] == "throughput" and cells["language"] == "python"


def test_radar_file(spark, tmp_path):
    table = spark.createDataFrame([("rust", 20.3590001, 1.0), ("python", 16.71314, 0.123456789)], "language string, throughput double, score double")
    path = str(tmp_path / "radar.csv")
    results.write_radar(table, path)
    assert open(path).read() == "language,throughput,score\npython,16.7131,0.123457\nrust,20.359,1\n"


def test_empty_measurements(spark, tmp_path):
    with pytest.warns(UserWarning):
        raw = measures.read_csv(spark, str(tmp_path / "none.csv"), METRICS["recovery"])
    assert measures.clean(raw, "go", "recovery", METRICS["recovery"]).isEmpty()
    assert raw.select(F.count(F.lit(1))).first()[0] == 0
