from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import analytics, control, measures, metadata, tasks
from foliospark.operators.pipeline import Controller
from foliospark.schemas import METRICS
from foliospark.sources import fetch, index_store, lake, results
from foliospark.sources.segments import SegmentedIndex
from foliospark.sources.store import Store
from foliospark.streaming import ingest


def put(root, folder, book_id, header=True, body="body"):
    (root / folder).mkdir(parents=True, exist_ok=True)
    (root / folder / f"{book_id}_body.txt").write_text(body)
    if header:
        (root / folder / f"{book_id}_header.txt").write_text(f"Title: Book {book_id}\nLanguage: English\n")


def ids_of(frame):
    return sorted(r.book_id for r in frame.collect())


def test_layouts(spark, tmp_path):
    for folder, i in (("20250925/14", 11), ("84", 84), ("174", 174), ("batch_1000_1999", 1342), ("batch_2000_2999", 2701)):
        put(tmp_path, folder, i)
    (tmp_path / "20250925/14/12_body.txt.tmp").write_text("x")
    put(tmp_path, "85", 86)
    root = str(tmp_path)
    assert ids_of(lake.list_books(spark, root, "time")) == [11]
    assert ids_of(lake.list_books(spark, root, "book")) == [84, 174]
    assert ids_of(lake.list_books(spark, root, "batch")) == [1342, 2701]
    assert lake.find_book(spark, root, "batch", 1342).first().body_path.endswith("batch_1000_1999/1342_body.txt")
    for layout in ("time", "book", "batch"):
        with pytest.raises(FileNotFoundError):
            lake.find_book(spark, root, layout, 999)
    with pytest.raises(ValueError):
        lake.book_folder(root, "batch", 1, 0)


def test_newest_complete_copy(spark, tmp_path):
    put(tmp_path, "20250925/09", 7)
    put(tmp_path, "20250926/14", 7, header=False)
    assert "20250925" in lake.find_book(spark, str(tmp_path), "time", 7).first().body_path
    put(tmp_path, "20250926/14", 7)
    assert "20250926" in lake.list_books(spark, str(tmp_path), "time").first().body_path


def test_stored_tables_are_pruned(spark, tmp_path):
    rows = [(i, "h", f"b{i}", "u", datetime(2025, 9, 25, 14)) for i in (11, 84, 1342)]
    books = spark.createDataFrame(rows, "book_id long, header string, body string, source_url string, downloaded_at timestamp")
    for layout in ("time", "book", "batch"):
        root = str(tmp_path / layout)
        lake.write_books(books, root, layout)
        found = lake.lookup_stored(spark, root, layout, 1342)
        assert [r.body for r in found.collect()] == ["b1342"]
        if layout != "time":
            assert "PartitionFilters: [isnotnull(" in found._jdf.queryExecution().toString()
        assert lake.read_books(spark, root).count() == 3


def test_fetch_outcomes(spark):
    texts = {1: f"h{T.START_MARKER}b{T.END_MARKER}", 2: "no markers"}

    def get(url):
        i = int(url.rsplit("pg", 1)[1].split(".")[0])
        return (200, texts[i]) if i in texts else (404, None) if i == 3 else (429, None) if i == 4 else (None, None)

    got = {r.book_id: (r.outcome, r.body) for r in fetch.fetch(spark.range(1, 6).select(F.col("id").alias("book_id")), get).collect()}
    assert got == {1: ("ok", "b"), 2: ("permanent", None), 3: ("permanent", None), 4: ("transient", None), 5: ("transient", None)}


BOOK = "book_id long, title string, author string, language string, capture_date string, header_path string, body_path string"


def test_metadata_searches_and_upserts(spark):
    rows = [(1342, "Pride_", "Jane AUSTEN", "en", "d", "h", "b1342"), (105, "Persuasion", "Austen, Jane", "en", "d", "h", "b105"), (84, "ÉMILE 100", "Shelley", "en", "d", "h", "b"), (9, "Old", "Austen", "en", "d", None, None)]
    table = spark.createDataFrame(rows, BOOK)
    assert [r.book_id for r in metadata.find_by(table, "author", "austen").collect()] == [105, 1342]
    assert metadata.find_by(table, "author", "%").count() == 0
    assert [r.book_id for r in metadata.find_by(table, "title", "_").collect()] == [1342]
    assert metadata.find_by(table, "title", "émile").count() == 0
    assert metadata.find_by(table, "title", "").count() == 3
    with pytest.raises(LookupError):
        metadata.require_book(table, 9)
    new = spark.createDataFrame([(84, "A", "x", "en", "d", "h", "b", 1), (84, "B", "x", "en", "d", "h", "b", 2), (9, "Old", "Austen", "en", "d", "h", "b9", 3)], BOOK + ", seq long")
    saved = {r.book_id: r.title for r in metadata.list_books(metadata.save_many(table, new)).collect()}
    assert saved == {9: "Old", 84: "B", 105: "Persuasion", 1342: "Pride_"}
    assert metadata.top_author(table).first().n_books == 1


def test_controller(spark, tmp_path):
    ok = lambda ids: ids.select("book_id", F.when(F.col("book_id") % 3 == 0, "permanent").when(F.col("book_id") % 3 == 1, "ok").otherwise("transient").alias("outcome"))
    build = lambda ids: ids.select("book_id", (F.col("book_id") != 4).alias("ok"))
    c = Controller(spark, str(tmp_path / "log"), ok, build, highest=9)
    first = c.step(9)
    assert (first.succeeded, first.failed) == (3, 6)
    assert ids_of(control.books_in(c.log(), "failed")) == [3, 6, 9]
    second = c.step(9)
    assert (second.succeeded, second.failed) == (2, 1)
    assert ids_of(control.pending_books(control.books_in(c.log(), "downloaded"), control.books_in(c.log(), "indexed"))) == [4]
    third = c.step(9)  # 4 is not tried again; candidates are the transient ones
    assert (third.succeeded, third.failed) == (0, 3)
    with pytest.raises(ValueError):
        c.run(-1)


def test_streamed_ingestion_is_exactly_once(spark, tmp_path):
    root, table, log = tmp_path / "lake", str(tmp_path / "index"), str(tmp_path / "log")
    put(root, "20250925/14", 11, body="cat dog")
    run = lambda: ingest.ingest(spark, str(root), table, log, str(tmp_path / "cp")).awaitTermination()
    run()
    put(root, "20250925/15", 12, body="cat owl")
    (root / "20250925/15/13_body.txt.tmp").write_text("never")
    run()
    run()
    rows = SegmentedIndex(spark, table).postings().collect()
    assert sorted((r.term, r.book_id) for r in rows) == [("cat", 11), ("cat", 12), ("dog", 11), ("owl", 12)]
    assert sorted(r.book_id for r in spark.read.parquet(log).collect()) == [11, 12]
    bodies = spark.createDataFrame([(12, "cat owl")], "book_id long, text string")
    ingest.index_batch(bodies, table, log)  # a batch done twice
    assert SegmentedIndex(spark, table).postings().count() == 4 and spark.read.parquet(log).count() == 2
    assert ids_of(index_store.lookup(spark, table, "cat")) == [11, 12]


def test_a_body_waits_for_its_header(spark, tmp_path):
    root, store = tmp_path / "lake", Store(spark, str(tmp_path / "store"))
    put(root, "20250925/14", 11, body="cat dog")
    put(root, "20250925/14", 12, header=False, body="cat owl")
    run = lambda: ingest.ingest_pairs(spark, str(root), store.root, str(tmp_path / "cp")).awaitTermination()
    state = lambda v: (ids_of(v.metadata.read()), ids_of(v.index.lookup("cat")), ids_of(v.log.read()))
    run()
    assert state(store.view()) == ([11], [11], [11])
    (root / "20250925/14/12_header.txt").write_text("Title: Book 12\nLanguage: English\n")
    (root / "20250925/15").mkdir()
    (root / "20250925/15/11_header.txt").write_text("Title: no body yet\n")
    run()
    run()
    assert state(store.view()) == ([11, 12], [11, 12], [11, 12])
    titles = lambda: {r.book_id: r.title for r in store.view().metadata.read().collect()}
    assert titles() == {11: "Book 11", 12: "Book 12"}
    (root / "20250925/15/11_body.txt").write_text("cat emu")  # a newer copy, in two parts
    put(root, "20240101/01", 12, body="cat fox")  # an older copy that comes late
    run()
    assert titles() == {11: "no body yet", 12: "Book 12"}
    view = store.view()
    assert ids_of(view.index.lookup("emu")) == [11] and view.index.lookup("fox").count() == 0
    before = store.manifest.latest()
    pairs = spark.createDataFrame([("d", 99, "h", "b")], "dir string, book_id long, header_path string, body_path string")
    ingest.index_pairs(pairs, store, str(root), str(tmp_path / "cp"), 0)  # a batch done twice
    assert store.manifest.latest() == before


def test_a_step_reads_its_own_books(spark, tmp_path):
    for layout in ("time", "book", "batch"):
        root = tmp_path / layout
        folder = {"time": lambda i: "20250925/14", "book": str, "batch": lambda i: f"batch_{i // 10 * 10}_{i // 10 * 10 + 9}"}[layout]
        for i in range(1, 31):
            put(root, folder(i), i, body="owl" if i == 4 else f"cat w{i}")
        asked = spark.createDataFrame([(3,), (4,), (17,), (99,)], "book_id long")
        found = lake.read_pairs(lake.find_books(spark, str(root), layout, asked, 10))
        assert {(r.book_id, r.body, r.header.split("\n")[0]) for r in found.collect()} == {(3, "cat w3", "Title: Book 3"), (4, "owl", "Title: Book 4"), (17, "cat w17", "Title: Book 17")}
        read = {f.rsplit("/", 1)[1] for f in found.inputFiles() if f.endswith(".txt")}
        assert read == {f"{i}_{kind}.txt" for i in (3, 4, 17) for kind in ("body", "header")}
        store = Store(spark, str(tmp_path / f"{layout}-store"), buckets=2)
        step = tasks.index_into_store(store, str(root), layout, 10)
        for _ in range(2):
            assert sorted((r.book_id, r.ok) for r in step(asked).collect()) == [(3, True), (4, True), (17, True), (99, False)]
        assert ids_of(store.view().metadata.read()) == [3, 4, 17] == ids_of(store.view().log.read())
        assert ids_of(store.view().index.lookup("cat")) == [3, 17]


def test_cleaning_keeps_the_latest(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Function_Name ,item_count,items_per_second,timestamp\na,1,10,2026-10-01\na,1,12,2026-10-02\nb,1,not-a-number,2026-10-02\nc,1,0,2026-10-02\n")
    raw = measures.read_csv(spark, str(tmp_path / "t.csv"), METRICS["throughput"])
    got = measures.clean(raw, "rust", "throughput", METRICS["throughput"]).collect()
    assert [(r.test_name, r.items_per_second, r.language) for r in got] == [("a", 12.0, "rust")]
    with pytest.raises(ValueError):
        measures.clean(raw.drop("timestamp"), "rust", "throughput", METRICS["throughput"])


def test_radar_values_of_a_tree(spark, tmp_path):
    """Composites of a tree of files against plain sums, to six digits."""
    rng, at = random.Random(4), datetime(2026, 10, 2)
    raw = {"throughput": {}, "statistics": {}, "scalability": {}}
    for lang in ("python", "go", "rust"):
        folder = tmp_path / lang
        folder.mkdir()
        tests = [f"t{i}" for i in range(5) if (lang, i) != ("go", 4)]  # go lacks a test, which then counts for nobody
        raw["throughput"][lang] = {t: round(rng.uniform(1, 900), 4) for t in tests}
        raw["statistics"][lang] = {t: round(rng.uniform(0.001, 3), 6) for t in tests}
        raw["scalability"][lang] = {(t, n): round(rng.uniform(5, 99), 2) for t in tests for n in (10, 100)}
        rows = {
            "throughput": [(t, 10, 1.0, v, at) for t, v in raw["throughput"][lang].items()],
            "statistics": [(t, 3, v, 0.1, v / 2, v * 2, at) for t, v in raw["statistics"][lang].items()],
            "scalability": [(t, n, 1.0, 0.1, 3, 5.0, v, 6.0, at) for (t, n), v in raw["scalability"][lang].items()],
            "recovery": [("resume", 100, 50, 50 if lang != "go" else 45, 0, 0 if lang != "go" else 5, 1.0, 1.0, 2.0, at)],
        }
        for metric, found in rows.items():
            frame = spark.createDataFrame(found, [*METRICS[metric].columns, "timestamp"])
            results.append_rows(frame, METRICS[metric], str(folder / f"{metric}.csv"))
    tree = results.read_tree(spark, str(tmp_path))
    table = {r.language: r for r in analytics.radar_table(*[tree[m] for m in ("throughput", "statistics", "scalability", "recovery")]).collect()}
    assert set(table) == {"python", "go", "rust"}
    geo = lambda v: math.exp(sum(map(math.log, v)) / len(v))
    for lang, r in table.items():
        assert results.six_digits(r.throughput) == results.six_digits(geo([v for t, v in raw["throughput"][lang].items() if t != "t4"]))
        assert results.six_digits(r.latency) == results.six_digits(geo([v for t, v in raw["statistics"][lang].items() if t != "t4"]))
        cpu = [v for (t, _), v in raw["scalability"][lang].items() if t != "t4"]
        assert results.six_digits(r.mean_cpu) == results.six_digits(sum(cpu) / len(cpu))
        assert r.reliability == (0.95 if lang == "go" else 1.0)
    assert max(r.throughput_score for r in table.values()) == 1.0 == max(r.latency_score for r in table.values())


def test_reliability_and_resume(spark):
    rec = spark.createDataFrame([("go", "t", 100, 50, 50, 0, 0), ("python", "t", 100, 50, 48, 0, 2)], "language string, test_name string, total_books long, processed_before_interruption long, processed_after_resume long, duplicated long, lost long")
    assert {r.language: r.reliability for r in analytics.reliability(rec).collect()} == {"go": 1.0, "python": 0.98}
    assert {r.language: r.verdict for r in analytics.recovery_verdict(rec).collect()} == {"go": "PASS", "python": "FAIL"}
    every = spark.range(1, 101).select(F.col("id").alias("book_id"))
    r = control.verify_resume(every, every.where("book_id <= 50"), every.where("book_id > 50")).first()
    assert (r.duplicated, r.lost) == (0, 0)
    with pytest.raises(Exception, match="throughput needs"):
        spark.range(1).select(measures.throughput(F.lit(5), F.lit(0.0))).collect()


def mart_agrees(spark, folder, name, rows):
    """A query over a few events (event_id, user_id, event_type, value) against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from foliospark.plans import bench_queries

    events = spark.createDataFrame([(i, datetime(2026, 10, 2, 7, 30, i % 60), u, t, v, "") for i, u, t, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    frame = bench_queries.QUERIES[name](spark, str(folder))
    want = con.execute(bench_queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
    return got


ZEROS = [(1, 0, "view", 0.0), (2, 1, "click", 2.5), (3, 2, "view", 0.0), (4, 0, "view", 4.0), (6, 4, "error", None), (8, 2, "click", 0.25), (11, 4, "click", 3.0)]


def test_throughput_of_no_time(spark, tmp_path):
    assert (1, math.inf) in mart_agrees(spark, tmp_path, "throughput", ZEROS)


#: Times of 1000 items: rates near a tie at the fifth place, which decimal digits and scaled doubles round otherwise; signed
#: zeros and infinities; and times so short that the rate has no fourth place, or that the scaled rate is infinite.
TIES = [34782.608695652176, 30257.1860816944, 11997.60047990402, 3956.4787339268055, -34782.608695652176, 10.24, -0.0, -math.inf, math.inf, 5e-16, 1e-302, 5e-324]


@pytest.mark.parametrize("name", ["throughput", "csv_text"])
def test_rates_are_rounded_as_their_sql_does(spark, tmp_path, name):
    rows = mart_agrees(spark, tmp_path, name, [(3 * i, 0, "view", v) for i, v in enumerate(TIES) if name == "throughput" or v in (-0.0, -math.inf) or abs(v) > 10])
    assert {0.0288, 0.0331, 0.0833, 0.2527, -0.0288, -math.inf} <= {float(r[1 if name == "throughput" else 3]) for r in rows}


def test_csv_text_of_no_time(spark, tmp_path):
    rows = mart_agrees(spark, tmp_path, "csv_text", ZEROS)
    assert {r[3] for r in rows} >= {"inf", None} and {r[2] for r in rows} >= {"0.000000", None}


def test_drop_invalid_drops_marked_times_only(spark, tmp_path):
    rows = mart_agrees(spark, tmp_path, "drop_invalid", [*ZEROS, (5, 0, "view", 1.0), (7, 0, "view", 1.0)])
    assert {r[0] for r in rows} >= {1, 3, 4}


def test_geo_mean_with_a_zero(spark, tmp_path):
    assert ("python", 0.0) in mart_agrees(spark, tmp_path, "geo_mean", ZEROS)
    frame = spark.createDataFrame([("go", 0.5), ("go", 2.0), ("go", None)], "language string, x double")
    assert [r.geo_mean for r in analytics.geo_mean(frame, "x").collect()] == [1.0]


def test_stage_winner_works_its_frame_out_once(spark):
    """Values that come out otherwise each time, as sums in another order do."""
    once = F.udf(lambda: random.random(), "double").asNondeterministic()
    frame = spark.createDataFrame([(t, lang) for t in "ab" for lang in ("go", "rust")], "test_name string, language string").withColumn("x", once())
    assert sorted(r.test_name for r in analytics.stage_winner(frame, "x", True).collect()) == ["a", "b"]
