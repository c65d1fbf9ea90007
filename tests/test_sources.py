"""Sources and sinks that plan their own work: the lake, the JSON index, the fetcher, draws and digests."""

from __future__ import annotations

import collections
import http.server
import json
import os
import random
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.operators import control, digests, sets
from foliospark.operators.pipeline import Controller
from foliospark.schemas import FETCHED
from foliospark.sources import fetch, index_store, lake_source
from foliospark.sources.files import Files

AT = datetime(2026, 10, 2, 7, 30)


@pytest.fixture
def lake(spark):
    lake_source.register(spark)
    return lambda root, layout, **o: spark.read.format("lake").options(path=str(root), layout=layout, batch_size="10", **o).load()


def books(spark, ids):
    return spark.createDataFrame([(i, f"Title: {i}", "" if i == 4 else f"bödy {i}", f"u{i}", AT) for i in ids], FETCHED)


def store(spark, root, layout, ids):
    books(spark, ids).write.format("lake").options(path=str(root), layout=layout, batch_size="10").mode("append").save()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_layouts_give_equal_rows_and_ids_are_pushed(spark, lake, tmp_path, scheme):
    seen = []
    for layout in ("time", "book", "batch"):
        root = tmp_path / layout
        store(spark, f"{scheme}{root}", layout, range(1, 31))
        assert not os.path.exists(root / "_staging" / "x") and (not (root / "_staging").exists() or not os.listdir(root / "_staging"))
        rows = lake(f"{scheme}{root}", layout, books_per_task="4").select("book_id", "header", "body")
        seen.append(sorted(map(tuple, rows.collect())))
        assert rows.rdd.getNumPartitions() == (3 if layout == "batch" else 8) + (layout == "batch")
        for i in (4, 17, 99):
            one = lake(f"{scheme}{root}", layout).where(F.col("book_id") == i)
            assert [r.book_id for r in one.collect()] == ([i] if i < 31 else []) and one.rdd.getNumPartitions() == 1
        assert sorted(r.book_id for r in lake(f"{scheme}{root}", layout).where("book_id IN (3, 28, 50) AND header LIKE 'T%'").collect()) == [3, 28]
        assert lake(f"{scheme}{root}", layout).where("book_id = 3 AND book_id = 4").count() == 0
    assert seen[0] == seen[1] == seen[2] == [(i, f"Title: {i}", "" if i == 4 else f"bödy {i}") for i in range(1, 31)]
    (tmp_path / "book/5/5_header.txt").unlink()
    (tmp_path / "book/6").chmod(0o755)
    (tmp_path / "book/77").mkdir()
    (tmp_path / "book/77/78_body.txt").write_text("x")
    assert lake(tmp_path / "book", "book").count() == 29
    with pytest.raises(Exception, match="no layout"):
        lake(tmp_path, "other").count()


def test_pushed_ids_open_one_folder(spark, tmp_path):
    reader = lake_source.LakeReader(lake_source.Lake({"path": str(tmp_path), "layout": "batch", "batch_size": "10"}))
    left = list(reader.pushFilters([lake_source.EqualTo(("book_id",), 17), lake_source.EqualTo(("header",), "x")]))
    assert [f.attribute for f in left] == [("header",)]
    assert [p.folders for p in reader.partitions()] == [["batch_10_19"]]  # not even listed: there is no such folder


def test_newest_complete_copy_of_the_source(lake, tmp_path):
    for folder, kinds in (("20250925/09", ("header", "body")), ("20250926/14", ("body",))):
        (tmp_path / folder).mkdir(parents=True)
        for kind in kinds:
            (tmp_path / folder / f"7_{kind}.txt").write_text(folder)
    assert [r.body for r in lake(tmp_path, "time").collect()] == ["20250925/09"]
    (tmp_path / "20250926/14/7_header.txt").write_text("h")
    assert [r.body for r in lake(tmp_path, "time").collect()] == ["20250926/14"]


def test_a_failed_write_leaves_nothing(spark, lake, tmp_path):
    bad = books(spark, range(1, 9)).withColumn("body", F.when(F.col("book_id") == 8, F.raise_error(F.lit("torn"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="torn"):
        bad.repartition(3).write.format("lake").options(path=str(tmp_path), layout="book").mode("append").save()
    assert lake(tmp_path, "book").count() == 0
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_streamed_books_come_once(spark, lake, tmp_path, monkeypatch):
    root, out = tmp_path / "lake", str(tmp_path / "out")
    store(spark, root, "batch", [1, 2])
    stream = spark.readStream.format("lake").options(path=str(root), layout="batch", batch_size="10").load().select("book_id", "body")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    got = lambda: sorted(r.book_id for r in spark.read.schema("book_id long, body string").parquet(out).collect()) if os.path.exists(out) else []

    def wait(want):
        for _ in range(120):
            if got() == want:
                return True
            time.sleep(0.5)
        return False

    try:
        assert wait([1, 2])
        store(spark, root, "batch", [3, 12])
        assert wait([1, 2, 3, 12])
    finally:
        query.stop()


@pytest.mark.parametrize("split", [64, 200, 10**7])
def test_json_index_is_read_in_splits(spark, tmp_path, split):
    rng = random.Random(3)
    want = {w: sorted(rng.sample(range(-5, 5000), rng.choice([1, 2, 40, 400]))) for w in ["cat", "dog", 'q"uote', "back\\slash", "ünï", "a]b", "{x}", "zebra"]} | {"none": []}
    path = str(tmp_path / "i.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(want, f, indent=rng.choice([None, 2]), ensure_ascii=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = index_store.load_json(spark, path)
        got = collections.defaultdict(list)
        for r in found.collect():
            got[r.term].append(r.book_id)
        assert {w: sorted(x) for w, x in got.items()} == {w: x for w, x in want.items() if x}
        splits = spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions()
        assert (splits > 10) == (split < 10**6)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    with open(path, "w") as f:
        json.dump({"a,b": [1, 2], "c": [3]}, f)
    assert sorted(map(tuple, index_store.load_json(spark, path).collect())) == [("a,b", 1), ("a,b", 2), ("c", 3)]
    (tmp_path / "e.json").write_text("{}")
    assert index_store.load_json(spark, str(tmp_path / "e.json")).count() == 0


class Server:
    """Counts requests, connections and their times; /busy answers 503 twice, /limit 429 always, /gone 404."""

    def __init__(self):
        seen = self
        self.times, self.connections, self.tries = [], 0, collections.Counter()

        class Handler(http.server.BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def setup(self):
                seen.connections += 1
                super().setup()

            def do_GET(self):
                seen.times.append(time.monotonic())
                seen.tries[self.path] += 1
                status = 404 if "gone" in self.path else 429 if "limit" in self.path else 503 if "busy" in self.path and seen.tries[self.path] < 3 else 200
                body = f"text of {self.path}".encode()
                self.send_response(status)
                if status == 429:
                    self.send_header("Retry-After", "0")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_a_host_is_fetched_at_its_rate_by_one_connection(spark):
    one, two = Server(), Server()
    paths = [f"/{i}" for i in range(8)] + ["/gone", "/limit", "/busy", "/7?x=1"]
    rows = [(i, f"{s.url}{p}") for s in (one, two) for i, p in enumerate(paths)] + [(99, "http://127.0.0.1:9/none")]
    got = {r.source_url: (r.status, r.text) for r in fetch.fetch_politely(spark.createDataFrame(rows, "book_id long, source_url string"), per_second=20, tries=3).collect()}
    for s in (one, two):
        for p in paths:
            want = (404, None) if p == "/gone" else (429, None) if p == "/limit" else (200, f"text of {p}")
            assert got[f"{s.url}{p}"] == want
        gaps = [b - a for a, b in zip(s.times, s.times[1:], strict=False)]
        assert min(gaps) > 0.035 and len(s.times) == len(paths) + 4 and s.connections == 1
        s.server.shutdown()
    assert got["http://127.0.0.1:9/none"] == (None, None)


@pytest.mark.parametrize("highest, k", [(1, 1), (37, 5), (64, 64), (1000, 93)])
def test_draws_meet_every_id_once(spark, highest, k):
    taken = spark.createDataFrame([(3,)] if highest > 3 else [], "book_id long")
    want, got, at = set(range(1, highest + 1)) - ({3} if highest > 3 else set()), [], control.Draw()
    while len(got) < len(want):
        found, at = control.draw_next(spark, taken, highest, min(k, len(want) - len(got)), at, key=5)
        got += found
    assert sorted(got) == sorted(want) and (highest < 30 or got != sorted(got))
    other, _ = control.draw_next(spark, taken, highest, min(k, len(want)), control.Draw(), key=6)
    assert highest < 30 or other != got[: len(other)]


def test_draws_go_on_after_a_restart(spark, tmp_path):
    asked = []

    def get(ids):
        asked.extend(r.book_id for r in ids.collect())
        return ids.select("book_id", F.lit("transient").alias("outcome"))

    for _ in range(5):  # a new controller each time
        Controller(spark, str(tmp_path / "log"), get, lambda ids: ids.select("book_id", F.lit(True).alias("ok")), highest=23).step(5)
    assert sorted(asked[:23]) == list(range(1, 24)) and len(asked) == 25 and len(set(asked[20:])) == 5


def test_digests_find_what_differs(spark):
    rng = random.Random(2)
    left = [(f"t{rng.randrange(400)}", rng.randrange(900)) for _ in range(4000)]
    left = sorted(set(left))
    right = [x for x in left if x != left[7]] + [("new", 1), (None, 2)]
    a, b = (spark.createDataFrame(x, "term string, book_id long") for x in (left, right))
    got = {tuple(r) for r in digests.difference(a.repartition(5), b, "term", "book_id").collect()}
    assert got == {(*left[7], "left"), ("new", 1, "right"), (None, 2, "right")}
    assert digests.difference(a, a.orderBy("book_id"), "term", "book_id").isEmpty()
    x, y = digests.in_unequal_ranges(a, b, F.pmod(F.xxhash64("term"), F.lit(digests.RANGES)), "term", "book_id")
    assert x.count() < 100 and y.count() < 100  # equal ranges take no part in the comparison
    leaves = digests.range_digests(a, F.pmod(F.xxhash64("term"), F.lit(64)), "term", "book_id")
    root = digests.rolled_up(digests.rolled_up(leaves, 8), 8).collect()
    whole = digests.range_digests(a, F.lit(0).cast("long"), "term", "book_id").collect()
    assert [tuple(map(int, r)) for r in root] == [tuple(map(int, r)) for r in whole]


def test_first_difference_by_ranges(spark):
    lines = [(i, f"v{i}") for i in range(0, 9000, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "line long, value string")
    other = list(lines)
    other[2000], other[2500] = (6000, "x"), (7500, None)
    for a, b in ((lines, other), (lines, lines), (lines, lines[:-1]), (lines[5:], lines), ([], lines), ([], [])):
        want = [tuple(r) for r in sets.first_difference(frame(a), frame(b)).collect()]
        assert [tuple(r) for r in digests.first_difference(frame(a), frame(b)).collect()] == want


def test_files_of_a_file_system(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/x")
    assert files.names() == [] and files.stamp() == () and not files.exists("a/b.txt")
    assert files.create("a/b.txt", "öne") and not files.create("a/b.txt", "two") and files.read("a/b.txt") == "öne"
    assert files.create("a/b.txt", "three", replace=True) and files.read("a/b.txt") == "three"
    before = files.stamp()
    assert files.create("c.txt", "") and files.stamp() != before and files.names() == ["a", "c.txt"]
    assert files.rename("c.txt", "a/d.txt") and files.names("a") == ["b.txt", "d.txt"]
    files.delete("a")
    assert files.names() == []


def test_json_is_written_by_tasks(spark, tmp_path):
    """No entry comes to the driver, the order of rows and partitions is kept, and nothing is left beside the file."""
    import json

    want = {f"t{i:04}": [i, i + 7, -i] for i in range(500)} | {'zz"\\é': [1], "zzz": []}
    frame = spark.createDataFrame(list(want.items()), "term string, postings array<long>").repartitionByRange(7, "term").sortWithinPartitions("term")
    kept, type(frame).toLocalIterator = type(frame).toLocalIterator, None
    try:
        index_store.save_json(frame, str(tmp_path / "i.json"))
    finally:
        type(frame).toLocalIterator = kept
    text = (tmp_path / "i.json").read_text()
    assert json.loads(text) == want and list(json.loads(text)) == sorted(want)
    assert text.startswith('{\n  "t0000": [\n    0,\n    7,\n    0\n  ],\n') and text.endswith("\n}")
    assert [p.name for p in tmp_path.iterdir()] == ["i.json"]
    assert sorted(map(tuple, index_store.load_json(spark, str(tmp_path / "i.json")).collect())) == sorted((t, i) for t, p in want.items() for i in p)


def test_lake_messages_do_not_grow_with_the_books(spark, tmp_path):
    """A task sends the path of its list; the commit moves what the lists name."""
    import pickle
    from datetime import datetime

    from pyspark.sql.types import Row, StructType

    schema = StructType.fromDDL("book_id long, header string, body string, source_url string, downloaded_at timestamp")
    lake = lake_source.Lake({"path": str(tmp_path), "layout": "batch", "batch_size": "10"})
    sizes = {}
    for low, n in ((0, 1), (100, 300)):
        writer = lake_source.LakeWriter(lake, schema)
        message = writer.write(iter([Row(book_id=low + i, header="h", body=f"b{i}", source_url="u", downloaded_at=datetime(2026, 10, 2)) for i in range(n)]))
        sizes[n] = len(pickle.dumps(message))
        writer.commit([message, None])
    assert sizes[300] == sizes[1]
    assert (tmp_path / "batch_390_399" / "399_body.txt").read_text() == "b299" and not list((tmp_path / "_staging").iterdir())
