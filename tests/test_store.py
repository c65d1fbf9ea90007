from __future__ import annotations

import pytest

from foliospark.sources.manifest import Conflict
from foliospark.sources.store import LOG, METADATA, Store
from foliospark.sources.tables import AppendTable, MergeTable

KIND = "book_id long, title string, n long"


def rows(spark, *data):
    return spark.createDataFrame(list(data), KIND)


def titles(table):
    return {r.book_id: r.title for r in table.read().collect()}


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_last_row_of_a_key_counts(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), KIND, buckets=3)
    assert t.read().count() == 0
    want = {}
    for i in range(9):
        new = {k: f"v{i}-{k}" for k in range(i, i + 4)}
        t.upsert(rows(spark, *[(k, "old", 0) for k in new], *[(k, v, 1) for k, v in new.items()], (None, "x", 9)), order="n")
        want |= new
        assert titles(t) == want
    assert len(t.layers()) <= 5
    t.compact()
    assert titles(t) == want and len(t.layers()) == 1
    again = MergeTable(spark, str(tmp_path / "t"), KIND, buckets=3)
    assert titles(again) == want


def test_reads_and_joins_have_no_exchange(spark, tmp_path, shuffled_joins):
    left = MergeTable(spark, str(tmp_path / "l"), KIND, buckets=3)
    right = MergeTable(spark, str(tmp_path / "r"), "book_id long, text string", buckets=3)
    for i in range(3):
        left.upsert(rows(spark, *[(k, f"t{i}", i) for k in range(5 * i, 5 * i + 9)]))
        right.upsert(spark.createDataFrame([(k, f"b{i}") for k in range(4 * i, 4 * i + 6)], "book_id long, text string"))
    for frame in (left.read(), left.join(right), left.join(right, "left")):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    a, b = titles(left), {r.book_id: r.text for r in right.read().collect()}
    assert {(r.book_id, r.title, r.text) for r in left.join(right).collect()} == {(k, a[k], b[k]) for k in a.keys() & b.keys()}
    got = left.join(right, "left").collect()
    assert len(got) == len(a) and {(r.book_id, r.text) for r in got} == {(k, b.get(k)) for k in a}
    empty = MergeTable(spark, str(tmp_path / "e"), "book_id long, text string", buckets=3)
    assert left.join(empty).count() == 0 and {r.text for r in left.join(empty, "left").collect()} == {None}


def test_a_store_changes_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    books = spark.createDataFrame([(1, "cat"), (2, "dog")], "book_id long, text string")
    meta = spark.createDataFrame([(i, f"T{i}", "a", "en", "d", "h", "b") for i in (1, 2)], METADATA)
    log = spark.createDataFrame([(1, "indexed", 1), (2, "indexed", 1)], LOG)

    def write(view, upto):
        steps = [lambda: view.metadata.upsert(meta), lambda: view.index.add(books), lambda: view.log.append(log)]
        for step in steps[:upto]:
            step()

    seen = lambda view: (view.metadata.read().count(), view.index.postings().count(), view.log.read().count())
    for upto in range(4):  # a kill behind any of the writes
        with pytest.raises(KeyboardInterrupt):
            with store.change("stream", 0) as view:
                write(view, upto)
                raise KeyboardInterrupt
        assert seen(store.view()) == (0, 0, 0) and not store.seen("stream", 0)
    before = store.view()
    with store.change("stream", 0) as view:
        write(view, 3)
        assert seen(store.view()) == (0, 0, 0)
    assert seen(store.view()) == (2, 2, 2) and store.seen("stream", 0) and not store.seen("stream", 1)
    assert seen(before) == (0, 0, 0)
    with pytest.raises(PermissionError):
        store.view().log.append(log)
    held = store.view()
    with store.change() as view:
        view.index.add(spark.createDataFrame([(3, "cat owl")], "book_id long, text string"))
    assert seen(held) == (2, 2, 2) and seen(store.view()) == (2, 4, 2)
    with pytest.raises(Conflict):
        with store.change() as one:
            with store.change() as two:
                two.log.append(log)
            one.log.append(log)
    assert store.view().log.read().count() == 4
    store.compact()
    store.vacuum(keep=1)
    assert seen(store.view()) == (2, 4, 4)
    assert {r.book_id for r in store.view().index.lookup("cat").collect()} == {1, 3}


def test_appended_parts(spark, tmp_path):
    t = AppendTable(spark, str(tmp_path / "a"), LOG)
    for i in range(4):
        t.append(spark.createDataFrame([(i, "x", i)], LOG))
    t.compact(most=3)
    assert sorted(r.book_id for r in t.read().collect()) == [0, 1, 2, 3]
    assert len(t.manifest.latest()[1]["parts"]) == 1
