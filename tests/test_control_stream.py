from __future__ import annotations

import os
import time

import pytest

from foliospark.operators import control
from foliospark.sources.store import Store
from foliospark.streaming import controller


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, controller.PROVIDER)
    yield
    if old is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, old)


def fetcher(folder):
    """Multiples of 7 are gone, those of 10 fail once, those of 25 always; a call leaves a mark."""

    def fetch(i):
        calls = sum(name.startswith(f"{i}.") for name in os.listdir(folder)) if i % 10 == 0 or i % 25 == 0 else 0
        if i % 10 == 0 or i % 25 == 0:
            open(f"{folder}/{i}.{calls}", "w").close()
        if i % 7 == 0:
            return "permanent", None, None, f"u{i}"
        if i % 25 == 0 or (i % 10 == 0 and calls == 0):
            return "transient", None, None, f"u{i}"
        return "ok", f"Title: T{i}\nLanguage: English\n", f"cat w{i % 3}x", f"u{i}"

    return fetch


def test_books_live_their_lives(spark, tmp_path, rocks):
    n = 300
    marks, asked, root = tmp_path / "marks", tmp_path / "asked", str(tmp_path / "lake")
    marks.mkdir()
    asked.mkdir()
    store = Store(spark, str(tmp_path / "store"), buckets=2)

    def ask(name, ids):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in ids))
        os.replace(tmp_path / name, asked / name)

    def start():
        requests = spark.readStream.schema("book_id long").csv(str(asked))
        return controller.control_stream(requests, fetcher(str(marks)), store, root, "batch", str(tmp_path / "cp"), every="1 second", batch_size=100, wait_ms=500, tries=3)

    def states():
        log = store.view().log.read()
        return {s: {r.book_id for r in control.books_in(log, s).collect()} for s in (control.DOWNLOADED, control.INDEXED, control.FAILED)}

    def wait(ids):
        for _ in range(150):
            got = states()
            if got[control.DOWNLOADED] | got[control.FAILED] == set(ids):
                return got
            time.sleep(1)
        raise AssertionError(sorted(set(ids) - got[control.DOWNLOADED] - got[control.FAILED]))

    lost = lambda ids: {i for i in ids if i % 7 == 0 or i % 25 == 0}
    query = start()
    ask("one", range(1, n // 2))
    wait(range(1, n // 2))
    query.stop()
    query = start()  # goes on where it was
    ask("two", range(100, n))  # some are asked again
    got = wait(range(1, n))
    query.stop()
    assert got[control.FAILED] == lost(range(1, n))
    assert got[control.DOWNLOADED] == got[control.INDEXED] == set(range(1, n)) - lost(range(1, n))
    assert store.view().log.read().groupBy("book_id", "state").count().where("count > 1").isEmpty()
    assert {r.book_id for r in store.view().index.lookup("cat").collect()} == got[control.INDEXED]
    assert store.view().metadata.read().count() == len(got[control.INDEXED])
    tries = lambda i: sum(f.startswith(f"{i}.") for f in os.listdir(marks))
    assert tries(20) == 2 and tries(25) == 3 and tries(70) == 1
