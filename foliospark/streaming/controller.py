"""The control loop as a stream: each book's life is a state of its own, retries are its timers.

Ids come from a stream of requests. A book is fetched by the task that holds its state and stored in the lake before
its outcome is told; a permanent failure ends its life, a transient one sets a timer, with a longer wait each time.
What was downloaded in a batch is located, read and committed to the store with its log rows in one change. No
decision passes through the driver, and a batch may be thousands of books. Restarting goes on from the checkpoint:
a fetch that is done again writes the same files, a batch that was committed is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from foliospark.operators import control, tasks
from foliospark.sources import lake
from foliospark.sources.store import Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = StructType([StructField("book_id", LongType()), StructField("state", StringType()), StructField("tries", IntegerType())])
LIFE = StructType([StructField("state", StringType()), StructField("tries", IntegerType())])
Fetch = Callable[[int], tuple[str, str | None, str | None, str]]


class BookLife(StatefulProcessor):
    """One book: asked, then downloaded or failed; in between tries that ended in a transient failure.

    fetch(book_id) gives (outcome, header, body, source_url); outcome is ok, permanent or transient.
    """

    def __init__(self, fetch: Fetch, root: str, layout: str, batch_size: int, wait_ms: int, tries: int):
        self.fetch, self.root, self.layout, self.batch_size, self.wait_ms, self.tries = fetch, root, layout, batch_size, wait_ms, tries

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for _ in rows:
            pass
        if not self.life.exists():  # an id that is asked again has its life already
            yield from self._try(int(key[0]), 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, tries = self.life.get()
        if state == "waiting":
            yield from self._try(int(key[0]), tries, timerValues.getCurrentProcessingTimeInMs())

    def _try(self, book_id: int, tries: int, now_ms: int) -> Iterator[pd.DataFrame]:
        outcome, header, body, url = self.fetch(book_id)
        tries += 1
        if outcome == "ok":
            lake.store_text(self.root, self.layout, book_id, header, body, url, datetime.fromtimestamp(now_ms / 1000), self.batch_size)
            state = control.DOWNLOADED
        elif outcome == "permanent" or tries >= self.tries:
            state = control.FAILED
        else:
            state = "waiting"
            self.handle.registerTimer(now_ms + self.wait_ms * 2 ** (tries - 1))
        self.life.update((state, tries))
        if state != "waiting":
            yield pd.DataFrame({"book_id": [book_id], "state": [state], "tries": [tries]})

    def close(self) -> None:
        pass


def lives(requests: DataFrame, fetch: Fetch, root: str, layout: str, batch_size: int = 1000, wait_ms: int = 60_000, tries: int = 5) -> DataFrame:
    """A stream of (book_id, state, tries) of requests(book_id): each id once, when it was downloaded or has failed.

    After `tries` transient failures a book counts as failed. The session's state store has to be PROVIDER.
    """
    processor = BookLife(fetch, root, layout, batch_size, wait_ms, tries)
    asked = requests.where("book_id IS NOT NULL").select(F.col("book_id").cast("long").alias("book_id"))
    return asked.groupBy("book_id").transformWithStateInPandas(processor, OUTCOME, "append", "processingTime")


def control_stream(requests: DataFrame, fetch: Fetch, store: Store, root: str, layout: str, checkpoint: str, every: str = "10 seconds", **options) -> StreamingQuery:
    """Starts the loop: downloads what is requested, and commits each batch's metadata, postings and log at once."""

    def put(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.root, store.buckets)
        if own.seen(checkpoint, number):
            return
        done = batch.persist()
        try:
            down = done.where(F.col("state") == control.DOWNLOADED).select("book_id")
            books = lake.read_pairs(lake.find_books(batch.sparkSession, root, layout, down, options.get("batch_size", 1000))).persist()
            with own.change(checkpoint, number) as view:
                told = done.select("book_id", "state", F.unix_micros(F.current_timestamp()).alias("seq"))
                if not done.isEmpty():
                    view.log.append(told)
                if not books.isEmpty():
                    tasks.put_books(view, books, root)
            books.unpersist()
        finally:
            done.unpersist()

    found = lives(requests, fetch, root, layout, **options)
    return found.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
