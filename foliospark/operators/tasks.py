"""The steps of the control loop on a lake of text files: download and store, index, refresh metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import control, metadata
from foliospark.sources import fetch, lake
from foliospark.sources.segments import SegmentedIndex
from foliospark.sources.store import METADATA, Store, View
from foliospark.sources.tables import MergeTable


def download(root: str, layout: str, get: Callable = fetch.http_get, batch_size: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """A fetch step for the controller: what arrives whole is in the lake before its outcome is ok.

    Fetching and storing are one task's work, so no text travels; a task that runs again writes the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows[rows["outcome"] == "ok"].itertuples():
                lake.store_text(root, layout, int(r.book_id), r.header, r.body, r.source_url, r.downloaded_at, batch_size)
            yield rows[["book_id", "outcome"]]

    return lambda ids: fetch.fetch(ids, get).mapInPandas(run, "book_id long, outcome string")


def books_of(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """(book_id, header_path, body_path, header, body, modified) of the complete books of a lake."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = lake.list_books(spark, root, layout)
    texts = lake.read_texts(spark, f"{root}/{lake.LAYOUTS[layout]}/*_*.txt").withColumn("path", plain("path"))
    headers = texts.select(F.col("path").alias("header_path"), F.col("text").alias("header"), "modified")
    bodies = texts.select(F.col("path").alias("body_path"), F.col("text").alias("body"))
    found = found.select("book_id", plain("header_path").alias("header_path"), plain("body_path").alias("body_path"))
    return found.join(headers, "header_path").join(bodies, "body_path").select("book_id", "header_path", "body_path", "header", "body", "modified")


def refresh_metadata(books: DataFrame, root: str, path: str) -> None:
    """Puts the metadata of books(book_id, header_path, body_path, header, modified) into the table at `path`; rows
    that are there already are not written again."""
    put_metadata(MergeTable(books.sparkSession, path, METADATA), books, root)


def put_metadata(table: MergeTable, books: DataFrame, root: str) -> None:
    new = metadata.build_metadata(books, root)
    changed = new.join(table.read(), metadata.COLUMNS, "left_anti")
    if not changed.isEmpty():
        table.upsert(changed)


def current_metadata(spark: SparkSession, path: str) -> DataFrame:
    return MergeTable(spark, path, METADATA).read()


def index_books(spark: SparkSession, root: str, layout: str, index_path: str, metadata_path: str, batch_size: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """An index step for the controller: locate, metadata, postings. A missing book touches nothing and is not ok.

    A step reads the files of its own books only.
    """

    def run(ids: DataFrame) -> DataFrame:
        found = lake.read_pairs(lake.find_books(spark, root, layout, ids, batch_size)).persist()
        try:
            refresh_metadata(found, root, metadata_path)
            SegmentedIndex(spark, index_path).add(found.select("book_id", F.col("body").alias("text")))
            done = [r["book_id"] for r in found.select("book_id").collect()]  # one batch of the loop
        finally:
            found.unpersist()
        return ids.select("book_id", F.col("book_id").isin(done).alias("ok"))

    return run


def index_into_store(store: Store, root: str, layout: str, batch_size: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """An index step whose metadata, postings and log rows are committed together."""

    def run(ids: DataFrame) -> DataFrame:
        found = lake.read_pairs(lake.find_books(store.spark, root, layout, ids, batch_size)).persist()
        try:
            if not found.isEmpty():
                with store.change() as view:
                    put_books(view, found, root)
            done = [r["book_id"] for r in found.select("book_id").collect()]  # one batch of the loop
        finally:
            found.unpersist()
        return ids.select("book_id", F.col("book_id").isin(done).alias("ok"))

    return run


def put_books(view: View, books: DataFrame, root: str) -> None:
    """Puts books(book_id, header_path, body_path, header, body, modified) into an open change of a store."""
    put_metadata(view.metadata, books, root)
    view.index.add(books.select("book_id", F.col("body").alias("text")))
    view.log.append(control.mark(view.log.read(), books.select("book_id"), control.INDEXED))
