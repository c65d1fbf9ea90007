"""Metadata, index and log of a lake as one store: they change together or not at all.

One manifest names what of the three tables is live. A change writes new files beside the old ones and commits by
one rename, so a crash between any two writes leaves the old state, and a reader that has opened a view keeps the
state it opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from foliospark.sources.manifest import Manifest, Section
from foliospark.sources.segments import SegmentedIndex
from foliospark.sources.tables import AppendTable, MergeTable

METADATA = "book_id long, title string, author string, language string, capture_date string, header_path string, body_path string"
LOG = "book_id long, state string, seq long"


class View:
    """The three tables as of one state."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, state: dict, writable: bool, buckets: int):
        section = lambda name: Section(manifest, name, state, writable)
        self.state = state
        self.metadata = MergeTable(spark, f"{root}/metadata", METADATA, buckets=buckets, manifest=section("metadata"))
        self.index = SegmentedIndex(spark, f"{root}/index", section("index"))
        self.log = AppendTable(spark, f"{root}/log", LOG, section("log"))


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifest = Manifest(spark, self.root)

    def view(self, epoch: int | None = None) -> View:
        """The last state, or an earlier one that is still kept."""
        state = self.manifest.latest()[1] if epoch is None else self.manifest.at(epoch)
        return View(self.spark, self.root, self.manifest, state, False, self.buckets)

    def seen(self, source: str, batch: int) -> bool:
        """Whether a batch of a source is part of the last state."""
        return self.manifest.latest()[1].get("done", {}).get(source, -1) >= batch

    @contextmanager
    def change(self, source: str | None = None, batch: int | None = None) -> Iterator[View]:
        """A view whose tables can be written; all of it holds when the block ends, nothing if it raises.

        With a source and a number the commit also notes that this batch is done. Raises Conflict if another
        change was committed meanwhile.
        """
        base, state = self.manifest.latest()
        view = View(self.spark, self.root, self.manifest, state, True, self.buckets)
        yield view
        if source is not None and batch is not None:
            state["done"] = state.get("done", {}) | {source: batch}
        self.manifest.commit(base, state)

    def compact(self) -> None:
        with self.change() as view:
            view.metadata.compact()
            view.index.compact()
            view.log.compact()

    def vacuum(self, keep: int = 2) -> None:
        """Removes files that none of the last `keep` states names. For times without a writer."""
        states = self.manifest.forget(keep)
        view = self.view()
        for name, table in (("metadata", view.metadata), ("index", view.index), ("log", view.log)):
            table.drop_unnamed([s.get(name, {}) for s in states])
