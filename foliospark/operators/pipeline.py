"""The control loop: index what is pending, then admit new downloads, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import control
from foliospark.sources.manifest import Manifest


@dataclass
class Counts:
    succeeded: int = 0
    failed: int = 0


class Controller:
    """States live in an append-only table; fetch and index work on frames of ids.

    fetch(ids) gives (book_id, outcome), outcome ok, permanent or transient; index(ids) gives (book_id, ok).
    A book that fails to index is not tried again in this run; a permanent failure is recorded, a
    transient one is not.
    """

    def __init__(self, spark: SparkSession, log_path: str, fetch: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame], highest: int = 70_000):
        self.spark, self.log_path, self.fetch, self.index, self.highest = spark, log_path, fetch, index, highest
        self.skipped = spark.createDataFrame([], "book_id long")
        self.draws = Manifest(spark, f"{log_path.rstrip('/')}-draws")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.log_path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], "book_id long, state string, seq long")

    def _record(self, found: DataFrame, state: str) -> int:
        rows = control.mark(self.log(), found, state).collect()
        if rows:
            self.spark.createDataFrame(rows, "book_id long, state string, seq long").write.mode("append").parquet(self.log_path)
        return len(rows)

    def step(self, max_books: int = 1, seed: int = 0) -> Counts:
        """Indexes up to max_books pending books, by number; without any, downloads as many candidates.

        Candidates come in the order of the seed's permutation; how far it has gone outlasts a restart.
        """
        log, out = self.log(), Counts()
        done, have, lost = (control.books_in(log, s) for s in (control.INDEXED, control.DOWNLOADED, control.FAILED))
        pending = control.indexable(control.pending_books(have, done), self.skipped).orderBy("book_id").limit(max_books)
        if not pending.isEmpty():
            got = self.spark.createDataFrame(self.index(pending).collect(), "book_id long, ok boolean")
            out.succeeded = self._record(got.where("ok").select("book_id"), control.INDEXED)
            bad = [r for r in got.where("NOT ok").select("book_id").collect()]
            out.failed = len(bad)
            if bad:
                self.skipped = self.skipped.unionByName(self.spark.createDataFrame(bad, "book_id long"))
            return out
        base, at = self.draws.latest()
        taken = have.select("book_id").unionByName(lost.select("book_id"))
        drawn, ends = control.draw_next(self.spark, taken, self.highest, max_books, control.Draw(**at), seed)
        if drawn:
            self.draws.commit(base, asdict(ends))
        asked = self.spark.createDataFrame([(i,) for i in drawn], "book_id long")
        got = self.spark.createDataFrame(self.fetch(asked).select("book_id", "outcome").collect(), "book_id long, outcome string")
        out.succeeded = self._record(got.where("outcome = 'ok'").select("book_id"), control.DOWNLOADED)
        out.failed = got.where("outcome != 'ok'").count()
        self._record(got.where(F.col("outcome") == "permanent").select("book_id"), control.FAILED)
        return out

    def run(self, steps: int, max_books: int = 1) -> Counts:
        if steps < 0:
            raise ValueError("steps can't be negative")
        total = Counts()
        for _ in range(steps):
            one = self.step(max_books)
            total.succeeded += one.succeeded
            total.failed += one.failed
        return total
