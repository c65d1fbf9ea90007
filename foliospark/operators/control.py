"""Control decisions as set operations: pending, orphans, candidates, resume checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOWNLOADED, INDEXED, FAILED = "downloaded", "indexed", "failed"


def books_in(log: DataFrame, state: str) -> DataFrame:
    return log.where(F.col("state") == state).select("book_id").distinct()


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("book_id").distinct().join(right.select("book_id"), "book_id", "left_anti")


def pending_books(downloaded: DataFrame, indexed: DataFrame) -> DataFrame:
    return minus(downloaded, indexed)


def orphan_indexed(downloaded: DataFrame, indexed: DataFrame) -> DataFrame:
    return minus(indexed, downloaded)


def detect_pending(stored: DataFrame, known: DataFrame) -> DataFrame:
    return minus(stored, known).orderBy("book_id")


def indexable(pending: DataFrame, failed_now: DataFrame) -> DataFrame:
    return minus(pending, failed_now)


def download_candidates(downloaded: DataFrame, failed: DataFrame, highest: int = 70_000) -> DataFrame:
    every = downloaded.sparkSession.range(1, highest + 1).select(F.col("id").alias("book_id"))
    return minus(every, downloaded.select("book_id").unionByName(failed.select("book_id")))


def permuted(counter: Column, bits: int, key: int, rounds: int = 4) -> Column:
    """A keyed permutation of 0 to 2**bits - 1 (an even number of bits): a Feistel network over the two halves."""
    half = bits // 2
    mask = (1 << half) - 1
    left, right = F.shiftright(counter, half), counter.bitwiseAND(F.lit(mask))
    for i in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key), F.lit(i)).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


@dataclass
class Draw:
    """Where a drawing without replacement stands; the next draw goes on from there."""

    counter: int = 0
    turn: int = 0


def draw_next(spark: SparkSession, taken: DataFrame, highest: int, k: int, at: Draw, key: int = 0) -> tuple[list[int], Draw]:
    """k ids of 1 to `highest` that are not among taken(book_id), in a keyed random order, and where the draw ends.

    Counters run through a permutation of the next power of four; places beyond `highest` are walked over. So all
    ids come once before any comes twice, a draw costs about k steps and no sort of the candidates, and its state is
    a counter. At the end of a turn the next one has another order; a draw meets an id once.
    """
    bits = max(2, (highest - 1).bit_length() + (highest - 1).bit_length() % 2)
    end, found, here = 1 << bits, [], Draw(at.counter, at.turn)
    for _ in range(2):
        while here.counter < end and len(found) < k:
            span = min(end - here.counter, max(64, 2 * (k - len(found)) * end // max(highest, 1)))
            steps = spark.range(here.counter, here.counter + span).select("id", (permuted(F.col("id"), bits, key + 1_000_003 * here.turn) + 1).alias("book_id"))
            steps = steps.where(F.col("book_id") <= highest).join(taken.select("book_id"), "book_id", "left_anti")
            if found:
                steps = steps.where(~F.col("book_id").isin(found))
            rows = steps.orderBy("id").limit(k - len(found)).collect()
            found += [r["book_id"] for r in rows]
            here.counter = rows[-1]["id"] + 1 if len(found) == k else here.counter + span
        if len(found) == k or here.counter < end:
            break
        here = Draw(0, here.turn + 1)
    return found, here


def next_to_index(pending: DataFrame) -> DataFrame:
    """The numerically smallest id, of ids that may be text."""
    return pending.agg(F.min(F.expr("try_cast(book_id AS bigint)")).alias("book_id"))


def verify_resume(every: DataFrame, processed: DataFrame, resumed: DataFrame) -> DataFrame:
    """(duplicated, lost): books worked on twice, and those that neither run worked on."""
    twice = resumed.select("book_id").distinct().join(processed, "book_id", "left_semi").agg(F.count(F.lit(1)).alias("duplicated"))
    gone = minus(minus(every, processed), resumed).agg(F.count(F.lit(1)).alias("lost"))
    return twice.crossJoin(gone)  # one row each


def state_summary(log: DataFrame) -> DataFrame:
    """(state, n_books) of the three states and of pending."""
    counts = log.select("state", "book_id").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("n_books"))
    pending = pending_books(books_in(log, DOWNLOADED), books_in(log, INDEXED)).agg(F.lit("pending").alias("state"), F.count(F.lit(1)).alias("n_books"))
    return counts.unionByName(pending)


def mark(log: DataFrame, book_ids: DataFrame, state: str) -> DataFrame:
    """The log rows to append for books that are not in this state yet."""
    new = minus(book_ids, books_in(log, state))
    return new.select("book_id", F.lit(state).alias("state"), F.unix_micros(F.current_timestamp()).alias("seq"))
