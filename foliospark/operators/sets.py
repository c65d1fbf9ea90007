"""Ordered de-duplication, samples, and comparison of ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_dedup(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with its first place."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def candidate_ids(first: DataFrame, highest: int = 600) -> DataFrame:
    """(book_id, place): listed ids in their order, then 1 to highest, each once. first has (book_id, place)."""
    n = first.count()
    rest = first.sparkSession.range(1, highest + 1).select(F.col("id").alias("book_id"), (F.col("id") + n).alias("place"))
    return ordered_dedup(first.select("book_id", F.col("place").cast("long").alias("place")).unionByName(rest), "book_id", "place")


def _range_of(key: str, bounds: list[int], first: int = 0) -> Column:
    """How many of the ascending bounds a key has reached, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(F.col(key) < bounds[mid], _range_of(key, bounds[:mid], first)).otherwise(_range_of(key, bounds[mid + 1 :], first + mid + 1))


def ranked(rows: DataFrame, key: str, buckets: int = 128) -> DataFrame:
    """rows with `r`, their rank (from 0) by an integer key, without a task that sees all rows.

    Keys fall into ranges of about equal counts by their approximate quantiles, wherever they lie; counts of
    the ranges (a few numbers) give each range its first rank.
    """
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx(key, shares, 100 * buckets)).first()[0]
    if bounds is None:
        return rows.withColumn("r", F.lit(0).cast("long")).where("false")
    placed = rows.withColumn("_b", _range_of(key, sorted(set(bounds))))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(counts.select("_b", F.coalesce(before, F.lit(0)).alias("_f")))  # at most `buckets` rows
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return placed.join(firsts, "_b").withColumn("r", (inside + F.col("_f")).cast("long")).drop("_b", "_f")


def even_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """k keys evenly spaced in order, the first and the last among them; all of at most k keys."""
    distinct = rows.select(key).distinct()
    n = distinct.count()
    if n <= k:
        return distinct
    if k < 2:
        return distinct.orderBy(key).limit(k)
    wanted = rows.sparkSession.range(k).select(F.expr(f"id * {n - 1} div {k - 1}").alias("r")).distinct()
    return ranked(distinct, key).join(F.broadcast(wanted), "r", "left_semi").select(key)


def first_half(rows: DataFrame, key: str) -> DataFrame:
    return ranked(rows, key).where(F.col("r") < rows.count() // 2).drop("r")


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(line, left, right) of the first unequal row of two tables of (line, value)."""
    a = left.select("line", F.col("value").alias("left"))
    b = right.select("line", F.col("value").alias("right"))
    unequal = a.join(b, "line", "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return unequal.orderBy("line").limit(1)


def snapshot_parity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(section, place, expected, actual) of every place at which two snapshots(section, place, value) differ.

    Sections are the ordered labels, keys and headers of a snapshot; parity is an empty result.
    """
    both = expected.select("section", "place", F.col("value").alias("expected")).join(
        actual.select("section", "place", F.col("value").alias("actual")), ["section", "place"], "full"
    )
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def canonical_lines(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """(section, rank, key, line) of the canonical form of tokens(book_id, terms) and answers(query_id, books).

    Sort by the first three columns; the lines are tab-separated.
    """
    books = tokens.select(
        F.lit(0).alias("section"), F.col("book_id").cast("long").alias("rank"), F.lit("").alias("key"),
        F.concat(F.lit("tokens\t"), F.col("book_id").cast("string"), F.lit("\t"), F.array_join("terms", "\t")).alias("line"),
    )
    pairs = tokens.select("book_id", F.explode(F.array_distinct("terms")).alias("term"))
    index = pairs.groupBy("term").agg(F.array_join(F.sort_array(F.collect_set("book_id")), ",").alias("p"))
    posts = index.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("rank"), F.col("term").alias("key"), F.concat_ws("\t", F.lit("postings"), "term", "p").alias("line"))
    tail = F.when(F.col("books") != "", F.concat(F.lit("\t"), F.col("books"))).otherwise("")
    lines = answers.select(F.lit(2).alias("section"), F.col("query_id").cast("long").alias("rank"), F.lit("").alias("key"), F.concat(F.lit("query\t"), F.col("query_id").cast("string"), tail).alias("line"))
    return books.unionByName(posts).unionByName(lines)
