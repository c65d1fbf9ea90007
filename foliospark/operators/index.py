"""The inverted index: tokens, postings, merges, incremental adds.

postings(term, book_id), without repeats, is the primary form: a frequent term is many rows, not one
long array. Arrays are made on demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.sets import ranked


def tokens(books: DataFrame) -> DataFrame:
    """(book_id, pos, term) of books(book_id, text): indexable tokens with their places among those."""
    return books.select("book_id", F.posexplode(T.process_text(F.col("text"))).alias("pos", "term"))


def pairs(books: DataFrame) -> DataFrame:
    """(term, book_id), each pair once a row of books; no shuffle."""
    return books.select(F.explode(F.array_distinct(T.process_text(F.col("text")))).alias("term"), "book_id")


def build_postings(books: DataFrame) -> DataFrame:
    """(term, book_id): each pair is made once in its book, so a pair crosses the shuffle once."""
    return pairs(books).distinct()


def as_arrays(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.sort_array(F.collect_set("book_id")).alias("postings"))


def from_arrays(index: DataFrame) -> DataFrame:
    return index.select("term", F.explode("postings").alias("book_id")).distinct()


def term_first_seen(tokens_: DataFrame) -> DataFrame:
    """(term, book_id, pos) of the first token of each term, in the order of books and places."""
    once = tokens_.groupBy("term", "book_id").agg(F.min("pos").alias("pos"))  # mostly done where a book is read
    return once.groupBy("term").agg(F.min("book_id").alias("book_id"), F.min_by("pos", "book_id").alias("pos"))


def in_first_seen_order(tokens_: DataFrame) -> DataFrame:
    """index(term, postings) in the order in which terms first appear: the row order of exports."""
    first = term_first_seen(tokens_).select("term", F.col("book_id").alias("b"), F.col("pos").alias("p"))
    return as_arrays(tokens_.select("term", "book_id")).join(first, "term").orderBy("b", "p").select("term", "postings")


def unique_terms(books: DataFrame) -> DataFrame:
    """(book_id, terms): each book's distinct terms, first seen first."""
    return books.select("book_id", F.array_distinct(T.process_text(F.col("text"))).alias("terms"))


def merge_postings(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("term", "book_id").unionByName(right.select("term", "book_id")).distinct()


def new_postings(existing: DataFrame, books: DataFrame) -> DataFrame:
    """The pairs of books that the index lacks; adding a book again finds none."""
    return build_postings(books).join(existing, ["term", "book_id"], "left_anti")


def add_books(existing: DataFrame, books: DataFrame) -> DataFrame:
    """The index with books added. Terms a book no longer has stay: adding never removes."""
    return existing.select("term", "book_id").unionByName(new_postings(existing, books))


def term_count(postings: DataFrame) -> DataFrame:
    """Distinct terms are shuffled once each, not with their books."""
    return postings.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))


def synthetic_corpus(books: DataFrame, size: int, start: int = 900_000) -> DataFrame:
    """The first `size` books by id; beyond those, ids from `start` on whose texts cycle through the real ones."""
    n = books.count()
    if not n:
        return books.select("book_id", "text")
    order = ranked(books.select("book_id", "text"), "book_id")
    real = order.where(F.col("r") < size)
    if size <= n:
        return real.select("book_id", "text")
    extra = books.sparkSession.range(size - n).select((F.col("id") + start).alias("book_id"), (F.col("id") % n).alias("r"))
    return real.select("book_id", "text").unionByName(extra.join(order.select("r", "text"), "r").select("book_id", "text"))
