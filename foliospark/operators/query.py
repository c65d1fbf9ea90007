"""Query files, term look-ups and conjunctive queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import strip
from foliospark.sources.control_log import LINE_END


def parse_queries(texts: DataFrame) -> DataFrame:
    """(.., query_id, ordinal, term) of texts(.., content): lines without what follows '#', split at white space.

    Lines without a term are no queries; the others are numbered from 1 in their order, in each text for itself and
    within its row. Other columns of `texts` stay beside them.
    """
    rest = [c for c in texts.columns if c != "content"]
    bare = F.transform(F.split("content", LINE_END, -1), lambda line: strip(F.substring_index(line, "#", 1)))
    kept = texts.select(*rest, F.posexplode(F.filter(bare, lambda line: line != "")).alias("q", "bare"))
    words = kept.select(*rest, (F.col("q") + 1).alias("query_id"), F.posexplode(F.split("bare", r"(?U)[\s\x1c-\x1f]+", -1)).alias("p", "term"))
    return words.select(*rest, "query_id", (F.col("p") + 1).alias("ordinal"), "term")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    found = parse_queries(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")))
    if found.isEmpty():
        raise ValueError(f"{path} holds no query")
    return found


def conjunctive_query(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, book_id) of the books that hold every term of a query; repeated terms change nothing.

    Relational division: postings (pairs may repeat) are cut to the queries' few terms where they are read,
    then distinct matches are counted.
    """
    asked = queries.select("query_id", "term").distinct()
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = postings.join(asked, "term").select("query_id", "book_id", "term").distinct().groupBy("query_id", "book_id").agg(F.count(F.lit(1)).alias("m"))
    return hits.join(wanted, "query_id").where("m = n").select("query_id", "book_id")


def query_answers(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, n_books, books): every query, also without an answer; ids ascending, comma-joined."""
    return listed_answers(queries, conjunctive_query(queries, postings))


def listed_answers(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_answers of answers found(query_id, book_id)."""
    found = found.groupBy("query_id").agg(F.sort_array(F.collect_list("book_id")).alias("b"))
    every = queries.select("query_id").distinct().join(found, "query_id", "left")
    return every.select("query_id", F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_books"), F.array_join(F.coalesce("b", F.array().cast("array<bigint>")), ",").alias("books"))


def term_lookup(postings: DataFrame, term: str | Column) -> DataFrame:
    """Postings of one term exactly as it is written; none if it is absent."""
    return postings.where(F.col("term") == (F.lit(term) if isinstance(term, str) else term)).select("book_id").distinct()


def multi_term_lookup(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, postings) of each asked term, an empty array where it is absent."""
    found = postings.join(terms, "term", "left_semi").groupBy("term").agg(F.sort_array(F.collect_set("book_id")).alias("postings"))
    return terms.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("postings", F.array().cast("array<bigint>")).alias("postings"))
