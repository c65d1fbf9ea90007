"""The metadata table: building, upserts, look-ups and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import headers, ids
from foliospark.functions.text import contains_literal

COLUMNS = ["book_id", "title", "author", "language", "capture_date", "header_path", "body_path"]


def build_metadata(files: DataFrame, root: str) -> DataFrame:
    """Metadata rows of files(book_id, header_path, body_path, header, modified)."""
    text = F.regexp_replace("header", "\r\n?", "\n")
    rows = files.withColumn("m", headers.extract_metadata(text))
    return rows.select(
        "book_id", "m.title", "m.author", "m.language", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("capture_date"),
        ids.stored_path(F.col("header_path"), root).alias("header_path"), ids.stored_path(F.col("body_path"), root).alias("body_path"),
    )


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def save_many(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new(.., seq) rows put in; of one id the last new row wins, then any over the old one."""
    aged = table.select(*COLUMNS).withColumn("seq", F.lit(-1).cast("long"))
    return upsert_latest(aged.unionByName(new.select(*COLUMNS, F.col("seq").cast("long").alias("seq"))), ["book_id"], ["seq"]).drop("seq")


def list_books(table: DataFrame) -> DataFrame:
    """Rows with a body, by id; rows from before paths were kept stay hidden."""
    return table.where("body_path IS NOT NULL").select(*COLUMNS).orderBy("book_id")


def find_by_id(table: DataFrame, book_id: int) -> DataFrame:
    return list_books(table).where(F.col("book_id") == book_id)


def require_book(table: DataFrame, book_id: int) -> DataFrame:
    found = find_by_id(table, book_id)
    if found.isEmpty():
        raise LookupError(f"no book {book_id}")
    return found


def find_by(table: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose author or title holds the needle: A-Z folded, % and _ literal, by id."""
    return list_books(table.where(contains_literal(F.col(column), needle)))


def path_by_title(table: DataFrame, needle: str) -> DataFrame:
    """body_path of the first hit by id."""
    return table.where("body_path IS NOT NULL").where(contains_literal(F.col("title"), needle)).agg(F.min_by("body_path", "book_id").alias("body_path"))


def corpus_join(table: DataFrame, bodies: DataFrame) -> DataFrame:
    """(book_id, text) by the metadata's body_path; text is null where the file is missing."""
    return list_books(table).select("book_id", "body_path").join(bodies, "body_path", "left").select("book_id", "text")


def load_corpus(table: DataFrame, bodies: DataFrame) -> DataFrame:
    """corpus_join that fails on a missing file."""
    found = corpus_join(table, bodies)
    return found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no body of book "), F.col("book_id")))))


def top_author(table: DataFrame) -> DataFrame:
    """The most frequent author; of equally frequent ones the one with the smallest id."""
    counts = table.groupBy("author").agg(F.count(F.lit(1)).alias("n_books"), F.min("book_id").alias("f"))
    return counts.orderBy(F.desc("n_books"), "f").limit(1).select("author", "n_books")


def synthetic_metadata(template: DataFrame, size: int, start: int = 900_000) -> DataFrame:
    """`size` rows like the one template row, with ids from `start` on."""
    made = template.sparkSession.range(size).select((F.col("id") + start).alias("book_id"))
    return made.crossJoin(F.broadcast(template.drop("book_id").limit(1))).select(*COLUMNS)
