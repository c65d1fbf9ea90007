"""The control log: which books are downloaded, indexed or failed, one id a line, append only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.ids import normalize_book_id
from foliospark.functions.text import strip
from foliospark.sources.atomic import write_text

#: What ends a line when a text is split into lines: CR LF, or one of these.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def complete_lines(content: Column) -> Column:
    """Lines of a log; a last line without its end was torn by a crash and is dropped."""
    pieces = F.split(content, LINE_END, -1)
    torn = ~content.rlike(r"[\n\r]\z")
    empty_end = F.element_at(pieces, -1) == ""
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    # "torn" content that ends in another line end has an empty last piece: the line before it is dropped
    return F.when(torn & empty_end, F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 2, F.lit(0)))).otherwise(whole)


def read_ids(contents: DataFrame) -> DataFrame:
    """(log, pos, book_id) of contents(log, content): valid ids in file order, each once."""
    lines = contents.select("log", F.posexplode(complete_lines(F.col("content"))).alias("pos", "line"))
    valid = lines.select("log", "pos", normalize_book_id(F.col("line")).alias("book_id")).where("book_id is not null")
    return valid.groupBy("log", "book_id").agg(F.min("pos").alias("pos")).select("log", "pos", "book_id")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Ids of one file; a missing file is empty, undecodable bytes spoil their line only."""
    if not os.path.exists(path):
        return spark.createDataFrame([], "log string, pos int, book_id string")
    with open(path, "rb") as f:
        text = f.read().decode("utf-8", "replace")
    return read_ids(spark.createDataFrame([(path, text)], "log string, content string"))


def append(path: str, book_id: str) -> None:
    with open(path, "a", encoding="utf-8", newline="\n") as out:
        out.write(f"{book_id}\n")
        out.flush()
        os.fsync(out.fileno())


def repair(spark: SparkSession, path: str) -> bool:
    """Rewrites a log in canonical form if it is not; whether it did."""
    found = [r["book_id"] for r in load(spark, path).orderBy("pos").collect()]
    canonical = "".join(f"{b}\n" for b in found)
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == canonical.encode():
                return False
    elif not canonical:
        return False
    write_text(path, canonical)
    return True


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(place, book_id) of a file with one id a line, in its order; blank lines are skipped, other text is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", LINE_END, -1)).alias("place", "line"))
    bare = lines.select("place", strip("line").alias("id")).where("id != ''")
    return bare.select("place", F.col("id").cast("long").alias("book_id"))


def load_pending(spark: SparkSession, downloaded: str, indexed: str) -> DataFrame:
    """(book_id) of the downloaded books that are not indexed, by first download, after both logs are repaired."""
    for path in (downloaded, indexed):
        repair(spark, path)
    return load(spark, downloaded).join(load(spark, indexed).select("book_id"), "book_id", "left_anti").orderBy("pos").select("book_id")
