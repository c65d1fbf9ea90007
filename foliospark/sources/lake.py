"""The datalake: raw header and body files in time, book and batch layouts.

Bodies and headers are text files `<id>_body.txt` and `<id>_header.txt`. Listing reads paths only;
a book's folder in the book and batch layouts is computed from its id, so a look-up is pruned to it. Spark's file
listing passes over empty files, so a book with an empty half is not complete here; the `lake` data source has it.
"""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import ids
from foliospark.sources.atomic import write_text

LAYOUTS = {"time": "*/*", "book": "*", "batch": "*"}
_FILE = r"/([^/]+)/(?:([0-9]+)_(body|header)\.txt)$"


def _paths(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """(path, dir, parent, book_id, kind, size) of the lake files that globs reach; empty if there are none."""
    if isinstance(pattern, str) and not _exists(spark, pattern):
        return spark.createDataFrame([], "path string, dir string, parent string, book_id long, kind string, size long")
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"))
    return files.where(F.col("path").rlike(_FILE)).select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", _FILE, 1).alias("parent"),
        F.regexp_extract("path", _FILE, 2).cast("long").alias("book_id"),
        F.regexp_extract("path", _FILE, 3).alias("kind"),
        "size",
    )


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def pair_files(files: DataFrame) -> DataFrame:
    """(dir, parent, book_id, body_path, header_path) of the books of which both files lie in one folder."""
    side = lambda kind: files.where(F.col("kind") == kind)
    bodies = side("body").select("dir", "parent", "book_id", F.col("path").alias("body_path"))
    headers = side("header").select("dir", "book_id", F.col("path").alias("header_path"))
    return bodies.join(headers, ["dir", "book_id"]).select("dir", "parent", "book_id", "body_path", "header_path")


def newest_complete_copy(pairs: DataFrame) -> DataFrame:
    """One row a book: the pair in the folder that sorts last."""
    newest = F.max_by(F.struct("body_path", "header_path"), "dir").alias("n")
    return pairs.groupBy("book_id").agg(newest).select("book_id", "n.header_path", "n.body_path")


def list_books(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """(book_id, header_path, body_path) of the complete books of one layout; other files are ignored."""
    pairs = pair_files(_paths(spark, f"{root}/{LAYOUTS[layout]}/*_*.txt"))
    if layout == "book":
        pairs = pairs.where(F.col("parent") == F.col("book_id").cast("string"))
    elif layout == "batch":
        pairs = pairs.where(F.col("parent").rlike(r"^batch_\d+_\d+$"))
    return newest_complete_copy(pairs)


def book_folder(root: str, layout: str, book_id: int, batch_size: int = 1000) -> str:
    if layout == "book":
        return f"{root}/{book_id}"
    if batch_size < 1:
        raise ValueError(f"a batch holds at least one book, not {batch_size}")
    low = book_id // batch_size * batch_size
    return f"{root}/batch_{low}_{low + batch_size - 1}"


def find_book(spark: SparkSession, root: str, layout: str, book_id: int, batch_size: int = 1000) -> DataFrame:
    """The one row of a book; reads its own folder only where the layout tells it. Raises FileNotFoundError."""
    folder = f"{root}/*/*" if layout == "time" else book_folder(root, layout, book_id, batch_size)
    found = newest_complete_copy(pair_files(_paths(spark, f"{folder}/{book_id}_*.txt")))
    if found.isEmpty():
        raise FileNotFoundError(f"no header and body of book {book_id} in {root}")
    return found


def find_books(spark: SparkSession, root: str, layout: str, ids: DataFrame, batch_size: int = 1000) -> DataFrame:
    """(book_id, header_path, body_path) of those books of one batch of ids that are complete.

    Only folders that can hold them are listed: in the book and batch layouts they follow from the ids.
    """
    if layout == "time":
        pairs = pair_files(_paths(spark, f"{root}/*/*/*_*.txt"))
    else:
        folders = {book_folder(root, layout, r["book_id"], batch_size) for r in ids.where("book_id IS NOT NULL").select("book_id").distinct().collect()}
        there = sorted(f for f in folders if _exists(spark, f"{f}/*_*.txt"))
        pairs = pair_files(_paths(spark, [f"{f}/*_*.txt" for f in there] or f"{root}/_none/*.txt"))
    return newest_complete_copy(pairs.join(ids.select("book_id").distinct(), "book_id", "left_semi"))


def read_pairs(found: DataFrame) -> DataFrame:
    """(book_id, header_path, body_path, header, body, modified) of one batch of found(book_id, header_path, body_path).

    The paths of the batch go to the driver, as every list of files to read does, and no other file is opened.
    """
    spark = found.sparkSession
    rows = [tuple(r) for r in found.select("book_id", _plain("header_path").alias("h"), _plain("body_path").alias("b")).collect()]
    if not rows:
        return spark.createDataFrame([], "book_id long, header_path string, body_path string, header string, body string, modified timestamp")
    files = [(p, i, kind) for i, h, b in rows for p, kind in ((h, "header"), (b, "body"))]
    named = F.broadcast(spark.createDataFrame(files, "path string, book_id long, kind string"))
    texts = spark.read.text([p for p, _, _ in files], wholetext=True).select(
        _plain(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified")
    )
    of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return texts.join(named, "path").groupBy("book_id").agg(
        of("path", "header").alias("header_path"), of("path", "body").alias("body_path"), of("text", "header").alias("header"),
        of("text", "body").alias("body"), of("modified", "header").alias("modified"),
    )


def _plain(path) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def discover_book_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, f"{folder}/*_body.txt").select("book_id").orderBy("book_id")


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text, modified) of whole files."""
    raw = spark.read.text(pattern, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def read_directory_books(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, text) of the files pg<id>.txt: a fetcher that needs no network."""
    texts = read_texts(spark, f"{folder}/pg*.txt")
    name = F.regexp_extract("path", r"/pg([0-9]+)\.txt$", 1)
    return texts.where(name != "").select(name.cast("long").alias("book_id"), "text")


def disk_usage(files: DataFrame, root: str) -> DataFrame:
    """(size_mb, file_count, dir_count) below a root; the root itself is no directory of its own."""
    below = files.where(F.col("path").startswith(root.rstrip("/") + "/"))
    inner = F.split(F.regexp_extract(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")), "^(.*)/[^/]*$", 1), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(inner)), lambda i: F.array_join(F.slice(inner, F.lit(1), i), "/"))
    folders = below.select(F.explode(ancestors).alias("d")).where("d != ''").distinct().agg(F.count(F.lit(1)).alias("dir_count"))
    sizes = below.agg((F.coalesce(F.sum("size"), F.lit(0)) / (1 << 20)).alias("size_mb"), F.count(F.lit(1)).alias("file_count"))
    return sizes.crossJoin(folders)  # one row each


def store_text(root: str, layout: str, book_id: int, header: str, body: str, source_url: str, at: datetime, batch_size: int = 1000) -> None:
    """Stores one book's two text files where the layout has them (book layout: a metadata.json, too).

    For the tasks of a fetch, on a path that all executors share; each file appears whole or not at all.
    """
    folder = f"{root}/{at:%Y%m%d}/{at:%H}" if layout == "time" else book_folder(root, layout, book_id, batch_size)
    os.makedirs(folder, exist_ok=True)
    write_text(f"{folder}/{book_id}_header.txt", header)
    write_text(f"{folder}/{book_id}_body.txt", body)
    if layout == "book":
        side = {"book_id": book_id, "source_url": source_url, "downloaded_at": f"{at:%Y-%m-%dT%H:%M:%S}"}
        write_text(f"{folder}/metadata.json", json.dumps(side, indent=2) + "\n")


def store_texts(books: DataFrame, root: str, layout: str, batch_size: int = 1000) -> None:
    """Stores books(book_id, header, body, source_url, downloaded_at) as text files, by the tasks that hold them."""
    if layout == "batch":
        book_folder(root, layout, 0, batch_size)  # a bad batch size fails before anything is written
    columns = ("book_id", "header", "body", "source_url", "downloaded_at")

    def write(rows) -> None:
        for row in rows:
            store_text(root, layout, *[row[c] for c in columns], batch_size)

    books.select(*columns).foreachPartition(write)


def write_books(books: DataFrame, root: str, layout: str, batch_size: int = 1000) -> None:
    """Stores books(book_id, header, body, source_url, downloaded_at) as partitioned tables of one layout.

    Partitions of this write replace their old selves only where the session overwrites dynamically.
    """
    if layout == "time":
        keyed = books.withColumn("day", F.date_format("downloaded_at", "yyyyMMdd")).withColumn("hour", F.date_format("downloaded_at", "HH"))
        keyed.write.mode("append").partitionBy("day", "hour").parquet(root)
    elif layout == "book":
        side = F.to_json(F.struct("book_id", "source_url", F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("downloaded_at")))
        books.withColumn("metadata_json", side).withColumn("book", F.col("book_id")).write.mode("append").partitionBy("book").parquet(root)
    else:
        books.withColumn("batch", ids.batch_bucket(F.col("book_id"), batch_size)).write.mode("append").partitionBy("batch").parquet(root)


def read_books(spark: SparkSession, root: str) -> DataFrame:
    """The newest copy of each stored book."""
    order = Window.partitionBy("book_id").orderBy(F.desc("downloaded_at"))
    return spark.read.parquet(root).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lookup_stored(spark: SparkSession, root: str, layout: str, book_id: int, batch_size: int = 1000) -> DataFrame:
    """Stored rows of a book; the partition follows from the id, so other partitions are not read."""
    table = spark.read.parquet(root)
    if layout == "book":
        table = table.where(F.col("book") == book_id)
    elif layout == "batch":
        low = book_id // batch_size * batch_size
        table = table.where(F.col("batch") == f"batch_{low}_{low + batch_size - 1}")
    return table.where(F.col("book_id") == book_id)
