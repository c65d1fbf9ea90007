"""Incremental ingestion: new files of the lake become metadata, postings and log rows, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions import ids
from foliospark.operators import control, tasks
from foliospark.sources import lake
from foliospark.sources.segments import SegmentedIndex
from foliospark.sources.store import LOG, Store


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def index_batch(bodies: DataFrame, index_path: str, log_path: str) -> None:
    """Adds bodies(book_id, text) to the index that look-ups read, then to the log; doing it again changes nothing."""
    spark = bodies.sparkSession
    SegmentedIndex(spark, index_path).add(bodies)
    log = _table(spark, log_path, LOG)
    control.mark(log, bodies.select("book_id"), control.INDEXED).write.mode("append").parquet(log_path)


def ingest(spark: SparkSession, lake: str, index_path: str, log_path: str, checkpoint: str, pattern: str = "*_body.txt") -> StreamingQuery:
    """Starts a query that indexes every new body file below `lake` and ends when all are done.

    The checkpoint remembers files; a batch repeated after a failure adds nothing.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(lake)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)_body\.txt$", 1)
    bodies = files.select(name.cast("long").alias("book_id"), F.col("value").alias("text")).where("book_id IS NOT NULL")
    return (
        bodies.writeStream.foreachBatch(lambda batch, _: index_batch(batch, index_path, log_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def paired(spark: SparkSession, root: str, wait: str = "7 days", most_files: int = 10_000) -> DataFrame:
    """A stream of (dir, book_id, header_path, body_path): each header and body of one folder, once both are there.

    Only paths are held in the state, a file waits for its other half for `wait` after its own batch. Time is that
    of the batch in which a file is first seen, so a file whose own time is old is not late.
    """
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*_*.txt").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", most_files).schema("path string, modificationTime timestamp, length long, content binary").load(root).select("path", F.current_timestamp().alias("seen"))
    )

    def side(kind: str) -> DataFrame:
        name = rf"^(.*)/([0-9]+)_{kind}\.txt$"
        return files.where(F.col("path").rlike(name)).select(
            F.regexp_extract("path", name, 1).alias("dir"), F.regexp_extract("path", name, 2).cast("long").alias("book_id"),
            F.col("path").alias(f"{kind}_path"), F.col("seen").alias(f"{kind}_seen"),
        ).withWatermark(f"{kind}_seen", wait)

    near = F.expr(f"body_seen BETWEEN header_seen - INTERVAL {wait} AND header_seen + INTERVAL {wait}")
    header, body = side("header").alias("h"), side("body").alias("b")
    both = header.join(body, (F.col("h.dir") == F.col("b.dir")) & (F.col("h.book_id") == F.col("b.book_id")) & near)
    return both.select("h.dir", "h.book_id", "header_path", "body_path")


def index_pairs(pairs: DataFrame, store: Store, root: str, source: str, batch: int) -> None:
    """Reads the files of pairs(dir, book_id, header_path, body_path) and commits metadata, postings and log at once.

    Of copies of one book the one in the folder that sorts last counts, also against what is stored. A batch that
    was committed before is skipped.
    """
    if store.seen(source, batch):
        return
    # copied beside older ones, a folder that sorts before the stored one brings nothing new
    known = store.view().metadata.read().select("book_id", F.regexp_extract("body_path", "^(.*)/[^/]*$", 1).alias("stored"))
    below = ids.stored_path(F.regexp_replace("dir", "^file:/+", "/"), root)
    older = pairs.join(known, "book_id").where(below < F.col("stored")).select("dir", "book_id")
    newest = lake.newest_complete_copy(pairs.join(older, ["dir", "book_id"], "left_anti"))
    books = lake.read_pairs(newest).persist()
    try:
        with store.change(source, batch) as view:
            if not books.isEmpty():
                tasks.put_books(view, books, root)
    finally:
        books.unpersist()


def ingest_pairs(spark: SparkSession, root: str, store_root: str, checkpoint: str, wait: str = "7 days", most_files: int = 10_000) -> StreamingQuery:
    """Starts a query that puts every complete book below `root` into a store and ends when all are done.

    A body without its header is not indexed; it is when its header comes, in whatever later batch, once.
    """

    def put(batch: DataFrame, number: int) -> None:
        index_pairs(batch, Store(batch.sparkSession, store_root), root, checkpoint, number)

    return paired(spark, root, wait, most_files).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
