"""Stores of the inverted index: the segmented table (see segments), and the JSON and folder forms for exchange."""

from __future__ import annotations

import bisect
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import ids
from foliospark.sources.atomic import write_text
from foliospark.sources.segments import SegmentedIndex

def save_table(postings: DataFrame, path: str) -> None:
    """Replaces the stored index at `path` with postings(term, book_id)."""
    SegmentedIndex(postings.sparkSession, path).replace(postings)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return SegmentedIndex(spark, path).postings()


def lookup(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Postings of one term, as it is; only its folder is read."""
    return SegmentedIndex(spark, path).lookup(term)


def lookup_terms(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """(term, book_id) of the stored postings of a table of terms; only their folders are read."""
    return SegmentedIndex(spark, path).lookup_terms(terms)


#: A record of a JSON index cut at its commas: maybe the head of an entry, then maybe an id.
_RECORD = r'''\A[\s\]}{]*("(?:[^"\\]|\\.)*"\s*:\s*\[)?\s*(-?[0-9]+)?[\s\]}]*\z'''


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings of a JSON object of term to ids, in as many tasks as the file has splits.

    The file is cut at its commas, so a record is one id, and the first one of an entry has its term; an entry may
    reach over many splits. A first pass tells the last term of each split (a row a split, on the driver), a second
    one hands terms down while it reads, without a shuffle. Only terms that hold a comma themselves break a record; such a file is read whole.
    """
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    plain = F.expr(r"try_cast(trim(BOTH ' \n\r\t' FROM value) AS bigint)")
    record = raw.select("at", "n", plain.alias("id"), F.when(plain.isNull(), F.col("value")).alias("odd"))  # not just an id: the head of an entry, or the end
    head = F.nullif(F.regexp_extract("odd", _RECORD, 1), F.lit(""))
    key = F.regexp_extract(head, r'''\A("(?:[^"\\]|\\.)*")''', 1)
    term = F.when(head.isNotNull(), F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>")[0])
    odd = record.where("odd IS NOT NULL").select("at", "n", term.alias("term"), F.col("odd").rlike(_RECORD).alias("fits"))
    ends = odd.groupBy("at").agg(F.max_by("term", F.when(F.col("term").isNotNull(), F.col("n"))).alias("last"), F.bool_and("fits").alias("fits")).orderBy("at").collect()
    if not all(r["fits"] for r in ends):
        return _load_whole(spark, path)
    ats = [r["at"] for r in ends]
    lasts = []  # the term that holds behind each of these splits
    for r in ends:
        lasts.append(r["last"] if r["last"] is not None else lasts[-1] if lasts else None)

    def handed_down(batches):
        """Records in the order of the file, each with the term of its entry."""
        split, now = None, None
        for batch in batches:
            for run in _runs(batch):
                at = run["at"][0].as_py()
                if at != split:
                    k = bisect.bisect_left(ats, at)
                    split, now = at, lasts[k - 1] if k else None
                terms = pc.fill_null_forward(run["term"])
                terms = terms if now is None else pc.fill_null(terms, now)
                now = terms[-1].as_py()
                yield pa.RecordBatch.from_arrays([terms, run["id"]], ["term", "book_id"])

    here = record.select("at", F.when(F.col("odd").isNotNull(), term).alias("term"), F.coalesce("id", F.nullif(F.regexp_extract("odd", _RECORD, 2), F.lit("")).cast("long")).alias("id"))
    return here.mapInArrow(handed_down, "term string, book_id long").where("book_id IS NOT NULL")


def _runs(batch: pa.RecordBatch):
    """A batch cut where another split begins."""
    at = batch["at"].to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low < high:
            yield batch.slice(low, high - low)


def _load_whole(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("term", "p")).select("term", F.explode("p").alias("book_id"))


def save_json(index: DataFrame, path: str) -> None:
    """Writes index(term, postings), in its row order, as one JSON object; the file appears whole or not at all.

    Tasks write the entries beside the file, on a path that all executors see, and then copy what they wrote to its
    place in it; the driver knows names and lengths only.
    """
    spark, part = index.sparkSession, f"{path}.{uuid.uuid4().hex}.part"
    key = F.to_json(F.array("term"))
    body = F.array_join("postings", ",\n    ")
    entry = F.concat(F.lit("\n  "), F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": [\n    "), body, F.lit("\n  ]"))
    try:
        index.select(entry.alias("value")).write.option("lineSep", ",").text(f"file://{os.path.abspath(part)}")
        names = sorted(n for n in os.listdir(part) if n.startswith("part-"))
        sizes = [os.path.getsize(f"{part}/{n}") for n in names]
        starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
        whole, end = f"{part}/whole", 1 + sum(sizes)
        with open(whole, "wb") as out:
            out.write(b"{")
        pieces = [(f"{part}/{n}", at) for n, at, size in zip(names, starts, sizes, strict=True) if size]

        def copy(rows) -> None:
            for row in rows:
                with open(row["name"], "rb") as source, open(whole, "r+b") as out:
                    out.seek(row["at"])
                    shutil.copyfileobj(source, out, 1 << 20)
                    out.flush()
                    os.fsync(out.fileno())

        if pieces:
            spark.createDataFrame(pieces, "name string, at long").repartition(len(pieces), "at").foreachPartition(copy)
        with open(whole, "r+b") as out:
            out.seek(end - 1 if pieces else end)  # the last comma, or behind the brace
            out.write(b"\n}" if pieces else b"}")
            out.flush()
            os.fsync(out.fileno())
        os.replace(whole, path)
    finally:
        shutil.rmtree(part, ignore_errors=True)


def save_folders(index: DataFrame, root: str) -> None:
    """Writes <LETTER>/<term>.txt with one id a line, by the tasks that hold the terms; old files stay.

    For exchange only (one file a term), on a path that all executors see.
    """

    def write(rows) -> None:
        for row in rows:
            path = f"{root}/{row['path']}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            write_text(path, (f"{b}\n" for b in row["postings"]))

    index.select(ids.term_file_path(F.col("term")).alias("path"), "postings").foreachPartition(write)


def update_folders(postings: DataFrame, root: str) -> None:
    """Adds postings(term, book_id) to the folder form: only files of their terms are read, and only those that lack an id are rewritten."""

    def write(rows) -> None:
        for row in rows:
            path = f"{root}/{row['path']}"
            old = []
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    old = [int(x) for x in f.read().split()]
            new = sorted({*old, *row["postings"]})
            if len(new) > len(set(old)):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                write_text(path, (f"{b}\n" for b in new))

    arrays = postings.groupBy("term").agg(F.collect_set("book_id").alias("postings"))
    arrays.select(ids.term_file_path(F.col("term")).alias("path"), "postings").foreachPartition(write)


def load_folders(spark: SparkSession, root: str) -> DataFrame:
    lines = spark.read.text(f"{root}/*/*.txt").select(F.trim("value").alias("v"), F.col("_metadata.file_name").alias("f")).where("v != ''")
    return lines.select(ids.term_of_file_name(F.regexp_replace("f", r"\.txt$", "")).alias("term"), F.col("v").cast("long").alias("book_id"))


def drop(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)
