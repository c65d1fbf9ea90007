"""The served inverted index: blocked postings in segments, and a manifest that names the live ones.

A row is one term in one block of BLOCK ids: (term, block, n, first_id, last_id, ids, bits). A block with few ids
has them as an array, one with DENSE or more as a bitmap, so no row grows with the collection and a frequent term
is many rows. Rows lie in partitions by the term's letter and a hash bucket, sorted by term and block; as both
follow from the term, a look-up opens the folders of its terms only, and its terms are pushed into the scan.

Each added batch is a segment of its own. The manifest lists, segment by segment, the partitions that are live, so
compaction rewrites the partitions that lie in many segments and no others, and readers see the old state or the
new one. The ids of the indexed books lie beside the segments: a batch reads postings only for books that are
there already.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from foliospark.functions import ids as names
from foliospark.operators import digests, index
from foliospark.sources.manifest import Conflict, Manifest, Section

BUCKETS, LETTERS = 4, 27
BLOCK = 32_768  # ids, as many as Spark's bitmaps have bits
DENSE = 1024
PUSHED = 1000  # values that are pushed into a scan; more are joined
ROW = "term string, block long, n long, first_id long, last_id long, ids array<long>, bits binary, letter string, bucket int"


def partition_of(term: str) -> tuple[str, int]:
    """The folder of a term: its letter, "_" for all but A to Z, and a bucket."""
    letter = term[:1].upper()
    return letter if len(letter) == 1 and "A" <= letter <= "Z" else "_", zlib.crc32(term.encode()) % BUCKETS


def _placed(postings: DataFrame) -> DataFrame:
    letter = names.term_letter(F.col("term"))
    letter = F.when(letter.rlike(r"\A[A-Z]\z"), letter).otherwise("_")
    return postings.withColumn("letter", letter).withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int"))


def _byte(bits: Column, place: Column) -> Column:
    return F.ascii(F.decode(F.substring(bits, place + 1, F.lit(1)), "ISO-8859-1"))


def holds(bits: Column, book_id: Column) -> Column:
    """Whether a block's bitmap has an id of that block."""
    place = F.bitmap_bit_position(book_id)
    return F.getbit(_byte(bits, F.floor(place / 8).cast("int")), (place % 8).cast("int")) == 1


#: The places of the bits that are set in each value of a byte.
_PLACES = [[k for k in range(8) if byte >> k & 1] for byte in range(256)]


def _decoded(block: Column, bits: Column) -> Column:
    """The ids of a block's bitmap, ascending in their distance from 0. A byte's bits are looked up, not tested one by one."""
    places = F.expr(f"array({', '.join('array(' + ', '.join(map(str, p)) + ')' if p else 'array()' for p in _PLACES)})").cast("array<array<int>>")
    bytes_ = F.split(F.decode(bits, "ISO-8859-1"), "")
    of = lambda c, i: F.transform(F.get(places, F.ascii(c)), lambda k: i * 8 + k)
    place = F.flatten(F.transform(bytes_, of))
    base = F.when(block > 0, (block - 1) * BLOCK + 1).otherwise(block * BLOCK)
    sign = F.when(block > 0, 1).otherwise(-1)
    return F.transform(place, lambda p: base + sign * p)


def _ids(block: Column, ids: Column, bits: Column) -> Column:
    return F.coalesce(ids, _decoded(block, bits))


def met_blocks(postings: DataFrame) -> DataFrame:
    """(term, block, ids) of postings(term, book_id), pairs may repeat: ids meet by term and block, evenly dealt."""
    pairs = postings.select("term", "book_id").where("term IS NOT NULL AND book_id IS NOT NULL")
    ids = F.sort_array(F.array_distinct(F.collect_list("book_id")))  # a book's row has a pair once
    return pairs.groupBy("term", F.bitmap_bucket_number("book_id").alias("block")).agg(ids.alias("ids"))


def listed(postings: DataFrame, parts: int) -> DataFrame:
    """(term, block, n, first_id, last_id, ids, letter, bucket) of postings(term, book_id), pairs may repeat."""
    return _sent(met_blocks(postings), parts)


def _sent(met: DataFrame, parts: int) -> DataFrame:
    """listed of met blocks: finished blocks are sent on to their partition and, in `parts`, by the block."""
    placed = _placed(met).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).repartition("letter", "bucket", "part")
    ends = (F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))
    return placed.select("term", "block", *ends, "ids", "letter", "bucket")


def blocked(postings: DataFrame, parts: int, dense: bool = True) -> DataFrame:
    """ROW of postings(term, book_id), pairs may repeat."""
    return _rows(listed(postings, parts), dense)


def _rows(blocks: DataFrame, dense: bool) -> DataFrame:
    """ROW of listed blocks, which are read twice. Without `dense` all blocks are arrays, which saves the second look; for batches of few books."""
    sparse = blocks.where(F.col("n") < DENSE) if dense else blocks
    sparse = sparse.withColumn("bits", F.lit(None).cast("binary")).select("term", "block", "n", "first_id", "last_id", "ids", "bits", "letter", "bucket")
    if not dense:
        return sparse
    keys = ["letter", "bucket", "term", "block", "n", "first_id", "last_id"]
    opened = blocks.where(F.col("n") >= DENSE).select(*keys, F.explode("ids").alias("id"))
    maps = opened.groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return sparse.unionByName(maps.withColumn("ids", F.lit(None).cast("array<long>")).select(*sparse.columns))


class SegmentedIndex:
    """One index below a root folder of any file system; its states are its own or a section of a store's."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest | Section | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = manifest or Manifest(spark, self.root)

    # what is there

    def state(self) -> dict:
        return {"segments": [], "books": [], "done": {}} | self.manifest.latest()[1]

    def blocks(self, partitions: Iterable[tuple[str, int]] | None = None, state: dict | None = None) -> DataFrame:
        """ROW of the live rows, of all partitions or of those asked for; other folders are neither listed nor read."""
        wanted = None if partitions is None else set(partitions)
        paths = [
            f"{self.root}/segment={s['name']}/letter={letter}/bucket={bucket}"
            for s in (state or self.state())["segments"]
            for letter, bucket in s["partitions"]
            if wanted is None or (letter, bucket) in wanted
        ]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        # the letter is text even where all folders that are read look like numbers
        read = self.spark.read.schema(f"{ROW}, segment string").option("basePath", self.root).parquet(*paths)
        return read.drop("segment")

    def postings(self) -> DataFrame:
        """(term, book_id) of the whole index."""
        return self._opened(self.blocks())

    @staticmethod
    def _opened(blocks: DataFrame) -> DataFrame:
        return blocks.select("term", F.explode(_ids(F.col("block"), F.col("ids"), F.col("bits"))).alias("book_id"))

    def _whole(self, blocks: DataFrame, segments: int) -> DataFrame:
        """(term, block, ids, bits) of stored rows of so many segments; where a block may lie in several, its ids are put together."""
        if segments < 2:
            return blocks.select("term", "block", "ids", "bits")
        ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list(_ids(F.col("block"), F.col("ids"), F.col("bits"))))))
        return blocks.groupBy("term", "block").agg(ids.alias("ids")).withColumn("bits", F.lit(None).cast("binary"))

    @staticmethod
    def _arrays(whole: DataFrame) -> DataFrame:
        """(term, block, ids) of whole blocks."""
        return whole.select("term", "block", _ids(F.col("block"), F.col("ids"), F.col("bits")).alias("ids"))

    def whole_blocks(self) -> DataFrame:
        """(term, block, ids, bits) of the whole index, each block once."""
        state = self.state()
        return self._whole(self.blocks(state=state), len(state["segments"]))

    def with_books(self, books: DataFrame) -> DataFrame:
        """(term, book_id) of the index and of books(book_id, text) beside it, each pair once: index.add_books of a stored index.

        Nothing is written. The books' pairs meet by term and block and only blocks are joined; books without an id, which no
        block holds, are rows too.
        """
        state = self.state()
        unnamed = index.build_postings(books.where("book_id IS NULL"))
        return self._opened(self.blocks(state=state)).unionByName(self._missing(books, state, many=True)).unionByName(unnamed)

    def difference(self, other: SegmentedIndex) -> DataFrame:
        """(term, book_id, side) of the pairs that one index has and the other lacks; side is left (this one's) or right.

        Digests of ranges of terms are taken from the blocks as they lie. Of unequal ranges the blocks are shuffled, not
        their pairs: the two of a term and block meet, and are opened if they differ.
        """
        place = F.pmod(F.xxhash64("term"), F.lit(digests.RANGES))
        mine, theirs = digests.in_unequal_ranges(self.whole_blocks(), other.whole_blocks(), place, "term", "block", "ids", "bits", hashed=digests.stored_hash)
        met = mine.alias("a").join(theirs.alias("b"), ["term", "block"], "full")
        unequal = met.where(~(F.col("a.ids").eqNullSafe(F.col("b.ids")) & F.col("a.bits").eqNullSafe(F.col("b.bits"))))
        opened = lambda of: F.coalesce(_ids(F.col("block"), F.col(f"{of}.ids"), F.col(f"{of}.bits")), F.array().cast("array<bigint>"))
        ids = unequal.select("term", opened("a").alias("a"), opened("b").alias("b"))
        only = lambda side, x, y: F.struct(F.lit(side).alias("side"), F.array_except(x, y).alias("ids"))
        return ids.select("term", F.inline(F.array(only("left", "a", "b"), only("right", "b", "a")))).select("term", F.explode("ids").alias("book_id"), "side")

    def books(self, state: dict | None = None) -> DataFrame:
        """(book_id, block) of the indexed books, also of those without a term."""
        paths = [f"{self.root}/books/{name}" for name in (state or self.state())["books"]]
        kind = "book_id long, block long"
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    # look-ups

    def _rows_of(self, terms: list[str]) -> DataFrame:
        return self.blocks({partition_of(t) for t in terms}).where(F.col("term").isin(terms))

    def lookup(self, term: str) -> DataFrame:
        """(term, book_id) of one term, exactly as it is written."""
        return self._opened(self.blocks([partition_of(term)]).where(F.col("term") == term))

    def _few(self, terms: DataFrame) -> list[str] | None:
        """The distinct terms of a table, unless they are more than PUSHED."""
        found = [r["term"] for r in terms.select("term").where("term IS NOT NULL").distinct().limit(PUSHED + 1).collect()]
        return found if len(found) <= PUSHED else None

    def _asked(self, terms: DataFrame) -> DataFrame:
        few = self._few(terms)
        if few is not None:
            return self._rows_of(few)
        here = _placed(terms.select("term").distinct()).select("letter", "bucket").distinct().collect()  # LETTERS * BUCKETS at most
        return self.blocks({(r["letter"], r["bucket"]) for r in here}).join(terms.select("term").distinct(), "term", "left_semi")

    def lookup_terms(self, terms: DataFrame) -> DataFrame:
        """(term, book_id) of the terms of a table, of those partitions only."""
        return self._opened(self._asked(terms))

    def arrays(self, terms: DataFrame) -> DataFrame:
        """(term, postings) of each asked term, an empty array where it is absent; what is returned is an array a term."""
        few = self._few(terms)
        if few is None:
            found, asked = self.lookup_terms(terms), terms.select("term").distinct()
        else:
            found, asked = self._opened(self._rows_of(few)), self.spark.createDataFrame([(t,) for t in few], "term string")
        listed = found.groupBy("term").agg(F.sort_array(F.collect_set("book_id")).alias("postings"))
        return asked.join(listed, "term", "left").select("term", F.coalesce("postings", F.array().cast("array<bigint>")).alias("postings"))

    def surviving_blocks(self, queries: DataFrame) -> DataFrame:
        """(query_id, block, n_terms, low, high): blocks in which every term of a query has ids, whose ranges meet.

        Read from the ranges alone, no ids. A query with a term that is nowhere has none.
        """
        return self._survivors(*self._query_rows(queries))

    def _query_rows(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = queries.select("query_id", "term").where("term IS NOT NULL").distinct()
        local = self._local(asked)
        if local is None:
            return asked, self._asked(asked)
        return local[0], self._rows_of(sorted({r["term"] for r in local[1]}))

    def _local(self, rows: DataFrame) -> tuple[DataFrame, list] | None:
        """A table of at most PUSHED rows as values of the plan, so that what made it does not run again; None if it is larger."""
        few = rows.limit(PUSHED + 1).collect()
        return (self.spark.createDataFrame(few, rows.schema), few) if len(few) <= PUSHED else None

    @staticmethod
    def _survivors(asked: DataFrame, rows: DataFrame) -> DataFrame:
        # a term may have a block in several segments
        ranges = rows.groupBy("term", "block").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
        met = ranges.join(asked, "term").groupBy("query_id", "block").agg(
            F.count(F.lit(1)).alias("n_terms"), F.max("first_id").alias("low"), F.min("last_id").alias("high")
        )
        sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        return met.join(sizes, "query_id").where("n_terms = n AND low <= high").select("query_id", "block", "n_terms", "low", "high")

    def conjunctive(self, queries: DataFrame) -> DataFrame:
        """(query_id, book_id) of the books that hold every term of queries(query_id, term); repeated terms change nothing.

        First the ranges tell which blocks can hold an answer; without any, nothing more is read. Then the blocks'
        ids meet one block at a time, the rarest term first, and a term is asked only for what the ones before
        it have left. What one task holds is a block of each term of a query.
        """
        asked, rows = self._query_rows(queries)
        alive = self._survivors(asked, rows)
        local = self._local(alive)
        if local is not None:
            alive, few = local
            if not few:
                return alive.select("query_id", F.col("block").alias("book_id"))
            rows = rows.where(F.col("block").isin(sorted({r["block"] for r in few})))
        met = rows.join(asked, "term").join(alive, ["query_id", "block"])
        per_term = met.groupBy("query_id", "block", "low", "high", "term").agg(
            F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), F.collect_list("bits").alias("maps")
        )
        group = per_term.groupBy("query_id", "block", "low", "high").agg(F.array_sort(F.collect_list(F.struct("n", "term", "ids", "maps"))).alias("t"))
        first = F.col("t")[0]
        start = F.array_union(first["ids"], F.flatten(F.transform(first["maps"], lambda b: _decoded(F.col("block"), b))))
        start = F.filter(start, lambda i: (i >= F.col("low")) & (i <= F.col("high")))
        asks = lambda left, t: F.when(F.size(t["maps"]) == 0, F.array_intersect(left, t["ids"])).otherwise(
            F.filter(left, lambda i: F.array_contains(t["ids"], i) | F.exists(t["maps"], lambda b: holds(b, i)))
        )
        left = F.aggregate(F.slice("t", F.lit(2), F.size("t")), start, lambda left, t: F.when(F.size(left) == 0, left).otherwise(asks(left, t)))
        return group.select("query_id", F.explode(left).alias("book_id"))

    # changes

    def _parts(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // (LETTERS * BUCKETS))

    def _write(self, postings: DataFrame, dense: bool = True) -> dict:
        return self._write_blocks(met_blocks(postings), dense)

    def _write_blocks(self, met: DataFrame, dense: bool = True) -> dict:
        """A segment of blocks(term, block, ids), each once."""
        name = uuid.uuid4().hex
        blocks = _sent(met, self._parts())
        kept = blocks.persist(StorageLevel.DISK_ONLY) if dense else blocks
        try:
            rows = _rows(kept, dense).sortWithinPartitions("letter", "bucket", "term", "block")
            rows.write.partitionBy("letter", "bucket").parquet(f"{self.root}/segment={name}")
        finally:
            if dense:
                kept.unpersist()
        files = self.manifest.files
        partitions = [
            [letter.removeprefix("letter="), int(bucket.removeprefix("bucket="))]
            for letter in files.names(f"segment={name}") if letter.startswith("letter=")
            for bucket in files.names(f"segment={name}/{letter}")
        ]
        return {"name": name, "partitions": partitions}

    def _write_books(self, books: DataFrame) -> str:
        name = uuid.uuid4().hex
        known = books.where("book_id IS NOT NULL").select("book_id", F.bitmap_bucket_number("book_id").alias("block")).distinct()
        known.sortWithinPartitions("block", "book_id").write.parquet(f"{self.root}/books/{name}")
        return name

    def replace(self, postings: DataFrame, books: DataFrame | None = None) -> None:
        """Makes postings(term, book_id) the whole index; books(book_id) may name books without a term, too."""
        base, _ = self.manifest.latest()
        segment = self._write(postings)
        state = {"segments": [segment] if segment["partitions"] else [], "books": [], "done": {}}
        state["books"] = [self._write_books(self._opened(self.blocks(state=state)) if books is None else books)]
        self.manifest.commit(base, state)

    def add(self, books: DataFrame, source: str | None = None, batch: int | None = None, tries: int = 3) -> bool:
        """Adds books(book_id, text) as one segment; whether anything was written.

        Pairs that are there already are not added again, so a book added twice changes nothing, and terms that a
        book no longer has stay. With a source and a batch number, a batch that was committed before is skipped.
        After another writer's commit the batch is worked out again on the new state, `tries` times at most.
        """
        for turn in range(tries):
            try:
                return self._add_once(books, source, batch)
            except Conflict:
                if turn == tries - 1:
                    raise
        return False

    def _add_once(self, books: DataFrame, source: str | None, batch: int | None) -> bool:
        base, state = self.manifest.latest()
        state = {"segments": [], "books": [], "done": {}} | state
        if source is not None and batch is not None and state["done"].get(source, -1) >= batch:
            return False
        new, known = self._split(books, state)
        pairs = index.pairs(new)
        many = books.select("book_id").limit(DENSE).count() >= DENSE
        if known is not None:
            pairs = pairs.unionByName(self._missing(known, state, many))
        segment = self._write(pairs, many)
        done = state["done"] | ({source: batch} if source is not None and batch is not None else {})
        segments = state["segments"] + ([segment] if segment["partitions"] else [])
        self.manifest.commit(base, {"segments": segments, "books": [*state["books"], self._write_books(new)], "done": done})
        return True

    def _split(self, books: DataFrame, state: dict) -> tuple[DataFrame, DataFrame | None]:
        """The books that are not indexed yet, and those that are (None if there are none)."""
        if not state["books"]:
            return books, None
        there = self.books(state)
        few = [r["block"] for r in books.select(F.bitmap_bucket_number("book_id").alias("block")).distinct().limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            there = there.where(F.col("block").isin(few))
        there = there.select("book_id").distinct()
        known = books.join(there, "book_id", "left_semi")
        if known.isEmpty():
            return books, None
        return books.join(there, "book_id", "left_anti"), known

    def _missing(self, books: DataFrame, state: dict, many: bool = False) -> DataFrame:
        """The pairs of indexed books that the index lacks; of it only their terms' partitions and blocks are read.

        The books' pairs meet by term and block first, so a stored block is joined and opened once, not for each of its
        pairs. `many` books have terms of all partitions, which aren't listed first then.
        """
        partitions = None
        if not many:
            placed = _placed(index.pairs(books).select("term").distinct()).select("letter", "bucket").distinct()
            partitions = {(r["letter"], r["bucket"]) for r in placed.collect()}  # LETTERS * BUCKETS at most
        rows = self.blocks(partitions, state)
        few = [r["block"] for r in books.select(F.bitmap_bucket_number("book_id").alias("block")).distinct().limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            rows = rows.where(F.col("block").isin(few))
        there = self._whole(rows, len(state["segments"])).select("term", "block", F.col("ids").alias("old"), "bits")
        met = met_blocks(index.pairs(books)).join(there, ["term", "block"], "left")
        old = F.coalesce(_ids(F.col("block"), F.col("old"), F.col("bits")), F.array().cast("array<bigint>"))
        return met.select("term", F.explode(F.array_except("ids", old)).alias("book_id"))

    def compact(self, most: int = 4) -> int:
        """Rewrites the partitions that lie in more than `most` segments as one; how many. Answers stay as they are."""
        base, state = self.manifest.latest()
        lies: dict[tuple[str, int], int] = {}
        for s in state.get("segments", []):
            for letter, bucket in s["partitions"]:
                lies[letter, bucket] = lies.get((letter, bucket), 0) + 1
        touched = {p for p, n in lies.items() if n > most}
        books = state.get("books", [])
        if not touched and len(books) <= most:
            return 0
        segments = state["segments"]
        if touched:
            merged = self._write_blocks(self._arrays(self._whole(self.blocks(touched, state), len(segments))))
            rest = [s | {"partitions": [p for p in s["partitions"] if tuple(p) not in touched]} for s in segments]
            segments = [*[s for s in rest if s["partitions"]], merged]
        if len(books) > most:
            books = [self._write_books(self.books(state).repartitionByRange("book_id"))]
        self.manifest.commit(base, state | {"segments": segments, "books": books})
        return len(touched)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the segments that none of the last `keep` states names, and the older states; the removed names.

        For times without a writer: what a writer has not committed yet is named by no state.
        """
        return self.drop_unnamed(self.manifest.forget(keep))

    def drop_unnamed(self, states: list[dict]) -> list[str]:
        """Removes the segments that none of these states names; the removed names."""
        named = {s["name"] for state in states for s in state.get("segments", [])}
        known = {name for state in states for name in state.get("books", [])}
        files, gone = self.manifest.files, []
        for folder in files.names():
            if folder.startswith("segment=") and folder.removeprefix("segment=") not in named:
                files.delete(folder)
                gone.append(folder.removeprefix("segment="))
        for name in files.names("books"):
            if name not in known:
                files.delete(f"books/{name}")
        return gone
