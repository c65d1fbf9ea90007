"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of distinct k-word shingles; two documents link when
100 * intersection >= percent * union. The plan:

1. One scan hashes every text's shingles and adds their counts into a hashed table of fixed width,
   which orders shingles rare-first. Any order gives the same links; a good one gives short lists.
2. A second scan keeps, of each document, its set size, a 128-bit signature of its whole set, the
   histogram of its hashes over RANGES equal ranges (for the suffix filter) and the prefix of its set
   in that order (size - ceil(t * size) + 1 shingles). Documents of one signature are copies and go
   on as one class.
3. Classes that share a prefix shingle are candidates. Pairs pass the length, positional and suffix filters (the last in a coarse form where pairs
   arise, then in a finer one) and are verified exactly, once each, on whole sets. If the lists would need
   more than a few comparisons an entry, by counts, members are first compared with a few hashed
   members of their list; components of the links so far make most lists uniform. These are closed, as
   components only grow, and further rounds take other leaders of the open ones while that finds links.
   Then all pairs across components in the open lists are compared. A pair inside a component needs no
   check, as it cannot change the components; every pair between components is checked, so no link that
   connects different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import arrowtext as at
from foliospark.llm.common import release, small_batches, stored, tidy
from foliospark.llm.components import components

#: Counters of the rare-first order (one saturating byte each a task, two in the sum: 8 MB), the blocks
#: they are summed in, and the ranges of the suffix filter. None of them changes any result.
COUNTERS = 1 << 22
BLOCK = 1 << 14
RANGES = 64
#: Most members of a list that a round compares the others with, at first, where most lists of many are groups of
#: near copies, and later; most rounds; and how many comparisons an entry of the lists may stand for without a
#: round, at first and later.
FIRST_LEADERS, LEADERS, ROUNDS, FIRST, LATER = 16, 64, 3, 1, 16
#: Entries of one list and class of sizes that one task compares with others in the last round.
HOT = 1000
#: Ids of this many rows are broadcast (8 bytes each); more are joined by a shuffle.
SMALL = 1_000_000


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - 22)).astype(np.int64)


def _counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            for part in at.slices(batch, "text"):
                value, _ = at.shingles(*at.word_hashes(part.column("text")), k)
                np.add.at(counts, _slot(value), 1)
        packed = np.minimum(counts, 255).astype(np.uint8).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(packed))), pa.array([x.tobytes() for x in packed], pa.binary())], ["block", "counts"]
        )

    return run


def _sum_blocks(key: tuple, group: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, dtype=np.int64)
    for x in group.column("counts").to_pylist():
        total += np.frombuffer(x, dtype=np.uint8)
    packed = np.minimum(total, 65535).astype(np.uint16).tobytes()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([packed], pa.binary())})


def _signatures(value: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Both halves of each row's signature: sums over its set; 0 for an empty set."""
    total = np.zeros((2, len(offset) - 1), dtype=np.uint64)
    full = np.flatnonzero(np.diff(offset) > 0)
    if len(full):
        total[0, full] = np.add.reduceat(at.mix(value + np.uint64(1)), offset[:-1][full])
        total[1, full] = np.add.reduceat(at.mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), offset[:-1][full])
    return total.view(np.int64)


def _prefixes(k: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, dtype=np.uint16)
        for batch in batches:
            for part in at.slices(batch, "text"):
                value, offset = at.shingles(*at.word_hashes(part.column("text")), k)
                rows, size = at.row_numbers(offset), np.diff(offset)
                # rarest first; equal counts by value, as a stable sort of sorted values leaves them
                rank = (table[_slot(value)].astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
                take = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                ends = np.zeros(len(size) + 1, dtype=np.int64)
                np.cumsum(take, out=ends[1:])
                prefix = np.empty(ends[-1], dtype=np.uint64)
                for i, (a, b) in enumerate(zip(offset[:-1], offset[1:], strict=True)):
                    prefix[ends[i] : ends[i + 1]] = value[a:b][np.argsort(rank[a:b], kind="stable")[: take[i]]]
                total = _signatures(value, offset)
                hist = np.bincount(rows * RANGES + (value >> np.uint64(58)).astype(np.int64), minlength=len(size) * RANGES)
                coarse = np.minimum(hist.reshape(len(size), 8, RANGES // 8).sum(axis=2), 255).astype(np.uint8).view("<i8").ravel()
                hist = (np.minimum(hist, 255) - 128).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(size),
                        pa.array(total[0]),
                        pa.array(total[1]),
                        pa.array(coarse),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * RANGES), pa.array(hist)),
                        at.lists(prefix, ends),
                    ],
                    ["doc_id", "n", "sig", "sig2", "coarse", "hist", "prefix"],
                )

    return run


def _sets(k: int):
    """Whole sets of texts, with their signatures; of equal ones a task keeps one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            for part in at.slices(batch, "text"):
                value, offset = at.shingles(*at.word_hashes(part.column("text")), k)
                total, size = _signatures(value, offset), np.diff(offset)
                names = zip(*total.tolist(), size.tolist(), strict=True)
                fresh = np.array([not (x in seen or seen.add(x)) for x in names], dtype=bool)
                ends = np.concatenate([[0], np.cumsum(size[fresh])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total[0][fresh]), pa.array(total[1][fresh]), pa.array(size[fresh]), at.lists(value[np.repeat(fresh, size)], ends)],
                    ["sig", "sig2", "n", "items"],
                )

    return run


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Smallest intersection of a link between sets of these sizes."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100.0 + percent) - F.lit(1e-9))


def _fits(percent: int) -> Column:
    """Length filter, then positional filter: what can still be shared from the common place on."""
    n, m = F.col("n"), F.col("l_n")
    rest = F.least(n - F.col("pos"), m - F.col("l_pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest >= _needed(n, m, percent))


def _coarsely_near(percent: int) -> Column:
    """The suffix filter where pairs arise: by the counts over eight ranges of the hash, packed into one number."""
    byte = lambda name, i: F.shiftrightunsigned(name, 8 * i).bitwiseAND(F.lit(255))
    apart = reduce(lambda s, i: s + F.abs(byte("coarse", i) - byte("l_coarse", i)), range(8), F.lit(0))
    return apart <= F.col("n") + F.col("l_n") - 2 * _needed(F.col("n"), F.col("l_n"), percent)


def _suffix_filtered(pairs: DataFrame, hists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose sets may differ by as little as a link allows.

    Sets differ by at least the sum, over the ranges of the hash, of the differences of their counts.
    """
    apart = F.aggregate(
        F.zip_with("ha", "hb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x
    )
    both = pairs.join(hists.select(F.col("node").alias("a"), F.col("hist").alias("ha")), "a").join(
        hists.select(F.col("node").alias("b"), F.col("hist").alias("hb")), "b"
    )
    near = both.where(apart <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent))
    return near.select("a", "b", "na", "nb")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among distinct pairs, by the exact intersection of the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    same = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("ia", "ib")).cast("long"))
    return same.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, node, root, component_id) of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach; node names the row's set, root its component.
    A null or wordless text has size 0, links with nothing and is its own component. Rows of one doc_id
    are judged by their own texts; a row without doc_id takes part and gets null if it is alone. Other
    columns are ignored, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = np.zeros((COUNTERS // BLOCK, BLOCK), dtype=np.uint16)
    blocks = texts.select("text").mapInArrow(_counts(k), "block long, counts binary").groupBy("block")
    for block, packed in blocks.applyInArrow(_sum_blocks, "block long, counts binary").collect():  # 8 MB at most
        table[block] = np.frombuffer(packed, dtype=np.uint16)
    counts = spark.sparkContext.broadcast(table.tobytes())
    kind = "doc_id long, n long, sig long, sig2 long, coarse long, hist array<tinyint>, prefix array<long>"
    rows = stored(texts.mapInArrow(_prefixes(k, percent, counts), kind), "prefixes")
    rows = rows.withColumn("node", F.xxhash64("sig", "sig2", "n"))
    links = _links(texts, rows, k, percent)
    small = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    classes = small.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = classes.withColumn("root", F.col("node")) if links is None else classes.join(links, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "root", "component_id")
    return small.join(named, "node", "left").select(
        "doc_id", "n_shingles", "node", "root", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _sets_of(wanted: DataFrame, rows: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, items) of the wanted nodes, from the text of one row each.

    The row is named by its doc_id (null only if no row of the node has one). As ids may be null or repeat
    with other texts, all texts of these ids are hashed, and the signature of each says which node it is.
    """
    named = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = stored(named, "wanted")
    n = named.count()
    small = F.broadcast if n <= SMALL else lambda x: x
    there = texts.where("text is not null").join(small(named.select("doc_id").distinct()), texts["doc_id"].eqNullSafe(named["doc_id"]), "left_semi")
    found = there.select("text").mapInArrow(_sets(k), "sig long, sig2 long, n long, items array<long>")
    found = found.select(F.xxhash64("sig", "sig2", "n").alias("node"), "items").join(small(named.select("node")), "node", "left_semi")
    sets = stored(found, "sets")
    return sets if sets.count() == n else stored(sets.dropDuplicates(["node"]), "sets")  # more: equal texts of one id


def _comparisons(lists: DataFrame, percent: int) -> int:
    """At most how many pairs across components the lists hold, from counts alone.

    In a link, the smaller set's place is among its first n - needed(n, n) + 1, so pairs of two later places
    don't count.
    """
    late = F.sum(F.when(F.col("n") - F.col("pos") < _needed(F.col("n"), F.col("n"), percent), 1.0).otherwise(0.0))
    by_root = lists.groupBy("h", "root").agg(F.count(F.lit(1)).cast("double").alias("a"), late.alias("p"))
    across = lambda x: (F.sum(x) * F.sum(x) - F.sum(F.col(x) * F.col(x))) / 2
    by_list = by_root.groupBy("h").agg((across("a") - across("p")).alias("pairs"))
    return int(by_list.agg(F.sum("pairs")).first()[0] or 0)


def _sized(lists: DataFrame, percent: int) -> DataFrame:
    """Entries with `s`, the class of their size: sizes that the length filter lets meet lie in one class or in neighbours."""
    base = math.log(100 / percent) * (1 + 1e-9)
    return lists.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / base).cast("int"))


def _all_pairs(lists: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Each pair of entries of one list whose sizes can link, once.

    A list is joined class of sizes by class. The left side of a class of more than HOT entries is dealt to
    parts and the right side goes to every part, so what one task compares is bounded on one side by HOT entries.
    """
    sized = _sized(lists, percent)
    hot = sized.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT)
    hot = stored(hot.select("h", "s", F.ceil(F.col("c") / HOT).cast("int").alias("parts")), "hot-lists")
    deal = F.broadcast(hot) if hot.count() <= SMALL else hot  # a row for each HOT entries at most
    parts = F.coalesce("parts", F.lit(1))
    left = sized.join(deal, ["h", "s"], "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("parts")
    other = sized.select("h", *[F.col(x).alias(f"l_{x}") for x in names], F.col("s").alias("l_s"))
    right = other.withColumn("s", F.explode(F.array("l_s", F.col("l_s") + 1))).join(deal, ["h", "s"], "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["h", "s", "part"]).where((F.col("s") > F.col("l_s")) | (F.col("node") > F.col("l_node")))


def _candidates(lists: DataFrame, turn: int | None, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of entries of one list that pass the filters: all pairs, or those with the leaders of a turn."""
    names = [c for c in ("node", "n", "pos", "coarse", "root") if c in lists.columns]
    if turn is None:
        both = _all_pairs(lists, names, percent)
    else:
        # one leader a bucket of the turn's hash of the node
        bucket = F.xxhash64("node", F.lit(turn))
        drawn = lists.select("h", F.struct(bucket.alias("o"), *names).alias("l"), F.pmod(bucket, F.lit(FIRST_LEADERS if turn == 0 else LEADERS)).alias("part"))
        led = drawn.groupBy("h", "part").agg(F.min("l").alias("l")).select("h", *[F.col(f"l.{x}").alias(f"l_{x}") for x in names])
        both = lists.join(led, "h")
    apart = "root != l_root" if "root" in names else "node != l_node"
    first = F.col("node") < F.col("l_node")
    return (
        both.where(apart)
        .where(_fits(percent))
        .where(_coarsely_near(percent))
        .select(
            F.least("node", "l_node").alias("a"),
            F.greatest("node", "l_node").alias("b"),
            F.when(first, F.col("n")).otherwise(F.col("l_n")).alias("na"),
            F.when(first, F.col("l_n")).otherwise(F.col("n")).alias("nb"),
        )
        .distinct()
    )


def _open(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries of lists that still hold two components, with the roots of now; the others never open again."""
    if "root" not in lists.columns:
        lists = lists.withColumn("root", F.col("node"))
    if roots is not None:
        now = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
        lists = lists.join(now, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
    mixed = lists.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    return stored(lists.join(mixed.select("h"), "h", "left_semi"), "open-lists")


def _links(texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, root) of the classes that link with another; None if there are none."""
    full = rows.where("n > 0")
    place = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long"))  # both in one number, as most entries travel for nothing
    posted = full.dropDuplicates(["node"]).select("node", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "node", place.alias("place"))
    frequent = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    shared = stored(posted.join(frequent, "h", "left_semi"), "shared")
    tidy(rows.sparkSession)
    hists = full.select("node", "hist", "coarse").dropDuplicates(["node"])
    parts = F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")
    lists = stored(shared.select("h", "node", *parts).join(hists.select("node", "coarse"), "node"), "postings")
    release(shared)
    entries = lists.count()
    links = sets = tested = roots = None
    fruitful = True
    for turn in range(ROUNDS + 1):
        compared = _comparisons(lists if turn else lists.withColumn("root", F.col("node")), percent)
        if not compared:
            break
        last = compared <= (LATER if turn else FIRST) * entries or not fruitful or turn == ROUNDS
        pairs = _candidates(lists, None if last else turn, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(_suffix_filtered(pairs, hists, percent), "pairs")
        tidy(rows.sparkSession)
        fruitful = False
        if not pairs.isEmpty():
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("node"), "node", "left_anti")
            more = _sets_of(wanted, rows, texts, k)
            tidy(rows.sparkSession)
            sets = more if sets is None else sets.unionByName(more)
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
            new = stored(_verified(pairs, sets, percent), "links")
            fruitful = not new.isEmpty()
            if fruitful:
                links = new if links is None else links.unionByName(new)
                roots = components(links)
        if last:
            break
        lists, before = _open(lists, roots if fruitful else None), lists
        release(before)
        tidy(rows.sparkSession)
    release(lists)
    return roots
