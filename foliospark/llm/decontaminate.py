"""Benchmark decontamination by SimHash windows with a multi-index over Hamming blocks, DataFrame functions only.

An item leaks into a document if an item-sized window of the document's words has a weighted Jaccard
similarity of at least THRESHOLD with it, on K-word shingles weighted by how often they occur; a document
that is shorter than the item is one window as a whole. Steps:

1. Anchors. A window that similar shares all but a few of the item's shingles, so some of any MISS + 1
   of them; each item's `anchors` are its first share of shingles in the order of rareness among items.
   Documents are hashed once, shingle by shingle, and only places that hold a shingle of an item go on:
   what a benchmark does not touch costs one hash look-up a word.
2. Windows. Every anchor place proposes all windows that hold it, of the sizes of the items that have the
   anchor. Those with fewer places of shingles of such items than a leak needs are dropped: they cannot
   be similar enough. Equal windows (of copies, too) are one from here on, by the hash of their shingles.
3. SimHash. Each window and each item gets a 64-bit fingerprint of its weighted shingles. Fingerprints
   are cut into BLOCKS blocks: two within RADIUS differ by at most RADIUS // BLOCKS bits in one of them
   (pigeonhole), so each item is entered under all values that near, and a join on (size, block, value)
   yields every pair within the radius; the rest is cut by distance. Blocks of 16 bits select: two
   unrelated fingerprints meet with a chance of 0.14, which the anchors have lowered before.
4. Exact weighted similarity decides on the pairs that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import stored

K = 5
THRESHOLD = 0.8
RADIUS, BLOCKS = 19, 4
BLOCK_BITS = 64 // BLOCKS
SMALL = 1_000_000  # rows of three numbers that are broadcast; more are joined by a shuffle

WORD = r"[\p{L}\p{N}]+"


def _hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingled(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, g): one row for each K-word shingle of `words`, in place order; texts of fewer words have none."""
    n = F.size("words")
    parts = [F.slice("words", F.lit(j + 1), F.greatest(n - (K - 1), F.lit(0))).alias(f"w{j}") for j in range(K)]
    zipped = F.arrays_zip(*parts)
    flat = rows.select(*keys, F.posexplode(zipped).alias("pos", "w"))
    return flat.select(*keys, "pos", F.xxhash64(*[F.col(f"w.w{j}") for j in range(K)]).alias("g"))


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _fingerprint(weighted: DataFrame, *keys: str) -> DataFrame:
    """(keys, f): SimHash of weighted(keys, g, w). Lanes of 16 bits add the bits of four at a time."""
    lanes = [F.sum(F.shiftrightunsigned("g", k).bitwiseAND(F.lit(0x0001000100010001)) * F.col("w")).alias(f"s{k}") for k in range(16)]
    sums = weighted.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)
    bits = F.lit(0).cast("long")
    for k in range(16):
        for j in range(4):
            ones = F.shiftrightunsigned(f"s{k}", 16 * j).bitwiseAND(F.lit(0xFFFF))
            bits = bits.bitwiseOR(F.shiftleft((2 * ones > F.col("total")).cast("long"), k + 16 * j))
    return sums.select(*keys, bits.alias("f"))


def _blocks(f: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(f, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("v")) for i in range(BLOCKS)])


def _near_blocks(rows: DataFrame) -> DataFrame:
    """rows(h, ..) once for each block `i` and each value `v` that differs from it by at most RADIUS // BLOCKS bits."""
    masks = ",".join(str(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS)
    flips = F.split(F.lit(masks), ",").cast("array<long>")  # a constant
    blocks = rows.select("*", F.inline(_blocks(F.col("h"))).alias("i", "block"))
    return blocks.withColumn("v", F.explode(flips)).withColumn("v", F.col("v").bitwiseXOR(F.col("block"))).drop("block")


def _proposed(marks: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, size, start) of the windows that hold an anchor and enough of marks(doc_id, size, pos, anchor).

    A window of an item's size shares at least 2 t / (1 + t) of it; one at 0 may be a text that is shorter
    than the item and then shares at least t of it. Starts beyond the end of the text are not cut here.
    """
    least = F.ceil(F.col("size") * threshold - 1e-9)
    able = marks.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("anchor")).where(F.col("anchor") & (F.col("n") >= least))
    marks = marks.join(_broadcast_if_small(stored(able.select("doc_id", "size"), "able")), ["doc_id", "size"])
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1), F.col("pos")))
    starts = marks.where("anchor").select("doc_id", "size", starts.alias("start")).distinct()
    # marks before the end of a window, less those before its start, by one running sum
    edge = lambda at, sign: F.struct((2 * at).cast("long").alias("at"), F.lit(sign).alias("sign"))
    edges = starts.select("doc_id", "size", "start", F.inline(F.array(edge(F.col("start"), -1), edge(F.col("start") + F.col("size"), 1))))
    rows = edges.unionByName(marks.select("doc_id", "size", F.lit(None).cast("int").alias("start"), (2 * F.col("pos") + 1).cast("long").alias("at"), F.lit(0).alias("sign")))
    running = Window.partitionBy("doc_id", "size").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("before", F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(running)).where("sign <> 0")
    held = summed.groupBy("doc_id", "size", "start").agg(F.sum(F.col("sign") * F.col("before")).alias("held"))
    need = F.when(F.col("start") == 0, least).otherwise(F.ceil(F.col("size") * (2 * threshold / (1 + threshold)) - 1e-9))
    return held.where(F.col("held") >= need).select("doc_id", "size", "start")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of docs(doc_id, text, ..) against benchmark(item_id, text, ..).

    One row for each document and item that leaks into it: its best window, the first of equal ones; start
    counts words from 0. A text of fewer words than the item is a window itself. Words are runs of letters and digits, lower-cased, so punctuation changes nothing.
    Items of fewer than K words hold no shingle and match nothing, and so do null and empty texts. Items
    with equal words each match. Rows without doc_id or item_id are left out; rows of one doc_id count as
    one document with its best window over all its texts. Other columns are ignored. Empty tables on
    either side give an empty table.
    """
    items = _shingled(benchmark.where("item_id IS NOT NULL").select("item_id", _hashes(F.col("text")).alias("words")), "item_id")
    items = stored(items.distinct(), "items")
    size = items.groupBy("item_id").agg((F.max("pos") + 1).alias("size"))
    weights = items.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("w"), F.min("pos").alias("first"))
    spread = weights.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # similarity t leaves at most 1 - t of the item's weight unshared, in a window that is shorter than the item
    order = Window.partitionBy("item_id").orderBy("df", "first")
    ranked = weights.join(spread, "g").join(size, "item_id").withColumn("mass", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    anchored = ranked.where(F.coalesce("mass", F.lit(0)) <= F.floor(F.col("size") * (1 - threshold) + 1e-9))
    known = weights.join(size, "item_id").join(anchored.select("item_id", "g", F.lit(True).alias("anchor")), ["item_id", "g"], "left")
    known = stored(known.groupBy("g", "size").agg(F.max(F.coalesce("anchor", F.lit(False))).alias("anchor")), "known")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = _shingled(texts.select("doc_id", _hashes(F.col("text")).alias("words")), "doc_id")
    marks = stored(places.join(_broadcast_if_small(known), "g").select("doc_id", "size", "pos", "anchor"), "marks")
    proposed = stored(_proposed(marks, threshold), "proposed")
    # the texts that hold an anchor are hashed again for their windows; windows gather in their own document
    wanted = proposed.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("asked"))
    wanted = stored(wanted, "wanted")
    n = F.size("words")
    found = texts.join(_broadcast_if_small(wanted), "doc_id").select("doc_id", "asked", _hashes(F.col("text")).alias("words"))
    cut = found.where(n >= K).select("doc_id", "words", F.inline("asked"))
    cut = cut.where((F.col("start") + F.col("size") + K - 1 <= n) | (F.col("start") == 0))  # else a text shorter than the item
    cut = cut.select("doc_id", "start", "size", F.slice("words", F.col("start") + 1, F.col("size") + K - 1).alias("words"))
    windows = stored(cut.select("doc_id", "start", "size", F.xxhash64("words").alias("win"), (n - (K - 1)).alias("held"), "words"), "windows")
    unique = windows.select("win", "size", "words").dropDuplicates(["win", "size"])
    shingles = stored(_shingled(unique, "win", "size").groupBy("win", "size", "g").agg(F.count(F.lit(1)).alias("w")), "window-shingles")
    left = _fingerprint(shingles, "win", "size").select("win", "size", "f", F.inline(_blocks(F.col("f"))))
    # ten thousand rows an item, which Spark can't estimate behind a generator: not to be broadcast
    right = _near_blocks(stored(_fingerprint(weights, "item_id").join(size, "item_id").select("item_id", "size", F.col("f").alias("h")), "item-fingerprints"))
    near = left.join(right.hint("merge"), ["size", "i", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("h"))) <= RADIUS).select("win", "size", "item_id").distinct()
    shared = near.join(shingles.select("win", "size", "g", F.col("w").alias("a")), ["win", "size"]).join(weights.select("item_id", "g", F.col("w").alias("b")), ["item_id", "g"])
    same = shared.groupBy("win", "size", "item_id").agg(F.sum(F.least("a", "b")).alias("same"))
    placed = same.join(windows.drop("words"), ["win", "size"])
    scored = placed.withColumn("similarity", F.col("same") / (F.col("size") + F.col("held") - F.col("same"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "held")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), (F.col("b.held") + K - 1).cast("long").alias("n_words"), (-F.col("b.s")).alias("similarity"))
