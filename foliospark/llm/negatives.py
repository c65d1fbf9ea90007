"""Hard negatives by one-dimensional distance keys.

A vector x is augmented by sqrt(M - |x|^2), M being the largest squared norm, and a query by 0; the nearest rows
of the augmented space are then those of the largest inner product. Each row belongs to its nearest pivot and has
the distance from it as its key. Rows are stored sorted by (pivot, key) and cut into blocks. A block whose keys lie
in [lo, hi] can't hold a row nearer to a query than max(lo - d, d - hi), d being the query's distance from the
pivot. So a search scans intervals of keys around d that grow by rounds, each pivot's annulus by annulus, and ends
for a query when no block is left whose bound is below the distance of the last row that it still needs. The
result is exact: bounds carry a slack above the rounding of distances, ranks come from integer products.

Pivots are fitted on a bounded sample of at most SAMPLE rows; every row is indexed. Rows of equal vector and label
are one entry with its smallest ids. Blocks are at most MOST_BLOCKS and grow with the table; a block is worked on
in parts of PART rows against turns of about TURN queries, so neither a full block nor a busy one is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.ann import _kmeans, _matrix, entries
from foliospark.llm.common import release, stored

SAMPLE = 20_000
MOST_PIVOTS = 256
PART, TURN = 1024, 512
MOST_BLOCKS = 65_536
FIRST, GROWTH = 4096, 4  # rows of a query's first scan, and how many times as many the next ones may have scanned
SLACK = 1e-6
EXACT = 2.0**53
LIMIT = (1 << 63) - 1
FOUND = "qid long, target int, id long, score long"


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): integer components; without nulls, empty vectors and ones with non-finite parts."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    )
    return kept.where(~bad).withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))


def _keyed(pivots: np.ndarray, most: float):
    """The nearest pivot of each entry and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _augmented(_matrix(batch.column("v")), most)
            near = _to_pivots(x, pivots).argmin(axis=1)
            key = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(key)], [*batch.schema.names, "pivot", "key"])

    return run


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]])


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _advance(blocks: dict[str, np.ndarray], pivots: np.ndarray, most: float):
    """Adds to each query the blocks of its next scan (none: it is certified) and the radius scanned with them."""
    number, lo, hi, n = (blocks[c] for c in ("block", "lo", "hi", "n"))

    def further(q: np.ndarray, d: np.ndarray, caps: list[int], floors: list[int], last: dict[int, int], radius: float) -> tuple[float, np.ndarray]:
        far = lambda score: float(np.sqrt(max(q @ q + most - 2.0 * score, 0.0)))
        slack = SLACK * (np.sqrt(most) + np.sqrt(q @ q) + 1)
        needed = max(min(far(floor), far(last.get(j, floor))) for j, floor in enumerate(floors)) + slack
        bound = np.maximum(np.maximum(lo - d, d - hi), 0)
        too_near = d + hi < far(max(caps)) - slack  # scores above every cap
        while radius < needed:
            fresh = np.flatnonzero(bound > radius)
            if not len(fresh):
                break
            fresh = fresh[np.argsort(bound[fresh], kind="stable")]
            allowed = max(FIRST, (GROWTH - 1) * int(n[bound <= radius].sum()))
            reach = bound[fresh[min(int(np.searchsorted(np.cumsum(n[fresh]), allowed)), len(fresh) - 1)]]
            radius, chosen = min(needed, reach), fresh[bound[fresh] <= min(needed, reach)]
            chosen = chosen[~too_near[chosen]]
            if len(chosen):
                return radius, number[chosen]
        return needed, np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"))
            d = _to_pivots(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            radius, scans = [], []
            columns = [batch.column(c).to_pylist() for c in ("caps", "floors", "last", "radius")]
            for i, (caps, floors, last, r) in enumerate(zip(*columns, strict=True)):
                r, scan = further(q[i], d[i][blocks["pivot"]], caps, floors, dict(last or ()), r)
                radius.append(r)
                scans.append(scan.astype(np.int32))
            named = {c: batch.column(c) for c in ("qid", "anchor_id", "label", "v", "caps", "floors")}
            yield pa.RecordBatch.from_pydict(named | {"radius": pa.array(radius, pa.float64()), "blocks": pa.array(scans, pa.list_(pa.int32()))})

    return run


STATE = "qid long, anchor_id long, label long, v array<double>, caps array<long>, floors array<long>, radius double, blocks array<int>"


def _products(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products of integers; in doubles where all sums are below 2^53, else in integers, held to 64 bits."""
    if np.abs(q).max() * np.abs(e).max() * q.shape[1] < EXACT:
        return q @ e.T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object)
    return np.clip(whole(q) @ whole(e).T, -LIMIT, LIMIT)


def _scan(top: int, same: bool):
    """The best ids of one part of a block for the targets of one turn of its queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "target": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            scores = _products(_matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks()))
            labels, ids = right.column("label").to_numpy(), right.column("ids").to_pylist()
            asked = zip(*[left.column(c).to_pylist() for c in ("qid", "anchor_id", "label", "caps", "floors")], strict=True)
            for score, (qid, anchor, label, caps, floors) in zip(scores, asked, strict=True):
                fits = (labels == label) == same
                for j, (cap, floor) in enumerate(zip(caps, floors, strict=True)):
                    own = np.flatnonzero(fits & (score <= cap) & (score >= floor))
                    if len(own) > top + 1:  # one entry may hold the anchor alone
                        least = np.sort(score[own])[-top - 1]
                        own = own[score[own] >= least]
                    best = sorted((-int(score[x]), i) for x in own for i in ids[x] if i != anchor)[:top]
                    out["qid"] += [qid] * len(best)
                    out["target"] += [j] * len(best)
                    out["id"] += [i for _, i in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table(out, schema=pa.schema([("qid", pa.int64()), ("target", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))

    return run


class Index:
    """Rows (e, ids, label, v, pivot, key, block, part), sorted by (pivot, key), and the directory of their blocks."""

    def __init__(self, usable: DataFrame, keep: int):
        spark = usable.sparkSession
        # a label rides as the first component, so that equal vectors of one label are one entry
        labelled = usable.select("vec_id", F.concat(F.array(F.col("label").cast("double")), "v").alias("v"))
        taken = entries(labelled, keep).select("e", "ids", F.col("v")[0].cast("long").alias("label"), F.expr("slice(v, 2, size(v) - 1)").alias("v"))
        kept = stored(taken, "entries")
        square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        self.n, most = kept.agg(F.count(F.lit(1)), F.max(square)).first()
        self.most = most or 0.0
        share = max(1, self.n // SAMPLE)
        sample = [r["v"] for r in kept.where(F.pmod(F.xxhash64("v", "label"), F.lit(share)) == 0).select("v").limit(SAMPLE).collect()]
        sample = sample or [r["v"] for r in kept.select("v").limit(SAMPLE).collect()]
        x = _augmented(np.array(sample, dtype=np.float64), self.most)
        self.pivots = _kmeans(x, int(np.clip(round(self.n**0.5 / 4), 1, MOST_PIVOTS)), 1)
        kind = "e long, ids array<long>, label long, v array<double>, pivot int, key double"
        keyed = kept.mapInArrow(_keyed(self.pivots, self.most), kind)
        times = -(-self.n // (PART * MOST_BLOCKS))
        slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        runs = keyed.repartitionByRange(slices, "pivot", "key", "e", "label").sortWithinPartitions("pivot", "key", "e", "label")
        place = F.monotonically_increasing_id()  # the slice, and the row's place in it
        runs = runs.withColumn("run", F.floor(place / (PART * times)).cast("long")).withColumn("part", F.floor(place % (PART * times) / PART).cast("int"))
        runs = stored(runs, "runs")
        release(kept)
        found = runs.groupBy("pivot", "run").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"), (F.max("part") + 1).alias("parts"))
        rows = sorted(found.collect(), key=lambda r: (r["pivot"], r["run"]))  # a pivot, a slice and MOST_BLOCKS bound their number
        named = [(i, r["pivot"], r["run"], r["parts"]) for i, r in enumerate(rows)]
        self.parts = spark.createDataFrame(named, "block int, pivot int, run long, parts int")
        self.rows = runs.join(F.broadcast(self.parts.drop("parts")), ["pivot", "run"])
        self.blocks = {c: np.array([r[c] for r in rows]) for c in ("pivot", "lo", "hi", "n")} | {"block": np.arange(len(rows))}
        self.scanned = 0  # pairs of a query and a row, of all scans

    def search(self, asked: DataFrame, top: int, same: bool) -> DataFrame:
        """FOUND: for each target of asked(qid, anchor_id, label, v, caps, floors) its `top` rows of the same label
        (or of other ones) with floor <= score <= cap, by score, ties by smaller id."""
        spark = asked.sparkSession
        state, found = asked.withColumn("radius", F.lit(-1.0)), spark.createDataFrame([], FOUND)
        order = Window.partitionBy("qid", "target").orderBy(F.desc("score"), "id")
        while True:
            last = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top)
            last = last.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("last"))  # a handful of targets
            state, before = stored(state.join(last, "qid", "left").mapInArrow(_advance(self.blocks, self.pivots, self.most), STATE), "scans"), state
            release(before)
            scans = state.select("qid", "anchor_id", "label", "v", "caps", "floors", F.explode("blocks").alias("block"))
            load = scans.groupBy("block").agg(F.count(F.lit(1)).alias("asked")).join(F.broadcast(self.parts), "block").select(
                "block", "parts", "asked", F.ceil(F.col("asked") / TURN).cast("int").alias("turns")
            )
            load = stored(load, "load")
            loads = load.select("block", "asked").collect()  # no more than there are blocks
            if not loads:
                release(load, state)
                return found
            self.scanned += sum(r["asked"] * int(self.blocks["n"][r["block"]]) for r in loads)
            dealt = F.broadcast(load)
            left = scans.join(dealt, "block").select(
                "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int").alias("turn"),
                "qid", "anchor_id", "label", "v", "caps", "floors",
            )
            right = self.rows.join(dealt, "block").select(
                "block", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "ids", "label", "v"
            )
            keys = ["block", "part", "turn"]
            met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(top, same), FOUND)
            ranked = found.unionByName(met).distinct().withColumn("rank", F.row_number().over(order))
            found, before = stored(ranked.where(F.col("rank") <= top).drop("rank"), "found"), found
            release(before, load)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors (vec_id, embedding, label).

    A component x counts as floor(scale * x); a score is the integer inner product with the anchor, and more is
    better, ties go to the smaller vec_id. Positives are the first rows of the anchor's label, negatives for each
    of them the first rows of other labels with low * positive <= 100 * negative <= high * positive (none where a
    positive score is below 0 and low below high). Rows with a null id, label or vector, an empty vector or null
    or non-finite components take no part, on either side; of several dimensions the most frequent takes part.
    Rows under the anchor's own id are none of its partners; repeated rows count once. Empty tables give an empty
    table. Components and scores are held to 64 bits.
    """
    spark = rows.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable, asked = _usable(rows, scale), _usable(anchors, scale)
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], kind)
    usable, asked = (x.where(F.size("v") == sizes[0]["d"]) for x in (usable, asked))
    index = Index(usable, max(positives, negatives) + 1)
    longs = lambda x: F.array(F.lit(x).cast("long"))
    asked = asked.distinct().select(F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("anchor_id"), "label", "v")
    asked = stored(asked, "anchors")
    first = index.search(asked.withColumn("caps", longs(LIMIT)).withColumn("floors", longs(-LIMIT)), positives, True)
    exact = F.col("score").cast("decimal(20,0)")
    wanted = first.withColumn("cap", F.floor(exact * high / 100).cast("long")).withColumn("floor", F.ceil(exact * low / 100).cast("long")).where("floor <= cap")
    # one target for each score, as equal scores have the same negatives
    targets = wanted.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("score", "cap", "floor"))).alias("t"))
    again = asked.join(targets, "qid").select("qid", "anchor_id", "label", "v", F.col("t.cap").alias("caps"), F.col("t.floor").alias("floors"))
    second = index.search(again, negatives, False)
    scores = targets.select("qid", F.posexplode("t").alias("target", "x")).select("qid", "target", F.col("x.score").alias("positive_score"))
    order = Window.partitionBy("qid", "target").orderBy(F.desc("score"), "id")
    chosen = second.withColumn("rank", F.row_number().over(order)).join(scores, ["qid", "target"])
    pairs = first.select("qid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.select("qid", "anchor_id"), "qid")
    return pairs.join(chosen, ["qid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
