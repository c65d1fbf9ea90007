"""Approximate nearest neighbours by an inverted multi-index.

The two halves of each unit vector are quantised separately with `centroids` k-means centroids a half,
which gives centroids ** 2 cells. A query walks the cells by the sum of its two half distances with a
heap (the multi-sequence order) until the cells hold `wanted` vectors, and every vector of those cells
is reranked by its exact cosine on the original values in double precision.

How deep to walk depends on the data, so it is measured: the true neighbours of PROBED indexed vectors that
are no queries are found by brute force over all rows, and `wanted` is set so that the walk reaches RECALL of
them. Cells hold about four entries (more beyond MOST_CENTROIDS), so a walk stops close to that depth.

The codebooks are fitted on a bounded sample of at most SAMPLE vectors; every vector is indexed. Equal
vectors are one entry with its smallest ids, so a vector with very many copies stays one entry. Cells
are dealt to shards in runs, a shard in parts of about CHUNK entries and CHUNK queries, so a full cell is many
small tasks' work, and a query's vector travels once a shard and part, with its list of cells. Within a part a
query meets the entries of its own cells only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import release, stored

SAMPLE = 20_000
CHUNK = 2048
WALKS = 64  # queries whose walks are one task
ROUNDS = 15
PROBED, RECALL = 200, 0.96
MOST_CENTROIDS = 512


def _usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) in double precision; without null, empty, zero vectors or ones with non-finite parts."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    ).where(~bad & ~zero)


def _few(keep: int):
    """Of each distinct vector of a batch the `keep` smallest ids: what has many copies shrinks where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            vectors: dict[bytes, int] = {}
            column = batch.column("v")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(x) for x in column])])
            for i, n in enumerate(batch.column("vec_id").to_pylist()):
                key = flat[at[i] : at[i + 1]].tobytes()
                ids.setdefault(key, []).append(n)
                vectors.setdefault(key, i)
            yield pa.RecordBatch.from_arrays(
                [column.take(pa.array(list(vectors.values()), pa.int64())), pa.array([sorted(set(x))[:keep] for x in ids.values()], pa.list_(pa.int64()))],
                ["v", "ids"],
            )

    return run


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids, e): each distinct vector, its `keep` smallest ids, the smallest as its name."""
    local = rows.mapInArrow(_few(keep), "v array<double>, ids array<long>")
    merged = local.groupBy("v", F.pmod(F.xxhash64("ids"), F.lit(32)).alias("salt")).agg(F.flatten(F.collect_list("ids")).alias("ids"))
    short = F.slice(F.array_sort(F.array_distinct("ids")), 1, keep)
    merged = merged.select("v", short.alias("ids")).groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select("v", short.alias("ids")).withColumn("e", F.element_at("ids", 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _encode(books: tuple[np.ndarray, np.ndarray], half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v")))
            a = _distances(x[:, :half], books[0]).argmin(axis=1)
            b = _distances(x[:, half:], books[1]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("e"), batch.column("ids"), batch.column("v"), pa.array((a * len(books[1]) + b).astype(np.int32))],
                ["e", "ids", "v", "cell"],
            )

    return run


def traverse(da: np.ndarray, db: np.ndarray, counts: np.ndarray, wanted: int, until: set[int] | None = None) -> list[int]:
    """Cells by rising da[i] + db[j], with a heap over the two sorted lists, until they hold `wanted` entries.

    With `until` the walk also ends when it has met all these cells.
    """
    ia, ib = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, pushed, cells, have = [(da[ia[0]] + db[ib[0]], 0, 0)], {(0, 0)}, [], 0
    left = set(until or ())
    while heap and have < wanted and (left or until is None):
        _, i, j = heapq.heappop(heap)
        cell = int(ia[i]) * len(db) + int(ib[j])
        if counts[cell]:
            cells.append(cell)
            have += int(counts[cell])
            left.discard(cell)
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(ia) and y < len(ib) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (da[ia[x]] + db[ib[y]], x, y))
    return cells


def _shard(cell, shards: int, cells: int):
    """Shards are runs of cells, so they hold the neighbours of a first half, and a walk meets few of them in part."""
    return cell * shards // cells


def _probe(books: tuple[np.ndarray, np.ndarray], half: int, counts: np.ndarray, wanted: int, shards: int):
    """A row for each query and shard: the cells of the shard that the query's walk reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v")))
            da, db = _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])
            for start in range(0, len(x), 256):
                rows, shard, cells = [], [], []
                for i in range(start, min(start + 256, len(x))):
                    found = np.sort(np.array(traverse(da[i], db[i], counts, wanted), dtype=np.int64))
                    place = _shard(found, shards, len(counts))
                    for cut in np.split(found, np.flatnonzero(np.diff(place)) + 1):
                        rows.append(i)
                        shard.append(int(_shard(int(cut[0]), shards, len(counts))))
                        cells.append(cut.astype(np.int32))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(shard, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                    ["query_id", "q", "shard", "cells"],
                )

    return run


def _cosines(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    q, e = q / np.abs(q).max(axis=1, keepdims=True), e / np.abs(e).max(axis=1, keepdims=True)
    return (q @ e.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((e * e).sum(1))[None]


def _brute(q: np.ndarray, ids: list[int], top: int):
    """The best entries of each batch for a few queries: (query, score, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _cosines(q, _matrix(batch.column("v")))
            score[np.array(ids)[:, None] == batch.column("e").to_numpy()[None]] = -2
            keep = min(top, batch.num_rows)
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            cell = batch.column("cell").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(q)), keep)), pa.array(np.take_along_axis(score, best, 1).ravel()), pa.array(cell[best].ravel())],
                ["i", "score", "cell"],
            )

    return run


def depth(coded: DataFrame, asked: DataFrame, books: tuple[np.ndarray, np.ndarray], half: int, counts: np.ndarray, top: int) -> int:
    """How many vectors a walk must reach so that RECALL of the true neighbours of PROBED entries are among them.

    The entries are none of the queries, unless all are; so the queries' recall is no fit to themselves.
    """
    asked = asked.select(F.col("vec_id").alias("e"), "v")
    others = coded.select("e", "v").join(asked.select("e"), "e", "left_anti")
    hashed = lambda rows: rows.orderBy(F.xxhash64("e")).limit(PROBED).select(F.col("e").alias("vec_id"), "v").collect()
    picked = hashed(others) or hashed(asked)
    if not picked:
        return top
    q = np.array([r["v"] for r in picked], dtype=np.float64)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))
    near = coded.select("e", "v", "cell").mapInArrow(_brute(q, [r["vec_id"] for r in picked], top), "i long, score double, cell int")
    true = near.withColumn("r", rank).where((F.col("r") <= top) & (F.col("score") > -2)).select("i", "cell").collect()
    x = _unit(q)
    da, db = _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])
    reach, sought = {}, {}
    for i, c in true:
        sought.setdefault(i, set()).add(c)
    for i, cells in sought.items():
        cells = traverse(da[i], db[i], counts, int(counts.sum()), cells)
        reach[i] = dict(zip(cells, np.cumsum(counts[cells]).tolist(), strict=True))
    needed = sorted(reach[i][c] for i, c in true)
    return needed[min(int(len(needed) * RECALL), len(needed) - 1)] if needed else top


#: Cosines that differ by less than rounding does are ties; the value itself is returned as it is.
PLACES = 13


def _exact(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Cosines of one vector with some others, each by sums of its own row, so that a pair gives the same wherever it is met."""
    q, e = q / np.abs(q).max(), e / np.abs(e).max(axis=1, keepdims=True)
    return (e * q).sum(axis=1) / np.sqrt((e * e).sum(axis=1)) / np.sqrt((q * q).sum())


def _rerank(top: int):
    """Of one part of a shard's queries against one of its entries: each query's best ids in its cells.

    Entries lie in the order of their cells; a query meets the runs of its own cells and no other entry.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("cell").to_numpy(), kind="stable")
            cell = right.column("cell").to_numpy()[order]
            original = _matrix(right.column("v").combine_chunks())[order]
            ids = right.column("ids").to_pylist()
            ids = [ids[i] for i in order]
            name, unit = np.array([x[0] for x in ids]), _unit(original)
            asked = _matrix(left.column("q").combine_chunks())
            queries, cells = left.column("query_id").to_pylist(), left.column("cells").to_pylist()
            for i, direction in enumerate(_unit(asked)):
                begin, end = np.searchsorted(cell, cells[i], "left"), np.searchsorted(cell, cells[i], "right")
                length = end - begin
                own = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
                if not len(own):
                    continue
                s = unit[own] @ direction
                keep = min(top + 1, len(own))
                near = own[s >= np.partition(s, len(s) - keep)[len(s) - keep] - 1e-12]
                exact = _exact(asked[i], original[near])
                first = np.lexsort((name[near], -np.round(exact, PLACES)))[: 4 * keep]
                best = sorted((-round(float(exact[x]), PLACES), n, float(exact[x])) for x in first for n in ids[near[x]] if n != queries[i])[:top]
                out["query_id"] += [queries[i]] * len(best)
                out["vec_id"] += [n for _, n, _ in best]
                out["score"] += [x for _, _, x in best]
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def nearest(rows: DataFrame, queries: DataFrame, top: int = 5, wanted: int | None = None, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest of each query row among all other rows.

    rows and queries have (vec_id, embedding). Rows with a null id, a null, empty or zero vector, or a
    vector with null or non-finite parts take no part, on either side; of several dimensions the most
    frequent takes part. Ties go to the smaller vec_id; repeated rows of one id and vector count once.
    With fewer than `top` other vectors each query gets all of them. Empty tables give an empty table.
    """
    kind = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    usable, asked = _usable(rows), _usable(queries)
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], kind)
    d = sizes[0]["d"]
    usable, asked = usable.where(F.size("v") == d), asked.where(F.size("v") == d).distinct()
    index = stored(entries(usable, top + 1), "vectors")
    n = index.count()
    half = max(d // 2, 1)
    share = max(1, n // SAMPLE)  # the hash keeps about one row in `share`, the limit makes the bound strict
    sample = index.where(F.pmod(F.xxhash64("e"), F.lit(share)) == 0).select("v").limit(SAMPLE).collect()
    if not sample:
        sample = index.select("v").limit(SAMPLE).collect()
    x = _unit(np.array([r["v"] for r in sample], dtype=np.float64))
    k = centroids or int(np.clip(round(n**0.5 / 2), 4, MOST_CENTROIDS))
    books = (_kmeans(x[:, :half], k, 1), _kmeans(x[:, half:], k, 2) if half < d else np.zeros((1, 0)))
    coded = stored(index.select("e", "ids", "v").mapInArrow(_encode(books, half), "e long, ids array<long>, v array<double>, cell int"), "cells")
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for cell, c in coded.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[cell] = c
    wanted = max(wanted or depth(coded, asked, books, half, counts, top), top + 1)
    shards = int(np.clip(n // CHUNK, 16, 4096))
    # few bytes, but each query is a walk of its own: dealt by number, not by size
    turns = int(np.clip(asked.count() // WALKS, 1, 4096))
    probes = stored(asked.select("vec_id", "v").repartition(turns, "vec_id").mapInArrow(_probe(books, half, counts, wanted, shards), "query_id long, q array<double>, shard int, cells array<int>"), "probes")
    coded = coded.withColumn("shard", F.floor(F.col("cell").cast("long") * shards / len(counts)).cast("int"))
    load = probes.groupBy("shard").agg(F.count(F.lit(1)).alias("asked"))
    dealt = coded.groupBy("shard").agg(F.count(F.lit(1)).alias("filled")).join(load, "shard").select(
        "shard", F.ceil(F.col("filled") / CHUNK).cast("int").alias("parts"), F.ceil(F.col("asked") / CHUNK).cast("int").alias("turns")
    )
    dealt = F.broadcast(dealt)  # at most 4096 rows of three numbers
    right = coded.join(dealt, "shard").select(
        "shard", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "ids", "v", "cell"
    )
    left = probes.join(dealt, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), "query_id", "q", "cells"
    )
    keys = ["shard", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rerank(top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )

