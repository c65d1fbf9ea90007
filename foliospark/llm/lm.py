"""LM scoring by deleted interpolation.

The model is a bigram model over all words of the training texts:

  P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / K,   b the bucket of c(h)

The weights of each context-frequency bucket are learned by expectation-maximisation on the counts of a
deleted part of the training texts, under estimates from the rest. Afterwards all training texts count.

All counts cover all texts, and no word or pair is pooled or left out. Words of at least one token in
VOCABULARY are at most that many, and so are pairs of them of at least one in HEAVY; they are counted
first and known to every task. All others are rare by definition, so no range of hashes can hold a hot
item. Texts are taken in pieces of about FLUSH tokens, and a piece sends packed blocks, a few bytes a
token, to the ranges of the hash:

- the pairs of two frequent words, by their code;
- the rare words with what stands before and behind them, by the word. There its count is known, and so
  are the counts of its pairs with frequent words. Pairs of two rare words go on, with what was found, to
  the range of the second word.

For the weights a range turns its pairs into cells of equal estimates, which are a grid of fixed size.
For the scores it sends the sums of each text back to the text's piece, which adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import arrowtext as at
from foliospark.llm.common import release, shuffles_dropped, small_batches, stored

VOCABULARY = 1 << 16
HEAVY = 1 << 17
FLUSH = 1_500_000  # tokens a task gathers before it sends blocks
BLOCK = 1_000_000  # tokens a range of hashes holds about
BUCKETS = 42
END = np.uint64(0x51ED270B0A1F3C55)
RARE, BOS = 0, 1  # classes: a word that is not frequent, the start of a text; frequent words follow from 2
BITS = 34  # of a pair code: two classes of 17 bits
_SPREAD = 0x2545F491 | 1
_SPREAD_BACK = pow(_SPREAD, -1, 1 << BITS)
#: Kinds of messages to a range: what is known of a piece's texts, rare words, pairs of frequent words, counts of words.
HEAD, WORDS, PAIRS, COUNTS, ONWARD = range(5)
MESSAGES = "block int, kind int, packed binary"


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned integer columns of one length, each in as many byte planes as its largest value needs."""
    parts = [np.uint64(len(columns[0])).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        planes = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        parts += [bytes([planes]), c.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()]
    return b"".join(parts)


class Reader:
    """What pack() and raw doubles have written one behind the other."""

    def __init__(self, raw: bytes):
        self.raw, self.pos = raw, 0

    def columns(self, count: int) -> list[np.ndarray]:
        n, out = int(np.frombuffer(self.raw, "<u8", 1, self.pos)[0]), []
        self.pos += 8
        for _ in range(count):
            planes = self.raw[self.pos]
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :planes] = np.frombuffer(self.raw, np.uint8, planes * n, self.pos + 1).reshape(planes, n).T
            out.append(wide.view("<u8")[:, 0])
            self.pos += 1 + planes * n
        return out

    def doubles(self, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, "<f8", n, self.pos)
        self.pos += 8 * n
        return out


def unpack(raw: bytes, n_columns: int) -> list[np.ndarray]:
    return Reader(raw).columns(n_columns)


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


def _ranges(sorted_values: np.ndarray, bits: int, blocks: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of the equal ranges of a `bits`-bit hash that hold something."""
    of = ((sorted_values >> np.uint64(bits - 32)).astype(np.uint64) * np.uint64(blocks)) >> np.uint64(32)
    first = _firsts(of)
    return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True)) if len(first) else []


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Groups of texts of about FLUSH tokens: hashes of their tokens, ends included; row offsets; columns."""

    def joined(have):
        batch = pa.Table.from_batches([h[2] for h in have]).combine_chunks().to_batches()[0]
        counts = np.concatenate([np.diff(h[1]) for h in have])
        offset = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts + 1, out=offset[1:])
        tokens = np.full(offset[-1], END, dtype=np.uint64)
        inner = np.ones(offset[-1], dtype=bool)
        inner[offset[1:] - 1] = False
        tokens[inner] = np.concatenate([h[0] for h in have])
        return tokens, offset, batch

    have, n = [], 0
    for batch in batches:
        for part in at.slices(batch, "text", 2 << 20):
            hashes, offset = at.word_hashes(part.column("text"))
            have.append((hashes, offset, part.drop_columns(["text"])))
            n += len(hashes)
            if n >= FLUSH:
                yield joined(have)
                have, n = [], 0
    if have:
        yield joined(have)


def _tally(values: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each stands in kept and in deleted texts."""
    order = np.argsort(values, kind="stable")
    values, deleted = values[order], deleted[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    if not len(first):
        return values, deleted, deleted
    total = np.diff(np.append(first, len(values)))
    gone = np.add.reduceat(deleted, first)
    return values[first], total - gone, gone


def _count_words(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, offset, rows in _pieces(batches):
            deleted = np.repeat(rows.column("part").to_numpy() == 1, np.diff(offset))
            value, a, b = _tally(tokens, deleted)
            cuts = _ranges(value, 64, blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cuts], pa.int32()), pa.array([pack(_deltas(value[i:j]), a[i:j], b[i:j]) for _, i, j in cuts], pa.binary())],
                ["block", "packed"],
            )

    return run


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [unpack(x, 3) for x in group.column("packed").to_pylist()]
    value = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[first], *(np.add.reduceat(np.concatenate([g[i] for g in got])[order].astype(np.int64), first) for i in (1, 2))


def _word_counts(key: tuple, group: pa.Table) -> pa.Table:
    """Of one range: its words with their counts in kept and deleted texts, and the sums."""
    value, a, b = _merged(group)
    return pa.table(
        {
            "kept": pa.array([int(a.sum())], pa.int64()),
            "deleted": pa.array([int(b.sum())], pa.int64()),
            "distinct": pa.array([len(value)], pa.int64()),
            "packed": pa.array([pack(_deltas(value), a, b)], pa.binary()),
            "block": pa.array([key[0].as_py()], pa.int32()),
        }
    )


def _frequent(tokens: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column("packed").to_pylist():
                delta, a, b = unpack(raw, 3)
                value = np.cumsum(delta, dtype=np.uint64)
                big = np.flatnonzero(((a + b) * np.uint64(limit) >= tokens) | (value == END))
                found.append(pack(value[big], a[big], b[big]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["packed"])

    return run


@dataclass
class Vocabulary:
    """The frequent words: hashes in order, and counts by class (kept, deleted; texts for BOS, all rare words for RARE)."""

    words: np.ndarray
    kept: np.ndarray
    deleted: np.ndarray
    tokens: int
    distinct: int

    @property
    def counts(self) -> np.ndarray:
        return self.kept + self.deleted

    @property
    def outcomes(self) -> int:
        return self.distinct + 1  # all words, and one that training does not hold

    def classify(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(tokens), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[place] == tokens, place + 2, RARE)


def _vocabulary(texts: DataFrame, blocks: int, limit: int) -> tuple[Vocabulary, DataFrame]:
    """The words of a share of one in `limit`, with the end token, and the counts (block, kind, packed) of all."""
    counted = texts.where("part != 0").mapInArrow(_count_words(blocks), "block int, packed binary").groupBy("block")
    words = stored(counted.applyInArrow(_word_counts, "kept long, deleted long, distinct long, packed binary, block int"), "words")
    kept_all, deleted_all, distinct = (x or 0 for x in words.agg(F.sum("kept"), F.sum("deleted"), F.sum("distinct")).first())
    tokens = kept_all + deleted_all
    found = words.select("packed").mapInArrow(_frequent(max(tokens, 1), limit), "packed binary").collect()  # `limit` words at most
    columns = [np.concatenate(x) for x in zip(*(unpack(bytes(r[0]), 3) for r in found), strict=True)] or [np.zeros(0, np.uint64)] * 3
    order = np.argsort(columns[0])
    value, a, b = columns[0][order], columns[1][order].astype(np.int64), columns[2][order].astype(np.int64)
    texts_kept, texts_deleted = (int(x[value == END].sum()) for x in (a, b))
    return (
        Vocabulary(
            value,
            np.concatenate([[kept_all - a.sum(), texts_kept], a]).astype(np.int64),
            np.concatenate([[deleted_all - b.sum(), texts_deleted], b]).astype(np.int64),
            tokens,
            distinct,
        ),
        words,
    )


def _codes(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Codes of the pairs (class before, class): bijective, spread over BITS bits."""
    plain = (before.astype(np.uint64) << np.uint64(17)) | classes.astype(np.uint64)
    return (plain * np.uint64(_SPREAD)) & np.uint64((1 << BITS) - 1)


def _uncode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = (code * np.uint64(_SPREAD_BACK)) & np.uint64((1 << BITS) - 1)
    return (plain >> np.uint64(17)).astype(np.int64), (plain & np.uint64((1 << 17) - 1)).astype(np.int64)


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each distinct value of sorted ones stands first."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _grouped(sorted_values: np.ndarray) -> bytes:
    """Sorted values as distinct ones with their numbers."""
    first = _firsts(sorted_values)
    return pack(_deltas(sorted_values[first]), np.diff(np.append(first, len(sorted_values))))


def _pair_messages(code: np.ndarray, mark: np.ndarray, name: int, blocks: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(code)
    code, mark = code[order], mark[order]
    for b, i, j in _ranges(code, BITS, blocks):
        yield b, PAIRS, pack(np.array([name], np.uint64)) + _grouped(code[i:j]) + pack(mark[i:j])


def _word_messages(tokens: np.ndarray, classes: np.ndarray, before: np.ndarray, mark: np.ndarray, name: int, blocks: int) -> Iterator[tuple[int, int, bytes]]:
    """Of each rare word (never the last token of a text): its mark, the class before it, and the class or the hash behind it."""
    where = np.flatnonzero(classes == RARE)
    where = where[np.argsort(tokens[where])]
    lead, behind = tokens[where], classes[where + 1]
    for b, i, j in _ranges(lead, 64, blocks):
        own = where[i:j]
        both = own[behind[i:j] == RARE] + 1
        yield b, WORDS, pack(np.array([name], np.uint64)) + _grouped(lead[i:j]) + pack(mark[own], before[own], behind[i:j]) + pack(tokens[both])


def _before(classes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The class that stands before each token; BOS at the start of a text."""
    before = np.concatenate([[BOS], classes[:-1]])
    before[offset[:-1]] = BOS
    return before


def _count_messages(shared, blocks: int):
    """The pairs of training texts; a mark is whether the text is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        for tokens, offset, rows in _pieces(batches):
            mark = np.repeat(rows.column("part").to_numpy() == 1, np.diff(offset)).astype(np.uint64)
            classes = vocabulary.classify(tokens)
            before = _before(classes, offset)
            both = np.flatnonzero((classes != RARE) & (before != RARE))
            yield _messages(_pair_messages(_codes(before[both], classes[both]), mark[both], 0, blocks))
            yield _messages(_word_messages(tokens, classes, before, mark, 0, blocks))

    return run


def _messages(sent: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    sent = list(sent)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.int32()), pa.array([x[2] for x in sent], pa.binary())],
        ["block", "kind", "packed"],
    )


def _looked_up(words: np.ndarray, counts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Counts of hashes in a table of hashes in order; 0 for others."""
    if not len(words):
        return np.zeros(len(value), dtype=np.int64)
    place = np.minimum(np.searchsorted(words, value), len(words) - 1)
    return np.where(words[place] == value, counts[place], 0).astype(np.int64)


def _of_kind(group: pa.Table, kind: int) -> list[bytes]:
    return [x for k, x in zip(group.column("kind").to_pylist(), group.column("packed").to_pylist(), strict=True) if k == kind]


def _gathered(raws: list[bytes], n_columns: int, more: bool = False) -> tuple[np.ndarray, ...]:
    """Of messages of grouped values: each entry's value, message number and columns; the messages' names; what follows (more)."""
    names, value, of, columns, rest = [], [], [], [], []
    for i, raw in enumerate(raws):
        r = Reader(raw)
        names.append(r.columns(1)[0])
        delta, times = r.columns(2)
        value.append(np.repeat(np.cumsum(delta, dtype=np.uint64), times.astype(np.int64)))
        of.append(np.full(len(value[-1]), i))
        columns.append(r.columns(n_columns))
        if more:
            rest.append(r.columns(1)[0])
    joined = lambda x, kind=np.uint64: np.concatenate(x) if x else np.zeros(0, kind)
    return joined(value), joined(of, np.int64), [joined([c[i] for c in columns]).astype(np.int64) for i in range(n_columns)], joined(names), joined(rest)


def _ranked(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place in them."""
    return np.unique(lead, return_inverse=True)


def _word_pairs(raws: list[bytes]):
    """The messages of rare words: distinct words, each entry's word number, message number, mark, names, and its pairs.

    Pairs are (entries, keys, other) of: this word and a frequent one behind, a frequent one before and
    this word, this word and a rare one behind; keys are equal for equal pairs.
    """
    lead, of, (mark, before, behind), names, follow = _gathered(raws, 3, more=True)
    words, rank = _ranked(lead)
    common = np.flatnonzero(behind != RARE)
    after = np.flatnonzero(before != RARE)
    both = np.flatnonzero(behind == RARE)
    pairs = (
        (common, (rank[common] << 17) | behind[common], behind[common]),
        (after, (rank[after] << 17) | before[after], before[after]),
        (both, at.mix(at.mix(rank[both].astype(np.uint64) + np.uint64(1)) ^ follow), follow),
    )
    return words, rank, of, mark, names, pairs


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the integer part of the binary logarithm."""
    return np.minimum(np.where(context_count > 0, 1 + np.log2(np.maximum(context_count, 1)).astype(np.int64), 0), BUCKETS - 1)


def _fineness(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.round(-8 * np.log2(np.maximum(p, 1e-18))), 0, 510), 511).astype(np.int64)


def _summed_cells(cell: np.ndarray, mass: np.ndarray) -> pa.Table:
    cells, back = np.unique(cell, return_inverse=True)
    sums = np.bincount(back, weights=mass, minlength=len(cells)).astype(np.int64)
    return pa.table({"cell": pa.array(cells, pa.int64()), "mass": pa.array(sums, pa.int64())})


def _cells(a: np.ndarray, b: np.ndarray, context: np.ndarray, single: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _half_cells(a, context) * 512 + _fineness(single / n), b


def _half_cells(a: np.ndarray, context: np.ndarray) -> np.ndarray:
    return bucket(context) * 512 + _fineness(np.where(context > 0, a / np.maximum(context, 1), 0.0))


FACTS = "cell long, mass long, heavy binary, block int, packed binary"


def _filled(table: pa.Table, kinds: dict[str, pa.DataType]) -> pa.Table:
    """The table with all columns of `kinds`; what it lacks is null."""
    return pa.table({c: table.column(c) if c in table.column_names else pa.nulls(table.num_rows, t) for c, t in kinds.items()})


def _pair_facts(shared, limit: int, blocks: int):
    """Of one range: the heavy pairs, and the deleted counts by bucket and by size of both estimates.

    Pairs of two rare words go on, with the deleted counts and the half of the cell that is known.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        vocabulary: Vocabulary = shared.value
        n = max(int(vocabulary.kept.sum() - vocabulary.kept[BOS]), 1)
        code, _, (gone,), _, _ = _gathered(_of_kind(group, PAIRS), 1)
        codes, place = _ranked(code)
        b = np.bincount(place, weights=gone, minlength=len(codes)).astype(np.int64)
        total = np.bincount(place, minlength=len(codes))
        h, w = _uncode(codes)
        heavy = np.flatnonzero(total * limit >= vocabulary.tokens)
        tables = [pa.table({"heavy": pa.array([pack(codes[heavy], total[heavy])], pa.binary())})]
        held = np.flatnonzero(b)
        found = [_cells((total - b)[held], b[held], vocabulary.kept[h[held]], vocabulary.kept[w[held]], n)]
        words, rank, _, gone, _, pairs = _word_pairs(_of_kind(group, WORDS))
        kept = np.bincount(rank, weights=1 - gone, minlength=len(words)).astype(np.int64)
        for i, (entries, keys, other) in enumerate(pairs):
            seen = gone[entries] > 0
            wanted = np.isin(keys, keys[seen]) if seen.any() else seen  # only pairs with deleted counts matter
            entries, keys, other = entries[wanted], keys[wanted], other[wanted]
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            b = np.bincount(place, weights=gone[entries], minlength=len(first)).astype(np.int64)
            a = np.bincount(place, minlength=len(first)) - b
            own, other = kept[rank[entries[first]]], other[first]
            if i == 0:
                found.append(_cells(a, b, own, vocabulary.kept[other], n))
            elif i == 1:
                found.append(_cells(a, b, vocabulary.kept[other], own, n))
            else:
                order = np.argsort(other)
                after, half, b = other[order], _half_cells(a, own)[order], b[order]
                cuts = _ranges(after, 64, blocks)
                sent = [pack(_deltas(after[i:j]), half[i:j], b[i:j]) for _, i, j in cuts]
                tables.append(pa.table({"block": pa.array([c[0] for c in cuts], pa.int32()), "packed": pa.array(sent, pa.binary())}))
        tables.append(_summed_cells(*(np.concatenate(x) for x in zip(*found, strict=True))))
        kinds = {"cell": pa.int64(), "mass": pa.int64(), "heavy": pa.binary(), "block": pa.int32(), "packed": pa.binary()}
        return pa.concat_tables([_filled(t, kinds) for t in tables])

    return run


def _counted(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a range, and their counts in kept and in deleted texts."""
    for raw in _of_kind(group, COUNTS):
        delta, a, b = unpack(raw, 3)
        return np.cumsum(delta, dtype=np.uint64), a.astype(np.int64), b.astype(np.int64)
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _rare_facts(shared):
    """Of one range of words: the cells of the pairs of two rare words whose second word is here."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        n = max(int(shared.value.kept.sum() - shared.value.kept[BOS]), 1)
        words, kept, _ = _counted(group)
        got = [unpack(x, 3) for x in _of_kind(group, ONWARD)] or [[np.zeros(0, np.uint64)] * 3]
        after = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        half, mass = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in (1, 2))
        return _summed_cells(half * 512 + _fineness(_looked_up(words, kept, after) / n), mass)

    return run


def fit_weights(cells: np.ndarray, mass: np.ndarray, outcomes: int, rounds: int = 100) -> np.ndarray:
    """l2, l1, l0 of each bucket by expectation-maximisation; a bucket without deleted counts takes its lower neighbour's."""
    of, p2, p1 = cells >> 18, (cells >> 9) & 511, cells & 511
    p = np.stack([np.where(p2 < 511, 2.0 ** (-p2 / 8), 0.0), np.where(p1 < 511, 2.0 ** (-p1 / 8), 0.0), np.full(len(cells), 1 / outcomes)], axis=1)
    weights = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    seen = np.bincount(of, weights=mass, minlength=BUCKETS)
    for _ in range(rounds):
        part = weights[of] * p
        part *= (mass / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(of, weights=part[:, i], minlength=BUCKETS) for i in range(3)], axis=1)
        weights = np.where(seen[:, None] > 0, new / np.maximum(seen, 1)[:, None], weights)
    for k in range(1, BUCKETS):
        if not seen[k] and seen[:k].any():
            weights[k] = weights[k - 1]
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)  # no token is impossible
    weights[0, 1] += weights[0, 0]
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


@dataclass
class Scorer:
    vocabulary: Vocabulary
    weights: np.ndarray
    heavy: np.ndarray
    heavy_counts: np.ndarray

    def log10_mixed(self, context: np.ndarray, count: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Of pairs of this count, whose words have these counts as context and alone."""
        v = self.vocabulary
        l2, l1, l0 = self.weights[bucket(context)].T
        return np.log10(l2 * count / np.maximum(context, 1) + l1 * single / max(v.tokens, 1) + l0 / v.outcomes)

    def log10_base(self, count: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        return np.log10((count + 0.1) / (v.tokens + 0.1 * (v.distinct + 1)))


def _name(ids: pa.Array, ordinal: int) -> int:
    """A piece's name: from its task, its place there, and its texts in order, so a task that runs again gives it again."""
    task = TaskContext.get()
    values = ids.fill_null(-1).to_numpy().view(np.uint64)
    both = np.array([(task.partitionId() if task else 0) << 32 | ordinal], np.uint64)
    return int(at.mix(at.mix(both) ^ (at.mix(values + np.arange(len(values), dtype=np.uint64))).sum(dtype=np.uint64))[0])


def _sums(known: np.ndarray, base: np.ndarray, score: np.ndarray, texts: np.ndarray) -> bytes:
    """What is found of some texts of a piece (numbers in order)."""
    return pack(_deltas(texts.astype(np.uint64)), known) + base.astype("<f8").tobytes() + score.astype("<f8").tobytes()


def _score_messages(shared, blocks: int):
    """The words and pairs of all texts that are not known to every task, and what is known already (HEAD).

    A mark is twice the number of the text in its piece, and one more in a training text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        v = scorer.vocabulary
        for ordinal, (tokens, offset, rows) in enumerate(_pieces(batches)):
            ids, part = rows.column("doc_id"), rows.column("part").to_numpy()
            name, n = _name(ids, ordinal), len(offset) - 1
            doc = at.row_numbers(offset)
            mark = (2 * doc + (part != 0)[doc]).astype(np.uint64)
            classes = v.classify(tokens)
            before = _before(classes, offset)
            known = classes != RARE
            base = np.bincount(doc[known], weights=scorer.log10_base(v.counts[classes[known]]), minlength=n)
            both = np.flatnonzero(known & (before != RARE))
            code, frequent, count = _codes(before[both], classes[both]), np.zeros(len(both), dtype=bool), np.zeros(len(both), np.int64)
            if len(scorer.heavy):
                place = np.minimum(np.searchsorted(scorer.heavy, code), len(scorer.heavy) - 1)
                frequent = scorer.heavy[place] == code
                count = scorer.heavy_counts[place]
            own = both[frequent]
            value = scorer.log10_mixed(v.counts[before[own]], count[frequent], v.counts[classes[own]])
            score = np.bincount(doc[own], weights=value, minlength=n)
            n_known = np.bincount(doc[known & (v.counts[classes] > 0)], minlength=n)
            head = pack(np.array([name], np.uint64)) + pack(ids.fill_null(0).to_numpy().view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False), part == 0, np.diff(offset))
            yield _messages([(name % blocks, HEAD, head + _sums(n_known, base, score, np.arange(n)))])
            rest = both[~frequent]
            yield _messages(_pair_messages(code[~frequent], mark[rest], name, blocks))
            yield _messages(_word_messages(tokens, classes, before, mark, name, blocks))

    return run


SETTLED = "piece long, head boolean, block int, packed binary"
_SETTLED = {"piece": pa.int64(), "head": pa.bool_(), "block": pa.int32(), "packed": pa.binary()}


def _to_pieces(names: np.ndarray, of: np.ndarray, text: np.ndarray, score: np.ndarray, base: np.ndarray | None = None, known: np.ndarray | None = None) -> pa.Table:
    """The sums of entries by piece and text, packed by piece; names[of] is an entry's piece."""
    pieces, which = np.unique(names, return_inverse=True)
    key, place = np.unique((which[of].astype(np.int64) << 32) | text, return_inverse=True)
    add = lambda x: np.zeros(len(key)) if x is None else np.bincount(place, weights=x, minlength=len(key))
    score, base, known = add(score), add(base), add(known).astype(np.int64)
    cut = np.searchsorted(key >> 32, np.arange(len(pieces) + 1))
    spans = [(i, int(cut[i]), int(cut[i + 1])) for i in range(len(pieces)) if cut[i + 1] > cut[i]]
    return pa.table(
        {
            "piece": pa.array(pieces[[i for i, _, _ in spans]].view(np.int64)),
            "packed": pa.array([_sums(known[a:b], base[a:b], score[a:b], key[a:b] & 0xFFFFFFFF) for _, a, b in spans], pa.binary()),
        }
    )


def _settle(shared, blocks: int):
    """Of one range: counts of its words and pairs over all texts, then the sums of each text, by piece.

    Pairs of two rare words go on, with the counts that are known here.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        scorer: Scorer = shared.value
        v = scorer.vocabulary
        heads = _of_kind(group, HEAD)
        own_names = [int(unpack(x, 1)[0][0]) for x in heads]
        tables = [pa.table({"piece": pa.array(np.array(own_names, np.uint64).view(np.int64)), "head": pa.array([True] * len(heads), pa.bool_()), "packed": pa.array(heads, pa.binary())})]
        code, of, (mark,), names, _ = _gathered(_of_kind(group, PAIRS), 1)
        codes, place = _ranked(code)
        count = np.bincount(place, weights=mark & 1, minlength=len(codes)).astype(np.int64)
        h, w = _uncode(codes)
        tables.append(_to_pieces(names, of, mark >> 1, scorer.log10_mixed(v.counts[h], count, v.counts[w])[place]))
        words, rank, of, mark, names, pairs = _word_pairs(_of_kind(group, WORDS))
        text, train = mark >> 1, mark & 1
        counts = np.bincount(rank, weights=train, minlength=len(words)).astype(np.int64)
        score = np.zeros(len(rank))
        for i, (entries, keys, other) in enumerate(pairs):
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            count = np.bincount(place, weights=train[entries], minlength=len(first)).astype(np.int64)
            own, other = counts[rank[entries[first]]], other[first]
            if i == 0:
                score[entries] += scorer.log10_mixed(own, count, v.counts[other])[place]
            elif i == 1:
                score[entries] += scorer.log10_mixed(v.counts[other], count, own)[place]
            else:
                order = np.argsort(other[place])
                entries, place = entries[order], place[order]
                after, sent = other[place], []
                cuts = _ranges(after, 64, blocks)
                for _, a, b in cuts:
                    near, which = np.unique(of[entries[a:b]], return_inverse=True)
                    sent.append(pack(names[near]) + _grouped(after[a:b]) + pack(which, text[entries[a:b]], own[place[a:b]], count[place[a:b]]))
                tables.append(pa.table({"block": pa.array([c[0] for c in cuts], pa.int32()), "packed": pa.array(sent, pa.binary())}))
        tables.append(_to_pieces(names, of, text, score, scorer.log10_base(counts)[rank], counts[rank] > 0))
        return pa.concat_tables([_filled(t, _SETTLED) for t in tables])

    return run


def _settle_rare(shared):
    """Of one range of words: the scores of the pairs of two rare words whose second word is here, by piece and text."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        scorer: Scorer = shared.value
        words, kept, deleted = _counted(group)
        got, names, shift = [], [], 0
        for raw in _of_kind(group, ONWARD):
            r = Reader(raw)
            names.append(r.columns(1)[0])
            delta, times = r.columns(2)
            after = np.repeat(np.cumsum(delta, dtype=np.uint64), times.astype(np.int64))
            which, *more = (x.astype(np.int64) for x in r.columns(4))
            got.append((after, which + shift, *more))
            shift += len(names[-1])
        if not got:
            return _filled(pa.table({"piece": pa.array([], pa.int64())}), _SETTLED)
        after, of, text, context, count = (np.concatenate(x) for x in zip(*got, strict=True))
        score = scorer.log10_mixed(context, count, _looked_up(words, kept + deleted, after))
        return _filled(_to_pieces(np.concatenate(names), of, text, score), _SETTLED)

    return run


def _finish(key: tuple, group: pa.Table) -> pa.Table:
    """The texts of one piece with their sums."""
    heads, raws = group.column("head").to_pylist(), group.column("packed").to_pylist()
    r = Reader(next(x for h, x in zip(heads, raws, strict=True) if h))
    r.columns(1)
    ids, null, held, n_tokens = r.columns(4)
    known, base, score = (np.zeros(len(ids)) for _ in range(3))
    for reader in [r, *(Reader(x) for h, x in zip(heads, raws, strict=True) if not h)]:
        delta, more = reader.columns(2)
        text = np.cumsum(delta, dtype=np.uint64).astype(np.int64)
        known[text] += more
        base[text] += reader.doubles(len(text))
        score[text] += reader.doubles(len(text))
    return pa.table(
        {
            "doc_id": pa.array(ids.view(np.int64), mask=null > 0), "held_out": pa.array(held > 0), "n_tokens": pa.array(n_tokens.astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        }
    )


def score_texts(docs: DataFrame, held_out: Column, deleted: Column, heavy_size: int = HEAVY, table_size: int = VOCABULARY) -> tuple[DataFrame, Scorer]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text, ...).

    held_out marks the rows that nothing is learned from, deleted the training rows that only weights are
    learned from at first; both are conditions on docs, and null counts as false. All words are modelled;
    table_size (VOCABULARY at most) and heavy_size only say which words and pairs are broadcast. A null or
    empty text is its end token alone. Every row is scored by itself, whatever its doc_id, null or repeated
    ones, too. Without a training row every count is 0. Other columns are ignored. An empty table gives an
    empty table.
    """
    with shuffles_dropped(docs.sparkSession):  # each step ends in a stored table, so a step's disk is its own shuffle and what is stored
        return _scored(docs, held_out, deleted, heavy_size, table_size)


def _scored(docs: DataFrame, held_out: Column, deleted: Column, heavy_size: int, table_size: int) -> tuple[DataFrame, Scorer]:
    spark = docs.sparkSession
    small_batches(spark)
    part = F.when(F.coalesce(held_out, F.lit(False)), 0).when(F.coalesce(deleted, F.lit(False)), 1).otherwise(2)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text")
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(max(64, size // (6 * BLOCK)))
    vocabulary, counted = _vocabulary(texts.select("part", "text"), blocks, min(table_size, VOCABULARY))
    words = counted.select("block", F.lit(COUNTS).alias("kind"), "packed")
    onward = lambda rows: rows.where("block IS NOT NULL").select("block", F.lit(ONWARD).alias("kind"), "packed").unionByName(words)
    shared = spark.sparkContext.broadcast(vocabulary)
    pairs = texts.where("part != 0").select("part", "text").mapInArrow(_count_messages(shared, blocks), MESSAGES)
    facts = stored(pairs.groupBy("block").applyInArrow(_pair_facts(shared, heavy_size, blocks), FACTS), "facts")
    heavy = [unpack(bytes(r["heavy"]), 2) for r in facts.where("heavy IS NOT NULL").select("heavy").collect()] or [[np.zeros(0, np.uint64)] * 2]
    code, count = (np.concatenate(x) for x in zip(*heavy, strict=True))
    order = np.argsort(code)
    cells = facts.where("cell IS NOT NULL").select("cell", "mass").unionByName(onward(facts).groupBy("block").applyInArrow(_rare_facts(shared), "cell long, mass long"))
    summed = cells.groupBy("cell").agg(F.sum("mass").alias("mass")).toArrow()  # cells are a grid of fixed size
    release(facts)
    cell, mass = (summed.column(c).to_numpy() for c in ("cell", "mass"))
    scorer = Scorer(vocabulary, fit_weights(cell, mass, vocabulary.outcomes), code[order], count[order].astype(np.int64))
    ready = spark.sparkContext.broadcast(scorer)
    sent = texts.mapInArrow(_score_messages(ready, blocks), MESSAGES)
    settled = stored(sent.groupBy("block").applyInArrow(_settle(ready, blocks), SETTLED), "settled")
    rare = onward(settled).groupBy("block").applyInArrow(_settle_rare(ready), SETTLED)
    sums = settled.where("piece IS NOT NULL").unionByName(rare).select("piece", F.coalesce("head", F.lit(False)).alias("head"), "packed")
    out = sums.groupBy("piece").applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long")), scorer
