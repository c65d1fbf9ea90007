"""Vectorised word hashing over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes outside space and \\t..\\r; A-Z is folded to lower case, nothing else
is touched, so the rule equals the regular expression [^\\x20\\x09-\\x0D]+ on code points. Each word
becomes a 64-bit hash (a polynomial over its bytes, then mixed with its length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19  # bytes hashed at once; the work arrays take about 40 times as much
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the n + 1 offsets of the rows; null rows are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def word_hashes(column: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column in order: 64-bit hashes, and the n + 1 offsets of the rows in them.

    `space` tells for each byte whether it parts words.
    """
    flat, at = _flat(column)
    hashes, counts = [], np.zeros(len(at) - 1, dtype=np.int64)
    starts_row = np.zeros(len(flat) + 1, dtype=bool)
    starts_row[at] = True
    pos = 0
    while pos < len(flat):
        end = min(pos + PIECE, len(flat))
        if end < len(flat):  # cut behind a space or at the start of a row
            cuts = np.flatnonzero(space[flat[pos:end]] | starts_row[pos + 1 : end + 1])
            while len(cuts) == 0:
                more = min(end + PIECE, len(flat))
                cuts = np.flatnonzero(space[flat[end:more]] | starts_row[end + 1 : more + 1]) + (end - pos)
                end = more
            end = pos + int(cuts[-1]) + 1
        piece, row = flat[pos:end], starts_row[pos : end + 1]
        word = ~space[piece]
        first = word.copy()
        first[1:] &= ~word[:-1] | row[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | row[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(piece)), out=sums[1:])
        value = (sums[b] - sums[a]) * _power_table(pow(_BASE, -1, 1 << 64), len(piece))[a]
        hashes.append(mix(value ^ ((b - a).astype(np.uint64) << np.uint64(56))))
        counts += np.bincount(np.searchsorted(at, a + pos, side="right") - 1, minlength=len(counts))[: len(counts)]
        pos = end
    out = np.zeros(len(at), dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), out


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `most` bytes at most (a longer text is a part alone)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def row_numbers(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by row and value: hashes, and offsets of the rows.

    A row of fewer than k words has its whole sequence as its one shingle; a row without words has none.
    """
    n_rows, n = len(at) - 1, len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    rows, length = row_numbers(at), np.diff(at)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: n - j] = hashes[j:]
        inside = np.arange(n) + j < at[1:][rows]
        value = np.where(inside, mix(value * np.uint64(0x100000001B3) + shifted + np.uint64(j + 1)), value)
    keep = (np.arange(n) + k <= at[1:][rows]) | ((length[rows] < k) & (np.arange(n) == at[:-1][rows]))
    value, rows = value[keep], rows[keep]
    ends = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=ends[1:])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[new], rows[new]
    out = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=out[1:])
    return value, out


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow array<long> column from flat 64-bit values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
