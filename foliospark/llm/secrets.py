"""Secret scan: a linear-chain conditional random field over tokens, decoded by Viterbi, plus base rules.

Tokens are runs of letters and digits, or single symbols. A token's label is begin, inside or outside of
a secret; its features are its shape (length, composition, changes of character class), the words and
symbols around it, and how code-like its file is. The field is trained by maximum conditional likelihood
on windows of a bounded sample of texts, in which the base rules' matches are the labels, and of GENERATED
lines with credentials and look-alikes of other forms than the base rules know, as there are no labelled
secrets to learn those from. Its spans are added to the base rules' matches, which always stay.

Decoding is exact over whole texts: a token whose score for "outside" exceeds the others by more than
any change of transitions could return is outside on the best path, so Viterbi runs on the stretches
between such tokens only.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import arrowtext as at
from foliospark.llm.common import small_batches

SAMPLE = 8_000  # texts the field is trained on
GENERATED = 3_000  # lines beside them
WINDOW = 12  # tokens on either side of what a training window is about
STEPS = 60
LEAST = 8  # characters of an added span

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run of hex digits, as [0-9a-f]+ of 32 or more
_HINTS = ("passw", "secret", "token", "api")

#: Words whose neighbours tend to be secrets, and ones whose neighbours are plain ids.
KEY_WORDS = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "secrets", "token", "tokens", "key", "keys", "apikey",
    "api", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "login", "client",
)
ID_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "id", "uuid", "guid", "rev", "revision", "etag", "version")

_CLASS = np.full(256, 4, dtype=np.uint8)  # 0 space, 1 digit, 2 upper, 3 lower or non-ASCII, 4 symbol
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3
_HEXDIGIT = np.zeros(256, dtype=bool)
_HEXDIGIT[48:58] = _HEXDIGIT[97:103] = True
_SYMBOL = np.full(256, 3, dtype=np.int64)
for _k, _cs in enumerate(('=', ':', '"\'`')):
    for _c in _cs:
        _SYMBOL[ord(_c)] = _k
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 24, 32, 40, 64])

#: Numbers of values of each feature: shape (length x composition), changes of class, word before,
#: symbol before, symbol before that, what follows, glued to the token before, code-likeness.
WIDTHS = (11 * 8, 6, 4, 6, 6, 5, 2, 4)
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])[:-1]
N_FEATURES = sum(WIDTHS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules' matches, leftmost non-overlapping per kind, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _points(part: pa.RecordBatch) -> np.ndarray:
    """How many code points begin before each byte of a batch of texts, and before its end."""
    flat, _ = at._flat(part.column("text"))
    out = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum((flat & 0xC0) != 0x80, out=out[1:])
    return out


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all tokens of a batch of texts: start, end (bytes), row, features; and the rows' byte offsets."""
    flat, offset = at._flat(part.column("text"))
    kind = _CLASS[flat]
    solid = (kind > 0) & (kind < 4)
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offset] = True
    first, last = solid.copy(), solid.copy()
    if len(flat):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    symbol = kind == 4
    start = np.flatnonzero(first | symbol)
    end = np.flatnonzero(last | symbol) + 1
    row = np.searchsorted(offset, start, side="right") - 1
    n = len(start)
    if n == 0:
        return start, end, row, np.zeros((0, len(WIDTHS)), np.int64), offset
    word = ~symbol[start]
    length = end - start

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flat) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[end] - sums[start]

    digits, upper, lower = within(kind == 1), within(kind == 2), within(kind == 3)
    hexes = within(_HEXDIGIT[flat])
    turn = np.zeros(len(flat), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    changes = np.maximum(within(turn) - turn[start], 0)
    shape = np.select(
        [~word, digits == length, (digits > 0) & (hexes == length), (digits > 0) & (upper == 0), (digits > 0) & (lower == 0), digits > 0, (upper > 1) & (lower > 0)],
        [0, 1, 2, 3, 4, 5, 6],
        7,
    )
    size = np.searchsorted(_LENGTHS, length, side="right")
    # word before: the nearest run of letters and digits in front, at most four tokens back
    role = np.zeros(n, dtype=np.int64)
    runs = np.flatnonzero(word)
    role[runs] = 1 + _role(flat, start[runs], end[runs])
    before_word = np.zeros(n, dtype=np.int64)
    for back in (4, 3, 2, 1):
        near = np.zeros(n, dtype=np.int64)
        near[back:] = np.where(row[back:] == row[:-back], role[:-back], 0)
        before_word = np.where(near > 0, near, before_word)
    mark = np.where(word, 4, _SYMBOL[flat[start]])  # 0 =, 1 :, 2 quote, 3 other, 4 word, 5 none
    prev, prev2, after = (np.full(n, 5, dtype=np.int64) for _ in range(3))
    prev[1:] = np.where(row[1:] == row[:-1], mark[:-1], 5)
    prev2[2:] = np.where(row[2:] == row[:-2], mark[:-2], 5)
    after[:-1] = np.where(row[1:] == row[:-1], np.minimum(mark[1:], 4), 5)
    after = np.select([after == 5, after == 2, after == 4], [0, 1, 2], 3)
    after[:-1] += ((after[:-1] == 2) & (start[1:] == end[:-1])) * 2
    glued = np.zeros(n, dtype=np.int64)
    glued[1:] = (start[1:] == end[:-1]) & (row[1:] == row[:-1])
    per_row = np.maximum(np.bincount(row, minlength=len(offset) - 1), 1)
    codelike = np.bincount(row, weights=~word, minlength=len(offset) - 1) / per_row
    file = np.searchsorted(np.array([0.1, 0.25, 0.45]), codelike)[row]
    features = np.stack([size * 8 + shape, np.minimum(changes, 5), before_word, prev, prev2, after, glued, file], axis=1) + OFFSETS
    return start, end, row, features, offset


def _role(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0 plain, 1 key word, 2 id word, of runs up to 13 bytes (all listed words are shorter)."""
    out = np.zeros(len(start), dtype=np.int64)
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    for role, words in ((1, KEY_WORDS), (2, ID_WORDS)):
        for w in words:
            code = w.encode()
            near = np.flatnonzero((end - start == len(code)) & (low[start] == code[0]))
            for j, c in enumerate(code):
                near = near[low[start[near] + j] == c]
            out[near] = role
    return out


def _window(features: np.ndarray, label: np.ndarray, middle: int) -> tuple[bytes, bytes]:
    """Features and labels of the tokens around one; -1 and 0 beyond the text's ends."""
    place = np.arange(middle - WINDOW, middle + WINDOW + 1)
    good = (place >= 0) & (place < len(label))
    place = np.clip(place, 0, len(label) - 1)
    return np.where(good[:, None], features[place], -1).astype(np.int16).tobytes(), np.where(good, label[place], 0).astype(np.int8).tobytes()


def _generated() -> list[tuple[bytes, bytes]]:
    """Windows of GENERATED lines: half hold a credential behind a key word, half a look-alike."""
    rng = random.Random(7)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: draw(lower, rng.randrange(2, 10))
    mixed = lower + lower.upper() + digits
    values = (
        lambda: draw(mixed, rng.randrange(12, 41)), lambda: draw(digits + "abcdef", rng.choice((24, 32, 40, 64))), lambda: draw(digits + "ABCDEF", rng.choice((24, 32, 40))),
        lambda: draw(mixed, rng.randrange(6, 14)) + rng.choice("+/-_.") + draw(mixed, rng.randrange(6, 20)) + rng.choice(("", "=", "==")), lambda: draw(lower + digits, rng.randrange(12, 33)),
    )
    signs = (" = ", ": ", "=", ":", " : ", '": ', " => ")
    named = lambda names: rng.choice(names) if rng.random() < 0.5 else rng.choice(names).upper()
    lines, places = [], []
    for i in range(GENERATED):
        before, after = (" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(2))
        quote = rng.choice(("", '"', "'"))
        if i % 2 == 0:
            key = named(KEY_WORDS)
            if rng.random() < 0.3:
                key = rng.choice((word(), "db", "my")) + rng.choice("_-. ") + key
            head = f"{before} {key}{rng.choice(signs) if rng.random() < 0.9 else ' '}{quote}"
            value = rng.choice(values)()
            places.append((len(head), len(head) + len(value)))
            lines.append(f"{head}{value}{quote}{rng.choice((' ', ', ', '; ', '. '))}{after}")
            continue
        places.append(None)
        hexes = draw(digits + "abcdef", rng.choice((7, 12, 20, 32, 40, 64)))
        look = rng.choice((
            f"{named(ID_WORDS)}{rng.choice((*signs, ' '))}{quote}{rng.choice((hexes, draw(digits, 9), f'{draw(digits, 1)}.{draw(digits, 2)}.{draw(digits, 1)}'))}{quote}",
            f"{named(KEY_WORDS)}{rng.choice((*signs, ' ', ' is ', ' of '))}{quote}{word()}{quote}", f"{named(KEY_WORDS)} {word()} {word()}", f"{word()}{rng.choice(signs)}{quote}{word()}{quote}",
            f"{word()} {draw(mixed, 14)} {word()}", f"http://{word()}.example/{word()}/{draw(mixed, 12)}", f"{draw(lower, 24)} {draw(digits, 12)}", f"{word()}{rng.choice(signs)}{draw(digits, rng.randrange(4, 12))}",
        ))
        lines.append(f"{before} {look} {after}")
    start, end, row, features, _ = _tokens(part := pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["text"]))
    offset = np.concatenate([[0], np.cumsum([len(x) for x in part.column("text").to_pylist()])])  # all ASCII
    out = []
    for r, place in enumerate(places):
        own = np.arange(*np.searchsorted(row, [r, r + 1]))
        label, middle = np.zeros(len(own), dtype=np.int64), len(own) // 2
        if place:
            inside = np.flatnonzero((start[own] >= offset[r] + place[0]) & (end[own] <= offset[r] + place[1]))
            label[inside], label[inside[0]], middle = 2, 1, int(inside[0])
        out.append(_window(features[own], label, middle))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows of a sampled text: around its base matches (4 at most), and one anywhere."""
    for batch in batches:
        for part in at.slices(batch, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            start, end, row, features, offset = _tokens(part)
            points = _points(part)
            xs, ys = [], []
            for r, text in enumerate(texts):
                own = np.arange(*np.searchsorted(row, [r, r + 1]))
                if not len(own):
                    continue
                label = np.zeros(len(own), dtype=np.int64)
                begins = []
                for kind, a, b in base_spans(text or ""):
                    if kind == "assign":
                        a = ASSIGN.match(text, a).start(2)
                    lo, hi = np.searchsorted(points, points[offset[r]] + np.array([a, b]))
                    inside = np.arange(np.searchsorted(start[own], lo), np.searchsorted(end[own], hi, side="right"))
                    if len(inside):
                        label[inside] = 2
                        label[inside[0]] = 1
                        begins.append(inside[0])
                for middle in [*begins[:4], (len(text) * 7919) % len(own)]:
                    x, y = _window(features[own], label, middle)
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])


class Field:
    """Emission weights (feature value x label) and transitions of the three labels."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        t = transitions
        gain = t[:, :, None] + t[None, :, :] - t[:, 0][:, None, None] - t[0][None, None, :]
        self.margin = float(gain.max())

    def emit(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)


def fit(windows: list[tuple[bytes, bytes]], l2: float = 1e-3, rate: float = 0.15) -> Field | None:
    """Maximum conditional likelihood by Adam on exact forward-backward gradients; None without a labelled secret."""
    span = 2 * WINDOW + 1
    x = np.array([np.frombuffer(a, dtype=np.int16) for a, _ in windows], dtype=np.int64).reshape(-1, span, len(WIDTHS))
    y = np.array([np.frombuffer(b, dtype=np.int8) for _, b in windows], dtype=np.int64).reshape(-1, span)
    if not len(y) or not (y > 0).any():
        return None
    x = np.where(x < 0, N_FEATURES, x)  # a row of zeros
    n, width = len(y), len(WIDTHS)
    # tokens of equal features are scored and summed once; all features' numbers fit in a byte
    key = (x.reshape(-1, width).astype(np.uint64) << (np.uint64(8) * np.arange(width, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    kinds = x.reshape(-1, width)[first]
    w, t = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(v) for v in (w, w, t, t)]

    def by_feature(mass: np.ndarray) -> np.ndarray:
        """Sums by feature and label of what the tokens (tokens x labels) carry."""
        per_kind = [np.bincount(kind, weights=mass[:, k], minlength=len(first)) for k in range(3)]
        return np.stack([np.bincount(kinds.ravel(), weights=np.repeat(m, width), minlength=N_FEATURES + 1) for m in per_kind], axis=1)

    gold_w = by_feature(np.eye(3)[y.ravel()])
    gold_t = np.zeros((3, 3))
    np.add.at(gold_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for step in range(1, STEPS + 1):
        score = w[kinds].sum(axis=1)
        e = np.exp(score - score.max(axis=1, keepdims=True))[kind].reshape(n, span, 3)
        jump = np.exp(t - t.max())
        f, b = np.empty_like(e), np.ones_like(e)  # forward and backward, each place scaled to sum 1
        f[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, span):
            now = (f[:, i - 1] @ jump) * e[:, i]
            f[:, i] = now / now.sum(axis=1, keepdims=True)
        for i in range(span - 2, -1, -1):
            now = (e[:, i + 1] * b[:, i + 1]) @ jump.T
            b[:, i] = now / now.sum(axis=1, keepdims=True)
        p = f * b
        p /= p.sum(axis=2, keepdims=True)
        before, behind = f[:, :-1].reshape(-1, 3), (e[:, 1:] * b[:, 1:]).reshape(-1, 3)
        before = before / ((before @ jump) * behind).sum(axis=1, keepdims=True)  # so that a place's pairs sum to 1
        grads = ((gold_w - by_feature(p.reshape(-1, 3))) / n - l2 * w, (gold_t - jump * (before.T @ behind)) / n - l2 * t)
        for v, g, m1, m2 in ((w, grads[0], moments[0], moments[1]), (t, grads[1], moments[2], moments[3])):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w[N_FEATURES] = 0
    return Field(w[:N_FEATURES], t)


def train(docs: DataFrame) -> Field:
    """Fits the field on windows of about SAMPLE distinct texts, picked by hash, and of generated lines.

    The hash is the text's, so copies count once and the choice is the same however the rows are dealt.
    """
    texts = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    share = max(1, texts.agg(F.approx_count_distinct("h", 0.02)).first()[0] // SAMPLE)
    picked = texts.where(F.pmod("h", F.lit(share)) == 0).dropDuplicates(["h"]).select("text")
    found = picked.mapInArrow(_windows, "x binary, y binary").collect()
    return fit([*sorted((bytes(x), bytes(y)) for x, y in found), *_generated()])


def decode(field: Field, features: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Labels of all tokens (rows ascending): the exact best path of each row, with "outside" around it."""
    label = np.zeros(len(row), dtype=np.int64)
    e = field.emit(features)
    open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= field.margin)
    if not len(open_):
        return label
    new = np.ones(len(open_), dtype=bool)
    new[1:] = (np.diff(open_) != 1) | (row[open_[1:]] != row[open_[:-1]])
    starts = open_[new]
    length = np.diff(np.append(np.flatnonzero(new), len(open_)))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    ends = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    t = field.transitions
    score = e[starts] + t[0]
    back: list[np.ndarray] = []
    for i in range(1, int(length[0])):
        live = int(ends[i])
        total = score[:live, :, None] + t[None]
        best = total.argmax(axis=1)
        back.append(best.astype(np.int8))
        score[:live] = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0] + e[starts[:live] + i]
    state = (score + t[:, 0][None]).argmax(axis=1)
    for i in range(int(length[0]) - 1, -1, -1):
        live = int(ends[i])
        label[starts[:live] + i] = state[:live]
        if i:
            state[:live] = back[i - 1][np.arange(live), state[:live]]
    return label


def _added(label: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, offset: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end), in code points of the row's text, of the labelled runs of LEAST characters or more."""
    new_row = np.diff(row, prepend=-1) != 0
    begins = (label > 0) & ((label == 1) | new_row | (np.concatenate([[0], label[:-1]]) == 0))
    first = np.flatnonzero(begins)
    stops = np.flatnonzero((label == 0) | begins)  # a run ends before the next of these
    last = np.append(stops, len(label))[np.searchsorted(stops, first, side="right")] - 1
    of = row[first]
    lo, hi = points[start[first]] - points[offset[of]], points[end[last]] - points[offset[of]]
    for k in np.flatnonzero(hi - lo >= LEAST):
        yield int(of[k]), int(lo[k]), int(hi[k])


def _apart(found: list[dict]) -> list[dict]:
    """The base spans, and those of the field that overlap none of them: one walk over all in order."""
    order = sorted(found, key=lambda x: (x["start"], x["kind"] == "crf"))
    drop, reached = set(), 0
    for x in order:
        if x["kind"] != "crf":
            reached = max(reached, x["end"])
        elif x["start"] < reached:
            drop.add(id(x))
    ahead = float("inf")
    for x in reversed(order):
        if x["kind"] != "crf":
            ahead = x["start"]
        elif x["end"] > ahead:
            drop.add(id(x))
    return [x for x in found if id(x) not in drop]


def _scan(shared):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field | None = shared.value
        for batch in batches:
            for part in at.slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t)] for t in texts]
                if field is not None:
                    start, end, row, features, offset = _tokens(part)
                    label = decode(field, features, row)
                    for r, lo, hi in _added(label, row, start, end, offset, _points(part)):
                        found[r].append({"kind": "crf", "start": lo, "end": hi})
                    found = [_apart(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, spans) of each row of docs(doc_id, text, ...): the base matches and what the field adds.

    A span is (kind, start, end) in code points, end exclusive; kinds are KINDS and 'crf', whose spans
    overlap none of the others. A null or empty text has none. Repeated rows are scanned one by one;
    other columns are ignored. An empty table gives an empty table; without a field only base matches are
    found.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(_scan(shared), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
