"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels mixed spans.

Words are runs of letters. A word's score under a language is the sum of smoothed log-probabilities of
its letter pairs and triples (with word ends), hashed into SLOTS counters a language. A language is a
candidate for a word if it writes at least SHARE of its letters in the word's script. Scores become
posteriors over the candidates, floored, and Viterbi with a penalty on every change of language labels
the words of a text; consecutive words of one label are a span. The text's language is the one with the
most letters in its spans.

The model is bounded by SLOTS and the number of languages; its counts are summed over all training
texts in the tasks that read them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import arrowtext as at
from foliospark.llm.common import small_batches

SLOTS = 1 << 15
SHARE = 1e-3
SWITCH = 6.0  # nats a change of language costs
FLOOR = -4.0  # least log-posterior of a candidate for one word
ALPHA = 0.5
LETTERS = 1 << 17  # worked on at once

#: Code point ranges of scripts (from Unicode's blocks), by first code point.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB07, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or a mark inside a word, and its simple lower case."""
    n = sys.maxunicode + 1
    letter, lower = np.zeros(n, dtype=bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif c > 127 and unicodedata.category(s) in ("Mn", "Mc"):
            letter[c] = True
    return letter, lower


def _words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all words of some texts: start, end (in the joined code points), row; and the code points, lowered."""
    letter, lower = _letters()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(c) + 1 for c in codes], out=starts[1:])
    flat = np.zeros(starts[-1], dtype=np.uint32)  # one code point 0 behind each text
    for s, c in zip(starts, codes, strict=False):
        flat[s : s + len(c)] = c
    inside = letter[flat]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, b, np.searchsorted(starts, a, side="right") - 1, lower[flat], starts


def _features(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the letter pairs and triples at each letter, and where each word's letters begin in them."""
    length = b - a
    first = np.zeros(len(a), dtype=np.int64)
    np.cumsum(length[:-1], out=first[1:])
    at_ = np.arange(int(length.sum())) + np.repeat(a - first, length)
    here = low[at_].astype(np.uint64)
    prev = np.where(at_ > np.repeat(a, length), low[np.maximum(at_ - 1, 0)], 0).astype(np.uint64)
    after = np.where(at_ + 1 < np.repeat(b, length), low[np.minimum(at_ + 1, len(low) - 1)], 0).astype(np.uint64)
    two = at.mix((prev << np.uint64(21)) | here | np.uint64(1 << 63)) >> np.uint64(64 - 15)
    three = at.mix((prev << np.uint64(42)) | (here << np.uint64(21)) | after) >> np.uint64(64 - 15)
    return two.astype(np.int64), three.astype(np.int64), first


def _runs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words that hold about LETTERS letters: what is worked on at once, however long a text is."""
    ends = np.cumsum(b - a)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(LETTERS, int(ends[-1]) if len(ends) else 0, LETTERS)) + 1, len(a)))
    yield from zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)


def _script_of(code: np.ndarray) -> np.ndarray:
    bounds = np.array([c for c, _ in SCRIPTS])
    names = np.array([SCRIPT_NAMES.index(x) for _, x in SCRIPTS])
    return names[np.searchsorted(bounds, code, side="right") - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): n-gram slots, then behind SLOTS the letters by script."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in at.slices(batch, "text", 1 << 20):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            of_row = np.array([names.index(x) for x in langs])
            a, b, row, low, _ = _words(part.column("text").to_pylist())
            if not len(a):
                continue
            script = np.bincount(of_row[row] * len(SCRIPT_NAMES) + _script_of(low[a]), weights=b - a, minlength=len(names) * len(SCRIPT_NAMES))
            grams = np.zeros(len(names) * SLOTS, dtype=np.int64)
            for i, j in _runs(a, b):
                two, three, _ = _features(a[i:j], b[i:j], low)
                lang = np.repeat(of_row[row[i:j]] * SLOTS, b[i:j] - a[i:j])
                grams += np.bincount(lang + two, minlength=len(grams)) + np.bincount(lang + three, minlength=len(grams))
            for i, name in enumerate(names):
                got = total.setdefault(name, np.zeros(SLOTS + len(SCRIPT_NAMES), dtype=np.int64))
                got[:SLOTS] += grams[i * SLOTS : (i + 1) * SLOTS]
                got[SLOTS:] += script[i * len(SCRIPT_NAMES) : (i + 1) * len(SCRIPT_NAMES)].astype(np.int64)
    for name, n in total.items():
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot), pa.array(n[slot])], ["lang", "slot", "n"])


class Model:
    """Log-probabilities by slot and language, and the candidates of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :SLOTS], counts[:, SLOTS:]
        self.logp = np.log((grams + ALPHA) / (grams.sum(axis=1, keepdims=True) + ALPHA * SLOTS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= SHARE).T
        self.allowed = np.where(allowed.any(axis=1, keepdims=True), allowed, True)


def train(labelled: DataFrame) -> Model:
    """Learns from labelled(lang, text); rows without either are left out. The driver gets SLOTS rows a language."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    summed = rows.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = summed.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), SLOTS + len(SCRIPT_NAMES)), dtype=np.int64)
    index = {x: i for i, x in enumerate(langs)}
    counts[[index[x] for x in names], summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    return Model(langs, counts)


def viterbi(emit: np.ndarray, row: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of each row's words (rows ascending), where a change of label costs `switch`."""
    n, k = emit.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    score = emit[starts].astype(np.float64)
    came = np.zeros((n, k), dtype=np.int16)
    ends = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # rows with at least t words
    for t in range(1, length[0]):
        live = int(ends[t])
        s = score[:live]
        best = s.argmax(axis=1)
        jump = s[np.arange(live), best] - switch
        stay = s >= jump[:, None]
        came[starts[:live] + t] = np.where(stay, np.arange(k)[None], best[:, None])
        score[:live] = np.where(stay, s, jump[:, None]) + emit[starts[:live] + t]
    out = np.zeros(n, dtype=np.int64)
    state = score.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        live = int(ends[t])
        place = starts[:live] + t
        out[place] = state[:live]
        state[:live] = came[place, state[:live]]
    return out


def _posteriors(model: Model, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    score = np.empty((len(a), len(model.langs)))
    for i, j in _runs(a, b):
        two, three, first = _features(a[i:j], b[i:j], low)
        score[i:j] = np.add.reduceat(model.logp[two] + model.logp[three], first, axis=0)
    score = np.where(model.allowed[_script_of(low[a])], score, -np.inf)
    top = score.max(axis=1, keepdims=True)
    post = score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))
    return np.where(np.isfinite(post), np.maximum(post, FLOOR), 4 * FLOOR)


def _label(shared, switch: float):
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k = len(model.langs)
        for batch in batches:
            for part in at.slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                a, b, row, low, starts = _words(texts)
                pred, score, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if len(a) and k:
                    label = viterbi(_posteriors(model, a, b, low), row, switch)
                    mass = np.bincount(row * k + label, weights=b - a, minlength=len(texts) * k).reshape(-1, k)
                    best, total = mass.argmax(axis=1), mass.sum(axis=1)
                    new = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                    last = np.append(new[1:], len(a)) - 1
                    for i, j in zip(new, last, strict=True):
                        r = row[i]
                        spans[r].append({"start": int(a[i] - starts[r]), "end": int(b[j] - starts[r]), "lang": model.langs[label[i]]})
                    for r in np.flatnonzero(total):
                        if any(c.isalpha() for c in texts[r]):
                            pred[r], score[r] = model.langs[best[r]], float(mass[r, best[r]] / total[r])
                        else:
                            spans[r] = []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(kind))],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def label_languages(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row of docs(doc_id, text, ...).

    spans are the labelled stretches (start, end in code points, end exclusive, lang); lang_pred has the
    most letters in them and score is its share. A null text or one without a letter, or a model without
    a language, gives 'und', 0 and no spans. Equal masses go to the first language by name. Repeated rows
    are labelled one by one; other columns are ignored. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        _label(shared, switch), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    )
