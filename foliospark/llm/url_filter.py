"""URL filter: host/path rules first, then a ratio of two smoothed variable-order Markov models.

URLs that a rule decides are the training data: one character model learns the accepted ones, one the
rejected ones. A model is a table of character counts after contexts of 0 to ORDER characters; the
probability of a character after a context is interpolated with that after the next shorter one
(Witten-Bell weights), so every URL uses the longest context the model has seen at that place. The
verdict compares the length-normalised log-likelihood difference with a threshold that is calibrated on
URLs of a fold the models did not see.

Characters are folded into ALPHABET classes, so a model has at most ALPHABET ** (ORDER + 1) counts
(22 MB for both), whatever the input; counts are summed over all URLs in the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import crc_bucket

ORDER = 3
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_"
ALPHABET = len(_SYMBOLS) + 2  # 0 pads the start, the last is everything else
SIZES = [ALPHABET ** (k + 1) for k in range(ORDER + 1)]
BINS, SPAN = 4001, 10.0  # the calibration histogram of the score, in nats a character
FOLD = 5

_CODE = np.full(256, ALPHABET - 1, dtype=np.int64)
for _i, _c in enumerate(_SYMBOLS):
    _CODE[ord(_c)] = _i + 1
    _CODE[ord(_c.upper())] = _i + 1

Rule = tuple[str, str, str]  # verdict, host, path prefix
DEFAULT_RULES: Sequence[Rule] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://' or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    names, verdicts = [F.lit(None).cast("string")], [F.lit(None).cast("string")]
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        names.insert(-1, F.when(fits, F.lit(h + p)))
        verdicts.insert(-1, F.when(fits, F.lit(kind)))
    return F.coalesce(*names), F.coalesce(*verdicts)


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the code of each character with its context, and the row of each character."""
    rows, codes = [], []
    for i, t in enumerate(texts.to_pylist()):
        c = _CODE[np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8)]
        codes.append(np.concatenate([np.zeros(ORDER, np.int64), c]))
        rows.append(np.concatenate([np.full(ORDER, -1), np.full(len(c), i)]))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    here = np.flatnonzero(row >= 0)
    out, code = [], flat[here]
    out.append(code)
    for k in range(1, ORDER + 1):
        code = code + flat[here - k] * ALPHABET**k
        out.append(code)
    return out, row[here]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [[np.zeros(n, dtype=np.int64) for n in SIZES] for _ in range(2)]
    for batch in batches:
        good = np.array(batch.column("good").to_pylist(), dtype=np.int64)
        grams, row = _grams(batch.column("text"))
        for k, g in enumerate(grams):
            for side in (0, 1):
                total[side][k] += np.bincount(g[good[row] == side], minlength=SIZES[k])
    for side in (0, 1):
        for k in range(ORDER + 1):
            slot = np.flatnonzero(total[side][k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), side)), pa.array(np.full(len(slot), k)), pa.array(slot), pa.array(total[side][k][slot])],
                ["good", "k", "slot", "n"],
            )


class Markov:
    """Interpolated variable-order model from dense counts of each order."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self.context, self.kinds = [], []
        for c in counts:
            by = c.reshape(-1, ALPHABET)  # the last digit is the character, the others its context
            self.context.append(by.sum(axis=1))
            self.kinds.append((by > 0).sum(axis=1))

    def log_probability(self, grams: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), 1.0 / ALPHABET)
        for k, g in enumerate(grams):
            ctx = g // ALPHABET
            n, t = self.context[k][ctx], self.kinds[k][ctx]
            p = np.where(n > 0, (self.counts[k][g] + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def _score(shared):
    """shared holds, of each side and order, the slots that are not zero and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = (Markov([_dense(k, *c) for k, c in enumerate(side)]) for side in shared.value)
        for batch in batches:
            grams, row = _grams(batch.column("text"))
            gain = good.log_probability(grams) - bad.log_probability(grams)
            n = np.bincount(row, minlength=batch.num_rows)
            s = np.bincount(row, weights=gain, minlength=batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(batch.num_columns)), pa.array(s)], [*batch.schema.names, "score"]
            )

    return run


def _dense(k: int, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(SIZES[k], dtype=np.int64)
    out[slot] = n
    return out


def _calibrated(histogram: dict[tuple[int, bool], int]) -> float:
    """The score threshold of the best balanced accuracy; the middle of equally good ones."""
    n = np.zeros((2, BINS))
    for (b, good), c in histogram.items():
        n[int(good), b] = c
    if not n[0].sum() or not n[1].sum():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1) / n.sum(axis=1, keepdims=True)
    gain = below[0] - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return (float(best[len(best) // 2]) / BINS * 2 - 1) * SPAN


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of each row of pages(page_id, url, ...).

    verdict is the rule's where one fits, else allow if score >= threshold. score is the difference of
    the two models' log-likelihoods over the number of bytes; a null or empty URL scores 0. If rules
    leave one side without a URL to learn from, that side's model is uniform. Repeated rows are judged
    one by one; other columns are ignored. An empty table gives an empty table.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    name, verdict = _ruled(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", F.regexp_replace("text", r"(?s)^.*?://", "").alias("text"), "host", "path", name.alias("rule"), verdict.alias("said"))
    taught = base.where("said is not null").select(
        F.when(F.col("said") == "allow", 1).otherwise(0).alias("good"), "text", (F.coalesce(crc_bucket(F.col("page_id"), FOLD), F.lit(1)) == 0).alias("held")
    )
    summed = (
        taught.where("not held").select("good", "text").mapInArrow(_count, "good long, k long, slot long, n long").groupBy("good", "k", "slot").agg(F.sum("n").alias("n"))
    )
    counts = summed.toArrow()  # at most twice the sum of SIZES rows, see above
    side, order = counts.column("good").to_numpy(), counts.column("k").to_numpy()
    slot, n = counts.column("slot").to_numpy().astype(np.int32), counts.column("n").to_numpy()
    models = [[(slot[(side == i) & (order == k)], n[(side == i) & (order == k)]) for k in range(ORDER + 1)] for i in (0, 1)]
    score = _score(pages.sparkSession.sparkContext.broadcast(models))
    place = F.least(F.greatest(F.floor((F.col("score") / SPAN + 1) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    held = taught.where("held").select("good", "text").mapInArrow(score, "good int, text string, score double")
    histogram = {(int(b), bool(g)): n for b, g, n in held.groupBy(place.alias("b"), "good").count().collect()}
    threshold = _calibrated(histogram)
    out = base.mapInArrow(score, "page_id long, text string, host string, path string, rule string, said string, score double")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score", F.lit(threshold).alias("threshold"),
    )
