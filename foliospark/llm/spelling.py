"""Spelling variants of the words of a corpus, grouped by anagram hashing.

A letter's value is the fifth power of its code point and a word's key is the sum over its letters, so the key
ignores their order. Two words one edit apart have keys that differ by one letter's value (added or removed) or
by the difference of two values (exchanged), and no two pairs of letters in the range of words() have the same
difference. Every word stands in the index under its key and under its key less each of its letters: an addition
or removal meets as key against lessened key, an exchange as lessened key against lessened key. As one edit
leaves the first or the last half of a word as it was, an entry also names one half, so an entry is shared by
words that agree in half of their letters by place and in all but one by count, and not by all anagrams.
Each pair of near words meets once; the order of its letters is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrowtext import slices
from foliospark.llm.common import release, small_batches, stored

FLUSH = 200_000  # distinct words that a task holds before it hands its counts on
MODULUS = (1 << 61) - 1  # of keys, so that no sum overflows
_RUN = re.compile("[a-zÀ-ÿ]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def damaged(prefix: int, word: str, every: int) -> str:
    """The word, or what is left of it when its hash tells to delete a letter; prefix: the hash of what precedes it."""
    h = zlib.crc32(word.encode(), prefix)
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(least: int, every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    runs = Counter(_RUN.findall(text.encode().translate(_FOLD).decode())) if text else {}
                    if every is None or name is None:
                        for word, n in runs.items():
                            if len(word) >= least:
                                total[word] += n
                    else:
                        prefix = zlib.crc32(f"{name}:".encode())
                        for word, n in runs.items():
                            if len(word) >= least and len(word := damaged(prefix, word, every)) >= least:
                                total[word] += n
                    if len(total) >= FLUSH:
                        yield flushed()
        if total:
            yield flushed()

    return run


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int | None = None) -> DataFrame:
    """(word, n): the letter runs of whole texts, A-Z folded, of a least length, with their least number of places.

    With `every`, a run whose crc32 with its document's id is divisible by it loses one letter first; in
    documents without an id none does. Null and empty texts have no runs; repeated rows count each time.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _entries(vocabulary: DataFrame) -> DataFrame:
    """(k, gone, side, word, n, half): a word under its key (gone 0) and under its key less one letter (gone 1)."""
    value = lambda c: F.ascii(c).cast("long") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c)
    keyed = vocabulary.withColumn("letters", F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).select(
        "word", "n", F.size("letters").alias("size"),
        F.aggregate("letters", F.lit(0).cast("long"), lambda total, c: (total + value(c)) % MODULUS).alias("key"),
        F.array_distinct("letters").alias("letters"),
    )
    own = F.struct(F.col("key").alias("key"), F.lit(0).alias("gone"))
    less = F.transform("letters", lambda c: F.struct(F.pmod(F.col("key") - value(c), F.lit(MODULUS)).alias("key"), F.lit(1).alias("gone")))
    opened = keyed.select("word", "n", "size", F.explode(F.concat(F.array(own), less)).alias("e"))
    rest = F.col("size") - F.col("e.gone")
    half = F.floor(rest / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.xxhash64("e.key", F.lit(0), F.substring("word", F.lit(1), half)).alias("k")),
        F.struct(F.lit(1).alias("side"), F.xxhash64("e.key", F.lit(1), F.expr("right(word, size - e.gone - floor((size - e.gone) / 2))")).alias("k")),
    )
    return opened.select("word", "n", F.col("e.gone").alias("gone"), half.alias("half"), F.explode(sides).alias("s")).select(
        "s.k", "s.side", "gone", "word", "n", "half"
    )


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words of (word, n) that differ by one edit, once."""
    entries = _entries(vocabulary)
    left = entries.where("gone = 1").select("k", "word", "n")
    right = entries.select("k", "side", "gone", "half", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = left.join(right, "k").where("gone = 0 OR word < other")
    # a pair whose first half is intact has met there already
    first = F.substring("word", F.lit(1), F.col("half")) == F.substring("other", F.lit(1), F.col("half"))
    return met.where(((F.col("side") == 0) | ~first) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each round doubles the steps taken; forms have no circles,
    as a form is at least twice as frequent as its word, so rounds are few."""
    jumps = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(jumps.join(ahead, "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
        release(jumps)
        jumps = moved
        if moved.where("moved").isEmpty():
            return jumps.select("word", "root")


def group_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of vocabulary(word, n).

    Words are near if they differ by one inserted, deleted or replaced letter. form is the near word of largest n
    (ties: the smallest in code-point order) if that n is at least `ratio` (2 or more) times the word's own; root
    is where the forms end. The words of `vocabulary` are distinct and not null; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms may run in circles")
    vocabulary = stored(vocabulary.select("word", "n"), "words")
    pairs = near_pairs(vocabulary)
    both = F.array(
        F.struct(F.col("word").alias("word"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("near")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("near")),
    )
    best = pairs.select(F.explode(both).alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x.near").alias("near"))
    takes = -F.col("near.less") >= ratio * F.col("n")
    forms = stored(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("near.form")).alias("form"), F.when(takes, -F.col("near.less")).alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
