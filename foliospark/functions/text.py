"""Text rules as column expressions: tokens, markers, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never indexed.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "it", "its", "he", "she", "they", "them", "his", "her", "their", "this", "that",
    "these", "those", "i", "you", "we", "me", "my", "your", "our", "not", "no", "so", "if", "then", "than", "too",
    "very", "just", "about", "also", "as", "from", "into", "up", "out", "off", "over", "under", "again", "there",
    "here", "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some",
    "such", "only", "own", "same", "now", "new", "one", "two", "three", "many", "much", "well", "back", "even",
    "still", "before", "after", "between", "through",
)

#: Roman numerals that are never indexed.
ROMAN_NUMERALS = (
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii",
    "xviii", "xix", "xx", "xxi", "xxii", "xxiii", "xxiv", "xxv", "xxvi", "xxvii", "xxviii", "xxix", "xxx", "xl", "l",
    "lx", "lxx", "lxxx", "xc", "c",
)

IGNORED_TERMS = tuple(sorted({*STOP_WORDS, *ROMAN_NUMERALS}))

#: The markers around a book's body.
START_MARKER = "*** START OF THE PROJECT GUTENBERG EBOOK"
END_MARKER = "*** END OF THE PROJECT GUTENBERG EBOOK"

#: White space as Python's str.strip sees it: Unicode white space and U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize(text: Column) -> Column:
    """Lower-cased text's maximal runs of a-z, in order, repeats kept; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def is_indexable(term: Column) -> Column:
    return (F.length(term) > 1) & ~term.isin(*IGNORED_TERMS)


def normalize(tokens: Column) -> Column:
    return F.filter(tokens, is_indexable)


def process_text(text: Column) -> Column:
    return normalize(tokenize(text))


def split_markers(text: Column, start: str = START_MARKER, end: str = END_MARKER) -> Column:
    """struct(header, body, failed): the text before the first start marker, and from there to the first end
    marker behind it, both stripped. Without either marker in this order failed is true and the rest null."""
    after_start = F.locate(start, text)
    rest = F.substring(text, after_start + len(start), F.length(text))
    end_at = F.locate(end, rest)
    good = (after_start > 0) & (end_at > 0)
    return F.struct(
        F.when(good, strip(F.substring(text, F.lit(1), after_start - 1))).alias("header"),
        F.when(good, strip(F.substring(rest, F.lit(1), end_at - 1))).alias("body"),
        (~F.coalesce(good, F.lit(False))).alias("failed"),
    )


def contains_literal(c: Column, needle: str) -> Column:
    """Substring test that folds only A-Z and takes % and _ as they are; every non-null value holds ''."""
    return F.contains(ascii_lower(c), ascii_lower(F.lit(needle)))
