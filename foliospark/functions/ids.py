"""Ids, folders and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip

#: Names no file may have on some systems; such a term's file gets an underscore.
RESERVED_NAMES = (
    "con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)


def normalize_book_id(raw: Column) -> Column:
    """Canonical decimal text of a positive id; null for anything else."""
    digits = F.regexp_replace(strip(raw.cast("string")), "^0+(?=[0-9])", "")
    return F.when(strip(raw.cast("string")).rlike(r"\A[0-9]+\z") & (digits != "0"), digits)


def batch_bounds(book_id: Column, size: int = 1000) -> tuple[Column, Column]:
    if size < 1:
        raise ValueError(f"a batch holds at least one book, not {size}")
    low = (F.floor(book_id / size) * size).cast("long")
    return low, low + (size - 1)


def batch_bucket(book_id: Column, size: int = 1000) -> Column:
    low, high = batch_bounds(book_id, size)
    return F.concat(F.lit("batch_"), low.cast("string"), F.lit("_"), high.cast("string"))


def time_bucket(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd/HH")


def term_letter(term: Column) -> Column:
    return F.upper(F.substring(term, 1, 1))


def term_file_name(term: Column) -> Column:
    return F.when(F.lower(term).isin(*RESERVED_NAMES), F.concat(term, F.lit("_"))).otherwise(term)


def term_of_file_name(name: Column) -> Column:
    bare = F.regexp_replace(name, "_$", "")
    return F.when(name.endswith("_") & F.lower(bare).isin(*RESERVED_NAMES), bare).otherwise(name)


def term_file_path(term: Column) -> Column:
    return F.concat(term_letter(term), F.lit("/"), term_file_name(term), F.lit(".txt"))


def stored_path(path: Column, root: str) -> Column:
    """Relative to root below it, else as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def resolved_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def book_url(book_id: Column, template: str = "https://www.gutenberg.org/cache/epub/{id}/pg{id}.txt") -> Column:
    parts = template.split("{id}")
    text = book_id.cast("string")
    columns = [F.lit(parts[0])]
    for p in parts[1:]:
        columns += [text, F.lit(p)]
    return F.concat(*columns)


def status_class(status: Column) -> Column:
    """ok, permanent (4xx but 408 and 429) or transient."""
    return (
        F.when(status == 200, "ok").when(status.between(400, 499) & ~status.isin(408, 429), "permanent").otherwise("transient")
    )
