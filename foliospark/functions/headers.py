"""Header fields, metadata and language names as column expressions; each row is parsed where it lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import SPACE, collapse, strip

UNKNOWN = "Unknown"
#: Fixed value: what a line that opens a field looks like.
FIELD_LINE = r"^([A-Za-z][A-Za-z ]*?):[ \t]*(.*)$"

#: Codes of language names.
LANGUAGE_CODES = {
    "afrikaans": "af", "arabic": "ar", "bulgarian": "bg", "catalan": "ca", "chinese": "zh",
    "czech": "cs", "danish": "da", "dutch": "nl", "english": "en", "esperanto": "eo",
    "finnish": "fi", "french": "fr", "galician": "gl", "german": "de", "greek": "el",
    "greek, ancient (to 1453)": "grc", "hebrew": "he", "hungarian": "hu", "icelandic": "is",
    "irish": "ga", "italian": "it", "japanese": "ja", "korean": "ko", "latin": "la",
    "middle english (1100-1500)": "enm", "norwegian": "no", "old english (ca. 450-1100)": "ang",
    "polish": "pl", "portuguese": "pt", "romanian": "ro", "russian": "ru", "serbian": "sr",
    "spanish": "es", "swedish": "sv", "tagalog": "tl", "welsh": "cy",
}


def header_fields(text: Column) -> Column:
    """array(struct(name, value)) of a header, in order.

    "Name: value" opens a field, an indented line extends the open one, any other line closes it. Names
    are lower-cased, values have single spaces. A null header has none.
    """
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n", -1)
    kind = "array<struct<name:string,value:string>>"

    def take(state: Column, line: Column) -> Column:
        bare, out = strip(line), state["out"]
        last = F.element_at(out, -1)
        indented = line.rlike(rf"(?U)\A{SPACE}")
        opens = ~indented & bare.rlike(FIELD_LINE)
        opened = F.struct(F.lower(strip(F.regexp_extract(bare, FIELD_LINE, 1))).alias("name"), F.regexp_extract(bare, FIELD_LINE, 2).alias("value"))
        longer = F.struct(last["name"].alias("name"), F.concat(last["value"], F.lit(" "), bare).alias("value"))
        extends = (bare != "") & indented & state["open"]
        return F.struct(
            ((bare != "") & (opens | extends)).alias("open"),
            F.when(extends, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer)))
            .when((bare != "") & opens, F.array_append(out, opened))
            .otherwise(out)
            .alias("out"),
        )

    found = F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast(kind).alias("out")), take)["out"]
    return F.transform(found, lambda f: F.struct(f["name"].alias("name"), collapse(f["value"]).alias("value")))


def _values(fields: Column, name: str) -> Column:
    return F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"])


def normalize_language(raw: Column) -> Column:
    """Codes of a list of language names: the whole text first, else name by name without repeats."""
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    clean = F.lower(collapse(F.coalesce(raw, F.lit(""))))
    code = lambda name: F.coalesce(F.try_element_at(codes, name), name)
    names = F.filter(F.split(clean, r"\s*,\s*|\s+and\s+|\s*;\s*", -1), lambda n: n != "")
    split = F.array_join(F.array_distinct(F.transform(names, code)), ",")
    return F.when(clean == "", UNKNOWN).otherwise(F.coalesce(F.try_element_at(codes, clean), split))


def extract_metadata(text: Column) -> Column:
    """struct(title, author, language) of a header."""
    fields = header_fields(text)
    titles = F.filter(_values(fields, "title"), lambda v: v != "")
    authors = F.array_join(_values(fields, "author"), "; ")
    return F.struct(
        F.coalesce(F.get(titles, 0), F.lit(UNKNOWN)).alias("title"),
        F.when(authors == "", UNKNOWN).otherwise(authors).alias("author"),
        normalize_language(F.array_join(_values(fields, "language"), ", ")).alias("language"),
    )
