"""Labels of measurements as column expressions: storage classes, stages, number formats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages of tests and the patterns of their names; known languages and tests in order.
LATENCY_STAGES = (
    ("Datalake lookups", "^lookup_"), ("Inverted-index queries", "^query_.*_index$"), ("Metadata queries", "^query_.*_sqlite$"),
)
THROUGHPUT_STAGES = (
    ("Datalake writes", "^write_throughput_"), ("Download + write", "^download_"), ("Tokenization", "^tokenize_"),
    ("Metadata inserts", "^insert_throughput_"),
)
OTHER_STAGE = "Other tests"
LANGUAGE_ORDER = ("python", "java", "go", "rust")
TEST_ORDER = (
    "write_throughput_time_based", "write_throughput_book_based", "write_throughput_batch_based",
    "incremental_time_based", "incremental_book_based", "incremental_batch_based", "download_write_throughput",
    "tokenize_books", "build_postings", "insert_throughput_sqlite", "insert_throughput_postgres",
    "insert_throughput_mongo", "build_json_index", "build_folder_index", "build_mongo_index", "insert_sqlite",
    "insert_postgres", "insert_mongo", "load_json_index", "update_json_index", "update_folder_index",
    "update_mongo_index", "lookup_time_based", "lookup_book_based", "lookup_batch_based", "query_json_index",
    "query_folder_index", "query_mongo_index", "query_id_sqlite", "query_path_sqlite", "query_author_sqlite",
)
PRODUCTIVITY = {"python": 1.0, "go": 0.8, "java": 0.7, "rust": 0.4}
TOKEN_LABELS = {"json": "JSON", "sqlite": "SQLite", "postgres": "PostgreSQL", "mongo": "MongoDB", "id": "ID"}


def classify_path(path: Column) -> Column:
    """struct(layer, component) of where a measured store lies; the first rule that fits decides."""
    low = F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(F.regexp_replace(low, "/+$", ""), "([^/]*)$", 1)
    dashed = F.replace(name, F.lit("_"), F.lit("-"))
    capital = F.concat(F.upper(F.substring(dashed, 1, 1)), F.substring(dashed, F.lit(2), F.length(dashed)))
    collection = F.regexp_extract(low, r"([^.]*)$", 1)
    rules = [
        (F.contains(low, F.lit("/datalake/")), F.lit("Datalake"), capital),
        (low.startswith("mongodb://"), F.when(F.contains(collection, F.lit("index")), "Index").otherwise("Metadata"), F.lit("MongoDB")),
        (F.contains(low, F.lit("dbname=")) | low.startswith("postgres://") | low.startswith("postgresql://"), F.lit("Metadata"), F.lit("PostgreSQL")),
        (low.rlike(r"\.(db|sqlite|sqlite3)$"), F.lit("Metadata"), F.lit("SQLite")),
        (F.contains(name, F.lit("inverted_index")), F.lit("Index"), F.when(name.endswith(".json"), "JSON file").otherwise("Folder")),
    ]
    layer, component = F.lit("Other"), name
    for fits, a, b in reversed(rules):
        layer, component = F.when(fits, a).otherwise(layer), F.when(fits, b).otherwise(component)
    return F.struct(layer.alias("layer"), component.alias("component"))


def stage_of_test(name: Column, stages: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda out, s: F.when(name.rlike(s[1]), s[0]).otherwise(out), reversed(stages), F.lit(OTHER_STAGE))


def rank_in(name: Column, known: Sequence[str]) -> Column:
    """Place in a list; names outside it share the place behind it."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), name)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(known)))


def _general(x: Column, digits: int) -> Column:
    """Like a %g format with this many significant digits, for values from 0.0001 up."""
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(x)).cast("int"))
    text = reduce(lambda out, k: F.when(places == k, F.format_string(f"%.{k}f", x)).otherwise(out), range(0, digits + 4), F.lit(""))
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def format_duration(seconds: Column) -> Column:
    out = F.format_string("%.0e s", seconds)
    for unit, scale in (("ns", 1e-9), ("µs", 1e-6), ("ms", 1e-3), ("s", 1.0)):
        value = seconds / scale
        text = F.when(value >= 100, F.format_string("%,.0f", value)).otherwise(_general(value, 3))
        out = F.when(seconds >= scale * 0.999, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return F.when(seconds <= 0, "").otherwise(out)


def format_count(value: Column) -> Column:
    return F.when(value >= 1000, F.concat(_general(value / 1000, 6), F.lit("k"))).otherwise(F.when(value == 0, "0").otherwise(_general(value.cast("double"), 6)))


def format_rate(value: Column) -> Column:
    return F.when(value < 10, F.format_string("%.2f", value)).when(value < 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))


def humanize_test_name(name: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in TOKEN_LABELS.items() for x in pair])
    words = F.transform(F.split(name, "_", -1), lambda w: F.coalesce(F.try_element_at(labels, w), w))
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
