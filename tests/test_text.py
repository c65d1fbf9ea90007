from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliospark.functions import headers, ids, labels
from foliospark.functions import text as T
from foliospark.sources import control_log


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("HELLO World", ["hello", "world"]), ("well-known", ["well", "known"]), ("word123 another", ["word", "another"]), ("", []), (None, []),
        ("café naïve", ["caf", "na", "ve"]), ("İstanbul", ["i", "stanbul"]), ("\u212aey", ["key"]),
    ],
)
def test_tokenize(spark, text, want):
    assert one(spark, text, T.tokenize) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("the cat is on the mat", ["cat", "mat"]), ("chapter ii introduction", ["chapter", "introduction"]), ("a big b cat", ["big", "cat"]),
        ("one two three hundred forty", ["hundred", "forty"]), ("The Cat is on the Mat, Chapter II!", ["cat", "mat", "chapter"]), ("xxxi d m", ["xxxi"]),
    ],
)
def test_process_text(spark, text, want):
    assert one(spark, text, T.process_text) == want


def test_fixed_lists():
    assert len(T.STOP_WORDS) == 109 and len(T.ROMAN_NUMERALS) == 37 and len(ids.RESERVED_NAMES) == 22


@pytest.mark.parametrize("raw", [" x\x1c", "\u2003x\u00a0\n", "\x1fa b\x1d", "", "\t\x0b\x0c", "x"])
def test_strip_is_pythons(spark, raw):
    assert one(spark, raw, T.strip) == raw.strip()


@pytest.mark.parametrize(
    "raw, want",
    [("English", "en"), ("English, French and Spanish", "en,fr,es"), ("Greek, Ancient (to 1453)", "grc"), ("Klingon", "klingon"), ("", "Unknown"), (None, "Unknown"), (" , ; ", ""), ("English; english", "en")],
)
def test_language(spark, raw, want):
    assert one(spark, raw, headers.normalize_language) == want


def test_header_fields_and_metadata(spark):
    head = "preamble\n\nTitle: A long\n   title\nAuthor: First Person\nAuthor: Second Person\nEditor:\tX\nnot a field\n lost\nRelease date: 2001\nLanguage: English\n"
    got = [(f.name, f.value) for f in one(spark, head, headers.header_fields)]
    assert got == [("title", "A long title"), ("author", "First Person"), ("author", "Second Person"), ("editor", "X"), ("release date", "2001"), ("language", "English")]
    m = one(spark, head, headers.extract_metadata)
    assert (m.title, m.author, m.language) == ("A long title", "First Person; Second Person", "en")
    assert tuple(one(spark, "nothing", headers.extract_metadata)) == ("Unknown",) * 3


@pytest.mark.parametrize("raw, want", [("0042", "42"), (" 7\n", "7"), ("0", None), ("-1", None), ("1.0", None), ("²", None), ("", None)])
def test_book_id(spark, raw, want):
    assert one(spark, raw, ids.normalize_book_id) == want


def test_markers(spark):
    p = one(spark, f"h\n{T.START_MARKER} SAMPLE ***\nbody\n{T.END_MARKER} SAMPLE ***\nfoot", T.split_markers)
    assert (p.header, p.body, p.failed) == ("h", "SAMPLE ***\nbody", False)
    assert one(spark, f"{T.END_MARKER}\n{T.START_MARKER}", T.split_markers).failed
    assert one(spark, None, T.split_markers).failed


def test_batches_and_names(spark):
    row = spark.range(1).select(
        *[ids.batch_bucket(F.lit(i), n).alias(f"b{k}") for k, (i, n) in enumerate([(0, 1000), (999, 1000), (1342, 1000), (1342, 500)])],
        ids.term_file_path(F.lit("con")).alias("p"), ids.term_file_path(F.lit("cone")).alias("q"),
    ).first()
    assert list(row) == ["batch_0_999", "batch_0_999", "batch_1000_1999", "batch_1000_1499", "C/con_.txt", "C/cone.txt"]
    with pytest.raises(ValueError):
        ids.batch_bucket(F.lit(1), 0)


@pytest.mark.parametrize(
    "path, want",
    [
        ("/home/u/.cache/go/datalake/time_based", ("Datalake", "Time-based")), ("/c/index/inverted_index.json", ("Index", "JSON file")), ("/c/rust/datamarts/inverted_index", ("Index", "Folder")),
        ("mongodb://localhost:27017/b.inverted_index", ("Index", "MongoDB")), ("mongodb://localhost:27017/b.books", ("Metadata", "MongoDB")),
        ("host=/var/run/postgresql dbname=bigdata", ("Metadata", "PostgreSQL")), ("/u/metadata_benchmark.db", ("Metadata", "SQLite")), ("C:\\x\\Odd", ("Other", "odd")),
    ],
)
def test_path_classes(spark, path, want):
    assert tuple(one(spark, path, labels.classify_path)) == want


def test_number_formats(spark):
    d = {2e-5: "20 µs", 0.1: "100 ms", 1181.0: "1,181 s", 4.587: "4.59 s", 0.0: ""}
    for x, want in d.items():
        assert spark.range(1).select(labels.format_duration(F.lit(x)).alias("r")).first().r == want
    c = {10.0: "10", 1000.0: "1k", 10000.0: "10k", 1500.0: "1.5k"}
    for x, want in c.items():
        assert spark.range(1).select(labels.format_count(F.lit(x)).alias("r")).first().r == want
    r = {2.61: "2.61", 25.83: "25.8", 120.4: "120"}
    for x, want in r.items():
        assert spark.range(1).select(labels.format_rate(F.lit(x)).alias("r")).first().r == want


def test_control_lines(spark, tmp_path):
    log = tmp_path / "log"
    log.write_bytes(b"1\r\n  2  \n\nabc\n\xff\xfe\n2\n0003\n")
    read = lambda: [r.book_id for r in control_log.load(spark, str(log)).orderBy("pos").collect()]
    assert read() == ["1", "2", "3"]
    assert control_log.repair(spark, str(log)) and log.read_bytes() == b"1\n2\n3\n"
    assert not control_log.repair(spark, str(log))
    log.write_bytes(b"1\n2\n12")
    assert read() == ["1", "2"]
    control_log.repair(spark, str(log))
    control_log.append(str(log), "12")
    assert read() == ["1", "2", "12"]
    assert control_log.load(spark, str(tmp_path / "none")).count() == 0
