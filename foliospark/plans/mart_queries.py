"""Queries of the lake, metadata and control operators over the local tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import headers, ids
from foliospark.functions import text as T
from foliospark.operators import control, metadata, sets
from foliospark.session import shared_dir
from foliospark.sources import control_log, lake
from foliospark.sources.store import METADATA
from foliospark.sources.tables import MergeTable

HEADERS = [
    (1, "Title: Pride and Prejudice\r\nAuthor: Jane Austen\r\nLanguage: English\r\n"),
    (2, "A preamble line\n\nTitle: A very long\n    title of two lines\nAuthor: First Person\nAuthor:   Second   Person \nEditor: Someone\n\n   lost line\nRelease Date: May 1, 2001\nLanguage: English, French and Spanish\n"),
    (3, "nothing here"), (4, "Title:\nTitle: Second title\nLanguage: Greek, Ancient (to 1453)"), (5, "Language: Klingon; English; klingon"),
    (6, ""), (7, "Author: A\n\tcontinued by tab\nnot a field\n continued nowhere\nLanguage: German"),
]
RAW_BOOKS = [
    (1, f"head\n{T.START_MARKER} SAMPLE ***\nbody text\n{T.END_MARKER} SAMPLE ***\nfoot"), (2, f"{T.END_MARKER} x\n{T.START_MARKER} y"),
    (3, "no marker"), (4, f" h {T.START_MARKER}a{T.END_MARKER}b{T.END_MARKER}"), (5, f"{T.START_MARKER} only start"),
]
def _q(s: str) -> str:
    parts = []
    for piece in s.replace("'", "''").replace("\r", "\x00CR\x00").replace("\n", "\x00LF\x00").replace("\t", "\x00TAB\x00").split("\x00"):
        parts.append({"CR": "chr(13)", "LF": "chr(10)", "TAB": "chr(9)"}.get(piece, f"'{piece}'"))
    return " || ".join(parts)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def mart(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a metadata table: source as author, first line as title, paths of the batch layout."""
    d = docs(spark, sf)
    batch = ids.batch_bucket(F.col("doc_id"), 100)
    file = lambda kind: F.concat(batch, F.lit("/"), F.col("doc_id").cast("string"), F.lit(f"_{kind}.txt"))
    return d.select(
        F.col("doc_id").alias("book_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"),
        F.lit("2024-01-01 00:00:00").alias("capture_date"), file("header").alias("header_path"), F.when(F.col("doc_id") % 10 != 3, file("body")).alias("body_path"),
    )


_MART = """SELECT doc_id AS book_id, split_part(text, chr(10), 1) AS title, source AS author, lang AS language, '2024-01-01 00:00:00' AS capture_date,
  'batch_' || (doc_id // 100 * 100) || '_' || (doc_id // 100 * 100 + 99) || '/' || doc_id || '_header.txt' AS header_path,
  CASE WHEN doc_id % 10 <> 3 THEN 'batch_' || (doc_id // 100 * 100) || '_' || (doc_id // 100 * 100 + 99) || '/' || doc_id || '_body.txt' END AS body_path FROM documents"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """orders as stored files: a body and, but for some, a header each, at an hour folder; customers as books."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    folder = F.concat(F.lit("lake/"), ids.time_bucket(F.col("o_orderdate")))
    base = o.select(F.col("o_custkey").alias("book_id"), folder.alias("dir"), F.col("o_orderkey").alias("k"))
    kind = lambda k: base.select("book_id", "dir", F.lit("").alias("parent"), F.lit(k).alias("kind"), F.concat("dir", F.lit("/"), F.col("book_id").cast("string"), F.lit(f"_{k}.txt")).alias("path"), "k")
    return kind("body").unionByName(kind("header").where("k % 3 <> 0")).drop("k").distinct()


_FILES = """SELECT DISTINCT o_custkey AS book_id, 'lake/' || strftime(o_orderdate, '%Y%m%d/%H') AS dir, o_orderkey % 3 <> 0 AS headed FROM orders"""
_PAIRS = f"SELECT DISTINCT book_id, dir, dir || '/' || book_id || '_body.txt' AS body_path, dir || '/' || book_id || '_header.txt' AS header_path FROM ({_FILES}) WHERE headed"


def downloaded(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("book_id"))


def indexed(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1_000_000).otherwise(0)).alias("book_id"))


_INDEXED = "SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000 ELSE 0 END AS book_id FROM labels"


def log(spark, sf):
    d = downloaded(spark, sf).select("book_id", F.lit("downloaded").alias("state"))
    i = indexed(spark, sf).select("book_id", F.lit("indexed").alias("state"))
    f = downloaded(spark, sf).where("book_id % 11 = 0").select((F.col("book_id") + 60_000).alias("book_id"), F.lit("failed").alias("state"))
    return d.unionByName(i).unionByName(f)


FIRST_MADE = 1000  # ids from here on are made of the documents


def raw_headers(spark, sf):
    """The odd headers, and one around every document: its id, source and length."""
    made = F.format_string("A preamble\n\nTitle: Book\n   %d  of\t%s\r\nAuthor: %s\nAuthor:  The %s\n\n lost\nLength: %d\nLanguage: English; German", "doc_id", "source", "source", "lang", F.length("text"))
    rows = docs(spark, sf).select((F.col("doc_id") + FIRST_MADE).alias("book_id"), made.alias("text"))
    return spark.createDataFrame(HEADERS, "book_id long, text string").unionByName(rows)


def raw_books(spark, sf):
    """The odd files, and every whole document as a body between its markers."""
    made = F.concat(F.lit("head of "), F.col("doc_id").cast("string"), F.lit(f"\n{T.START_MARKER} ["), F.coalesce("text", F.lit("")), F.lit(f"]\n{T.END_MARKER} x ***\nfoot"))
    rows = docs(spark, sf).select((F.col("doc_id") + FIRST_MADE).alias("book_id"), made.alias("text"))
    return spark.createDataFrame(RAW_BOOKS, "book_id long, text string").unionByName(rows)


def q_header_fields(spark, sf):
    h = raw_headers(spark, sf).select("book_id", F.posexplode(headers.header_fields(F.col("text"))).alias("ordinal", "f"))
    return h.select("book_id", "ordinal", "f.name", "f.value")


def q_extract_metadata(spark, sf):
    return raw_headers(spark, sf).select("book_id", headers.extract_metadata(F.col("text")).alias("m")).select("book_id", "m.*")


def q_metadata_build(spark, sf):
    """Headers made of the documents' own columns, parsed back and normalized."""
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French and Spanish", "es", "Spanish")])
    head = F.concat(F.lit("Title: Book\n  "), F.col("doc_id").cast("string"), F.lit("\r\nAuthor: "), F.col("source"), F.lit("\nLanguage: "), F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("")))
    made = docs(spark, sf).select(F.col("doc_id").alias("book_id"), head.alias("header"), F.lit("/lake/h").alias("header_path"), F.concat(F.lit("/other/"), F.col("doc_id").cast("string")).alias("body_path"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("modified"))
    return metadata.build_metadata(made, "/lake")


def q_normalize_language(spark, sf):
    d = docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    raw = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "  GERMAN ").when(F.col("lang") == "fr", "French, English; french").otherwise("Klingon and Spanish")
    return d.select("lang", "n", headers.normalize_language(raw).alias("code"))


def q_split_markers(spark, sf):
    return raw_books(spark, sf).select("book_id", T.split_markers(F.col("text")).alias("p")).select("book_id", "p.*")


def q_normalize_book_id(spark, sf):
    """Ids as people write them: with zeros, spaces, signs, fractions, letters."""
    forms = ["00%s", " %s\t", "-%s", "%s.0", "+%s", "%s", "0x%s", "%s\n", ""]
    raw = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(forms))):
        raw = F.when(F.col("doc_id") % len(forms) == i, F.format_string(form, F.col("doc_id").cast("string")) if form else F.lit("")).otherwise(raw)
    return docs(spark, sf).select("doc_id", ids.normalize_book_id(raw).alias("book_id"))


def q_build_url(spark, sf):
    return docs(spark, sf).select("doc_id", ids.book_url(F.col("doc_id")).alias("url"))


def q_classify_status(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 600).cast("int").alias("status"))
    return e.groupBy("status", ids.status_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def q_batch_bucket(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy(ids.batch_bucket(F.col("o_orderkey")).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def q_time_bucket(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(ids.time_bucket(F.col("ts")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def q_stored_path(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "/data/lake/").otherwise("/elsewhere/"), F.col("page_id").cast("string")).alias("path"))
    s = ids.stored_path(F.col("path"), "/data")
    return p.select("page_id", s.alias("stored"), ids.resolved_path(s, "/data").alias("resolved"))


def q_pair_files(spark, sf):
    return lake.pair_files(files(spark, sf)).select("book_id", "dir", "header_path", "body_path")


def q_newest(spark, sf):
    return lake.newest_complete_copy(lake.pair_files(files(spark, sf)))


def q_locate_newest(spark, sf):
    one = files(spark, sf).agg(F.max("book_id").alias("b")).first()["b"]
    return lake.newest_complete_copy(lake.pair_files(files(spark, sf).where(F.col("book_id") == one)))


def q_disk_usage(spark, sf):
    return lake.disk_usage(files(spark, sf).withColumn("size", F.length("path").cast("long")), "lake")


def q_control_read(spark, sf):
    """Logs of a hundred documents each: some lines are bad, some repeat, the last one of every other log is torn."""
    d = docs(spark, sf).where("doc_id IS NOT NULL").select("doc_id").distinct()
    rows = d.groupBy(F.floor(F.col("doc_id") / 100).alias("log")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))  # a hundred ids at most
    line = lambda i: F.when(i % 5 == 0, F.concat(F.lit("bad"), i)).when(i % 5 == 1, F.concat(F.lit(" 00"), i, F.lit(" "))).when(i % 5 == 2, (i - 1).cast("string")).otherwise(i.cast("string"))
    whole = F.array_join(F.transform("ids", line), "\r\n")
    made = rows.select("log", F.concat(whole, F.when(F.col("log") % 2 == 0, "\n").otherwise("")).alias("content"))
    return control_log.read_ids(made).select("log", "pos", "book_id")


def q_ordered_dedup(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return sets.ordered_dedup(e.select("user_id", "event_id"), "user_id", "event_id")


def q_upsert_latest(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return metadata.upsert_latest(e.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


def q_metadata_layers(spark, sf):
    """Metadata of all documents, then two changes of some of them, read from their layers."""
    kept = MergeTable(spark, f"{shared_dir(spark)}/foliospark/metadata-{uuid.uuid4().hex}", METADATA)
    rows = mart(spark, sf)
    kept.upsert(rows)
    for step, every in ((1, 3), (2, 5)):
        kept.upsert(rows.where(F.col("book_id") % every == 0).withColumn("title", F.concat(F.lit(f"edition {step} of "), F.col("book_id").cast("string"))))
    return kept.read()


def q_list_books(spark, sf):
    return metadata.list_books(mart(spark, sf))


def q_find_by_id(spark, sf):
    return metadata.find_by_id(mart(spark, sf), 42)


def q_find_by_author(spark, sf):
    return metadata.find_by(mart(spark, sf), "author", "SRC1")


def q_find_by_title(spark, sf):
    return metadata.find_by(mart(spark, sf), "title", "THE ").select("book_id", "title")


def q_find_wildcard(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    return c.where(T.contains_literal(F.col("c_name"), "R#00000001") | T.contains_literal(F.col("c_name"), "%") | T.contains_literal(F.col("c_name"), "_"))


def q_path_by_title(spark, sf):
    return metadata.path_by_title(mart(spark, sf), "the ")


def q_corpus_join(spark, sf):
    b = mart(spark, sf).where("book_id % 5 <> 0").select("body_path", F.concat(F.lit("text of "), F.col("book_id").cast("string")).alias("text")).where("body_path IS NOT NULL")
    return metadata.corpus_join(mart(spark, sf), b)


def q_top_author(spark, sf):
    return metadata.top_author(mart(spark, sf))


def q_synthetic_metadata(spark, sf):
    m = mart(spark, sf)
    return metadata.synthetic_metadata(m.where("book_id = 42"), m.count())


def q_pending(spark, sf):
    return control.pending_books(downloaded(spark, sf), indexed(spark, sf))


def q_orphans(spark, sf):
    return control.orphan_indexed(downloaded(spark, sf), indexed(spark, sf))


def q_detect_pending(spark, sf):
    return control.detect_pending(lake.newest_complete_copy(lake.pair_files(files(spark, sf))), indexed(spark, sf))


def q_candidates(spark, sf):
    return control.download_candidates(downloaded(spark, sf), control.books_in(log(spark, sf), control.FAILED))


def q_drawn(spark, sf):
    """All candidates, drawn ten thousand at a time by a keyed permutation."""
    taken = downloaded(spark, sf).unionByName(control.books_in(log(spark, sf), control.FAILED))
    at, out = control.Draw(), []
    while at.turn == 0:
        found, at = control.draw_next(spark, taken, 70_000, 10_000, at, key=7)
        out += found
    return spark.createDataFrame([(i,) for i in out], "book_id long").distinct()


def q_indexable(spark, sf):
    failed_now = docs(spark, sf).where("doc_id % 4 = 0").select(F.col("doc_id").alias("book_id"))
    return control.indexable(control.pending_books(downloaded(spark, sf), indexed(spark, sf)), failed_now)


def q_snapshot_parity(spark, sf):
    """Two snapshots of the documents by language; in the second some values differ and some rows are gone."""
    one = docs(spark, sf).where("lang IS NOT NULL").select(F.col("lang").alias("section"), F.col("doc_id").alias("place"), F.col("source").alias("value"))
    two = one.where("place % 13 <> 0").withColumn("value", F.when(F.col("place") % 10 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return sets.snapshot_parity(one, two)


def q_next(spark, sf):
    return control.next_to_index(control.pending_books(downloaded(spark, sf), indexed(spark, sf)).select(F.col("book_id").cast("string").alias("book_id")))


def q_verify_resume(spark, sf):
    every = downloaded(spark, sf)
    return control.verify_resume(every, every.where("book_id % 2 = 0"), every.where("book_id % 2 = 1 AND book_id % 9 <> 0 OR book_id % 100 = 0"))


def q_state_summary(spark, sf):
    return control.state_summary(log(spark, sf))


def q_first_half(spark, sf):
    return sets.first_half(downloaded(spark, sf), "book_id")


def q_even_sample(spark, sf):
    return sets.even_sample(downloaded(spark, sf), "book_id", 10)


def q_sha256(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_MADE_HEADER = """'A preamble' || chr(10) || chr(10) || 'Title: Book' || chr(10) || '   ' || doc_id || '  of' || chr(9) || source || chr(13) || chr(10) || 'Author: ' || source || chr(10)
  || 'Author:  The ' || coalesce(lang, 'null') || chr(10) || chr(10) || ' lost' || chr(10) || 'Length: ' || coalesce(CAST(length(text) AS VARCHAR), 'null') || chr(10) || 'Language: English; German'"""
_HEADER_ROWS = f"""(SELECT CAST(book_id AS BIGINT) AS book_id, text FROM (VALUES {", ".join(f"({i}, {_q(t)})" for i, t in HEADERS)}) v(book_id, text)
  UNION ALL SELECT doc_id + {FIRST_MADE}, {_MADE_HEADER} FROM documents) h"""
_WS = "[\\s\\x1c-\\x1f]"
_PARSED = f"""
  lines AS (SELECT book_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS pos FROM {_HEADER_ROWS}),
  kinds AS (SELECT *, CASE WHEN trim(line, ' ' || chr(9)) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s') THEN 'more'
    WHEN regexp_matches(trim(line, ' ' || chr(9)), '^[A-Za-z][A-Za-z ]*?:') THEN 'field' ELSE 'other' END AS kind FROM lines),
  runs AS (SELECT *, sum(CASE WHEN kind <> 'more' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos) AS g FROM kinds),
  heads AS (SELECT book_id, g, pos, lower(trim(regexp_extract(trim(line), '^([A-Za-z][A-Za-z ]*?):', 1))) AS name, regexp_extract(trim(line), '^[A-Za-z][A-Za-z ]*?:[ \\t]*(.*)$', 1) AS value FROM runs WHERE kind = 'field'),
  fields AS (SELECT h.book_id, h.pos, h.name, trim(regexp_replace(h.value || coalesce(' ' || string_agg(trim(m.line, ' ' || chr(9)), ' ' ORDER BY m.pos), ''), '\\s+', ' ', 'g')) AS value
    FROM heads h LEFT JOIN runs m ON m.book_id = h.book_id AND m.g = h.g AND m.kind = 'more' GROUP BY h.book_id, h.pos, h.name, h.value)"""
_CODE = "CASE n " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in headers.LANGUAGE_CODES.items()) + " ELSE n END"
_WHOLE = "CASE l " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in headers.LANGUAGE_CODES.items()) + " END"


def _language_sql(source: str) -> str:
    """(k, code) of (k, raw) rows."""
    return f"""SELECT k, CASE WHEN l = '' THEN 'Unknown' ELSE coalesce({_WHOLE}, c, '') END AS code FROM (
      SELECT k, trim(regexp_replace(lower(coalesce(raw, '')), '\\s+', ' ', 'g')) AS l FROM ({source})) x LEFT JOIN (
      SELECT k AS k2, string_agg(code, ',' ORDER BY p) AS c FROM (SELECT k, code, min(p) AS p FROM (SELECT k, p, {_CODE} AS code FROM (
        SELECT k, unnest(s) AS n, generate_subscripts(s, 1) AS p FROM (SELECT k, regexp_split_to_array(trim(regexp_replace(lower(coalesce(raw, '')), '\\s+', ' ', 'g')), '\\s*,\\s*|\\s+and\\s+|\\s*;\\s*') AS s FROM ({source}))) WHERE n <> '') GROUP BY k, code) GROUP BY k) y ON x.k = y.k2"""


def _values(rows, names) -> str:
    def lit(v):
        return "NULL" if v is None else _q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({names})"


_START, _END = (m.replace("*", "\\*") for m in (T.START_MARKER, T.END_MARKER))
_BOOK_SPLIT = f"""SELECT book_id, trim(split_part(text, '{T.START_MARKER}', 1), ' ' || chr(10)) AS h, text[strpos(text, '{T.START_MARKER}') + {len(T.START_MARKER)}:] AS r, strpos(text, '{T.START_MARKER}') > 0 AS s FROM (SELECT CAST(book_id AS BIGINT) AS book_id, text FROM {_values(RAW_BOOKS, "book_id, text")}
  UNION ALL SELECT doc_id + {FIRST_MADE}, 'head of ' || doc_id || chr(10) || '{T.START_MARKER} [' || coalesce(text, '') || ']' || chr(10) || '{T.END_MARKER} x ***' || chr(10) || 'foot' FROM documents)"""

QUERIES = {
    "header_fields": q_header_fields, "extract_metadata": q_extract_metadata, "metadata_build": q_metadata_build, "normalize_language": q_normalize_language,
    "split_markers": q_split_markers, "normalize_book_id": q_normalize_book_id, "build_url": q_build_url, "classify_status": q_classify_status,
    "batch_bucket": q_batch_bucket, "time_bucket": q_time_bucket, "stored_path": q_stored_path, "pair_files": q_pair_files,
    "newest_complete_copy": q_newest, "locate_newest": q_locate_newest, "disk_usage": q_disk_usage, "control_read": q_control_read,
    "metadata_layers": q_metadata_layers, "ordered_dedup": q_ordered_dedup, "upsert_latest": q_upsert_latest, "list_books": q_list_books, "find_by_id": q_find_by_id,
    "find_by_author": q_find_by_author, "find_by_title": q_find_by_title, "find_literal_wildcards": q_find_wildcard, "path_by_title": q_path_by_title,
    "corpus_join": q_corpus_join, "top_author": q_top_author, "synthetic_metadata": q_synthetic_metadata, "pending_books": q_pending,
    "orphan_indexed": q_orphans, "detect_pending": q_detect_pending, "download_candidates": q_candidates, "next_to_index": q_next, "drawn_candidates": q_drawn, "indexable": q_indexable, "snapshot_parity": q_snapshot_parity,
    "verify_resume": q_verify_resume, "state_summary": q_state_summary, "first_half": q_first_half, "even_sample": q_even_sample, "sha256": q_sha256,
}

_LISTED = f"SELECT * FROM ({_MART}) WHERE body_path IS NOT NULL"
ORACLE = {
    "header_fields": f"WITH {_PARSED} SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS INTEGER) AS ordinal, name, value FROM fields",
    "extract_metadata": f"""WITH {_PARSED}, langs AS ({_language_sql(f"SELECT book_id AS k, (SELECT string_agg(value, ', ' ORDER BY pos) FROM fields f WHERE f.book_id = h.book_id AND name = 'language') AS raw FROM {_HEADER_ROWS}")})
        SELECT h.book_id, coalesce((SELECT arg_min(value, pos) FROM fields f WHERE f.book_id = h.book_id AND name = 'title' AND value <> ''), 'Unknown') AS title,
          coalesce(nullif((SELECT string_agg(value, '; ' ORDER BY pos) FROM fields f WHERE f.book_id = h.book_id AND name = 'author'), ''), 'Unknown') AS author, code AS language
        FROM {_HEADER_ROWS} JOIN langs ON langs.k = h.book_id""",
    "metadata_build": """SELECT doc_id AS book_id, 'Book ' || doc_id AS title, source AS author,
          CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr,es' WHEN 'es' THEN 'es' ELSE 'Unknown' END AS language,
          '2024-05-06 07:08:09' AS capture_date, 'h' AS header_path, '/other/' || doc_id AS body_path FROM documents""",
    "normalize_language": "SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr,en' ELSE 'klingon,es' END AS code FROM documents GROUP BY lang",
    "split_markers": f"""SELECT book_id, CASE WHEN ok THEN h END AS header, CASE WHEN ok THEN trim(split_part(r, '{T.END_MARKER}', 1), ' ' || chr(10)) END AS body, NOT ok AS failed
        FROM (SELECT *, s AND strpos(r, '{T.END_MARKER}') > 0 AS ok FROM ({_BOOK_SPLIT}))""",
    "normalize_book_id": "SELECT doc_id, CASE WHEN doc_id > 0 AND doc_id % 9 IN (0, 1, 5, 7) THEN CAST(doc_id AS VARCHAR) END AS book_id FROM documents",
    "build_url": "SELECT doc_id, 'https://www.gutenberg.org/cache/epub/' || doc_id || '/pg' || doc_id || '.txt' AS url FROM documents",
    "classify_status": """SELECT CAST(event_id % 600 AS INTEGER) AS status, count(*) AS n, CASE WHEN event_id % 600 = 200 THEN 'ok'
          WHEN event_id % 600 >= 400 AND event_id % 600 < 500 AND event_id % 600 NOT IN (408, 429) THEN 'permanent' ELSE 'transient' END AS class FROM events GROUP BY event_id % 600""",
    "batch_bucket": "SELECT 'batch_' || (o_orderkey // 1000 * 1000) || '_' || (o_orderkey // 1000 * 1000 + 999) AS batch, count(*) AS n FROM orders GROUP BY 1",
    "time_bucket": "SELECT strftime(ts, '%Y%m%d/%H') AS folder, count(*) AS n FROM events GROUP BY 1",
    "stored_path": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'lake/' || page_id ELSE '/elsewhere/' || page_id END AS stored, CASE WHEN page_id % 2 = 0 THEN '/data/lake/' || page_id ELSE '/elsewhere/' || page_id END AS resolved FROM pages",
    "pair_files": f"SELECT book_id, dir, header_path, body_path FROM ({_PAIRS})",
    "newest_complete_copy": f"SELECT book_id, arg_max(header_path, dir) AS header_path, arg_max(body_path, dir) AS body_path FROM ({_PAIRS}) GROUP BY book_id",
    "locate_newest": f"SELECT book_id, arg_max(header_path, dir) AS header_path, arg_max(body_path, dir) AS body_path FROM ({_PAIRS}) WHERE book_id = (SELECT max(o_custkey) FROM orders) GROUP BY book_id",
    "disk_usage": f"""WITH f AS (SELECT DISTINCT dir, dir || '/' || book_id || '_body.txt' AS path FROM ({_FILES}) UNION SELECT DISTINCT dir, dir || '/' || book_id || '_header.txt' FROM ({_FILES}) WHERE headed)
        SELECT sum(length(path)) / 1048576.0 AS size_mb, count(*) AS file_count, (SELECT count(*) FROM (SELECT dir FROM f UNION SELECT regexp_extract(dir, '^(.*)/', 1) FROM f)) AS dir_count FROM f""",
    "control_read": """WITH lines AS (SELECT doc_id, doc_id // 100 AS log, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos,
          count(*) OVER (PARTITION BY doc_id // 100) AS n FROM (SELECT DISTINCT doc_id FROM documents)),
        valid AS (SELECT log, pos, CASE WHEN doc_id % 5 = 2 THEN doc_id - 1 ELSE doc_id END AS id FROM lines WHERE doc_id % 5 <> 0 AND (log % 2 = 0 OR pos < n - 1))
        SELECT log, CAST(min(pos) AS INTEGER) AS pos, CAST(id AS VARCHAR) AS book_id FROM valid WHERE id > 0 GROUP BY log, id""",
    "ordered_dedup": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
    "upsert_latest": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "metadata_layers": f"""SELECT book_id, CASE WHEN book_id % 5 = 0 THEN 'edition 2 of ' || book_id WHEN book_id % 3 = 0 THEN 'edition 1 of ' || book_id ELSE title END AS title,
          author, language, capture_date, header_path, body_path FROM ({_MART})""",
    "list_books": _LISTED,
    "find_by_id": f"SELECT * FROM ({_LISTED}) WHERE book_id = 42",
    "find_by_author": f"SELECT * FROM ({_LISTED}) WHERE contains(author, 'src1')",
    "find_by_title": f"SELECT book_id, title FROM ({_LISTED}) WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ')",
    "find_literal_wildcards": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(c_name, '%') OR contains(c_name, '_')",
    "path_by_title": f"SELECT arg_min(body_path, book_id) AS body_path FROM ({_LISTED}) WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ')",
    "corpus_join": f"SELECT book_id, CASE WHEN book_id % 5 <> 0 THEN 'text of ' || book_id END AS text FROM ({_LISTED})",
    "top_author": f"SELECT author, count(*) AS n_books FROM ({_MART}) GROUP BY author ORDER BY count(*) DESC, min(book_id) LIMIT 1",
    "synthetic_metadata": f"SELECT 900000 + r AS book_id, title, author, language, capture_date, header_path, body_path FROM ({_MART}) m, range((SELECT count(*) FROM documents)) t(r) WHERE m.book_id = 42",
    "pending_books": f"SELECT DISTINCT doc_id AS book_id FROM documents WHERE doc_id NOT IN ({_INDEXED})",
    "orphan_indexed": f"SELECT DISTINCT book_id FROM ({_INDEXED}) WHERE book_id NOT IN (SELECT doc_id FROM documents)",
    "detect_pending": f"SELECT DISTINCT book_id FROM ({_PAIRS}) WHERE book_id NOT IN ({_INDEXED})",
    "download_candidates": "SELECT r AS book_id FROM range(1, 70001) t(r) WHERE r NOT IN (SELECT doc_id FROM documents) AND r NOT IN (SELECT doc_id + 60000 FROM documents WHERE doc_id % 11 = 0)",
    "drawn_candidates": "SELECT r AS book_id FROM range(1, 70001) t(r) WHERE r NOT IN (SELECT doc_id FROM documents) AND r NOT IN (SELECT doc_id + 60000 FROM documents WHERE doc_id % 11 = 0)",
    "indexable": f"SELECT DISTINCT doc_id AS book_id FROM documents WHERE doc_id NOT IN ({_INDEXED}) AND doc_id % 4 <> 0",
    "snapshot_parity": """SELECT lang AS section, doc_id AS place, source AS expected, CASE WHEN doc_id % 13 <> 0 THEN source || '!' END AS actual FROM documents
        WHERE lang IS NOT NULL AND (doc_id % 13 = 0 OR doc_id % 10 = 0 AND source IS NOT NULL)""",
    "next_to_index": f"SELECT min(doc_id) AS book_id FROM documents WHERE doc_id NOT IN ({_INDEXED})",
    "verify_resume": """WITH a AS (SELECT DISTINCT doc_id AS b FROM documents), p AS (SELECT b FROM a WHERE b % 2 = 0), r AS (SELECT b FROM a WHERE b % 2 = 1 AND b % 9 <> 0 OR b % 100 = 0)
        SELECT (SELECT count(*) FROM r WHERE b IN (SELECT b FROM p)) AS duplicated, (SELECT count(*) FROM a WHERE b NOT IN (SELECT b FROM p) AND b NOT IN (SELECT b FROM r)) AS lost""",
    "state_summary": f"""SELECT 'downloaded' AS state, count(DISTINCT doc_id) AS n_books FROM documents UNION ALL SELECT 'indexed', count(DISTINCT book_id) FROM ({_INDEXED})
        UNION ALL SELECT 'failed', count(DISTINCT doc_id) FROM documents WHERE doc_id % 11 = 0
        UNION ALL SELECT 'pending', count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN ({_INDEXED})""",
    "first_half": "SELECT doc_id AS book_id FROM documents ORDER BY doc_id LIMIT (SELECT count(*) // 2 FROM documents)",
    "even_sample": """WITH d AS (SELECT doc_id AS book_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents))
        SELECT book_id FROM d WHERE n <= 10 OR r IN (SELECT i * (n - 1) // 9 FROM range(10) t(i))""",
    "sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
}
