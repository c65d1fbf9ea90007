"""Queries of the text and index operators: `documents` are the books, their text the bodies."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import ids
from foliospark.functions import text as T
from foliospark.operators import digests, index, query, sets
from foliospark.session import shared_dir
from foliospark.sources import index_store, lake_source
from foliospark.sources.files import Files
from foliospark.sources.segments import SegmentedIndex

#: The registered workload: frequent, rarer, repeated, absent and wrongly cased terms.
WORKLOAD = """# the registered workload
thtion
andthe  # a comment behind a query
worthless pathetic

ering thtion nter
onon onon
absentterm onon
Thtion
ering
"""


def books(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("book_id"), "text")


def known(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("book_id")).distinct()


def workload(spark: SparkSession) -> DataFrame:
    return query.parse_queries(spark.createDataFrame([(WORKLOAD,)], "content string"))


_STORED: dict[tuple, str] = {}


def stored_index(spark: SparkSession, sf: str, part: str = "all") -> SegmentedIndex:
    """The stored index of the books (part `known`: of those with labels), built once an application and input.

    An input whose files have other names, lengths or times is another input.
    """
    key = (spark.sparkContext.applicationId, part, Files(spark, f"{sf}/documents.parquet").stamp(), Files(spark, f"{sf}/labels.parquet").stamp())
    if key not in _STORED:
        chosen = books(spark, sf) if part == "all" else books(spark, sf).join(known(spark, sf), "book_id", "left_semi")
        path = f"{shared_dir(spark)}/foliospark/index-{uuid.uuid4().hex}"
        SegmentedIndex(spark, path).replace(index.pairs(chosen), chosen)
        _STORED[key] = path
    return SegmentedIndex(spark, _STORED[key])


def _joined(index_: DataFrame) -> DataFrame:
    return index_.select("term", F.size("postings").cast("long").alias("n_books"), F.array_join("postings", ",").alias("postings"))


def q_tokenize(spark, sf):
    rows = books(spark, sf).select("book_id", T.tokenize(F.col("text")).alias("t"))
    weighted = F.aggregate(F.transform("t", lambda x, i: F.length(x).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.where(F.size("t") > 0).select(
        "book_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), weighted.alias("weighted")
    )


def q_normalize(spark, sf):
    t = books(spark, sf).select("book_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    return t.where(T.is_indexable(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def q_process_text(spark, sf):
    return books(spark, sf).select("book_id", F.array_join(T.process_text(F.col("text")), " ").alias("terms"))


def q_build_postings(spark, sf):
    return index.build_postings(books(spark, sf))


def q_index_arrays(spark, sf):
    return _joined(index.as_arrays(index.pairs(books(spark, sf))))


def q_first_seen(spark, sf):
    return index.term_first_seen(index.tokens(books(spark, sf)))


def q_unique_terms(spark, sf):
    return index.unique_terms(books(spark, sf)).select("book_id", F.array_join("terms", " ").alias("terms"))


def q_merge(spark, sf):
    b = books(spark, sf)
    left = index.build_postings(b.join(known(spark, sf), "book_id", "left_semi"))
    return index.merge_postings(left, index.build_postings(b.join(known(spark, sf), "book_id", "left_anti")))


def q_add_book(spark, sf):
    return stored_index(spark, sf, "known").with_books(books(spark, sf)).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_terms"))


def q_term_count(spark, sf):
    return index.term_count(index.pairs(books(spark, sf)))


def q_postings_sorted(spark, sf):
    return _joined(index.as_arrays(index.pairs(books(spark, sf)))).orderBy("term")


def q_synthetic_corpus(spark, sf):
    b = books(spark, sf)
    made = index.synthetic_corpus(b, 2 * b.count())
    return made.select("book_id", F.size(T.process_text(F.col("text"))).cast("long").alias("n_terms"))


def q_term_lookup(spark, sf):
    return stored_index(spark, sf).lookup("onon").select("book_id")


def q_multi_term_lookup(spark, sf):
    return _joined(stored_index(spark, sf).arrays(workload(spark)))


def q_conjunctive(spark, sf):
    asked = workload(spark)
    return query.listed_answers(asked, stored_index(spark, sf).conjunctive(asked))


def q_parse_queries(spark, sf):
    """Every document as a query file: its sentences are lines, what follows a comma is a comment."""
    made = F.translate(F.coalesce("text", F.lit("")), ".,", "\n#")
    parsed = query.parse_queries(books(spark, sf).select("book_id", made.alias("content")))
    return parsed.groupBy("book_id").agg(
        F.max("query_id").cast("long").alias("n_queries"), F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("term") * F.col("query_id") * F.col("ordinal")).alias("weighted")
    )


def grown_index(spark: SparkSession, sf: str) -> SegmentedIndex:
    """An index that three batches of books have made, the first one twice, and that was compacted then."""
    grown = SegmentedIndex(spark, f"{shared_dir(spark)}/foliospark/grown-{uuid.uuid4().hex}")
    batch = lambda i: books(spark, sf).where(F.pmod(F.xxhash64("book_id"), F.lit(3)) == i)
    for i in (0, 1, 0, 2):
        grown.add(batch(i))
    grown.compact(most=2)
    return grown


def q_index_batches(spark, sf):
    blocks = grown_index(spark, sf).blocks()
    return blocks.groupBy("term").agg(F.sum("n").alias("n_books"), F.min("first_id").alias("first_book"), F.max("last_id").alias("last_book"))


def q_conjunctive_batches(spark, sf):
    asked = workload(spark)
    return query.listed_answers(asked, grown_index(spark, sf).conjunctive(asked))


def q_stored_postings(spark, sf):
    return stored_index(spark, sf).postings()


def q_json_index(spark, sf):
    """The whole index written as one JSON object, and read again in splits."""
    path = f"{re.sub('^file:/+', '/', shared_dir(spark))}/foliospark/index-{uuid.uuid4().hex}.json"
    index_store.save_json(index.as_arrays(stored_index(spark, sf).postings()), path)
    return index_store.load_json(spark, path)


def q_lake_source(spark, sf):
    """Every document stored as a book through the lake's sink, and read again through its source."""
    lake_source.register(spark)
    root = f"{shared_dir(spark)}/foliospark/lake-{uuid.uuid4().hex}"
    made = books(spark, sf).where("book_id IS NOT NULL").select(
        "book_id", F.format_string("Title: Book %d\n", "book_id").alias("header"), F.col("text").alias("body"), F.lit("u").alias("source_url"), F.lit("2026-10-02 07:30:00").cast("timestamp").alias("downloaded_at")
    )
    options = {"path": root, "layout": "batch", "batch_size": "100"}
    made.write.format("lake").options(**options).mode("append").save()
    found = spark.read.format("lake").options(**options).load()
    return found.select("book_id", "folder", "header", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


def q_index_difference(spark, sf):
    """What the stored index of the labelled books lacks against the one of all, by ranges of terms."""
    return stored_index(spark, sf).difference(stored_index(spark, sf, "known"))


def q_range_digests(spark, sf):
    posts = stored_index(spark, sf).postings()
    return digests.range_digests(posts, F.floor(F.col("book_id") / 100), "term", "book_id").select("place", "n", F.col("total").cast("string").alias("total"), "mixed")


def q_term_file_path(spark, sf):
    t = index.pairs(books(spark, sf)).select("term").distinct()
    t = t.unionByName(spark.createDataFrame([("con",), ("cone",), ("lpt9",), ("nul",)], "term string"))
    return t.select("term", ids.term_file_path(F.col("term")).alias("path"), ids.term_of_file_name(ids.term_file_name(F.col("term"))).alias("back"))


def q_canonical(spark, sf):
    b = index.unique_terms(books(spark, sf))
    tokens = books(spark, sf).select("book_id", T.process_text(F.col("text")).alias("terms"))
    answers = query.query_answers(workload(spark), index.from_arrays(b.select(F.explode("terms").alias("term"), F.array("book_id").alias("postings"))))
    return sets.canonical_lines(tokens, answers).select("section", "line")


def q_first_difference(spark, sf):
    b = books(spark, sf)
    left = b.select(F.col("book_id").alias("line"), F.size(T.tokenize(F.col("text"))).alias("value"))
    right = b.select(F.col("book_id").alias("line"), F.size(T.process_text(F.col("text"))).alias("value"))
    return sets.first_difference(left, right)


_IGNORED = ", ".join(f"'{t}'" for t in T.IGNORED_TERMS)
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_TERMS = f"list_filter({_TOKENS}, lambda t: length(t) > 1 AND t NOT IN ({_IGNORED}))"
_POSTINGS = f"SELECT DISTINCT term, book_id FROM (SELECT unnest({_TERMS}) AS term, doc_id AS book_id FROM documents)"
_WORDS = [w for line in WORKLOAD.split("\n") if (w := line.split("#")[0].split())]
_WORKLOAD_SQL = "(VALUES " + ", ".join(f"({q + 1}, {i + 1}, '{t}')" for q, w in enumerate(_WORDS) for i, t in enumerate(w)) + ") q(query_id, ordinal, term)"
_ARRAYS = f"SELECT term, count(*) AS n_books, string_agg(CAST(book_id AS VARCHAR), ',' ORDER BY book_id) AS postings FROM ({_POSTINGS}) GROUP BY term"
_ANSWERS = f"""
SELECT e.query_id, coalesce(n, 0) AS n_books, coalesce(b, '') AS books FROM (SELECT DISTINCT query_id FROM {_WORKLOAD_SQL}) e LEFT JOIN (
  SELECT query_id, count(*) AS n, string_agg(CAST(book_id AS VARCHAR), ',' ORDER BY book_id) AS b FROM (
    SELECT query_id, book_id, count(DISTINCT p.term) AS m FROM ({_POSTINGS}) p JOIN {_WORKLOAD_SQL} ON q.term = p.term GROUP BY 1, 2) h
  JOIN (SELECT query_id, count(DISTINCT term) AS n_terms FROM {_WORKLOAD_SQL} GROUP BY 1) w USING (query_id)
  WHERE m = n_terms GROUP BY query_id) a USING (query_id)
"""
_BLANKS = "' ' || chr(9) || chr(13)"
_RESERVED = ", ".join(f"'{n}'" for n in ids.RESERVED_NAMES)

QUERIES = {
    "tokenize": q_tokenize, "normalize": q_normalize, "process_text": q_process_text, "build_postings": q_build_postings,
    "index_arrays": q_index_arrays, "term_first_seen": q_first_seen, "unique_terms": q_unique_terms, "merge_postings": q_merge,
    "add_book": q_add_book, "term_count": q_term_count, "postings_sorted": q_postings_sorted, "synthetic_corpus": q_synthetic_corpus,
    "term_lookup": q_term_lookup, "multi_term_lookup": q_multi_term_lookup, "conjunctive_query": q_conjunctive, "parse_queries": q_parse_queries,
    "term_file_path": q_term_file_path, "canonical_file": q_canonical, "first_difference": q_first_difference,
    "index_batches": q_index_batches, "conjunctive_batches": q_conjunctive_batches, "index_difference": q_index_difference,
    "range_digests": q_range_digests, "stored_postings": q_stored_postings, "json_index": q_json_index, "lake_source": q_lake_source,
}

ORACLE = {
    "tokenize": f"""SELECT book_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, CAST(sum(length(term) * pos) AS BIGINT) AS weighted
        FROM (SELECT doc_id AS book_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS pos FROM documents) GROUP BY book_id""",
    "normalize": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS}) AS term FROM documents) GROUP BY term",
    "process_text": f"SELECT doc_id AS book_id, array_to_string({_TERMS}, ' ') AS terms FROM documents",
    "build_postings": _POSTINGS,
    "index_arrays": _ARRAYS,
    "term_first_seen": f"""SELECT term, book_id, CAST(pos AS INTEGER) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY book_id, pos) AS r FROM (
          SELECT doc_id AS book_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) - 1 AS pos FROM documents)) WHERE r = 1""",
    "unique_terms": f"""SELECT d.doc_id AS book_id, coalesce(t.terms, '') AS terms FROM documents d LEFT JOIN (
        SELECT book_id, string_agg(term, ' ' ORDER BY p) AS terms FROM (SELECT book_id, term, min(pos) AS p FROM (
          SELECT doc_id AS book_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM documents) GROUP BY 1, 2) GROUP BY 1) t ON t.book_id = d.doc_id""",
    "merge_postings": _POSTINGS,
    "add_book": f"SELECT book_id, count(*) AS n_terms FROM ({_POSTINGS}) GROUP BY book_id",
    "term_count": f"SELECT count(DISTINCT term) AS n_terms FROM ({_POSTINGS})",
    "postings_sorted": _ARRAYS + " ORDER BY term",
    "synthetic_corpus": f"""WITH r AS (SELECT doc_id AS book_id, len({_TERMS}) AS n_terms, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
        SELECT book_id, n_terms FROM r UNION ALL SELECT 900000 + r, n_terms FROM r""",
    "term_lookup": f"SELECT book_id FROM ({_POSTINGS}) WHERE term = 'onon'",
    "multi_term_lookup": f"""SELECT w.term, coalesce(n_books, 0) AS n_books, coalesce(postings, '') AS postings
        FROM (SELECT DISTINCT term FROM {_WORKLOAD_SQL}) w LEFT JOIN ({_ARRAYS}) a ON a.term = w.term""",
    "conjunctive_query": _ANSWERS,
    "parse_queries": f"""WITH lines AS (SELECT doc_id, pos, trim(split_part(line, '#', 1), {_BLANKS}) AS line FROM (
          SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), '.,', chr(10) || '#'), chr(10)) AS l FROM documents))),
        queries AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM lines WHERE line <> ''),
        terms AS (SELECT doc_id, q, unnest(w) AS term, generate_subscripts(w, 1) AS o FROM (SELECT doc_id, q, regexp_split_to_array(line, '[ \\t\\r]+') AS w FROM queries))
        SELECT doc_id AS book_id, max(q) AS n_queries, count(*) AS n_terms, CAST(sum(length(term) * q * o) AS BIGINT) AS weighted FROM terms GROUP BY doc_id""",
    "index_batches": f"SELECT term, count(*) AS n_books, min(book_id) AS first_book, max(book_id) AS last_book FROM ({_POSTINGS}) GROUP BY term",
    "conjunctive_batches": _ANSWERS,
    "stored_postings": _POSTINGS,
    "json_index": _POSTINGS,
    "lake_source": """SELECT doc_id AS book_id, 'batch_' || (doc_id // 100 * 100) || '_' || (doc_id // 100 * 100 + 99) AS folder, 'Title: Book ' || doc_id || chr(10) AS header,
          sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL""",
    "index_difference": f"SELECT term, book_id, 'left' AS side FROM ({_POSTINGS}) WHERE book_id NOT IN (SELECT doc_id FROM labels)",
    "range_digests": f"""SELECT book_id // 100 AS place, count(*) AS n, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS total, bit_xor(h) AS mixed FROM (
          SELECT book_id, CAST('0x' || md5('=' || term || chr(9) || '=' || book_id)[:12] AS BIGINT) AS h FROM ({_POSTINGS})) GROUP BY 1""",
    "term_file_path": f"""SELECT term, upper(term[1]) || '/' || CASE WHEN term IN ({_RESERVED}) THEN term || '_' ELSE term END || '.txt' AS path, term AS back
        FROM (SELECT DISTINCT term FROM ({_POSTINGS}) UNION ALL VALUES ('con'), ('cone'), ('lpt9'), ('nul'))""",
    "canonical_file": f"""SELECT 0 AS section, 'tokens' || chr(9) || doc_id || chr(9) || array_to_string({_TERMS}, chr(9)) AS line FROM documents
        UNION ALL SELECT 1, 'postings' || chr(9) || term || chr(9) || postings FROM ({_ARRAYS})
        UNION ALL SELECT 2, 'query' || chr(9) || query_id || CASE WHEN books <> '' THEN chr(9) || books ELSE '' END FROM ({_ANSWERS})""",
    "first_difference": f"""SELECT doc_id AS line, CAST(len({_TOKENS}) AS INTEGER) AS "left", CAST(len({_TERMS}) AS INTEGER) AS "right" FROM documents
        WHERE len({_TOKENS}) <> len({_TERMS}) ORDER BY doc_id LIMIT 1""",
}
