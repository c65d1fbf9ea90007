"""The registered queries of the training-data operators, each on its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import crc_bucket, digest, rendered, table

#: Words of a text in DuckDB: A-Z folded, runs outside space and \\t..\\r.
SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.ngram_join import similar_documents

    found = similar_documents(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


OP8_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM sets
  UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    base = F.filter("spans", lambda s: F.array_contains(F.array(*[F.lit(k) for k in pii.BASE]), s["kind"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE],
        digest(rendered(base, list(pii.BASE))).alias("base_sha256"),
        rendered(F.col("spans"), list(pii.KINDS)).alias("spans"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH turns AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|', '<\\|') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, replace(coalesce(text, ''), '<|', '<\\|')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE conv_id IS NOT NULL AND role <> 'system'),
pieces AS (
  SELECT t.conv_id, perspective, place // 256 AS segment, place, coalesce(role = perspective, false) AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user|> ' || coalesce(role, 'unknown') || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM turns t JOIN who USING (conv_id)),
ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place) AS e FROM pieces)
SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg((CAST(e AS BIGINT) - length(body)) || ':' || CAST(e AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS masks
FROM ends GROUP BY conv_id, perspective, segment
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("threshold")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm import secrets

    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        digest(rendered(base, list(secrets.KINDS))).alias("base_sha256"),
        rendered(F.col("spans"), [*secrets.KINDS, "crf"]).alias("spans"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.lm import score_texts

    fold = crc_bucket(F.col("doc_id"), 10)
    return score_texts(table(spark, sf_dir, "documents"), held_out=fold == 0, deleted=fold == 1)[0]


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def license_base_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_license_scan(spark, sf_dir).drop("labels", "score")


LICENSE_BASE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(label, p) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place
  FROM words, phrases WHERE list_has_all(w, p)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM words LEFT JOIN base USING (doc_id)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.negatives import hard_negatives

    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP12_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND n.label <> n.own
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.spelling import group_variants, words

    return group_variants(words(table(spark, sf_dir, "documents"), every=97))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.langid import label_languages, train

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    found = label_languages(docs, train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


# what of op1, op4 and op5 does not depend on a fitted model, for which there is SQL


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii_boosting(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_BASE_SQL = r"""
WITH found AS (
  SELECT doc_id,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) AS phone
  FROM documents)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false))) = 4)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda d: len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(d)), lambda i:
    CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INTEGER)
      ELSE CAST(d[len(d) - i] AS INTEGER) * 2 - CASE WHEN CAST(d[len(d) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda d: len(d) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM found
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


URL_RULES_SQL = r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(h, p) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY len(h || p) DESC LIMIT 1) AS rule
FROM split
"""


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_BASE_SQL = r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''),
    '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1),
    lambda v: len(v) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: len(v) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: len(v) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_boosting": op1_pii_boosting,
    "op2_decontamination": op2_decontamination,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_source_mixing": op9_source_mixing,
    "op10_inverted_multi_index": op10_inverted_multi_index,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
    "pii_base_counts": pii_base_counts,
    "url_rules": url_rules,
    "secret_base_counts": secret_base_counts,
    "license_base_labels": license_base_labels,
}
ORACLE: dict[str, str] = {
    "op3_chat_perspectives": OP3_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op12_hard_negatives": OP12_SQL,
    "pii_base_counts": PII_BASE_SQL,
    "url_rules": URL_RULES_SQL,
    "secret_base_counts": SECRET_BASE_SQL,
    "license_base_labels": LICENSE_BASE_SQL,
}
