"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fmindex, html, language, licences, merkle, packing, patterns, pseudonyms, simhash, toxicity, turns, vafile, yinyang
from quillspark.llm.common import read_table

#: The setting that names the secret of pseudonyms; Spark hides settings of that name.
SECRET = "spark.quillspark.pseudonyms.secret"


def pseudonym_key(spark: SparkSession) -> str:
    """The secret that is set; without one the session draws its own, so its pseudonyms agree with each
    other and with those of no other session."""
    if not spark.conf.get(SECRET, ""):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` for the audit: the payload's hash says which records it lacks or has changed."""
    start = F.substring(F.sha2("html", 256), 1, 2)
    kept = pages.where(F.col("html").isNull() | (start != "01"))
    changed = F.when(start == "00", F.concat("html", F.lit("\n"))).otherwise(F.col("html"))
    return kept.select("page_id", "url", changed.alias("html"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return merkle.audit(pages, damaged(pages))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.compress(read_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damaged(read_table(spark, sf_dir, "conversations")), F.col("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_licence_scan, op3_merkle_audit, op4_simhash, op5_pseudonyms, op6_vafile, op7_main_text, op8_packing, op9_decontamination, op10_toxicity, op11_pattern_packing, op12_vector_codes, op13_conversation_repair, pipeline]
    return {f.__name__: f for f in ops}


_MERKLE = r"""
WITH records AS (
  SELECT page_id, html, sha256(html) AS h, page_id >> 12 AS segment,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head
  FROM pages
), sized AS (
  SELECT *, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS body FROM records
), placed AS (
  SELECT *, strlen(body) AS size, coalesce(sum(strlen(body)) OVER (PARTITION BY segment ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM sized
)
SELECT page_id, CASE WHEN h LIKE '00%' THEN 'corrupt' ELSE 'missing' END AS status, segment, place::BIGINT AS "offset", size::BIGINT AS size,
  sha256(body) AS expected,
  CASE WHEN h LIKE '00%' THEN sha256(head || (strlen(html) + 1) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(10)) END AS found
FROM placed WHERE h LIKE '00%' OR h LIKE '01%'"""

_TOP = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_LEAKS = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark WHERE text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+'), []) AS w FROM documents
), places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (
  SELECT s.r, s.i, p.n, p.item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places, (SELECT DISTINCT n FROM phrases) WHERE i + n - 1 <= len(w)) s JOIN phrases p ON s.t = p.p AND s.n = p.n
), words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""


def oracle_sql() -> dict[str, str]:
    """Language models, hashes of 64 bits, keyed permutations, page markup and tokenizers have no
    SQL; their queries are tested against brute force in tests/llm."""
    return {"op2_licence_scan": licences.sql(), "op3_merkle_audit": _MERKLE, "op6_vafile": _TOP, "op9_decontamination": _LEAKS, "op12_vector_codes": yinyang.sql(), "op13_conversation_repair": turns.sql()}
