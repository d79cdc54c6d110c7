"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, embeddings, filter_audit, language, licenses, packing, pages, pii, quality, sharding,
               simhash, substrings, vector_codes)
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) with at least 0.8 of the item's five-word shingles in the document."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id of its near-duplicate group."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score from trees fitted on labels that are not held out."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's number of links at cosine 0.98 and the smallest vec_id of its component."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that start earlier."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 8, and of 9 after growth."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.topology(8), sharding.topology(9))
    return placed.withColumn("law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in a document, with its place and the share of the template it holds."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's personal data: counts and hash of the base spans, all spans, and their scores."""
    base = pii.base_spans("spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return pii.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every tokenised document with its place in a sequence of at most 2,048 tokens."""
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), TOKENIZER))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code of 16 parts, its error, its label's error, and the digest of the codebooks."""
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language from a network fitted on documents that are not held out."""
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's documents kept, removed and so on by every step of all 120 orders of five filters."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_simhash, op3_quality, op4_embeddings,
                             op5_substrings, op6_sharding, op7_licenses, op8_pii, op9_packing, op10_html,
                             op11_vector_codes, op12_language, op13_filter_audit)}



def _codes_sql() -> str:
    """Two rounds of codebooks as plain k-means steps over all entries, then the codes."""
    nearest = """
c{r} AS (SELECT vec_id, label, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT v.vec_id, v.label, v.part, v.x, b.entry,
               list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v JOIN b{r} b ON b.part = v.part)
  GROUP BY vec_id, label, part, x)"""
    moved = """
s{r} AS (SELECT part, entry, list(m ORDER BY pos) AS x
  FROM (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS m
        FROM (SELECT part, entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS n
              FROM c{p}, (SELECT unnest(range(1, 65)) AS pos) WHERE pos <= len(x) GROUP BY part, entry, pos))
  GROUP BY part, entry),
b{r} AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM b{p} b LEFT JOIN s{r} s USING (part, entry))"""
    return """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x
      FROM k, (SELECT unnest(range(16)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
b0 AS (SELECT part, entry, x FROM v JOIN f USING (vec_id)),""" + ",".join(
        nearest.format(r=r) + ("," + moved.format(p=r, r=r + 1) if r < 2 else "") for r in range(3)) + """,
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
             sum(d)::BIGINT AS error FROM c2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


_AUDIT_SQL = """
WITH RECURSIVE p AS (SELECT '' AS filter_order UNION ALL
  SELECT filter_order || l FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part, [
        len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w),
l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic
      FROM labels GROUP BY doc_id),
d AS (SELECT part, list_sum(list_transform(fails, lambda x: x::INT))::INT AS k, fails, coalesce(good, false) AS good,
             coalesce(toxic, false) AS toxic FROM m LEFT JOIN l USING (doc_id)),
t AS (SELECT part, filter_order, step, good, toxic, k,
             fails[instr('ABCDE', filter_order[step])] AS fail,
             len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) > 0 AS gone
      FROM d, (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p WHERE len(filter_order) = 5)),
r AS (SELECT part, filter_order, step, filter_order[step] AS f, count(*) FILTER (NOT fail AND NOT gone) AS kept,
             count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
             count(*) FILTER (fail AND k = 1) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good) AS good_lost,
             count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost
      FROM t GROUP BY part, filter_order, step)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

_LOWER_WORDS = "regexp_extract_all(lower({}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM e GROUP BY u)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""",
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS.format("text")} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k,
              unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
       FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2),
              lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
       FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles,
       count(*) / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9""",
    "op11_vector_codes": _codes_sql(),
    "op13_filter_audit": _AUDIT_SQL,
}
