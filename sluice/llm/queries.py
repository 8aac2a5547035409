"""Driver queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from . import decontaminate, lm_scoring, mixing, near_duplicates, substring_dedup, token_counts, topk_search, toxicity, url_filter, warc
from .common import crc_mod, read

URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]
#: target token shares of the quality labels' domains
MIX_WEIGHTS = {1: 0.97, 0: 0.03}
TOKEN_MODEL = "piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), k=20, query_mod=20, scale=64.0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by strings of 400 bytes, and ``passage_bytes``: bytes in runs of 50
    words that stand anywhere else too, which may be shorter than 400 bytes."""
    rows, (cuts, passages) = substring_dedup.cuts_by_kind(read(spark, sf_dir, "documents"), ((400, substring_dedup.BYTES), (50, substring_dedup.WORDS)))
    passages = passages.select("x1", "x2", F.col("removed").alias("in_passages"))
    out = rows.join(cuts, ["x1", "x2"], "left").join(passages, ["x1", "x2"], "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select("doc_id", "n_bytes", count("removed", "n_removed"), count("spans", "n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"), count("in_passages", "passage_bytes"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class (least doc_id of the linked documents) and number of links."""
    out = near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8, words=5)
    return out.select("doc_id", "class_id", "n_links")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), MIX_WEIGHTS, label="quality")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    train = crc_mod(F.col("doc_id"), 5) != 0
    out = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), train)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKEN_MODEL)), limit=4096)


def _shipped(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), sf_dir)

    return query


QUERIES = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_url_filter": op3_url_filter,
    "op4_lm_score": op4_lm_score,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

QUERIES = {name: _shipped(f) for name, f in QUERIES.items()}

_ALPHABET = warc.BASE32
# base32 of the 160 bits of a SHA-1, five at a time
_BASE32_SQL = f"""
array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1 + cast(
    16 * cast(substr(bits, 5 * i + 1, 1) AS INT) + 8 * cast(substr(bits, 5 * i + 2, 1) AS INT) + 4 * cast(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * cast(substr(bits, 5 * i + 4, 1) AS INT) + cast(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '')"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, j, 1)) - 1) + 1, 4)), '') AS bits FROM h)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b""",
    "op2_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * cast(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
