"""Vectors, top-k search and extractive answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round_half_even
from ..functions.vectors import dot, hash_embed
from ..operators.answer import answers
from ..operators.search import search, search_batch
from ..session import spread
from .feeds import table
from .oracle_parts import hashed

QUESTION = "What is the total of the invoice and when is it due?"


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk with its vector."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("source_file"),
        F.lit("documents").alias("kind"),
        F.col("doc_id").alias("chunk_ord"),
        "text",
        hash_embed(F.col("text")).alias("embedding"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "text AS question")


def _sparse(df: DataFrame, key: str) -> DataFrame:
    vectors = spread(df).select(key, F.posexplode_outer(hash_embed(F.col("text"))).alias("bucket", "weight"))
    return vectors.where("weight > 0").select(
        key, F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight")
    )


def hash_embed_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten stored vectors nearest to vector 0."""
    stored = table(spark, sf_dir, "embeddings")
    query = stored.where("vec_id = 0").select("embedding").scalar()
    score = round_half_even(dot(F.col("embedding"), F.col("query")), 4)
    return (
        stored.withColumn("query", query)
        .select("vec_id", "label", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    )


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(document_chunks(spark, sf_dir), QUESTION, k=10)
    return hits.select("source_file", "kind", F.md5("text").alias("text_md5"), "score")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_batch(document_chunks(spark, sf_dir), questions(spark, sf_dir))


def search_batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select(
        "question_id", F.col("rank").cast("bigint").alias("rank"), "source_file", F.md5("text").alias("text_md5"), "score"
    )


def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited answers to every benchmark text."""
    return answers(_batch(spark, sf_dir)).select(
        "question_id", "answer", F.array_join("sources", ",").alias("sources"), F.md5("context").alias("context_md5"), "mode"
    )


QUERIES = {
    "hash_embed": hash_embed_benchmark,
    "hash_embed_documents": hash_embed_documents,
    "cosine_topk": cosine_topk,
    "search_documents": search_documents,
    "search_batch": search_batch_documents,
    "answer_extractive": answer_extractive,
}

# A document without any token scores zero, hence the left joins.
_SCORES = f"""
src_d AS (SELECT doc_id AS id, text FROM documents),
{hashed('src_d', 'dv')},
src_q AS (SELECT item_id AS id, text FROM benchmark),
{hashed('src_q', 'qv')},
pairs AS (SELECT q.id AS question_id, d.id AS doc_id, sum(d.weight * q.weight) AS s
          FROM qv q JOIN dv d ON d.bucket = q.bucket GROUP BY ALL),
scored AS (SELECT q.id AS question_id, d.id AS doc_id, 'doc_' || d.id AS source_file, d.text,
                  round_even(coalesce(s, 0.0), 4) AS score
           FROM src_q q CROSS JOIN src_d d LEFT JOIN pairs p ON p.question_id = q.id AND p.doc_id = d.id),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_file, doc_id) AS rank FROM scored
         QUALIFY rank <= 3)"""

ORACLES = {
    "hash_embed": f"""
        WITH src AS (SELECT item_id AS id, text FROM benchmark), {hashed('src', 'v')}
        SELECT id AS item_id, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM v""",
    "hash_embed_documents": f"""
        WITH src AS (SELECT doc_id AS id, text FROM documents), {hashed('src', 'v')}
        SELECT id AS doc_id, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM v""",
    "cosine_topk": """
        SELECT vec_id, label, round_even(list_inner_product(CAST(embedding AS DOUBLE[]),
                 (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 4) AS score
        FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""",
    "search_documents": f"""
        WITH src_d AS (SELECT doc_id AS id, text FROM documents), {hashed('src_d', 'dv')},
        src_q AS (SELECT 0 AS id, '{QUESTION}' AS text), {hashed('src_q', 'qv')},
        s AS (SELECT d.id, sum(d.weight * q.weight) AS s FROM dv d JOIN qv q ON d.bucket = q.bucket GROUP BY ALL)
        SELECT 'doc_' || d.id AS source_file, 'documents' AS kind, md5(d.text) AS text_md5, round_even(coalesce(s, 0.0), 4) AS score
        FROM src_d d LEFT JOIN s ON s.id = d.id ORDER BY score DESC, source_file, d.id LIMIT 10""",
    "search_batch": f"""
        WITH {_SCORES}
        SELECT question_id, rank, source_file, md5(text) AS text_md5, score FROM hits""",
    "answer_extractive": f"""
        WITH {_SCORES}
        SELECT question_id, 'Offline extractive mode: best matching passages:' || chr(10)
                 || string_agg('- ' || text || ' [source: ' || source_file || ']', chr(10) ORDER BY rank) AS answer,
               string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS sources,
               md5(string_agg('[' || source_file || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
               'extractive' AS mode
        FROM hits GROUP BY question_id""",
}
