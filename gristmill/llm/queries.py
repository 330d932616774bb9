"""The registered queries of the operators, each with its check SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe_codec, cap_filters, conversations, jaccard_join, language_id, lm_score, mixing, quality_gam, sanitize, token_files, topk_search, toxicity, whitening
from gristmill.llm.jaccard_join import jaccard_components


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(_documents(spark, sf_dir), tokenizer_path())


def op9_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.span_digests(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.predicted(docs, language_id.train(docs))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_gam.scored(docs, quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(_documents(spark, sf_dir))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.write(_documents(spark, sf_dir), tokenizer_path()))


QUERIES = {
    "op4_cap_filters": op4_cap_filters,
    "op6_topk_search": op6_topk_search,
    "op3_lm_score": op3_lm_score,
    "op1_language_id": op1_language_id,
    "op7_quality_gam": op7_quality_gam,
    "op2_toxicity": op2_toxicity,
    "op5_mixing": op5_mixing,
    "op9_sanitize": op9_sanitize,
    "op8_jaccard_join": op8_jaccard_join,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_whitening": op11_whitening,
    "op12_conversations": op12_conversations,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {
    "op5_mixing": mixing.ORACLE_SQL,
    "op6_topk_search": topk_search.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op12_conversations": conversations.ORACLE_SQL,
}
