"""Corpus pipeline: reject toxic documents, keep one document of each near-copy group, sanitise, mix, encode.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe_codec, jaccard_join, mixing, sanitize, toxicity
from gristmill.llm.queries import tokenizer_path
from gristmill.session import stage


# Near copies: shingles of five words, linked from 80 hundredths on.
SHINGLE_WORDS, PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model doesn't reject; it learns from the labelled rows among them."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose id is the smallest of its component; rows without an id stay, and of rows that repeat an id one for each text."""
    ids = stage(jaccard_join.jaccard_components(docs, SHINGLE_WORDS, PERCENT), "components")
    gone = ids.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return jaccard_join.without_ids(docs, stage(gone, "gone"), stage(repeated, "repeated"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and disclosing terms generalised or removed."""
    return sanitize.sanitized(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: once an epoch, and once more if the fractional selection has it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text's tokens, and digests of the ids and of what they decode to."""
    return bpe_codec.digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Learned models and byte-pair encoding are not SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
