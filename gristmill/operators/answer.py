"""Extractive answers with citations, built from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import DEFAULT_TOP_K
from ..functions.vectors import hash_embed
from .search import search

# The texts of an extractive answer.
HEADER = "Offline extractive mode: best matching passages:\n"
NO_MATCH = "No indexed content matches the question."


def _in_rank_order(value: Column) -> Column:
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), value.alias("line"))))
    return F.transform(ranked, lambda r: r["line"])


def answers(hits: DataFrame) -> DataFrame:
    """One row per question from at most ``k`` ranked hits each
    (``question_id, rank, source_file, text``)."""
    grouped = hits.groupBy("question_id").agg(
        F.array_join(
            _in_rank_order(
                F.concat(F.lit("- "), F.col("text"), F.lit(" [source: "), F.col("source_file"), F.lit("]"))
            ),
            "\n",
        ).alias("lines"),
        F.array_join(
            _in_rank_order(F.concat(F.lit("["), F.col("source_file"), F.lit("] "), F.col("text"))), "\n\n"
        ).alias("context"),
        F.array_sort(F.collect_set("source_file")).alias("sources"),
    )
    return grouped.select(
        "question_id",
        F.concat(F.lit(HEADER), F.col("lines")).alias("answer"),
        "sources",
        "context",
        F.lit("extractive").alias("mode"),
    )


def complete_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """As :func:`answers`, with the no-match text for questions without hits."""
    found = questions.select("question_id").join(answers(hits), "question_id", "left")
    return found.select(
        "question_id",
        F.coalesce("answer", F.lit(NO_MATCH)).alias("answer"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.lit("extractive").alias("mode"),
    )


def answer(chunks: DataFrame, question: str, k: int = DEFAULT_TOP_K, embedder=hash_embed) -> DataFrame:
    """Answer one question over the chunks."""
    hits = search(chunks, question, k, embedder)
    # At most k rows are left, so numbering them needs no distribution.
    ranked = hits.select(
        F.lit(0).cast("bigint").alias("question_id"),
        F.expr("row_number() over (order by score desc, source_file, chunk_ord)").alias("rank"),
        "source_file",
        "text",
    )
    one = chunks.sparkSession.range(1).select(F.col("id").alias("question_id"))
    return complete_answers(one, ranked)
