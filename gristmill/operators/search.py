"""Exact top-k search over chunk vectors, for one question or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import DEFAULT_TOP_K
from ..functions.text import round_half_even
from ..functions.vectors import dot_literal, hash_embed
from ..session import bounded_batches

SCORE_DIGITS = 4
# Questions scored per pass over the chunks.  A block is at most this many
# vectors (50 MB at 384 dimensions), which bounds what is broadcast; more
# questions mean more passes.  Tasks multiply a slice of the block at a time.
QUESTION_BLOCK = 16384
QUESTION_SLICE = 256


def embed_question(spark: SparkSession, question: str, embedder=hash_embed) -> list[float]:
    """The vector of one question, by the same expression that embeds chunks."""
    row = spark.range(1).select(embedder(F.lit(question)).alias("v")).first()
    return [float(v) for v in row["v"]]


def search(chunks: DataFrame, question: str, k: int = DEFAULT_TOP_K, embedder=hash_embed) -> DataFrame:
    """The ``k`` best chunks: ``source_file, kind, text, score`` with ties in
    (file, chunk) order.  Every chunk is scored and there is no score floor."""
    bounded_batches(chunks.sparkSession)
    weights = embed_question(chunks.sparkSession, question, embedder)
    score = round_half_even(dot_literal(F.col("embedding"), weights), SCORE_DIGITS)
    return (
        chunks.select("source_file", "kind", "chunk_ord", "text", score.alias("score"))
        .orderBy(F.desc("score"), "source_file", "chunk_ord")
        .limit(k)
    )


def search_batch(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    embedder=hash_embed,
    block: int = QUESTION_BLOCK,
) -> DataFrame:
    """The ``k`` best chunks for each question (``question_id, question``).

    Chunks never move: each task multiplies its Arrow batches with a block of
    question vectors and keeps its best ``k`` per question over all of them, so
    what is shuffled is a few rows per question and task, never all pairs.
    Texts are joined back for the winners alone.
    """
    spark = chunks.sparkSession
    bounded_batches(spark)
    vectors = questions.select("question_id", embedder(F.col("question")).alias("v"))
    schema = "question_id bigint, source_file string, chunk_ord bigint, score double"
    best = spark.createDataFrame([], schema)
    for ids, matrix in _blocks(vectors, block):
        best = best.unionByName(
            chunks.select("source_file", "chunk_ord", "embedding").mapInPandas(
                _block_scorer(spark.sparkContext.broadcast(matrix.tobytes()), ids, k), schema
            )
        )
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source_file", "chunk_ord")
    winners = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return winners.join(
        chunks.select("source_file", "chunk_ord", "kind", "text"), ["source_file", "chunk_ord"]
    ).select("question_id", "rank", "source_file", "kind", "chunk_ord", "text", "score")


def _blocks(vectors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Question vectors in bounded blocks; one block at a time on the driver."""
    ids, rows = [], []
    for row in vectors.toLocalIterator():
        ids.append(row["question_id"])
        rows.append(np.asarray(row["v"], dtype=np.float64))
        if len(ids) == size:
            yield np.asarray(ids), np.vstack(rows)
            ids, rows = [], []
    if ids:
        yield np.asarray(ids), np.vstack(rows)


def rounded(scores: np.ndarray) -> np.ndarray:
    """Exact rounding to ``SCORE_DIGITS``, the same rule as ``round_half_even``: only
    scores beside a tie need the slow exact form."""
    scale = 10.0**SCORE_DIGITS
    out = np.rint(scores * scale) / scale
    beside = np.abs(np.abs(scores * scale) % 1.0 - 0.5) < 1e-6
    out[beside] = [round(x, SCORE_DIGITS) for x in scores[beside].tolist()]
    return out


def _block_scorer(shared, ids: np.ndarray, k: int):
    """Best ``k`` chunks per question over all batches of a task."""
    columns = ["question", "score", "source_file", "chunk_ord"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        questions = np.frombuffer(shared.value).reshape(len(ids), -1)
        best = pd.DataFrame({c: [] for c in columns})
        for batch in batches:
            if batch.empty:
                continue
            # Sort once, so that a stable sort by score keeps ties in order.
            batch = batch.sort_values(["source_file", "chunk_ord"], kind="stable")
            files, ords = batch["source_file"].to_numpy(), batch["chunk_ord"].to_numpy()
            vectors = np.vstack(batch["embedding"].to_numpy())
            found = []
            for start in range(0, len(ids), QUESTION_SLICE):
                part = slice(start, start + QUESTION_SLICE)
                scores = rounded(vectors @ questions[part].T)
                top = np.argsort(-scores, axis=0, kind="stable")[:k]
                asked = np.arange(len(ids))[part]
                values = np.take_along_axis(scores, top, axis=0).ravel()
                found.append(pd.DataFrame(dict(zip(columns, (np.tile(asked, len(top)), values, files[top].ravel(), ords[top].ravel())))))
            best = pd.concat([x for x in (best, *found) if len(x)])
            best = best.sort_values(columns, ascending=[True, False, True, True], kind="stable").groupby("question").head(k)
        if len(best):
            at = best["question"].to_numpy().astype(int)
            yield pd.DataFrame({"question_id": ids[at], **{c: best[c].to_numpy() for c in columns[2:]}, "score": best["score"].to_numpy()})

    return score
