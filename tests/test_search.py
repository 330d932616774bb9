"""Vectors, exact top-k, answers."""

import math

from pyspark.sql import functions as F

from gristmill.functions.vectors import dot, hash_embed
from gristmill.operators.answer import answer
from gristmill.operators.chunks import transaction_chunks
from gristmill.operators.search import search, search_batch

TEXTS = [
    "Invoice HPW-31-01 from Heron Paper Works total 3915 AED",
    "courier dock badge card number desk",
    "courier dock badge card number desk",
    "",
    "Café à GO go GO 12",
    "heron " * 50 + "paper",
]


# The buckets of these tokens, worked out beforehand.
BUCKETS = {
    "01": 211, "12": 272, "31": 245, "3915": 133, "aed": 232, "badge": 172, "caf": 34, "card": 85,
    "courier": 10, "desk": 371, "dock": 335, "from": 60, "go": 107, "heron": 12, "hpw": 49, "invoice": 133,
    "is": 233, "known": 77, "nothing": 93, "number": 95, "open": 105, "paper": 211, "t0": 64, "t1": 247,
    "t2": 194, "t3": 265, "t4": 234, "t5": 288, "total": 222, "unknown": 74, "what": 198, "with": 297,
    "works": 228, "zzzz": 211,
}


def embed(text):
    """Unit vector of a text whose tokens are all in the table."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    counts = {}
    for w in words:
        counts[BUCKETS[w]] = counts.get(BUCKETS[w], 0) + 1
    length = math.dist([0] * len(counts), list(counts.values()))
    return [counts.get(k, 0) / length if counts else 0.0 for k in range(384)]


def chunk_table(spark):
    rows = [(f"f{i}", "documents", 0, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "source_file string, kind string, chunk_ord bigint, text string")
    return df.withColumn("embedding", hash_embed(F.col("text")))


def brute(question, k):
    q = embed(question)
    scored = [(round(sum(a * b for a, b in zip(q, embed(t))), 4), f"f{i}") for i, t in enumerate(TEXTS)]
    return [(f, s) for s, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def test_vectors_equal_plain_code(spark):
    for row in chunk_table(spark).collect():
        assert row["embedding"] == embed(row["text"])
    rows = spark.createDataFrame([("a a",), (None,)], "t string").select(hash_embed(F.col("t"), 7).alias("v")).collect()
    assert sorted(rows[0]["v"]) == [0.0] * 6 + [1.0] and rows[1]["v"] is None


def test_ties_at_four_digits_in_both_searches(spark):
    scores = [0.00015, 0.00035, 0.12345, 0.00025, 0.99995]
    rows = [(f"s{i}", "documents", 0, "t", [x, 1.0]) for i, x in enumerate(scores)]
    chunks = spark.createDataFrame(rows, "source_file string, kind string, chunk_ord bigint, text string, embedding array<double>")

    def unit(text):
        return F.array(F.lit(1.0), F.lit(0.0))

    want = sorted(((round(x, 4), f"s{i}") for i, x in enumerate(scores)), key=lambda x: (-x[0], x[1]))
    one = search(chunks, "q", k=5, embedder=unit).collect()
    questions = spark.createDataFrame([(1, "q")], "question_id bigint, question string")
    many = search_batch(chunks.repartition(2), questions, k=5, embedder=unit).orderBy("rank").collect()
    assert [(r["score"], r["source_file"]) for r in one] == want == [(r["score"], r["source_file"]) for r in many]


def test_dot_cuts_to_the_shorter(spark):
    row = spark.range(1).select(dot(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"))
    assert row.first()["d"] == 11.0


def test_search_equals_brute_force(spark):
    for question in ("what is open with Heron Paper Works", "courier badge", "zzzz unknown", "", " ".join(f"t{i}" for i in range(6))):
        got = search(chunk_table(spark), question, k=4).collect()
        assert [(r["source_file"], r["score"]) for r in got] == brute(question, 4)


def test_batch_equals_single_searches(spark):
    asked = ["heron paper", "courier badge", "nothing known", "go"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id bigint, question string")
    got = search_batch(chunk_table(spark).repartition(3), questions, k=2, block=3).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["source_file"], r["score"]) for r in got] == [
        (i, f, s) for i, q in enumerate(asked) for f, s in brute(q, 2)
    ]


def test_answer(spark):
    row = answer(chunk_table(spark), "heron paper", k=2).first()
    assert row["mode"] == "extractive" and row["sources"] == ["f0", "f5"]
    assert row["answer"].splitlines()[1] == f"- {TEXTS[5]} [source: f5]"
    empty = answer(chunk_table(spark).where("false"), "heron").first()
    assert empty["answer"] == "No indexed content matches the question." and empty["sources"] == []


def test_transaction_chunk(spark):
    rows = [("f", "2026-01-02", 1.5, "B", "x"), ("f", "2026-01-01", None, "A", "x"), ("f", None, 2.0, "B", None)]
    df = spark.createDataFrame(rows, "source_file string, date string, amount double, merchant string, category string")
    assert transaction_chunks(df).first()["text"] == (
        "Transactions file f: 3 rows from 2026-01-01 to None, total 3.50, merchants A, B, categories None, x."
    )


def test_long_texts_meet_in_small_batches(spark):
    """A worker never holds thousands of long texts at once, for one question or many."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.pandas_udf("array<double>")
    def met(texts):
        return texts.map(lambda _: [float(len(texts))])

    def chunks():
        rows = spark.range(0, 300, 1, 1).selectExpr("concat('f', id) AS source_file", "'documents' AS kind", "id AS chunk_ord", "repeat('long ', 20000) AS text")
        return rows.withColumn("embedding", met(F.col("text")))

    one = lambda text: F.array(F.lit(1.0))
    asked = spark.createDataFrame([(1, "q")], "question_id bigint, question string")
    for search_all in (lambda: search(chunks(), "q", 1, one), lambda: search_batch(chunks(), asked, 1, one)):
        before = spark.conf.get(key)
        spark.conf.unset(key)
        try:
            assert search_all().first()["score"] <= 60
        finally:
            spark.conf.set(key, before)
