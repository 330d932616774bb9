"""One retrievable text per loaded unit, and its vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_double, text_or_none, two_decimals
from ..functions.vectors import hash_embed


def invoice_chunks(invoices: DataFrame) -> DataFrame:
    text = F.format_string(
        "Invoice %s from %s: total %s %s, invoice date %s, due date %s.",
        text_or_none(F.col("invoice_number")),
        text_or_none(F.col("vendor")),
        text_or_none(plain_double(F.col("total_amount"))),
        text_or_none(F.col("currency")),
        text_or_none(F.col("invoice_date")),
        text_or_none(F.col("due_date")),
    )
    return invoices.select(
        "source_file", F.lit("invoices").alias("kind"), F.col("pos").alias("chunk_ord"), text.alias("text")
    )


def mail_chunks(documents: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Email from "), text_or_none(F.col("sender")),
        F.lit(" on "), text_or_none(F.col("date")),
        F.lit(", subject '"), text_or_none(F.col("subject")),
        F.lit("': "), text_or_none(F.col("body")),
    )
    return documents.select(
        "source_file", F.lit("documents").alias("kind"), F.col("pos").alias("chunk_ord"), text.alias("text")
    )


def transaction_chunks(transactions: DataFrame) -> DataFrame:
    """One text per file.

    The name lists are made distinct across all tasks before a file's names
    meet, so a hot file sends each name once rather than once per row.
    """
    totals = transactions.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(text_or_none(F.col("date"))).alias("first"),
        F.max(text_or_none(F.col("date"))).alias("last"),
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("total"),
    )
    names = (
        transactions.select(
            "source_file",
            F.explode(
                F.array(
                    F.struct(F.lit(True).alias("is_merchant"), text_or_none(F.col("merchant")).alias("name")),
                    F.struct(F.lit(False).alias("is_merchant"), text_or_none(F.col("category")).alias("name")),
                )
            ).alias("n"),
        )
        .select("source_file", "n.*")
        .distinct()
        .groupBy("source_file")
        .agg(
            _joined(F.when(F.col("is_merchant"), F.col("name"))).alias("merchants"),
            _joined(F.when(~F.col("is_merchant"), F.col("name"))).alias("categories"),
        )
    )
    text = F.concat(
        F.lit("Transactions file "), F.col("source_file"), F.lit(": "), F.col("n"),
        F.lit(" rows from "), F.col("first"), F.lit(" to "), F.col("last"),
        F.lit(", total "), two_decimals(F.col("total")),
        F.lit(", merchants "), F.col("merchants"),
        F.lit(", categories "), F.col("categories"), F.lit("."),
    )
    return totals.join(names, "source_file").select(
        "source_file",
        F.lit("transactions").alias("kind"),
        F.lit(0).cast("bigint").alias("chunk_ord"),
        text.alias("text"),
    )


def _joined(names):
    return F.array_join(F.array_sort(F.collect_list(names)), ", ")


def chunks(records: dict[str, DataFrame], embedder=hash_embed) -> DataFrame:
    """All chunks with vectors: ``source_file, kind, chunk_ord, text, embedding``.

    ``embedder`` is a ``Column -> Column`` function from text to a vector.
    """
    makers = {"transactions": transaction_chunks, "invoices": invoice_chunks, "documents": mail_chunks}
    parts = [makers[kind](df) for kind, df in records.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("embedding", embedder(F.col("text")))
