"""Mailbox exports: message split, header fields, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .redact import has_type_aggregates, raw_findings, redact_fields, type_list
from .repair import present_fields

# Message separator, head/body separator, header names.
MESSAGE_BREAK = r"(?md)^={3,}[\s\x1c-\x1f]*$"
BODY_BREAK = "\n---\n"
HEADERS = {"subject": "subject", "sender": "from", "date": "date"}
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_messages(texts: DataFrame) -> DataFrame:
    """``source_file, raw_text`` to one row per message: ``source_file, pos, block``."""
    pieces = texts.select(
        "source_file", F.posexplode_outer(F.split("raw_text", MESSAGE_BREAK)).alias("pos", "piece")
    )
    return keep_messages(pieces)


def keep_messages(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "source_file", F.col("pos").cast("bigint").alias("pos"), strip(F.col("piece")).alias("block")
    ).where("block != ''")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Subject, sender, date and body of each message; the block is kept for
    the raw scan and must be dropped before storing."""
    cut = F.locate(BODY_BREAK, F.col("block"))
    head = F.when(cut > 0, F.expr("substring(block, 1, cut - 1)")).otherwise(F.col("block"))
    body = F.when(cut > 0, F.expr(f"substring(block, cut + {len(BODY_BREAK)})")).otherwise(F.lit(""))
    parts = (
        messages.withColumn("cut", cut)
        .withColumns({"head": head, "body": strip(body)})
        .withColumn("lines", F.split("head", LINE_BREAK))
    )

    def header(name: str) -> Column:
        named = F.filter(
            "lines", lambda line: F.lower(strip(F.substring_index(line, ":", 1))) == name
        )
        last = F.get(named, F.size(named) - 1)
        value = F.when(last.contains(":"), F.regexp_replace(last, "(?s)^[^:]*:", "")).otherwise("")
        return F.coalesce(strip(value), F.lit(""))

    return parts.select(
        "source_file",
        "pos",
        *[header(label).alias(field) for field, label in HEADERS.items()],
        F.when(F.col("body") != "", F.col("body")).otherwise(F.col("head")).alias("body"),
        "block",
    )


def redact_messages(parsed: DataFrame) -> DataFrame:
    """Redacted messages with the findings of the raw block and of the fields.

    No detector can match across a separator line (none accepts ``=``), so the
    findings of the blocks together are those of the whole export.
    """
    scanned = redact_fields(parsed, ["subject", "sender", "date", "body"])
    return scanned.withColumn("raw_findings", raw_findings("block")).drop("block")


def mail_facts(records: DataFrame) -> DataFrame:
    """File-grain facts of redacted messages."""
    both = F.concat("raw_findings", "findings")
    grouped = records.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(present_fields("documents")).alias("present"),
        F.sum(F.size("raw_findings") + F.size("findings")).alias("n_findings"),
        *has_type_aggregates(both),
    )
    return finish_mail_facts(grouped.withColumn("pii_types", type_list()))


def empty_mail_facts(files: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return finish_mail_facts(
        files.select(
            "source_file",
            zero.alias("n_records"),
            zero.alias("present"),
            zero.alias("n_findings"),
            F.array().cast("array<string>").alias("pii_types"),
        )
    )


def finish_mail_facts(grouped: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return grouped.select(
        "source_file",
        F.lit("documents").alias("record_kind"),
        F.lit(1.0).alias("confidence"),
        F.lit("email_parser").alias("method"),
        "n_records",
        "present",
        "n_findings",
        "pii_types",
        none.alias("fixes"),
        F.lit(0).cast("bigint").alias("n_issues"),
        none.alias("plan_issues"),
        F.array(
            F.concat(F.lit("parse_email: "), F.col("n_records"), F.lit(" message(s)"))
        ).alias("branch_audit"),
    )
