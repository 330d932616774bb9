"""Invoice extraction from document text, with a replaceable extractor.

An extractor is any ``DataFrame -> DataFrame`` function: it receives
``source_file, raw_text`` (unredacted) and returns one row per file with
``source_file, records array<invoice>, confidence double, method string``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import INVOICE_RECORD
from ..functions.coerce import coerce_date, coerce_number
from ..functions.text import round_half_even, strip_column, two_decimals, unicode_regex
from .redact import raw_findings, redact_structs
from .repair import present_fields

Extractor = Callable[[DataFrame], DataFrame]

# The labelled fields; the first match counts.
LABELS = {
    "invoice_number": r"Invoice Number:\s*(\S+)",
    "vendor": r"Vendor:\s*(.+)",
    "invoice_date": r"Invoice Date:\s*([\d/\-]+)",
    "due_date": r"Due Date:\s*([\d/\-]+)",
}
TOTAL = r"Total:\s*([A-Z]{3})\s*([\d,\.]+)"
UNKNOWN_VENDOR = "UNKNOWN"
DEFAULT_CURRENCY = "AED"

FIELDS = [f.name for f in INVOICE_RECORD.fields]
RECORDS = f"array<{INVOICE_RECORD.simpleString()}>"
FIELD_TEXTS = ["invoice_number", "vendor", "invoice_date", "due_date", "currency"]


def _first(pattern: str, group: int) -> Column:
    # Every capture needs at least one character, so "" can only mean no match.
    found = F.regexp_extract("raw_text", "(?d)" + unicode_regex(pattern), group)
    return F.nullif(found, F.lit(""))


def _label_columns() -> dict[str, Column]:
    found = {name: _first(p, 1) for name, p in LABELS.items()}
    found["total_currency"], found["total_digits"] = _first(TOTAL, 1), _first(TOTAL, 2)
    return found


def label_extractor(texts: DataFrame) -> DataFrame:
    """The built-in extractor: labelled fields, confidence by what was found.

    Only adds columns, so it costs no shuffle and keeps the others.
    """
    others = [c for c in texts.columns if c != "raw_text"]
    found = texts.select(*others, *[c.alias(n) for n, c in _label_columns().items()])
    found = found.withColumns({name: strip_column(F.col(name)) for name in LABELS})
    hits = (
        F.col("invoice_number").isNotNull().cast("int")
        + F.col("vendor").isNotNull().cast("int")
        + F.col("invoice_date").isNotNull().cast("int")
        + F.col("total_currency").isNotNull().cast("int") * 2
    )
    record = F.struct(
        F.col("invoice_number"),
        F.coalesce("vendor", F.lit(UNKNOWN_VENDOR)).alias("vendor"),
        *[
            F.coalesce(coerce_date(F.col(c)), F.col(c)).alias(c)
            for c in ("invoice_date", "due_date")
        ],
        coerce_number(F.col("total_digits")).alias("total_amount"),
        F.coalesce("total_currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
    )
    numbered = F.col("invoice_number").isNotNull()
    return found.select(
        *others,
        F.when(numbered, F.array(record)).otherwise(F.array().cast(RECORDS)).alias("records"),
        F.when(numbered, round_half_even(hits / 5.0, 3)).otherwise(0.0).alias("confidence"),
        F.lit("regex").alias("method"),
    )


def extract(texts: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """One row per document with redacted records; the text is not carried on.

    ``source_file, n_chars, raw_findings, records, confidence, method``, where
    each record ends with its own ``findings``.  A caller's extractor sees raw
    text and its result is joined back by file; the built-in one needs no join.
    """
    facts = texts.select(
        "source_file",
        "raw_text",
        F.coalesce(F.length("raw_text"), F.lit(0)).alias("n_chars"),
        raw_findings("raw_text").alias("raw_findings"),
    )
    if extractor is None:
        result = label_extractor(facts)
    else:
        found = extractor(texts.select("source_file", "raw_text")).select(
            "source_file", F.col("records").cast(RECORDS), "confidence", "method"
        )
        # A document the extractor leaves out keeps its findings and has no records.
        result = facts.drop("raw_text").join(found, "source_file", "left").withColumns(
            {
                "records": F.coalesce("records", F.array().cast(RECORDS)),
                "confidence": F.coalesce("confidence", F.lit(0.0)),
                "method": F.coalesce("method", F.lit("none")),
            }
        )
    return result.withColumn("records", redact_structs("records", FIELDS, FIELD_TEXTS))


def invoice_records(extracted: DataFrame) -> DataFrame:
    """Redacted invoices: ``source_file, pos, <fields>, findings``."""
    # The outer form, since the inner one adds a filter that repeats the whole
    # extraction below the generator.
    return (
        extracted.select("source_file", F.posexplode_outer("records").alias("pos", "record"))
        .where("record IS NOT NULL")
        .select("source_file", F.col("pos").cast("bigint").alias("pos"), "record.*")
    )


def invoice_facts(extracted: DataFrame) -> DataFrame:
    """File-grain facts; a document is one row, so nothing is grouped."""
    none = F.array().cast("array<string>")
    all_findings = F.concat("raw_findings", F.flatten(F.col("records.findings")))
    present = F.aggregate(
        "records",
        F.lit(0).cast("bigint"),
        lambda total, r: total + present_fields("invoices", get=lambda name: r[name]),
    )
    n_records = F.size("records").cast("bigint")
    types = F.array_sort(F.array_distinct(F.col("all_findings.type")))
    return extracted.withColumn("all_findings", all_findings).select(
        "source_file",
        F.lit("invoices").alias("record_kind"),
        "confidence",
        "method",
        n_records.alias("n_records"),
        present.alias("present"),
        F.size("all_findings").cast("bigint").alias("n_findings"),
        types.alias("pii_types"),
        none.alias("fixes"),
        F.lit(0).cast("bigint").alias("n_issues"),
        none.alias("plan_issues"),
        F.array(
            F.format_string("extract_pdf: %d chars of text", F.col("n_chars")),
            F.concat(
                F.lit("extract_records: "), n_records, F.lit(" record(s) via "), F.col("method"),
                F.lit(", confidence="), two_decimals(F.col("confidence")),
            ),
        ).alias("branch_audit"),
    )
