"""Completeness, gate, decision, reasons and audit trail, at file grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import LOAD_THRESHOLD, REQUIRED_FIELDS
from ..functions.text import round_half_even, two_decimals
from .classify import CONTENT_TYPES

UNROUTED = "unclassified file type; needs a human to route it"


def completeness(present: Column, n_records: Column, kind: Column) -> Column:
    """Mean share of required fields; zero without records or for an unknown kind.

    Counted in integers, so the result does not depend on summation order.
    """
    required = F.lit(None).cast("int")
    for name, fields in REQUIRED_FIELDS.items():
        required = F.when(kind == name, len(fields)).otherwise(required)
    share = present / F.when(n_records > 0, required * n_records)
    return F.coalesce(round_half_even(share, 3), F.lit(0.0))


def gate(confidence: Column, complete: Column) -> Column:
    return round_half_even(confidence * complete, 3)


def verdict(score: Column) -> Column:
    return F.when(score >= LOAD_THRESHOLD, "LOAD").otherwise("REVIEW")


def decide(files: DataFrame, facts: DataFrame) -> DataFrame:
    """One decision per file.

    ``files`` has ``source_file, size_bytes, file_type``; ``facts`` comes from
    the branches.  Both have one row per file.
    """
    known = F.col("file_type").isin(*CONTENT_TYPES)
    none = F.array().cast("array<string>")
    complete = completeness(F.col("present"), F.col("n_records"), F.col("record_kind"))
    joined = (
        files.join(facts, "source_file", "left")
        .withColumn("completeness", F.when(known, complete))
        .withColumn("score", F.when(known, gate(F.coalesce("confidence", F.lit(0.0)), F.col("completeness"))).otherwise(0.0))
        .withColumn("action", F.when(known, verdict(F.col("score"))).otherwise("REVIEW"))
        .withColumns(
            {
                "n_records": F.coalesce("n_records", F.lit(0)),
                "n_findings": F.coalesce("n_findings", F.lit(0)),
                "n_issues": F.coalesce("n_issues", F.lit(0)),
                "pii_types": F.coalesce("pii_types", none),
                "fixes": F.coalesce("fixes", none),
                "plan_issues": F.coalesce("plan_issues", none),
                # Named once, since several lines of the audit trail tell it.
                "score_text": two_decimals(F.col("score")),
            }
        )
    )
    return joined.select(
        "source_file",
        "file_type",
        "record_kind",
        "method",
        "confidence",
        "completeness",
        "action",
        F.col("score").alias("quality_score"),
        (F.col("n_findings") > 0).alias("quarantine"),
        "n_records",
        F.when(F.col("action") == "LOAD", F.col("n_records")).otherwise(0).cast("int").alias("records_loaded"),
        "n_findings",
        "pii_types",
        "fixes",
        "n_issues",
        "plan_issues",
        _audit(known).alias("audit"),
    )


def _audit(known: Column) -> Column:
    score = F.col("score_text")
    types = F.when(
        F.size("pii_types") > 0, F.concat(F.lit(" ["), F.array_join("pii_types", ", "), F.lit("]"))
    ).otherwise("")
    head = F.array(
        F.concat(F.lit("ingest: "), F.col("source_file"), F.lit(" ("), F.col("size_bytes"), F.lit(" bytes)")),
        F.concat(F.lit("classify: "), F.col("file_type")),
    )
    middle = F.concat(
        F.coalesce("branch_audit", F.array().cast("array<string>")),
        F.array(
            F.concat(F.lit("pii_scan: "), F.col("n_findings"), F.lit(" finding(s)"), types),
            F.concat(F.lit("quality_gate: score="), score, F.lit(" -> "), F.col("action")),
        ),
    )
    tail = F.array(F.concat(F.lit("decide: "), F.col("action"), F.lit(" (score="), score, F.lit(")")))
    return F.when(known, F.concat(head, middle, tail)).otherwise(F.concat(head, tail))


def reasons(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Why each file was decided as it was, one row per reason.

    ``part, stage, pos`` give the order: repairs, unfixed issues, personal
    data.  Kept as rows, since one bad file can have an issue per record.
    """
    zero = F.lit(0).cast("bigint")
    unrouted = decisions.where(~F.col("file_type").isin(*CONTENT_TYPES)).select(
        "source_file", F.lit(0).alias("part"), F.lit(0).alias("stage"), zero.alias("pos"), F.lit(UNROUTED).alias("reason")
    )
    repairs = decisions.select("source_file", F.posexplode_outer("fixes").alias("pos", "reason")).where("reason IS NOT NULL").select(
        "source_file", F.lit(1).alias("part"), F.lit(0).alias("stage"), F.col("pos").cast("bigint").alias("pos"), "reason"
    )
    unfixed = issues.select(
        "source_file", F.lit(2).alias("part"), "stage", "pos", F.concat(F.lit("UNFIXED: "), F.col("issue")).alias("reason")
    )
    personal = decisions.where("quarantine").select(
        "source_file", F.lit(3).alias("part"), F.lit(0).alias("stage"), zero.alias("pos"),
        F.concat(
            F.lit("PII redacted before load ("), F.array_join("pii_types", ", "),
            F.lit("); original quarantined"),
        ).alias("reason"),
    )
    return reduce(DataFrame.unionByName, [unrouted, repairs, unfixed, personal])


def review_queue(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Files held for a person, with every reason (null where there is none).

    An inner join, since a file with a reason per record would otherwise be one
    task's work: Spark can split a hot key on either side of an inner join, but
    not on the right of an outer one.
    """
    held = decisions.where("action = 'REVIEW'")
    shown = ["source_file", "file_type", "quality_score"]
    explained = reasons(decisions, issues).join(held.select(*shown), "source_file")
    silent = held.where(
        F.col("file_type").isin(*CONTENT_TYPES)
        & (F.size("fixes") == 0)
        & (F.col("n_issues") == 0)
        & ~F.col("quarantine")
    )
    columns = [*shown, "part", "stage", "pos", "reason"]
    none = {"part": "int", "stage": "int", "pos": "bigint", "reason": "string"}
    return explained.select(*columns).unionByName(
        silent.select(*shown, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    )
