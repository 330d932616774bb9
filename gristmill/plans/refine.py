"""The batch job: a folder of mixed files in, records and decisions out.

Every branch handles all of its files in one plan.  Row-level work (parse,
repair, extract, redact) runs once and is staged as a columnar table in the
shared scratch folder; decisions, logs, findings, chunks and tables are lazy
plans over that table.  Nothing unredacted is staged and nothing is loaded
here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TRANSACTIONS, Contract
from ..functions.vectors import hash_embed
from ..operators import chunks as chunking
from ..operators import quality
from ..operators.classify import file_type, looks_like_mail
from ..operators.invoice import Extractor, extract, invoice_facts, invoice_records
from ..operators.mail import mail_facts, parse_messages, redact_messages, split_messages
from ..operators.profile import drift, profile
from ..operators.repair import (
    Feeds,
    deduplicate,
    empty_feed_facts,
    feed_facts,
    header_issues,
    plan_table,
    repair_and_redact,
    row_issues,
)
from ..session import local_frame, stage
from ..sources.csv_feed import CsvSource, read_feeds
from ..sources.listing import Listing, hidden, list_folder, split_size
from ..sources.mail_text import large_messages, oversize_exports, read_texts, sniff_head

UNREADABLE = "file name starts with an underscore and cannot be read"
INVALID = "file is not valid UTF-8 text"
OVERSIZE = "file holds a record too long to be one value"

FACTS = (
    "source_file string, record_kind string, confidence double, method string, n_records bigint,"
    " present bigint, n_findings bigint, pii_types array<string>, fixes array<string>,"
    " n_issues bigint, plan_issues array<string>, branch_audit array<string>"
)
ISSUES = "source_file string, stage int, pos bigint, issue string"
FINDINGS = "source_file string, part int, rank int, pos bigint, ord int, type string, preview string"


@dataclass
class Branch:
    """What one content path yields."""

    facts: DataFrame
    records: DataFrame | None = None
    issues: list[DataFrame] = field(default_factory=list)
    findings: list[DataFrame] = field(default_factory=list)
    feeds: Feeds | None = None


@dataclass
class RefineResult:
    """Outcome of one batch, as lazy DataFrames over staged tables."""

    files: Listing
    decisions: DataFrame
    records: dict[str, DataFrame]
    issues: DataFrame
    findings: DataFrame
    feeds: Feeds | None
    contract: Contract

    def profiles(self) -> DataFrame:
        """Row count, columns, null rates and drift of every delimited file; read
        from the files when asked for, as nothing else needs the rates."""
        listed = self.decisions.where("file_type = 'csv'").select("source_file")
        empty = "source_file string, row_count bigint, columns array<string>, null_rates map<string,double>"
        measured = profile(self.feeds) if self.feeds else self.decisions.sparkSession.createDataFrame([], empty)
        found = listed.join(measured, "source_file", "left")
        return found.select(
            "source_file",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
            F.coalesce("null_rates", F.create_map().cast("map<string,double>")).alias("null_rates"),
        ).withColumn("drift", drift(F.col("columns"), self.contract))

    def reasons(self) -> DataFrame:
        return quality.reasons(self.decisions, self.issues)

    def review_queue(self) -> DataFrame:
        return quality.review_queue(self.decisions, self.issues)

    def loaded(self) -> dict[str, DataFrame]:
        """Records of the files that passed the gate."""
        passed = self.decisions.where("action = 'LOAD'").select("source_file")
        return {k: df.join(passed, "source_file", "left_semi") for k, df in self.records.items()}

    def chunks(self, embedder=hash_embed) -> DataFrame:
        return chunking.chunks(self.loaded(), embedder)

    def report(self) -> DataFrame:
        """One row per file, as an operator would read it."""
        return self.decisions.select(
            "source_file", "file_type", "action", "quality_score", "quarantine", "records_loaded"
        )


def refine(
    spark: SparkSession,
    folder: str,
    contract: Contract = TRANSACTIONS,
    texts: DataFrame | None = None,
    extractor: Extractor | None = None,
) -> RefineResult:
    """Process every file of ``folder``.

    ``texts`` (``source_file, raw_text``) carries the text of documents whose
    format is decoded elsewhere; a document without text goes to review.
    """
    files = list_folder(spark, folder)
    listing = files.table

    csv_branch = _csv_branch(spark, files.only("csv"), contract)
    mail_branch = _mail_branch(spark, files.only("eml", "txt"))
    pdf_branch = _pdf_branch(spark, listing, texts, extractor)
    branches = [csv_branch, mail_branch, pdf_branch]

    facts = reduce(DataFrame.unionByName, [b.facts for b in branches])
    # A mailbox export holds at least the message its marks were found in, so
    # the files with mail facts are exactly the ones sniffed as mail.
    mails = mail_branch.facts.select("source_file", F.lit(True).alias("mail"))
    typed = listing.join(mails, "source_file", "left").select(
        "source_file",
        "size_bytes",
        file_type(F.col("source_file"), F.coalesce("mail", F.lit(False))).alias("file_type"),
    )
    decisions = stage(quality.decide(typed, facts), "decisions")
    issues = [header_issues(decisions), *(i for b in branches for i in b.issues)]
    findings = [spark.createDataFrame([], FINDINGS), *(f for b in branches for f in b.findings)]
    kinds = (contract.kind, "documents", "invoices")
    return RefineResult(
        files=files,
        decisions=decisions,
        records={k: b.records for k, b in zip(kinds, branches) if b.records is not None},
        issues=reduce(DataFrame.unionByName, issues),
        findings=reduce(DataFrame.unionByName, findings),
        feeds=csv_branch.feeds,
        contract=contract,
    )


def _csv_branch(spark: SparkSession, files: Listing, contract: Contract) -> Branch:
    if not files.counts:
        return Branch(spark.createDataFrame([], FACTS))
    source = read_feeds(spark, files)
    rejected = _rejected_facts(spark, source, contract)
    others = files.table.join(rejected, "source_file", "left_anti")
    if not source.feeds:
        return Branch(rejected.unionByName(empty_feed_facts(others, contract)))
    plans = plan_table(spark, source.feeds.headers, contract)
    rows = stage(repair_and_redact(source.feeds, contract, plans), "feed-rows")
    # Issues name every bad row, so they come from all rows; the rest reads what is left.
    records = stage(deduplicate(rows, contract), "feed-records")
    facts = feed_facts(records, plans, contract)
    empty = others.join(facts.select("source_file"), "source_file", "left_anti")
    return Branch(
        reduce(DataFrame.unionByName, [facts, rejected, empty_feed_facts(empty, contract)]),
        records,
        [row_issues(rows, contract)],
        [explode_findings(records, "findings", 1)],
        source.feeds,
    )


def _rejected_facts(spark: SparkSession, source: CsvSource, contract: Contract) -> DataFrame:
    """Files that cannot be parsed: no records, zero confidence, a stated issue."""
    named = {n: OVERSIZE for n in source.oversize}
    named |= {n: INVALID for n in source.invalid} | {n: UNREADABLE for n in source.unreadable}
    return _rejected(spark, named, contract.kind, "csv", "profile")


def _rejected(spark: SparkSession, named: dict[str, str], kind: str, method: str, step: str) -> DataFrame:
    rows = [
        (n, kind, 0.0, method, 0, 0, 0, [], [], 1, [why], [f"{step}: not read ({why})"])
        for n, why in named.items()
    ]
    return local_frame(spark, rows, FACTS)


def _mail_branch(spark: SparkSession, files: Listing) -> Branch:
    limit = split_size(spark)
    named = [f for f in files.named if not hidden(f) and f.size]
    large = [f for f in named if f.size > limit and sniff_head(spark, f)]
    oversize = oversize_exports(spark, large) if large else []
    large = [f for f in large if f.name not in oversize]
    rejected = _rejected(spark, {n: OVERSIZE for n in oversize}, "documents", "email_parser", "parse_email")
    parts = []
    texts = read_texts(spark, files, [f for f in named if f.size <= limit])
    if texts is not None:
        parts.append(split_messages(texts.where(looks_like_mail(F.col("raw_text")))))
    if large:
        parts.append(large_messages(spark, large))
    if not parts:
        return Branch(rejected)
    messages = reduce(DataFrame.unionByName, parts)
    records = stage(redact_messages(parse_messages(messages)), "messages")
    return Branch(
        mail_facts(records).unionByName(rejected),
        records.drop("raw_findings"),
        [],
        [explode_findings(records, "raw_findings", 0), explode_findings(records, "findings", 1)],
    )


def _pdf_branch(
    spark: SparkSession, listing: DataFrame, texts: DataFrame | None, extractor: Extractor | None
) -> Branch:
    documents = listing.where(file_type(F.col("source_file"), F.lit(False)) == "pdf").select("source_file")
    if texts is None:
        with_text = documents.withColumn("raw_text", F.lit(""))
    else:
        with_text = documents.join(texts, "source_file", "left").select(
            "source_file", F.coalesce("raw_text", F.lit("")).alias("raw_text")
        )
    extracted = stage(extract(with_text, extractor), "invoices")
    records = invoice_records(extracted)
    raw = extracted.withColumn("pos", F.lit(0).cast("bigint"))
    return Branch(
        invoice_facts(extracted),
        records,
        [],
        [explode_findings(raw, "raw_findings", 0), explode_findings(records, "findings", 1)],
    )


def explode_findings(df: DataFrame, column: str, part: int) -> DataFrame:
    """One row per finding; ``part, rank, pos, ord`` give the order within a file.

    Raw texts (part 0) are scanned whole, detector by detector, whatever pieces
    they were cut into; fields (part 1) record by record.
    """
    flat = df.select("source_file", F.lit(part).alias("part"), "pos", F.posexplode_outer(column).alias("ord", "f"))
    rank = F.col("f.detector") if part == 0 else F.lit(0)
    return flat.where("f IS NOT NULL").select(
        "source_file", "part", rank.alias("rank"), "pos", "ord", "f.type", "f.preview"
    )
