"""Classification, personal data, mail and invoice extraction, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import scan
from ..operators.chunks import invoice_chunks, mail_chunks, transaction_chunks
from ..operators.classify import file_type, looks_like_mail
from ..operators.invoice import FIELDS, INVOICE_RECORD, extract, invoice_facts, invoice_records
from ..operators.mail import mail_facts, parse_messages, redact_messages, split_messages
from ..operators.quality import completeness, gate, verdict
from ..operators.redact import has_type_aggregates, redact_fields, type_list
from ..session import spread
from .feeds import invoice_texts, mail_texts, planted_customers, table
from .oracle_parts import INVOICES, MAILS, ORDER_ROWS
from .repair_queries import repaired_records


def mail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mail_texts(spark, sf_dir).select("source_file", "raw_text")
    return redact_messages(parse_messages(split_messages(texts)))


def extracted_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(invoice_texts(spark, sf_dir).select("source_file", "raw_text"))


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """concat('doc_', doc_id, CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.PDF' WHEN 2 THEN '.eml'
             WHEN 3 THEN '.Txt' WHEN 4 THEN '.txt.gz' ELSE '' END) AS name""",
        r"""CASE doc_id % 4 WHEN 0 THEN concat('From: a\nSubject: b\n', text) WHEN 1 THEN concat('From: a\n', text)
             WHEN 2 THEN concat(text, '\nFrom: a\nSubject: b') ELSE concat('from: a\nsubject: b\n', text) END AS body""",
    )
    return rows.select("doc_id", file_type(F.col("name"), looks_like_mail(F.col("body"))).alias("file_type"))


def split_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mail_texts(spark, sf_dir).select("source_file", "raw_text")
    parsed = parse_messages(split_messages(texts))
    return parsed.select("source_file", "pos", "subject", "sender", "date", "body")


def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_records(extracted_invoices(spark, sf_dir)).select("source_file", *FIELDS)


def invoice_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_invoices(spark, sf_dir).select(
        "source_file", "confidence", F.size("records").cast("bigint").alias("n_records"), "method"
    )


def invoice_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = completeness(F.col("present"), F.col("n_records"), F.col("record_kind"))
    return (
        invoice_facts(extracted_invoices(spark, sf_dir))
        .withColumn("completeness", complete)
        .withColumn("score", gate(F.col("confidence"), F.col("completeness")))
        .select("source_file", "confidence", "completeness", "score", verdict(F.col("score")).alias("action"))
    )


def pluggable_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction step with another extractor put in its place."""

    def last_line_total(texts: DataFrame) -> DataFrame:
        amount = F.regexp_extract("raw_text", r"Total: AED ([0-9,.]+)$", 1)
        record = F.struct(
            F.col("source_file").alias("invoice_number"),
            F.lit("desk").alias("vendor"),
            F.lit(None).cast("string").alias("invoice_date"),
            F.lit(None).cast("string").alias("due_date"),
            F.replace(amount, F.lit(","), F.lit("")).try_cast("double").alias("total_amount"),
            F.lit("AED").alias("currency"),
        ).cast(INVOICE_RECORD)
        return texts.select(
            "source_file", F.array(record).alias("records"), F.lit(0.95).alias("confidence"), F.lit("totals").alias("method")
        )

    texts = invoice_texts(spark, sf_dir).select("source_file", "raw_text")
    extracted = extract(texts, last_line_total)
    complete = completeness(F.col("present"), F.col("n_records"), F.col("record_kind"))
    return (
        invoice_facts(extracted)
        .withColumn("score", gate(F.col("confidence"), complete))
        .select("source_file", "method", "n_findings", "score", verdict(F.col("score")).alias("action"))
    )


def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail findings of every whole document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", F.filter(scan("text")["findings"], lambda f: f["type"] == "email").alias("f"))
    return found.select(
        "doc_id",
        F.size("f").cast("bigint").alias("n_emails"),
        F.array_join(F.col("f.preview"), ",").alias("previews"),
    )


def pii_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over all documents and conversation turns."""
    docs = table(spark, sf_dir, "documents").selectExpr("'documents' AS origin", "doc_id AS id", "0L AS part", "text")
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "'conversations' AS origin", "conv_id AS id", "turn AS part", "text"
    )
    scanned = spread(docs.unionByName(turns)).withColumn("s", scan("text"))
    return scanned.select(
        "origin",
        "id",
        "part",
        F.size("s.findings").cast("bigint").alias("n_findings"),
        F.array_join(F.col("s.findings.type"), ",").alias("types"),
        F.md5("s.redacted").alias("redacted_md5"),
    )


def pii_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector on notes whose contents are known."""
    notes = spread(planted_customers(spark, sf_dir).select("c_custkey", "note"))
    scanned = notes.withColumn("s", scan("note"))
    return scanned.select(
        "c_custkey",
        F.col("s.redacted").alias("redacted"),
        F.array_join(F.transform("s.findings", lambda f: F.concat(f["type"], F.lit(":"), f["preview"])), ",").alias("findings"),
    )


def redact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string field of a record; numbers stay as they are."""
    rows = spread(planted_customers(spark, sf_dir))
    redacted = redact_fields(rows)
    return redacted.select(
        "c_custkey", "c_mktsegment", "c_acctbal", "c_name", "note", "contact",
        F.size("findings").cast("bigint").alias("n_findings"),
    )


def _types_by(df: DataFrame, key: str) -> DataFrame:
    """Distinct sorted types, finding count and quarantine flag per group."""
    return (
        df.groupBy(key)
        .agg(F.sum(F.size("findings")).alias("n_findings"), *has_type_aggregates(F.col("findings")))
        .select(
            key, "n_findings", F.array_join(type_list(), ",").alias("pii_types"), (F.col("n_findings") > 0).alias("quarantine")
        )
    )


def pii_types_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(planted_customers(spark, sf_dir).select("c_mktsegment", "note"))
    return _types_by(rows.select("c_mktsegment", scan("note")["findings"].alias("findings")), "c_mktsegment")


def pii_types_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return _types_by(docs.select("source", scan("text")["findings"].alias("findings")), "source")


def mail_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages after redaction; exports are scanned raw and by record."""
    return mail_messages(spark, sf_dir).select(
        "source_file", "pos", "subject", "sender", "date", "body",
        (F.size("raw_findings") + F.size("findings")).cast("bigint").alias("n_findings"),
    )


def mail_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_facts(mail_messages(spark, sf_dir)).select(
        "source_file", "record_kind", "confidence", "method", "n_records", "n_findings",
        F.array_join("pii_types", ",").alias("pii_types"),
    )


def chunk_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = invoice_records(extracted_invoices(spark, sf_dir))
    return invoice_chunks(records).select("source_file", "kind", "text")


def chunk_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_chunks(mail_messages(spark, sf_dir)).select("source_file", "kind", "chunk_ord", "text")


def chunk_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_chunks(repaired_records(spark, sf_dir)).select("source_file", "kind", "text")


QUERIES = {
    "classify_files": classify_files,
    "split_mail": split_mail,
    "mail_redaction": mail_redaction,
    "mail_file_facts": mail_file_facts,
    "invoice_fields": invoice_fields,
    "invoice_confidence": invoice_confidence,
    "invoice_gate": invoice_gate,
    "pluggable_extractor": pluggable_extractor,
    "pii_email": pii_email,
    "pii_all_documents": pii_all_documents,
    "pii_planted": pii_planted,
    "redact_records": redact_records,
    "pii_types_by_segment": pii_types_by_segment,
    "pii_types_by_source": pii_types_by_source,
    "chunk_invoices": chunk_invoices,
    "chunk_mail": chunk_mail,
    "chunk_transactions": chunk_transactions,
}

NOTE = """'Client ' || c_name || ' ref INV-2026-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' ' ||
  CASE c_custkey % 8 WHEN 0 THEN 'id [REDACTED-EMIRATES_ID]' WHEN 1 THEN 'id [REDACTED-EMIRATES_ID]'
    WHEN 2 THEN 'iban [REDACTED-IBAN]' WHEN 3 THEN 'mail [REDACTED-EMAIL] and [REDACTED-EMAIL]'
    WHEN 4 THEN 'call [REDACTED-PHONE]' WHEN 5 THEN 'call [REDACTED-PHONE]'
    WHEN 6 THEN 'call [REDACTED-PHONE] or [REDACTED-PHONE]' ELSE 'dated 2026-08-01 for AED 4,520.00' END"""
N_FOUND = "CASE c_custkey % 8 WHEN 3 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 0 ELSE 1 END"

ORACLES = {
    "classify_files": """
        WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'From: a' || chr(10) || 'Subject: b' || chr(10) || text
            WHEN 1 THEN 'From: a' || chr(10) || text
            WHEN 2 THEN text || chr(10) || 'From: a' || chr(10) || 'Subject: b'
            ELSE 'from: a' || chr(10) || 'subject: b' || chr(10) || text END[1:2000] AS head FROM documents)
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown'
            ELSE CASE WHEN contains(head, 'From:') AND contains(head, 'Subject:') THEN 'email' ELSE 'unknown' END END AS file_type
        FROM t""",
    "split_mail": f"""
        WITH {MAILS}
        SELECT source_file, CAST(0 AS BIGINT) AS pos, subject, role || '.' || conv_id || '@mail.example' AS sender, date, body FROM m
        UNION ALL SELECT source_file, pos, subject, sender, date, body FROM messages WHERE pos = 1""",
    "mail_redaction": f"""
        WITH {MAILS}
        SELECT source_file, CAST(pos AS BIGINT) AS pos, subject, sender, date, body,
               CAST(CASE pos WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS n_findings FROM messages""",
    "mail_file_facts": f"""
        WITH {MAILS}
        SELECT source_file, 'documents' AS record_kind, CAST(1.0 AS DOUBLE) AS confidence, 'email_parser' AS method,
               CAST(2 AS BIGINT) AS n_records, CAST(2 AS BIGINT) AS n_findings, 'email' AS pii_types FROM m""",
    "invoice_fields": f"""
        WITH {INVOICES}
        SELECT source_file, invoice_number, vendor, invoice_date, due_date, total_amount, currency FROM i WHERE numbered""",
    "invoice_confidence": f"""
        WITH {INVOICES}
        SELECT source_file, CAST(confidence AS DOUBLE) AS confidence, CAST(numbered AS BIGINT) AS n_records, 'regex' AS method FROM i""",
    "invoice_gate": f"""
        WITH {INVOICES}
        SELECT source_file, CAST(confidence AS DOUBLE) AS confidence, CAST(completeness AS DOUBLE) AS completeness,
               CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END AS action FROM i""",
    "pluggable_extractor": f"""
        WITH {INVOICES}
        SELECT source_file, 'totals' AS method, CAST(has_phone AS BIGINT) AS n_findings,
               CAST(CASE WHEN k % 5 = 3 THEN round_even(0.95 * 0.667, 3) ELSE 0.95 END AS DOUBLE) AS score,
               CASE WHEN k % 5 = 3 THEN 'REVIEW' ELSE 'LOAD' END AS action
        FROM i""",
    "pii_email": r"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '784[-\s]?\d{4}[-\s]?\d{7}[-\s]?\d', '[REDACTED-EMIRATES_ID]', 'g'),
                '\b[A-Z]{2}\d{2}[A-Z0-9]{11,28}\b', '[REDACTED-IBAN]', 'g') AS text FROM documents),
        f AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS found FROM t)
        SELECT doc_id, CAST(len(found) AS BIGINT) AS n_emails,
               array_to_string(list_transform(found, lambda m: m[1:4] || '***'), ',') AS previews
        FROM f""",
    "pii_planted": f"""
        SELECT c_custkey, {NOTE} AS redacted,
               CASE c_custkey % 8 WHEN 0 THEN 'emirates_id:784-***' WHEN 1 THEN 'emirates_id:7841***' WHEN 2 THEN 'iban:AE07***'
                 WHEN 3 THEN 'email:' || ('c.' || c_custkey || '@shop')[1:4] || '***,email:x@y.***'
                 WHEN 4 THEN 'phone:+971***' WHEN 5 THEN 'phone:0501***' WHEN 6 THEN 'phone:(04)***,phone:+971***' ELSE '' END AS findings
        FROM customer""",
    "redact_records": f"""
        SELECT c_custkey, c_mktsegment, c_acctbal, c_name, {NOTE} AS note, '[REDACTED-EMAIL]' AS contact,
               CAST({N_FOUND} + 1 AS BIGINT) AS n_findings FROM customer""",
    "pii_types_by_segment": f"""
        SELECT c_mktsegment, CAST(sum({N_FOUND}) AS BIGINT) AS n_findings,
               concat_ws(',', CASE WHEN bool_or(c_custkey % 8 = 3) THEN 'email' END,
                 CASE WHEN bool_or(c_custkey % 8 IN (0, 1)) THEN 'emirates_id' END, CASE WHEN bool_or(c_custkey % 8 = 2) THEN 'iban' END,
                 CASE WHEN bool_or(c_custkey % 8 IN (4, 5, 6)) THEN 'phone' END) AS pii_types,
               sum({N_FOUND}) > 0 AS quarantine
        FROM customer GROUP BY ALL""",
    "chunk_invoices": f"""
        WITH {INVOICES}
        SELECT source_file, 'invoices' AS kind,
               'Invoice ' || invoice_number || ' from ' || vendor || ': total ' || coalesce(CAST(total_amount AS VARCHAR), 'None') || ' AED, invoice date '
               || coalesce(invoice_date, 'None') || ', due date ' || coalesce(due_date, 'None') || '.' AS text
        FROM i WHERE numbered""",
    "chunk_mail": f"""
        WITH {MAILS}
        SELECT source_file, 'documents' AS kind, CAST(pos AS BIGINT) AS chunk_ord,
               'Email from ' || sender || ' on ' || date || ', subject ''' || subject || ''': ' || body AS text
        FROM messages""",
    "chunk_transactions": f"""
        WITH {ORDER_ROWS}
        SELECT source_file, 'transactions' AS kind,
               'Transactions file ' || source_file || ': ' || count(*) || ' rows from ' || min(date) || ' to ' || max(date) || ', total '
               || printf('%.2f', sum(coalesce(amount, 0))) || ', merchants ' || string_agg(DISTINCT merchant, ', ' ORDER BY merchant)
               || ', categories ' || string_agg(DISTINCT category, ', ' ORDER BY category) || '.' AS text
        FROM records GROUP BY source_file""",
}
