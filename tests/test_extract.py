"""Mailbox messages, invoice fields, gate arithmetic."""

import pytest
from fixtures import FULL_INVOICE, PARTIAL_INVOICE
from pyspark.sql import functions as F

from gristmill.operators.invoice import extract, invoice_facts, invoice_records
from gristmill.operators.mail import parse_messages, split_messages
from gristmill.operators.quality import completeness, gate, verdict


def messages(spark, text):
    df = spark.createDataFrame([("m.txt", text)], "source_file string, raw_text string")
    return parse_messages(split_messages(df)).orderBy("pos").collect()


def test_messages(spark):
    first, second = messages(
        spark,
        "From: a@b.ae\nSubject: Hello\nDate: 2026-07-10\n---\nBody one\n=====\n"
        "From: c@d.ae\nSubject: Second\nDate: 2026-07-12\n---\nBody two",
    )
    assert (first["sender"], first["subject"], first["date"], first["body"]) == ("a@b.ae", "Hello", "2026-07-10", "Body one")
    assert (second["sender"], second["body"]) == ("c@d.ae", "Body two")


def test_message_details(spark):
    got = messages(
        spark,
        "===\n\n  FROM : x: y \nfrom\nSubject:a\nsubject: b\nOther: z\n---\n\n line\n---\nmore\n=======   \n\n"
        "no header here\n==\nstill\n====\n   \n====\nFrom: q\n---\n   ",
    )
    assert [(m["sender"], m["subject"], m["body"]) for m in got] == [
        ("", "b", "line\n---\nmore"),
        ("", "", "no header here\n==\nstill"),
        ("q", "", "From: q\n---"),
    ]


def invoices(spark, *texts, extractor=None):
    rows = [(f"i{n}.pdf", t) for n, t in enumerate(texts)]
    return extract(spark.createDataFrame(rows, "source_file string, raw_text string"), extractor)


def first_invoice(spark, text):
    extracted = invoices(spark, text)
    return invoice_records(extracted).collect(), invoice_facts(extracted).first()


def test_full_invoice(spark):
    (r,), f = first_invoice(spark, FULL_INVOICE)
    assert (r["invoice_number"], r["vendor"], r["total_amount"], r["currency"]) == ("HPW-31-01", "Heron Paper Works", 3915.0, "AED")
    assert (r["invoice_date"], r["due_date"], f["confidence"]) == ("2026-07-01", "2026-08-01", 1.0)


def test_partial_invoice(spark):
    (r,), f = first_invoice(spark, PARTIAL_INVOICE)
    assert r["total_amount"] is None and r["due_date"] is None and f["confidence"] == 0.6


@pytest.mark.parametrize("text", ["just some text", ""])
def test_no_invoice_number(spark, text):
    records, f = first_invoice(spark, text)
    assert records == [] and (f["confidence"], f["method"], f["n_records"]) == (0.0, "regex", 0)


def test_invoice_details(spark):
    (r,), f = first_invoice(
        spark, "Invoice Number: 7\nVendor:\n  Next Line \nInvoice Date: 1 Jul 2026\nDue Date: 2026/8/1\nGrand Total: USD 1.200,5\nSubtotal: AED 9"
    )
    assert (r["vendor"], r["invoice_date"], r["due_date"]) == ("Next Line", "1", "2026-08-01")
    assert (r["currency"], r["total_amount"], f["confidence"]) == ("USD", 1.2005, 1.0)
    (r,), f = first_invoice(spark, "Invoice Number: A\nSubtotal: AED 5\nTotal: AED ,,")
    assert (r["vendor"], r["total_amount"], f["confidence"]) == ("UNKNOWN", None, 0.6)


def test_invoice_redaction_counts_text_and_record(spark):
    text = FULL_INVOICE.replace("Heron Paper Works", "Gulf 055-310-7729")
    (r,), f = first_invoice(spark, text)
    assert r["vendor"] == "Gulf [REDACTED-PHONE]" and f["n_findings"] == 2 and f["pii_types"] == ["phone"]


def test_own_extractor(spark):
    def python_rows(texts):
        def rows(batches):
            for batch in batches:
                for name in batch["source_file"]:
                    record = {"invoice_number": name, "vendor": "v", "invoice_date": None, "due_date": None, "total_amount": 1.0, "currency": "AED"}
                    yield __import__("pandas").DataFrame({"source_file": [name], "records": [[record, record]], "confidence": [0.95], "method": ["own"]})

        schema = (
            "source_file string, records array<struct<invoice_number:string,vendor:string,invoice_date:string,"
            "due_date:string,total_amount:double,currency:string>>, confidence double, method string"
        )
        return texts.mapInPandas(rows, schema)

    extracted = invoices(spark, "a", "b", extractor=python_rows)
    assert invoice_records(extracted).count() == 4
    f = invoice_facts(extracted).orderBy("source_file").first()
    assert (f["method"], f["confidence"], f["n_records"], f["present"]) == ("own", 0.95, 2, 6)
    assert f["branch_audit"][1] == "extract_records: 2 record(s) via own, confidence=0.95"


def test_completeness_and_gate(spark):
    rows = spark.createDataFrame(
        [(5, 2, "invoices", 1.0), (0, 0, "invoices", 1.0), (3, 1, "mystery", 1.0), (3, 1, "invoices", 0.6), (9, 4, "transactions", 1.0), (1, 1, "documents", 0.75)],
        "present bigint, n bigint, kind string, conf double",
    )
    done = rows.withColumn("c", completeness(F.col("present"), F.col("n"), F.col("kind"))).withColumn("s", gate(F.col("conf"), F.col("c")))
    got = [(r["c"], r["s"], r["v"]) for r in done.withColumn("v", verdict(F.col("s"))).collect()]
    assert got == [
        (0.833, 0.833, "LOAD"), (0.0, 0.0, "REVIEW"), (0.0, 0.0, "REVIEW"), (1.0, 0.6, "REVIEW"), (0.75, 0.75, "LOAD"), (1.0, 0.75, "LOAD"),
    ]
