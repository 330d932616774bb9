"""The whole batch job: folder in, tables, lineage, quarantine out."""

import json

import pytest
from fixtures import DRIFTED_CSV, INVOICE_TEXTS, MAILS, write_folder

from gristmill.plans.refine import refine
from gristmill.sinks.batch import run_batch
from gristmill.sinks.quarantine import findings_json, original
from gristmill.sinks.warehouse import Warehouse, lineage_rows


def texts(spark):
    return spark.createDataFrame(INVOICE_TEXTS, "source_file string, raw_text string")


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    write_folder(folder)
    return refine(spark, str(folder), texts=texts(spark))


@pytest.fixture(scope="module")
def warehouse(spark, result, tmp_path_factory):
    made = Warehouse(spark, str(tmp_path_factory.mktemp("wh")))
    made.restricted = str(tmp_path_factory.mktemp("restricted"))
    made.counts = run_batch(result, made, made.restricted).first().asDict()
    return made


def test_decisions(result):
    got = {r["source_file"]: r for r in result.decisions.collect()}
    expect = {
        "clean.csv": ("csv", "LOAD", 1.0), "drifted.csv": ("csv", "LOAD", 1.0), "a b+c%.csv": ("csv", "LOAD", 1.0),
        "bad.csv": ("csv", "REVIEW", 0.278), "header_only.csv": ("csv", "REVIEW", 0.0), "zero.csv": ("csv", "REVIEW", 0.0),
        "latin.csv": ("csv", "REVIEW", 0.0), "_hidden.csv": ("csv", "REVIEW", 0.0),
        "emails.txt": ("email", "LOAD", 1.0), "crlf.eml": ("email", "LOAD", 1.0),
        "notes.txt": ("unknown", "REVIEW", 0.0), "notes.docx": ("unknown", "REVIEW", 0.0),
        "invoice_001.pdf": ("pdf", "LOAD", 1.0), "invoice_002.pdf": ("pdf", "LOAD", 1.0),
        "invoice_003.pdf": ("pdf", "REVIEW", 0.4), "blank.pdf": ("pdf", "REVIEW", 0.0),
    }
    assert {n: (r["file_type"], r["action"], r["quality_score"]) for n, r in got.items()} == expect
    assert {n for n, r in got.items() if r["quarantine"]} == {"emails.txt", "crlf.eml", "invoice_002.pdf"}
    stages = [line.split(":")[0] for line in got["clean.csv"]["audit"]]
    assert stages == ["ingest", "classify", "profile", "fix", "pii_scan", "quality_gate", "decide"]
    assert got["notes.txt"]["audit"] == ["ingest: notes.txt (29 bytes)", "classify: unknown", "decide: REVIEW (score=0.00)"]


def test_mail_is_redacted_and_newlines_do_not_matter(result):
    rows = result.records["documents"].orderBy("source_file", "pos").collect()
    assert [r["body"] for r in rows[:2]] == [r["body"] for r in rows[2:]]
    assert "[REDACTED-PHONE]" in rows[0]["body"] and "HPW-31-01" in rows[0]["body"]
    assert {r["sender"] for r in rows} == {"[REDACTED-EMAIL]"}


def test_profiles(result):
    got = {r["source_file"]: r for r in result.profiles().collect()}
    assert got["bad.csv"]["row_count"] == 3 and got["bad.csv"]["null_rates"] == {"transaction_id": 0.0, "amount": 0.333}
    assert got["bad.csv"]["drift"]["unexpected_columns"] == ["transaction_id"]
    assert not got["clean.csv"]["drift"]["has_drift"]
    assert got["zero.csv"]["row_count"] == 0 and got["zero.csv"]["columns"] == [] and got["zero.csv"]["drift"]["has_drift"]


def test_reasons(result):
    got = {}
    for r in result.reasons().orderBy("source_file", "part", "stage", "pos").collect():
        got.setdefault(r["source_file"], []).append(r["reason"])
    assert got["notes.docx"] == ["unclassified file type; needs a human to route it"]
    assert got["zero.csv"] == ["UNFIXED: file contains no data rows"]
    assert got["emails.txt"] == ["PII redacted before load (email, emirates_id, phone); original quarantined"]
    assert "UNFIXED: unparseable number 'n/a' in column 'amount'" in got["bad.csv"]
    assert result.review_queue().select("source_file").distinct().count() == 9


def test_counts_and_tables(warehouse):
    assert warehouse.counts == {"transactions": 6, "invoices": 2, "documents": 4, "chunks": 9, "review": 9}
    for name, n in (("transactions", 6), ("invoices", 2), ("documents", 4), ("chunks", 9)):
        assert warehouse.table(name).count() == n
    assert warehouse.lineage_report().count() == 16


def test_lineage_row(warehouse):
    row = warehouse.lineage().where("source_file = 'bad.csv'").first()
    assert (row["decision"], row["records_loaded"], row["n_unfixed"], row["pii_types"]) == ("REVIEW", 0, 4, "")
    assert json.loads(row["unfixed"])[0] == "missing required column 'date' with no known default"
    assert len(json.loads(row["unfixed"])) == 4 and len(json.loads(row["fixes"])) == 3


def test_issue_lists_are_whole_whatever_their_length(spark, tmp_path):
    lines = "".join(f"T-{k},n/a\n" for k in range(12_000))
    (tmp_path / "many.csv").write_text("transaction_id,amount\n" + lines)
    done = refine(spark, str(tmp_path))
    row = lineage_rows(done.decisions, done.issues).first()
    listed = json.loads(row["unfixed"])
    assert row["n_unfixed"] == len(listed) == 12_002 and listed[-1] == "unparseable number 'n/a' in column 'amount'"


def test_documents_an_extractor_leaves_out_are_quarantined(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    given = spark.createDataFrame([("a.pdf", "ring 055-310-7729")], "source_file string, raw_text string")
    none = "source_file string, records array<struct<invoice_number:string,vendor:string,invoice_date:string,due_date:string,total_amount:double,currency:string>>, confidence double, method string"
    row = refine(spark, str(tmp_path), texts=given, extractor=lambda df: spark.createDataFrame([], none)).decisions.first()
    assert row["quarantine"] and row["action"] == "REVIEW" and row["n_findings"] == 1


def test_search_answers_and_sql(spark, warehouse):
    assert warehouse.search("what is open with Heron Paper Works", k=1).first()["source_file"] == "invoice_001.pdf"
    reply = warehouse.answer("what is the total of invoice HPW-31-01").first()
    assert "invoice_001.pdf" in reply["sources"] and "3915" in reply["answer"]
    warehouse.register_views()
    assert spark.sql("SELECT sum(amount) AS s FROM transactions WHERE source_file = 'drifted.csv'").first()["s"] == 1387.25


def test_quarantine(spark, warehouse):
    kept = spark.read.parquet(f"{warehouse.restricted}/originals")
    assert {r["source_file"] for r in kept.collect()} == {"emails.txt", "crlf.eml", "invoice_002.pdf"}
    for name, data in (("emails.txt", MAILS.encode()), ("crlf.eml", MAILS.replace("\n", "\r\n").encode())):
        lines = original(kept, name).collect()
        joined = b"\n".join(bytes(r["line"]) for r in lines)
        assert joined + b"\n" * (lines[0]["length"] - len(joined)) == data
    found = spark.read.parquet(f"{warehouse.restricted}/findings")
    reports = {r["source_file"]: json.loads(r["findings"]) for r in findings_json(found).collect()}
    assert reports["invoice_002.pdf"] == [{"type": "phone", "preview": "+971***"}]
    assert [f["type"] for f in reports["emails.txt"]] == [
        "emirates_id", "email", "email", "phone", "phone", "email", "phone", "email", "emirates_id", "phone",
    ]


def test_reload_replaces_and_review_removes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "t.csv").write_text(DRIFTED_CSV)
    (folder / "u.csv").write_text(DRIFTED_CSV)
    made = Warehouse(spark, str(tmp_path / "wh"))
    made.load(refine(spark, str(folder)))
    made.load(refine(spark, str(folder)))
    assert made.table("transactions").count() == 4 and made.table("chunks").count() == 2
    (folder / "u.csv").unlink()
    (folder / "t.csv").write_text(DRIFTED_CSV.replace("47.25", "n/a"))
    made.load(refine(spark, str(folder)))
    assert {r["source_file"] for r in made.table("transactions").collect()} == {"u.csv"}
    assert made.lineage().where("source_file = 't.csv'").count() == 3
    small = made.compact(str(tmp_path / "wh2"))
    assert small.table("transactions").count() == 2 and small._stored("transactions").count() == 2
    assert small.lineage().count() == 5


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        refine(spark, str(tmp_path / "none"))
    done = refine(spark, str(tmp_path))
    assert done.decisions.count() == 0 and done.findings.count() == 0
