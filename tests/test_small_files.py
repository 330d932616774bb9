"""Small files are listed into a table and opened by tasks: the driver holds none of their names."""

import pytest
from pyspark.sql import functions as F

from fixtures import INVOICE_TEXTS, write_folder
from gristmill.plans.refine import refine
from gristmill.sinks import quarantine as originals
from gristmill.sources import csv_feed, listing, mail_text
from gristmill.sources.listing import file_name, list_files, list_folder, text_lines

CONTENTS = [
    b"", b"\n", b"\r", b"\r\n\r\n", b"a", b"a\n", b"a\n\n", b"a\r\nb\rc\nd", b"a\r\r\nb\n\r", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", b"\xef\xbb\xbfa\nb",
    b"a\xef\xbb\xbfb\n", b"\x0b\x0c\x1c\x85\n\xe2\x80\xa8x", b"caf\xe9\n\x00\n", b" \n \r\n ",
]


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in +[a=1] b%"
    folder.mkdir()
    write_folder(folder)
    (folder / "bom.csv").write_bytes(b"\xef\xbb\xbftxn_id,date,amount,currency,merchant,category\r\nB-1,2026-06-02,1,AED,+971506642083,g\r\n")
    (folder / "blank.csv").write_bytes(b"\n \n\n")
    (folder / "open.csv").write_bytes(b'txn_id,date,"amount\nT-1,2026-06-02,1')
    (folder / "_a=b.txt").write_text("From: a@b.example\nSubject: s\n---\nhidden")
    (folder / "none.txt").write_bytes(b"")
    (folder / "latin.txt").write_bytes(b"From: caf\xe9@mail.example\r\nSubject: s\r\n---\r\ncall +971506642083")
    return folder


def outcome(spark, folder, target):
    texts = spark.createDataFrame(INVOICE_TEXTS, "source_file string, raw_text string")
    done = refine(spark, str(folder), texts=texts)
    originals.quarantine(spark, done, target)
    lines = spark.read.parquet(f"{target}/originals").orderBy("source_file", "block", "seq").select("source_file", "length", "line").collect()
    tables = [done.decisions, *(df.drop("plan_id") for df in done.records.values()), done.issues, done.findings]
    return [sorted(map(str, df.collect())) for df in tables], lines


def test_lines_are_those_of_sparks_reader(spark, tmp_path):
    for i, content in enumerate(CONTENTS):
        (tmp_path / f"f{i}").write_bytes(content)
    for options in ({}, {"lineSep": "\n"}):
        read = spark.read.text(str(tmp_path), **options).select(file_name().alias("f"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("v"))
        told = {}
        for r in read.orderBy("f", "i").collect():
            told.setdefault(r["f"], []).append(bytes(r["v"]))
        for i, content in enumerate(CONTENTS):
            assert text_lines(content, line_feeds=bool(options)) == told.get(f"f{i}", []), (content, options)


def test_same_rows_as_from_sparks_reader(spark, inbox, tmp_path, monkeypatch):
    own = outcome(spark, inbox, f"{tmp_path}/q0")
    monkeypatch.setattr(listing, "SMALL_BYTES", -1)
    assert not list_folder(spark, str(inbox)).n_small
    assert outcome(spark, inbox, f"{tmp_path}/q1") == own


def test_the_driver_holds_no_names(spark, inbox, tmp_path, monkeypatch):
    """Neither a list of the files nor Spark's index of them is made."""
    listed = {f.name: f.size for f in list_files(spark, str(inbox))}
    (inbox / "_a=b.txt").unlink()

    def held(*_, **__):
        raise AssertionError("files are listed on the driver")

    for module, name in ((listing, "list_files"), (csv_feed, "read_text"), (mail_text, "read_text"), (originals, "read_text"), (listing, "read_text")):
        monkeypatch.setattr(module, name, held)
    monkeypatch.setattr(listing, "LISTED", 3)
    found = list_folder(spark, str(inbox))
    assert {r["source_file"]: r["size_bytes"] for r in found.table.collect()} == {n: s for n, s in listed.items() if n != "_a=b.txt"}
    assert not found.named and found.n_small < sum(found.counts.values())
    (decisions, *_), lines = outcome(spark, inbox, f"{tmp_path}/q")
    assert len(decisions) == len(listed) - 1
    assert {r["source_file"] for r in lines} == {"bom.csv", "crlf.eml", "emails.txt", "latin.txt", "invoice_002.pdf"}


def test_every_small_file_is_dealt_to_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "TASK_BYTES", 10 * listing.OPEN_BYTES)
    for i in range(200):
        (tmp_path / f"f{i}.csv").write_text("x" * (i % 7))
    names = list_folder(spark, str(tmp_path)).only("csv").small_names()
    tasks = names.rdd.glom().map(len).collect()
    assert sum(tasks) == sum(i % 7 > 0 for i in range(200)) == names.distinct().count()
    assert 10 < len(tasks) < 30 and max(tasks) < 20
